"""Attention queries: exact, causal, tiled, sparse, dense fallback; sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import attention as A

from .registry import DIM, query, table, tokens
from .retrieval import SCORED, selected

SCALE = 1 / DIM**0.5


def _kv(spark: SparkSession, sf_dir: str, one_head: bool = False) -> DataFrame:
    return tokens(spark, sf_dir, one_head).withColumn("value", F.col("key"))


def _queries(kv: DataFrame) -> DataFrame:
    """Each head's first token as its query."""
    return kv.groupBy("head").agg(F.min_by("key", "token_pos").alias("query"))


def _rows(out: DataFrame, *by: str) -> DataFrame:
    return out.select(*by, F.posexplode("out").alias("pos", "value")).select(*by, (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"))




def _sql(scored: str, by: str) -> str:
    weighted = f"select {by}, key, exp(z - max(z) over (partition by {by})) as w from ({scored})"
    return f"select {by}, pos::int as pos, round(sum(w * v) / sum(w), 6) as value from (select {by}, w, unnest(key)::double as v, generate_subscripts(key, 1) as pos from ({weighted})) group by {by}, pos"


EXACT = "select e.label as head, e.vec_id as token_pos, e.embedding as key, list_dot_product(q.embedding::double[], e.embedding::double[]) * 0.125::double as z from embeddings e join (select label, arg_min(embedding, vec_id) as embedding from embeddings group by label) q on q.label = e.label"


@query(_sql(EXACT, "head"))
def attention_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _kv(spark, sf_dir)
    return _rows(A.attend(kv, _queries(kv), DIM, SCALE), "head")


@query(_sql(EXACT, "head"))
def attention_tiled_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 16 places with merged log-sum-exp states; the SQL is that of one shot."""
    kv = _kv(spark, sf_dir)
    return _rows(A.attend_tiled(kv, _queries(kv), DIM, SCALE, F.floor(F.col("token_pos") / 16)), "head")


CAUSAL = "select e.label as head, q.vec_id as q_pos, e.embedding as key, list_dot_product(q.embedding::double[], e.embedding::double[]) * 0.125::double as z from embeddings e join embeddings q on q.label = e.label and e.vec_id <= q.vec_id"


@query(_sql(CAUSAL, "head, q_pos"))
def attention_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _kv(spark, sf_dir)
    q = kv.select("head", F.col("token_pos").alias("q_pos"), F.col("key").alias("query"))
    return _rows(A.attend_causal(kv, q, DIM, SCALE), "head", "q_pos")


@query(_sql(CAUSAL, "head, q_pos"))
def attention_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in two chunks, each over its key prefix: row by row the same as in one."""
    kv = _kv(spark, sf_dir)
    q = kv.select("head", F.col("token_pos").alias("q_pos"), F.col("key").alias("query"))
    parts = [A.attend_causal(kv.where(F.col("token_pos") <= b), q.where((F.col("q_pos") >= a) & (F.col("q_pos") <= b)), DIM, SCALE) for a, b in ((-(1 << 63), 255), (256, (1 << 63) - 1))]
    return _rows(parts[0].unionByName(parts[1]), "head", "q_pos")


SPARSE = f"select 0 as head, e.embedding as key, list_dot_product(q.embedding::double[], e.embedding::double[]) * 0.125::double as z from embeddings e, (select embedding from embeddings where vec_id = 0) q, (select count(*) as n from embeddings) where e.vec_id < 32 or e.vec_id >= n - 64 or e.label in (with {SCORED} select cluster_id from selected)"


@query(_sql(SPARSE, "head"))
def attention_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steady tokens and those of the clusters selected under the budget, each once."""
    kv = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("head"), F.col("vec_id").alias("token_pos"), F.col("label").alias("cluster_id"), F.col("embedding").alias("key"), F.col("embedding").alias("value"))
    n = kv.agg(F.count("*").alias("n"))
    rows = kv.crossJoin(F.broadcast(n)).withColumn("steady", (F.col("token_pos") < 32) | (F.col("token_pos") >= F.col("n") - 64))
    got = rows.where("not steady").join(selected(spark, sf_dir).select("cluster_id"), "cluster_id", "left_semi")
    q = kv.where("token_pos = 0").select("head", F.col("key").alias("query"))
    return _rows(A.attend(rows.where("steady").unionByName(got), q, DIM, SCALE), "head")


DENSE = "select 0 as head, e.embedding as key, list_dot_product(q.embedding::double[], e.embedding::double[]) * 0.125::double as z from embeddings e, (select embedding from embeddings where vec_id = 0) q"


@query(_sql(DENSE, "head"))
def attention_dense_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing indexed yet: all tokens of the head count as steady."""
    kv = _kv(spark, sf_dir, one_head=True)
    return _rows(A.attend(kv, kv.where("token_pos = 0").select("head", F.col("key").alias("query")), DIM, SCALE), "head")


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("token", "v")).select("row", "token", (F.col("v").cast("double") * 8).alias("logit"))


LOGITS = "l as (select vec_id as \"row\", (generate_subscripts(embedding, 1) - 1)::int as token, unnest(embedding)::double * 8 as logit from embeddings)"


@query(f'with {LOGITS} select "row", token from (select *, row_number() over (partition by "row" order by logit desc, token) as r from l) where r = 1')
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.greedy(_logits(spark, sf_dir))


TOPP = f"""with {LOGITS}, r as (select *, row_number() over (partition by "row" order by logit desc, token) as rank from l), k as (select * from r where rank <= {{k}}),
w as (select *, exp((logit - max(logit) over (partition by "row")) / {{t}}) as w from k), p as (select *, w / sum(w) over (partition by "row") as p from w),
c as (select *, sum(p) over (partition by "row" order by logit desc, token rows between unbounded preceding and current row) - p as b from p), f as (select * from c where b < {{p}})
select "row", token, rank, round(p / sum(p) over (partition by "row"), 6) as p from f"""


@query(TOPP.format(k=1000, t="1.0::double", p=0.7))
def top_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.filtered(_logits(spark, sf_dir), top_p=0.7))


@query(TOPP.format(k=5, t="0.7::double", p=2))
def top_k_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.filtered(_logits(spark, sf_dir), top_k=5, temperature=0.7))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("row", "token", F.col("rank").cast("long").alias("rank"), F.round("p", 6).alias("p"))


@query("""with s as (select user_id as seq, event_id as step, event_type as t from events), b as (select *, max(case when t = 'purchase' then 1 else 0 end) over (partition by seq order by step rows between unbounded preceding and 1 preceding) as d from s)
select seq, step from b where coalesce(d, 0) = 0""")
def stop_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each sequence up to its first stop token (here: a purchase)."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("step"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("token"))
    return A.until_stop(s, [1]).select("seq", "step")
