"""One deterministic clustering step, index construction, and invariants of full builds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.operators import clustering as C

from .registry import DIM, query, table, tokens

D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
ASSIGN = f"""near as (select vec_id, c as cluster_id, d from (
  select e.vec_id, s.vec_id as c, {D2.format(a="e.embedding", b="s.embedding")} as d, row_number() over (partition by e.vec_id order by {D2.format(a="e.embedding", b="s.embedding")}, s.vec_id) as r
  from embeddings e, (select * from embeddings where vec_id < 8) s) where r = 1)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir, one_head=True)
    book = t.where("token_pos < 8").select("head", F.col("token_pos").alias("cluster_id"), F.col("key").alias("centroid"))
    return C.assign(t, book)


@query(f"with {ASSIGN} select vec_id as token_pos, cluster_id, round(d, 6) as dist2 from near")
def kmeans_assign_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("token_pos", "cluster_id", F.round("dist2", 6).alias("dist2"))


@query(f"""with {ASSIGN} select cluster_id, pos::int as pos, round(avg(v), 6) as value, count(*) as size
from (select cluster_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from near join embeddings using (vec_id)) group by cluster_id, pos""")
def kmeans_update_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.means(_assigned(spark, sf_dir), DIM)
    return m.select("cluster_id", F.posexplode("centroid").alias("pos", "value"), "size").select("cluster_id", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"), "size")


@query(f"with {ASSIGN} select count(*) as n, count(distinct cluster_id) as clusters, round(sum(d), 4) as inertia from near")
def kmeans_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("cluster_id").alias("clusters"), F.round(F.sum("dist2"), 4).alias("inertia"))


SEEDS = "select label, embedding, row_number() over (partition by label order by vec_id) - 1 as c from embeddings"


def _codes_sql(counts: tuple[int, ...]) -> str:
    """Codes by the first tokens of each head, as a chain of common table expressions ending in ``codes``."""
    parts, width = len(counts), DIM // len(counts)
    sub = lambda t, p: f"{t}.embedding[{p * width + 1}:{p * width + width}]"
    out = [f"seeds as ({SEEDS})"]
    for p, k in enumerate(counts):
        d = D2.format(a=sub("e", p), b=sub("s", p))
        out.append(f"p{p} as (select vec_id, arg_min(c, (d, c)) as code{p} from (select e.vec_id, s.c, {d} as d from embeddings e join (select * from ({SEEDS}) where c < {k}) s on e.label = s.label) group by vec_id)")
    gid = "code0"
    for p, k in list(enumerate(counts))[1:]:
        gid = f"({gid} * {k} + code{p})"
    joins = " ".join(f"join p{p} using (vec_id)" for p in range(parts))
    out.append(f"codes as (select label as head, vec_id as token_pos, {', '.join(f'code{p}' for p in range(parts))}, {gid}::bigint as global_id from embeddings {joins})")
    return ",\n".join(out)


TWO, FOUR, ONE = (4, 4), (2, 2, 2, 2), (6,)
COMPACT = """used as (select head, global_id, count(*) as size from codes group by head, global_id),
clusters as (select head, global_id, row_number() over (partition by head order by global_id) - 1 as cluster_id, size,
  (sum(size) over (partition by head order by global_id rows between unbounded preceding and current row) - size)::bigint as "offset" from used)"""


def _codes(spark: SparkSession, sf_dir: str, counts: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    t = tokens(spark, sf_dir)
    book = C.seeded_codebook(t, counts, DIM)
    return C.encode(t, book, counts, DIM), book


def _public(codes: DataFrame, counts: tuple[int, ...]) -> DataFrame:
    return codes.select("head", "token_pos", *(F.col(f"code{p}").cast("long").alias(f"code{p}") for p in range(len(counts))), "global_id")


@query(f"with {_codes_sql(TWO)} select head, token_pos, code0, code1, global_id from codes")
def imi2_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(_codes(spark, sf_dir, TWO)[0], TWO)


@query(f"with {_codes_sql(FOUR)} select head, token_pos, code0, code1, code2, code3, global_id from codes")
def imi4_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(_codes(spark, sf_dir, FOUR)[0], FOUR)


@query(f"with {_codes_sql(ONE)} select head, token_pos, code0, global_id from codes")
def ivf_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(_codes(spark, sf_dir, ONE)[0], ONE)


@query(f"with {_codes_sql(TWO)}, {COMPACT} select c.head, token_pos, cluster_id from codes c join clusters using (head, global_id)")
def imi_compact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = _codes(spark, sf_dir, TWO)
    return codes.join(C.compact(codes), ["head", "global_id"]).select("head", "token_pos", "cluster_id")


@query(f'with {_codes_sql(TWO)}, {COMPACT} select head, global_id, cluster_id, size, "offset" from clusters')
def imi_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compact(_codes(spark, sf_dir, TWO)[0])


@query(f"""with {_codes_sql(TWO)}, {COMPACT}
select k.head, cluster_id, round(a.embedding[1]::double, 6) as first_value, round(b.embedding[64]::double, 6) as last_value, 64 as dims
from clusters k join seeds a on a.label = k.head and a.c = k.global_id // 4 join seeds b on b.label = k.head and b.c = k.global_id % 4""")
def imi_merged_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = _codes(spark, sf_dir, TWO)
    m = C.merged_centroids(C.compact(codes), book, TWO)
    return m.select("head", "cluster_id", F.round(F.element_at("centroid", 1), 6).alias("first_value"), F.round(F.element_at("centroid", -1), 6).alias("last_value"), F.size("centroid").alias("dims"))


@query(f"""with {_codes_sql(FOUR)}, {COMPACT}
select head, token_pos, cluster_id, row_number() over (partition by head order by global_id, token_pos) - 1 as list_pos from codes join clusters using (head, global_id)""")
def imi_reorganize(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = _codes(spark, sf_dir, FOUR)
    return C.reorganize(codes, C.compact(codes)).select("head", "token_pos", "cluster_id", "list_pos")


@query(f"""with {_codes_sql(TWO)}, {COMPACT}
select (select count(*) from clusters) as clusters, round(count(*) / 16.0::double, 6) as ideal, 1.0::double as non_empty_ratio, (select max(size) from clusters) as largest, (select count(*) * 256 from clusters) as centroid_bytes from embeddings""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = _codes(spark, sf_dir, TWO)
    return C.index_stats(C.compact(codes), tokens(spark, sf_dir))


@query(f"""with {_codes_sql(TWO)}, {COMPACT}, have as (select head, count(*) as n, sum(size) as t from clusters group by head),
later as (select head, global_id, count(*) as size from codes where token_pos % 2 = 0 group by head, global_id),
fresh as (select head, global_id, row_number() over (partition by head order by global_id) - 1 as cluster_id, size, (sum(size) over (partition by head order by global_id rows between unbounded preceding and current row) - size) as o from later)
select head, global_id, cluster_id, size, "offset" from clusters
union all select f.head, f.global_id, f.cluster_id + n, f.size, (f.o + t)::bigint from fresh f join have using (head)""")
def index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of later tokens (here those of even place) after what the index has."""
    codes, _ = _codes(spark, sf_dir, TWO)
    return C.append(C.compact(codes), C.compact(codes.where("token_pos % 2 = 0")))


@query()
def kmeans_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full seeded k-means of each head: inertia of every iteration."""
    t = tokens(spark, sf_dir).select("head", "token_pos", "key")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, inertia = C.lloyd(np.stack(pdf.sort_values("token_pos")["key"].to_numpy()), 8, 20, 42)
        return pd.DataFrame({"head": key[0], "iteration": np.arange(1, len(inertia) + 1), "inertia": inertia})

    return t.groupBy("head").applyInPandas(run, "head int, iteration long, inertia double")


@query("select label as head, true as falls from embeddings group by label")
def kmeans_inertia_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariant: inertia never rises from one iteration to the next."""
    before = F.lag("inertia").over(Window.partitionBy("head").orderBy("iteration"))
    rows = kmeans_full(spark, sf_dir).withColumn("before", before)
    return rows.groupBy("head").agg(F.min(F.coalesce(F.col("inertia") <= F.col("before") + 1e-6, F.lit(True))).alias("falls"))


@query()
def imi_full_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained two-part index: cluster metadata."""
    return C.build_index(tokens(spark, sf_dir), DIM, 2, TWO).clusters.select("head", "cluster_id", "size", "offset")


@query("""select label as head, count(*)::bigint as tokens, true as contiguous, true as stable, 0::bigint as first_pos, (count(*) - 1)::bigint as last_pos from embeddings group by label""")
def imi_build_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of a trained four-part index: sizes add up, lists are gapless, the order inside clusters is stable."""
    lists = C.build_index(tokens(spark, sf_dir), DIM, 4, FOUR).lists
    order = Window.partitionBy("head", "cluster_id").orderBy("list_pos")
    rows = lists.withColumns({"_p": F.lag("token_pos").over(order), "_l": F.lag("list_pos").over(order)})
    return rows.groupBy("head").agg(F.count("*").alias("tokens"), F.min(F.coalesce(F.col("list_pos") == F.col("_l") + 1, F.lit(True))).alias("contiguous"), F.min(F.coalesce(F.col("token_pos") > F.col("_p"), F.lit(True))).alias("stable"), F.min("list_pos").alias("first_pos"), F.max("list_pos").alias("last_pos"))


@query("select vec_id as token_pos, label as head, case when vec_id < 32 then 'steady' when vec_id >= n - 64 then 'steady' else 'indexed' end as zone from embeddings, (select count(*) as n from embeddings)")
def steady_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 and the last 64 tokens are always attended, the others are indexed."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    zone = F.when((F.col("vec_id") < 32) | (F.col("vec_id") >= F.col("n") - 64), "steady").otherwise("indexed")
    return e.crossJoin(F.broadcast(n)).select(F.col("vec_id").alias("token_pos"), F.col("label").alias("head"), zone.alias("zone"))
