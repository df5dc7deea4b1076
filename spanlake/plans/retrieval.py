"""Budgeted retrieval: selection, pages, joins to lists, buffers, cache simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.params import budget, hot_capacity
from spanlake.functions.vectors import dot
from spanlake.operators import clustering as C
from spanlake.operators import retrieval as R
from spanlake.operators.attention import softmax_rows

from .registry import DIM, label_clusters, query, table, tokens

#: Labels as clusters of one head, scored by the inner product with vector 0.
SCORED = """cent as (select label as cluster_id, count(*) as size from embeddings group by label),
vals as (select label as cluster_id, pos, avg(v) as m from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by label, pos),
q as (select pos, v as qv from (select unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings where vec_id = 0)),
sim as (select cluster_id, sum(m * qv) as s from vals join q using (pos) group by cluster_id),
ranked as (select sim.cluster_id, size, s, row_number() over (order by s desc, sim.cluster_id) as rank,
  (sum(size) over (order by s desc, sim.cluster_id rows between unbounded preceding and current row) - size)::bigint as prefix from sim join cent using (cluster_id)),
selected as (select * from ranked where rank <= 6 and prefix < 120)"""


#: Probes that leave no cluster out.
EVERY = (1 << 31) - 1


def selected(spark: SparkSession, sf_dir: str, probes: int = 6, token_budget: int = 120) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.lit(0).alias("head"), F.col("embedding").alias("query"))
    return R.select_clusters(R.group_similarity(q, label_clusters(spark, sf_dir), DIM), probes, token_budget)


@query(f"with {SCORED} select cluster_id, size, round(s, 6) as similarity, rank, prefix from selected")
def budgeted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir).select("cluster_id", "size", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"), "prefix")


@query(f"""with {SCORED}, paged as (select *, ceil(size / 8.0)::bigint as pages from ranked where size > 0),
run as (select *, (sum(pages) over (order by rank rows between unbounded preceding and current row))::bigint as running_pages from paged)
select cluster_id, rank, pages, running_pages from run where running_pages <= 24""")
def page_budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.page_gate(selected(spark, sf_dir, EVERY, 1 << 62), 24)
    return rows.select("cluster_id", F.col("rank").cast("long").alias("rank"), "pages", "running_pages")


@query(f"""with {SCORED}, blocks as (select cluster_id, rank, size, unnest(range(0, ceil(size / 8.0)::bigint)) as block from selected)
select cluster_id, rank, block, least(8, size - 8 * block)::bigint as block_size,
  (sum(least(8, size - 8 * block)) over (order by rank, block rows between unbounded preceding and current row) - least(8, size - 8 * block))::bigint as dst_offset from blocks""")
def block_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expand_blocks(selected(spark, sf_dir)).select("cluster_id", F.col("rank").cast("long").alias("rank"), "block", "block_size", "dst_offset")


@query(f"""with recursive {SCORED}, n as (select 0 as head, rank, cluster_id, size, ceil(size / 8.0)::bigint as need from ranked where size > 0),
t as (select head, rank, cluster_id, size, 0 as tile, need as used from n where rank = 1 and need <= 40
  union all select n.head, n.rank, n.cluster_id, n.size, case when t.used + n.need > 40 then t.tile + 1 else t.tile end, case when t.used + n.need > 40 then n.need else t.used + n.need end
  from t join n on n.rank = t.rank + 1 where n.need <= 40)
select head, rank, cluster_id, size, tile from t""")
def cluster_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cluster_tiles(_long(selected(spark, sf_dir, EVERY, 1 << 62)), 40)


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({"cluster_id": F.col("cluster_id").cast("long"), "size": F.col("size").cast("long")})


@query(f"with {SCORED} select count(*) as clusters, sum(ceil(size / 8.0))::bigint as pages, true as within from ranked where ceil(size / 8.0) <= 400")
def cluster_tiles_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No tile exceeds the buffer and, without oversize clusters, none is lost."""
    fit = selected(spark, sf_dir, EVERY, 1 << 62).where(R.page_count("size") <= 400)
    tiles = R.cluster_tiles(_long(fit), 400)
    per = tiles.groupBy("tile").agg(F.count("*").alias("n"), F.sum(R.page_count("size")).alias("p"))
    within = F.coalesce(F.min(F.col("p") <= 400), F.lit(True)).alias("within")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("clusters"), F.sum("p").alias("pages"), within)


LISTS = """lists as (select vec_id as token_pos, label as cluster_id, row_number() over (order by label, vec_id) - 1 as list_pos from embeddings)"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lists and cluster metadata (with offsets) of labels as clusters of one head."""
    codes = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("head"), F.col("vec_id").alias("token_pos"), F.col("label").cast("long").alias("global_id"), F.col("embedding").alias("key"))
    clusters = C.compact(codes)
    return C.reorganize(codes, clusters), clusters


@query(f"with {SCORED}, {LISTS} select token_pos, cluster_id, rank from lists join selected using (cluster_id)")
def member_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, clusters = _lists(spark, sf_dir)
    return R.members(_named(selected(spark, sf_dir), clusters), lists).select("token_pos", F.col("global_id").cast("int").alias("cluster_id"), F.col("rank").cast("long").alias("rank"))


def _named(sel: DataFrame, clusters: DataFrame) -> DataFrame:
    """Selected labels under the index's compact ids, with offsets."""
    mine = sel.select("head", F.col("cluster_id").cast("long").alias("global_id"), "rank")
    return mine.join(clusters, ["head", "global_id"])


@query(f"with {SCORED}, {LISTS} select token_pos, list_pos, cluster_id, rank from lists join selected using (cluster_id)")
def range_probe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by place ranges, through buckets of places."""
    lists, clusters = _lists(spark, sf_dir)
    found = R.members_by_range(_named(selected(spark, sf_dir), clusters), lists)
    return found.select("token_pos", "list_pos", F.col("global_id").cast("int").alias("cluster_id"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {SCORED}, n as (select count(*) as n from embeddings),
steady as (select vec_id as token_pos, 0 as s from embeddings, n where vec_id < 32 or vec_id >= n - 64),
got as (select vec_id as token_pos, case when label % 2 = 0 then 1 else 2 end as s from embeddings, n where label in (select cluster_id from selected) and not (vec_id < 32 or vec_id >= n - 64)),
every as (select * from steady union all select * from got)
select token_pos, case s when 0 then 'steady' when 1 then 'miss' else 'hit' end as source, row_number() over (order by s, token_pos) - 1 as dst_pos from every""")
def gather_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution buffer: steady tokens, then missed, then cached ones (odd clusters count as cached)."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    rows = e.crossJoin(F.broadcast(n)).select(F.lit(0).alias("head"), F.col("vec_id").alias("token_pos"), F.col("label").alias("cluster_id"), ((F.col("vec_id") < 32) | (F.col("vec_id") >= F.col("n") - 64)).alias("steady"))
    got = rows.where("not steady").join(selected(spark, sf_dir).select("cluster_id"), "cluster_id", "left_semi").select("head", "token_pos", "cluster_id")
    parts = [("steady", rows.where("steady").select("head", "token_pos")), ("miss", got.where("cluster_id % 2 = 0").select("head", "token_pos")), ("hit", got.where("cluster_id % 2 = 1").select("head", "token_pos"))]
    return R.concat_sources(parts).select("token_pos", "source", "dst_pos")


@query("""with c as (select label as cluster_id, count(*) as size from embeddings group by label),
o as (select cluster_id, size, row_number() over (order by md5(concat_ws(':', '7', '0', cluster_id::varchar)), cluster_id) as ord from c)
select cluster_id, size, ord from o where ord <= 4""")
def warmup_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.warm_up(label_clusters(spark, sf_dir), 4, 7).select("cluster_id", "size", F.col("ord").cast("long").alias("ord"))


@query("""with e as (select user_id % 8 as grp, event_id as step, (event_id * 7 + user_id) % 40 as cluster_id, 1 + (event_id % 5) as size from events),
cached as (select grp, cluster_id from (select distinct grp, cluster_id from e) where cluster_id % 3 = 0)
select e.grp as "group", step, e.cluster_id, size, case when cached.cluster_id is null then 'miss' else 'hit' end as kind from e left join cached on e.grp = cached.grp and e.cluster_id = cached.cluster_id""")
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted clusters against a cache's content: an outer join and a null test."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("group"), F.col("event_id").alias("step"), ((F.col("event_id") * 7 + F.col("user_id")) % 40).alias("cluster_id"), (1 + F.col("event_id") % 5).alias("size"))
    cached = e.select("group", "cluster_id").distinct().where("cluster_id % 3 = 0").withColumn("cached", F.lit(True))
    return e.join(cached, ["group", "cluster_id"], "left").select("group", "step", "cluster_id", "size", F.when(F.col("cached").isNull(), "miss").otherwise("hit").alias("kind"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accesses: groups of users, four clusters a step."""
    e = table(spark, sf_dir, "events")
    c = F.explode(F.sequence(F.lit(0), F.lit(3)))
    rows = e.select((F.col("user_id") % 8).alias("group"), F.col("event_id").alias("step"), "user_id", c.alias("ord"))
    return rows.select("group", "step", "ord", F.pmod(F.col("user_id") + F.col("ord") * F.col("ord") * 3, F.lit(48)).alias("cluster_id")).withColumn("pages", 1 + F.col("cluster_id") % 3)


@query()
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-tier cache over the trace: hits and misses of every step."""
    return R.replay(trace(spark, sf_dir), 40, hot_capacity(40), 16)


@query('select user_id % 8 as "group", count(*) as steps, (count(*) * 4)::bigint as wanted from events group by user_id % 8')
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and accesses of each group; the hit rate itself is in ``cache_replay_rate``."""
    r = cache_replay(spark, sf_dir)
    return r.groupBy("group").agg(F.count("*").alias("steps"), F.sum(F.col("hits") + F.col("misses")).alias("wanted"))


@query()
def cache_replay_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cache_replay(spark, sf_dir)
    return r.groupBy("group").agg((F.sum("hits") / F.greatest(F.sum(F.col("hits") + F.col("misses")), F.lit(1))).alias("rate"))


@query("""with e as (select vec_id, embedding, label from embeddings), q as (select embedding as qv, vec_id as qid from embeddings where vec_id % 20 = 0),
exact as (select qid, vec_id, label, row_number() over (partition by qid order by list_dot_product(qv::double[], embedding::double[]) desc, vec_id) as r from e, q),
cent as (select label, list(m order by pos) as c from (select label, pos, avg(v) as m from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by label, pos) group by label),
sizes as (select label, count(*) as size from embeddings group by label),
near as (select qid, label, size, row_number() over (partition by qid order by list_dot_product(c, qv::double[]) desc, label) as rank from cent join sizes using (label), q),
pre as (select *, sum(size) over (partition by qid order by rank rows between unbounded preceding and current row) - size as prefix from near),
b as (select unnest([0.1::double, 0.2::double, 0.5::double, 1.0::double]) as budget), n as (select count(*) as n from e),
sel as (select budget, qid, label from pre, b, n where prefix < greatest(floor(budget * n), 1))
select budget, round(avg(case when sel.label is not null then 1.0::double else 0.0::double end), 6) as recall
from (select * from exact, b where r <= 10) x left join sel using (budget, qid, label) group by budget""")
def recall_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact 10 best tokens of the queries (ids divisible by 20) that lie in the clusters selected under each budget."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    exact = R.best_by_product(e, q, DIM, 10)
    cent = q.crossJoin(F.broadcast(label_clusters(spark, sf_dir))).select(F.col("qid").alias("head"), "cluster_id", "size", dot("centroid", "qv").alias("similarity"))
    near = R.select_clusters(cent, EVERY, 1 << 62).select(F.col("head").alias("qid"), F.col("cluster_id").alias("label"), "prefix")
    n = e.count()
    # one pass for all budgets: a cluster is selected while the tokens before it are under the budget
    hits = {share: F.coalesce((F.col("prefix") < budget(10, n, share).tokens).cast("double"), F.lit(0.0)) for share in (0.1, 0.2, 0.5, 1.0)}
    row = exact.join(near, ["qid", "label"], "left").agg(F.array(*(F.struct(F.lit(share).alias("budget"), F.round(F.avg(hit), 6).alias("recall")) for share, hit in hits.items())).alias("r"))
    return row.select(F.inline("r"))


PARTS = f"""with {SCORED}, n as (select count(*) as n from embeddings),
steady as (select vec_id as token_pos, 0 as s, 0 as rank from embeddings, n where vec_id < 32 or vec_id >= n - 64),
got as (select vec_id as token_pos, case when label % 2 = 0 then 1 else 2 end as s, rank from embeddings, n, selected where label = cluster_id and not (vec_id < 32 or vec_id >= n - 64))"""


@query(f"{PARTS} select token_pos, case s when 1 then 'miss' else 'hit' end as source, row_number() over (order by s, token_pos) - 1 as dst_pos from got")
def gather_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile mode: missed tokens, then cached ones, without the steady zone."""
    rows = gather_concat(spark, sf_dir).where("source <> 'steady'").select(F.lit(0).alias("head"), "token_pos", "source")
    parts = [(k, rows.where(F.col("source") == k).select("head", "token_pos")) for k in ("miss", "hit")]
    return R.concat_sources(parts).select("token_pos", "source", "dst_pos")


@query(f"{PARTS}, every as (select * from steady union all select * from got) select token_pos, dst_pos from (select token_pos, row_number() over (order by least(s, 1), rank, token_pos) - 1 as dst_pos from every) where dst_pos < 150")
def gather_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steady tokens, then those of the selected clusters in order of rank, as far as the buffer reaches."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    rows = e.crossJoin(F.broadcast(n)).select(F.lit(0).alias("head"), F.col("vec_id").alias("token_pos"), F.col("label").alias("cluster_id"), ((F.col("vec_id") < 32) | (F.col("vec_id") >= F.col("n") - 64)).alias("steady"))
    got = rows.where("not steady").join(selected(spark, sf_dir).select("cluster_id", "rank"), "cluster_id").select("head", "token_pos", F.struct("rank", "token_pos").alias("at"))
    parts = [("steady", rows.where("steady").select("head", "token_pos", F.struct(F.lit(0).alias("rank"), "token_pos").alias("at"))), ("clusters", got)]
    return R.concat_sources(parts, order="at", most=150).select("token_pos", "dst_pos")


@query("select label as cluster_id, count(*) as size, ceil(count(*) / 8.0)::bigint as pages from embeddings group by label having ceil(count(*) / 8.0) <= 6")
def oversize_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty clusters that fit a page buffer."""
    c = label_clusters(spark, sf_dir).where("size > 0").withColumn("pages", R.page_count("size"))
    return c.where("pages <= 6").select("cluster_id", "size", "pages")


@query("select min(n) as shortest, max(n) as longest, round(avg(n), 6) as mean from (select count(*) as n from embeddings group by label)")
def valid_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tokens(spark, sf_dir).groupBy("head").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))


@query("""with s as (select conv_id, min(turn) filter (role <> 'system') as start from conversations group by conv_id)
select c.conv_id as seq, c.turn - s.start as token_pos, c.role from conversations c join s on c.conv_id = s.conv_id where c.turn >= s.start""")
def padding_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left padding of each sequence goes (here: system turns in front), positions start at 0."""
    c = table(spark, sf_dir, "conversations")
    start = c.where("role <> 'system'").groupBy("conv_id").agg(F.min("turn").alias("start"))
    return c.join(start, "conv_id").where("turn >= start").select(F.col("conv_id").alias("seq"), (F.col("turn") - F.col("start")).alias("token_pos"), "role")


@query("""select label as head, vec_id as token_pos, 'prefill' as source from embeddings union all select label, max(vec_id) + 1, 'decode' from embeddings group by label""")
def kv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decoded token after the last of each head."""
    t = tokens(spark, sf_dir).select("head", "token_pos")
    fresh = t.groupBy("head").agg((F.max("token_pos") + 1).alias("token_pos"))
    return t.withColumn("source", F.lit("prefill")).unionByName(fresh.withColumn("source", F.lit("decode")))


@query("""with e as (select label as head, vec_id, embedding from embeddings), q as (select * from e where vec_id % 20 = 0),
z as (select q.head, q.vec_id as query_id, e.vec_id as token_pos, list_dot_product(q.embedding::double[], e.embedding::double[]) * 0.125::double as z from q join e using (head)),
w as (select *, exp(z - max(z) over (partition by query_id)) as w from z)
select query_id, token_pos, round(w / sum(w) over (partition by query_id), 6) as weight from w""")
def gemm_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a query set against their heads' keys, normalised by row: maximum, sum of exponentials, division."""
    t = tokens(spark, sf_dir)
    q = t.where("token_pos % 20 = 0").select("head", F.col("token_pos").alias("query_id"), F.col("key").alias("query"))
    return softmax_rows(t, q, DIM, 0.125)
