"""Incremental updates and the ring of recent tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.vectors import dot, sums
from spanlake.operators import updates as U

from .registry import DIM, label_clusters, query, table, tokens
from .retrieval import SCORED, selected


@query("select head, token_pos from (select label as head, vec_id as token_pos, row_number() over (partition by label order by vec_id desc) as r from embeddings) where r <= 16")
def delta_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.recent(tokens(spark, sf_dir), 16).select("head", "token_pos")


@query(f"""with {SCORED}, d as (select vec_id as token_pos, label as cluster_id, row_number() over (order by vec_id desc) as r from embeddings),
m as (select token_pos, cluster_id, row_number() over (order by token_pos) as place from d where r <= 128 and cluster_id in (select cluster_id from selected))
select token_pos, cluster_id from m where place <= 20""")
def delta_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent tokens of selected clusters, as far as the buffer has room."""
    t = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("head"), F.col("vec_id").alias("token_pos"), F.col("label").alias("cluster_id"))
    return U.delta_members(U.recent(t, 128), selected(spark, sf_dir), 20).select("token_pos", "cluster_id")


BATCH = """cent as (select label, list(m order by pos) as c from (select label, pos, avg(v) as m from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by label, pos) group by label),
sizes as (select label, count(*) as n from embeddings group by label),
near as (select vec_id, label as cluster_id, embedding from (select k.vec_id, cent.label, k.embedding, row_number() over (partition by k.vec_id order by list_dot_product(c, k.embedding::double[]) desc, cent.label) as r from cent, embeddings k) where r = 1),
delta as (select cluster_id, count(*) as d from near group by cluster_id)"""


@query(f"""with {BATCH}, t as (select label as cluster_id, n, coalesce(d, 0) as d from sizes left join delta on label = cluster_id)
select cluster_id, (n + case when d >= 50 then d else 0 end)::bigint as size, (case when d < 50 then d else 0 end)::bigint as pending from t""")
def centroid_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys as one batch with a threshold of 50: sizes and pending keys of the clusters."""
    keys = tokens(spark, sf_dir, one_head=True)
    return U.fold(keys, label_clusters(spark, sf_dir), threshold=50, batch=keys.count()).select(F.col("cluster_id").cast("int").alias("cluster_id"), "size", "pending")


@query(f"""with {BATCH}, s as (select cluster_id, pos, sum(v) as s from (select cluster_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from near) group by cluster_id, pos),
v as (select label, unnest(c) as m, generate_subscripts(c, 1) as pos from cent)
select v.label as cluster_id, v.pos::int as pos, round(case when coalesce(d, 0) >= 50 then (m * n + s) / (n + d) else m end, 6) as value from v join sizes using (label) left join delta on delta.cluster_id = label left join s on s.cluster_id = label and s.pos = v.pos""")
def centroid_incremental_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tokens(spark, sf_dir, one_head=True)
    out = U.fold(keys, label_clusters(spark, sf_dir), threshold=50, batch=keys.count())
    return out.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.posexplode("centroid").alias("pos", "value")).select("cluster_id", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"))


@query(f"with {BATCH} select cluster_id, d::bigint as count, round(list_sum(list_transform(sumv, lambda x: x)), 6) as total from delta join (select cluster_id, list(s) as sumv from (select cluster_id, pos, sum(v) as s from (select cluster_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from near) group by cluster_id, pos) group by cluster_id) using (cluster_id)")
def scatter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of all keys per nearest cluster, as one native aggregate."""
    keys = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("key"))
    cent = F.broadcast(label_clusters(spark, sf_dir).agg(F.sort_array(F.collect_list(F.struct("cluster_id", "centroid"))).alias("book")))
    near = F.array_max(F.transform("book", lambda c: F.struct(dot(F.col("key"), c["centroid"]).alias("s"), (-c["cluster_id"]).alias("neg"))))
    rows = keys.crossJoin(cent).select((-near["neg"]).alias("cluster_id"), "key")
    out = rows.groupBy("cluster_id").agg(F.count("*").alias("count"), *sums("key", DIM))
    total = F.lit(0.0)
    for i in range(DIM):
        total = total + F.col(f"_s{i}")
    return out.select("cluster_id", "count", F.round(total, 6).alias("total"))
