"""Scans over vectors: products, distances, sub-vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.vectors import dot, l2_squared, subvector, sums
from spanlake.operators.retrieval import group_similarity

from .registry import DIM, label_clusters, query, table


@query("""select e.vec_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]), 6) as similarity
from embeddings e, (select embedding from embeddings where vec_id = 0) q""")
def vec_dot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(dot("q", "embedding"), 6).alias("similarity"))


@query("""select e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6) as dist2
from embeddings e, (select embedding from embeddings where vec_id = 0) q""")
def vec_l2_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(l2_squared("q", "embedding"), 6).alias("dist2"))


CENTROIDS = """cent as (select label as cluster_id, count(*) as size from embeddings group by label),
vals as (select label as cluster_id, pos, avg(v) as m from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by label, pos),
q as (select pos, sum(v) as qv from (select unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings where vec_id < 4) group by pos),
sim as (select cluster_id, sum(m * qv) as s from vals join q using (pos) group by cluster_id)"""


@query(f"with {CENTROIDS} select cluster_id, size, round(s, 6) as similarity from sim join cent using (cluster_id)")
def gqa_group_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four grouped queries against the centroids of their head."""
    q = table(spark, sf_dir, "embeddings").where("vec_id < 4").select(F.lit(0).alias("head"), F.col("embedding").alias("query"))
    return group_similarity(q, label_clusters(spark, sf_dir), DIM).select("cluster_id", "size", F.round("similarity", 6).alias("similarity"))


def _split(parts: int) -> str:
    width = DIM // parts
    return f"""select vec_id, part::int as part, round(list_sum(list_transform(embedding[part * {width} + 1 : part * {width} + {width}], lambda x: x::double)), 6) as total,
round(embedding[part * {width} + 1]::double, 6) as first_value
from embeddings, (select unnest(range(0, {parts})) as part)"""


def _parts(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    width = DIM // parts
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.array(*(subvector("embedding", p, width) for p in range(parts)))).alias("part", "sub"))
    total = F.aggregate(F.transform("sub", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", "part", F.round(total, 6).alias("total"), F.round(F.element_at("sub", 1).cast("double"), 6).alias("first_value"))


@query(_split(2))
def subvector_split_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, 2)


@query(_split(4))
def subvector_split_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, 4)


@query("""select label as head, pos::int as pos, round(sum(v), 6) as total from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by label, pos""")
def vector_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise sums per head by partial aggregation."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("head")).agg(*sums("embedding", DIM))
    return e.select("head", F.posexplode(F.array(*(F.col(f"_s{i}") for i in range(DIM)))).alias("pos", "total")).select("head", (F.col("pos") + 1).alias("pos"), F.round("total", 6).alias("total"))
