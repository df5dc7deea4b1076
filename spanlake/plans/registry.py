"""Registration of queries together with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.session import shipped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name; without ``sql`` only its rows are checked."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = shipped(f)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str, one_head: bool = False) -> DataFrame:
    """Embeddings as a key/value table: (head, token_pos, key). ``label`` is the head."""
    head = F.lit(0) if one_head else F.col("label")
    return table(spark, sf_dir, "embeddings").select(head.alias("head"), F.col("vec_id").alias("token_pos"), F.col("embedding").alias("key"))


def label_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the clusters of one head: (head, cluster_id, size, centroid)."""
    from spanlake.operators.clustering import means

    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("head"), F.col("label").alias("cluster_id"), F.col("embedding").alias("key"))
    return means(rows, DIM)
