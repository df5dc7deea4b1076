"""Places and small DataFrame tools that several corpus operators use."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of its own on a local master and an error on a cluster."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spanlake-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def passing_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark)}/spanlake-{tag}-{uuid.uuid4().hex}"
    files, hadoop = _hadoop(spark, path)
    files.deleteOnExit(hadoop)
    return path


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    The folder goes when the application ends, or with ``drop``.
    """
    spark = df.sparkSession
    path = passing_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Have the JVM collect garbage, upon which Spark deletes shuffle files that no DataFrame can reach any more.

    It would do so at some later time; a job that writes as much again needn't find the disk full of them.
    """
    gc.collect()
    for _ in range(2):  # what the first one finalises still holds the finished job
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def drop(*stashed: DataFrame) -> None:
    """Delete what ``stash`` wrote, once nothing lazy reads it any more."""
    for df in stashed:
        files, hadoop = _hadoop(df.sparkSession, df._stashed)
        files.delete(hadoop, True)


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def text_bytes(col: Column) -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


WORD = r"[^\x20\x09-\x0D]+"


def word_count(col: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def shards_for(total: int, each: int = 8 << 20) -> int:
    """Shards, a power of two, of about ``each`` bytes of text."""
    return 1 << max(3, (max(total, 1) // each).bit_length())


def chunk_for(total: int, least: int, full: int = 32 << 30, early: int | None = None) -> int:
    """Bytes of text in a chunk, and in a shard, of operators that send blocks from every chunk to every shard.

    ``least`` up to ``full`` bytes, from there on growing with the root of the total (56 times as much at 100 TB). So
    the number of blocks, the product of those of chunks and shards, grows with the total and not with its square, at
    the price of tasks whose memory grows with its root. With ``early``, they grow by the same law from that many bytes
    on, until ``full``; there they stay until the root from ``full`` on has caught up.
    """
    grown = math.sqrt(max(total, 0) / full)
    if early is not None:
        grown = max(grown, math.sqrt(min(max(total, 0), full) / early))
    return int(least * max(1.0, grown))


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v) with u > v are stars: each u has one v, and no v is another edge's u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: one row (node, component) per node, component = smallest node.

    Alternates large-star and small-star steps until the edges are stars; each step is a partial-aggregating ``min`` and
    an equi-join, so a hub's edges are split by adaptive skew handling. Every round is written to the shared folder.
    Edges (node, component) of components already found are a short way to add more edges to them. Empty input: no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stash(e, "cc")
    for _ in range(most_rounds):
        if _settled(e):
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node's neighbours below it, and the node, point at the least of them
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        joined = big.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, e = e, stash(small, "cc")
        drop(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
