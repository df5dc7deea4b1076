"""Line-delimited JSON: samples, predictions, chunk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "index long, input string, outputs array<string>, length long"
PREDICTION = "index long, pred string, input string, outputs array<string>, others map<string,string>, truncation int, length long"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = SAMPLE, first: int | None = None) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    return df if first is None else df.limit(first)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def with_defaults(predictions: DataFrame) -> DataFrame:
    """Missing fields: an empty map, -1."""
    return predictions.withColumns({"others": F.coalesce("others", F.create_map().cast("map<string,string>")), "truncation": F.coalesce("truncation", F.lit(-1)), "length": F.coalesce("length", F.lit(-1))})


def merge_chunks(spark: SparkSession, folder: str, schema: str = PREDICTION) -> DataFrame:
    """Chunk files ``<task>-<n>.jsonl`` as one table with ``task`` and ``chunk``; the files stay as they are."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)-(\d+)\.jsonl$", 1)
    chunk = F.regexp_extract(F.input_file_name(), r"([^/]+)-(\d+)\.jsonl$", 2).cast("int")
    return spark.read.schema(schema).option("pathGlobFilter", "*-[0-9]*.jsonl").json(folder).select(F.url_decode(name).alias("task"), chunk.alias("chunk"), "*")


def unfinished(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Samples whose index has no prediction yet."""
    return samples.join(predictions.select("index"), "index", "left_anti")
