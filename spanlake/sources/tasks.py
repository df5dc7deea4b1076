"""Task configurations, and CSV reports of evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of tasks with their answer lengths and metrics.
BASE = (("niah", 128, "all"), ("variable_tracking", 30, "all"), ("common_words_extraction", 120, "all"), ("freq_words_extraction", 50, "all"), ("qa", 32, "part"))

#: The thirteen tasks and their arguments.
TASKS = (
    ("niah_single_1", "niah", {"type_haystack": "repeat", "type_needle_k": "words", "type_needle_v": "numbers"}),
    ("niah_single_2", "niah", {"type_haystack": "essay", "type_needle_k": "words", "type_needle_v": "numbers"}),
    ("niah_single_3", "niah", {"type_haystack": "essay", "type_needle_k": "words", "type_needle_v": "uuids"}),
    ("niah_multikey_1", "niah", {"type_haystack": "essay", "type_needle_k": "words", "type_needle_v": "numbers", "num_needle_k": "4"}),
    ("niah_multikey_2", "niah", {"type_haystack": "needle", "type_needle_k": "words", "type_needle_v": "numbers"}),
    ("niah_multikey_3", "niah", {"type_haystack": "needle", "type_needle_k": "uuids", "type_needle_v": "uuids"}),
    ("niah_multivalue", "niah", {"type_haystack": "essay", "type_needle_k": "words", "type_needle_v": "numbers", "num_needle_v": "4"}),
    ("niah_multiquery", "niah", {"type_haystack": "essay", "type_needle_k": "words", "type_needle_v": "numbers", "num_needle_q": "4"}),
    ("vt", "variable_tracking", {"num_chains": "1", "num_hops": "4"}),
    ("cwe", "common_words_extraction", {"freq_cw": "30", "freq_ucw": "3", "num_cw": "10"}),
    ("fwe", "freq_words_extraction", {"alpha": "2.0"}),
    ("qa_1", "qa", {"dataset": "squad"}),
    ("qa_2", "qa", {"dataset": "hotpotqa"}),
)


def task_table(spark: SparkSession) -> DataFrame:
    """(name, task, args, tokens_to_generate, metric): each task with the values of its kind."""
    tasks = spark.createDataFrame([(n, t, a) for n, t, a in TASKS], "name string, task string, args map<string,string>")
    base = spark.createDataFrame(list(BASE), "task string, tokens_to_generate int, metric string")
    return tasks.join(F.broadcast(base), "task").select("name", "task", "args", "tokens_to_generate", "metric")


def summary(scores: DataFrame) -> DataFrame:
    """One row per measure (Score, Nulls), one column per task: the report's transposed form."""
    long = scores.select("task", F.explode(F.map_from_arrays(F.array(F.lit("Score"), F.lit("Nulls")), F.array(F.col("score").cast("string"), F.col("nulls")))).alias("Tasks", "value"))
    return long.groupBy("Tasks").pivot("task").agg(F.first("value")).orderBy(F.desc("Tasks"))


def write_summary(scores: DataFrame, path: str) -> None:
    summary(scores).coalesce(1).write.mode("overwrite").csv(path, header=True)


def submission(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.col("task").alias("Task"), F.col("index").alias("ID"), F.col("pred").alias("Prediction"))


def write_submission(predictions: DataFrame, path: str) -> None:
    submission(predictions).write.mode("overwrite").csv(path, header=True, quoteAll=True)
