"""Question corpora from nested JSON: paragraphs with questions, and multi-hop questions with titled contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARAGRAPHS = "data array<struct<title string, paragraphs array<struct<context string, qas array<struct<id string, question string, is_impossible boolean, answers array<struct<text string>>>>>>>>"
HOPS = "question string, answer string, context array<struct<title string, sentences array<string>>>"


def numbered(texts: DataFrame) -> DataFrame:
    """Distinct texts in order, numbered from 0.

    The rank comes from counts of sorted ranges: only the ranges' totals pass through one task.
    """
    ranged = texts.select("text").distinct().repartitionByRange("text").sortWithinPartitions("text").withColumn("_part", F.spark_partition_id())
    total = ranged.groupBy("_part").count()
    ends = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = total.withColumn("_start", F.sum("count").over(ends) - F.col("count")).select("_part", "_start")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("text")) - 1
    return ranged.withColumn("_rank", rank).join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_rank")).alias("doc_idx"), "text")


def read_paragraph_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, questions): contexts are the documents; other contexts of the same article are ``more_context``."""
    articles = spark.read.schema(PARAGRAPHS).json(path, multiLine=True).select(F.explode("data").alias("a")).select(F.col("a.title").alias("title"), F.explode("a.paragraphs").alias("p"))
    docs = numbered(articles.select(F.col("p.context").alias("text")))
    placed = articles.join(docs, articles["p.context"] == docs["text"])
    article = placed.groupBy("title").agg(F.sort_array(F.collect_set("doc_idx")).alias("_all"))
    qas = placed.select("title", "doc_idx", F.explode("p.qas").alias("q")).where("not coalesce(q.is_impossible, false)").join(article, "title")
    return docs, qas.select(F.col("q.question").alias("query"), F.array_distinct(F.col("q.answers.text")).alias("outputs"), F.array("doc_idx").alias("context"), F.array_except("_all", F.array("doc_idx")).alias("more_context"))


def read_hop_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, questions): a document is its title, a line break and its sentences."""
    rows = spark.read.schema(HOPS).json(path, multiLine=True).withColumn("_q", F.monotonically_increasing_id())
    flat = rows.select("_q", "question", "answer", F.posexplode("context").alias("pos", "c"))
    flat = flat.withColumn("text", F.concat("c.title", F.lit("\n"), F.array_join("c.sentences", "")))
    docs = numbered(flat.select("text"))
    qas = flat.join(docs, "text").groupBy("_q").agg(F.first("question").alias("query"), F.array(F.first("answer")).alias("outputs"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc_idx"))), lambda x: x["doc_idx"]).alias("context"))
    return docs, qas.select("query", "outputs", "context", F.array().cast("array<bigint>").alias("more_context"))
