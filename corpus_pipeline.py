"""A corpus pipeline of five operators, each stage on all that the one before kept.

quality classifier, n-gram Jaccard join, suffix-array dedup, mixing to target weights, packing. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Between stages
the rows are written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.bucket_packing import file_order, pack_buckets
from spanlake.llm.curriculum_mix import mix_sources, training_order
from spanlake.llm.factorization_machine import fit_quality, score_quality
from spanlake.llm.jaccard_join import jaccard_components
from spanlake.llm.shared import stash
from spanlake.llm.suffix_dedup import repeated_spans
from spanlake.session import shipped


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of score 0.3 or more; null and empty texts are scored like others. The labels are those of sf_dir."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, score_col="_score").where("_score >= 0.3").select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document of the smallest id stays.

    Rows equal in all columns count as one. Rows that share an id otherwise stay or go together: they stay if one of
    them is the smallest of its component. Documents without words and those without an id stay.
    """
    again = stash(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.isEmpty():
        docs = docs.join(again, "doc_id", "left_anti").unionByName(docs.join(again, "doc_id", "left_semi").distinct()).select(*(f"`{c}`" for c in docs.columns))
    found = jaccard_components(docs)
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("first")).where("first = 0").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes bytes out that 50-byte strings of documents with smaller ids cover. Null texts become empty; n_chars follows."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = repeated_spans(docs, keep=keep, with_text=True).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(f"`{c}`" for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: documents once, twice or not at all by their source's target, in order of position."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    out = mix_sources(docs.select("doc_id", "source", "text", row), ordered=False)
    return training_order(out, ["row"]).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their texts, in padded places of token-budget batches.

    Inside a bucket pieces stand in the order of the files that ``docs`` is read from: that of the training sequence.
    """
    docs, order = file_order(docs)
    return pack_buckets(docs, keep=tuple(c for c in ("lang", "source") if c in docs.columns), order=order)


STAGES = [(f.__name__, shipped(f)) for f in (quality, near_duplicates, repeated_passages, mixed, packed)]

#: The stages' models, links and byte spans have no SQL; they are tested against plain versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
