"""One query per operator, over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.session import shipped

from .bucket_packing import pack_buckets
from .curriculum_mix import mix_sources
from .factorization_machine import fit_quality, held_out, score_quality
from .ivf_pq import nearest
from .jaccard_join import jaccard_components
from .ngram_trie import score_documents
from .repair_tokens import read_digests, write_tokens
from .ring_shards import ring_shards
from .robust_outliers import robust_outliers
from .shared import passing_path, text_bytes, word_count
from .suffix_dedup import repeated_spans


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_repair_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Ids of every whole text, written as Re-Pair shards and decoded again. The files go when the application ends."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = passing_path(spark, "tokens")
    write_tokens(_documents(spark, sf_dir, "doc_id", "text"), path, tokenizer)
    return read_digests(spark, path)


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of a consistent-hash ring, counts at most one apart."""
    docs = _documents(spark, sf_dir, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (text_bytes(F.col("text")) + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = ring_shards(slim, "doc_id", F.xxhash64("text_crc32", "size"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and when on the training time from 0 to 1."""
    docs = _documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("n"))
    return mix_sources(docs, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken", "first_taken", "position", "repeat_position")


OP3_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), o as (
  select *, md5(concat_ws(':', coalesce(doc_id::varchar, '-'), size::varchar)) as k from d
), per as (select source, sum(size)::bigint as words from d group by source),
w as (
  select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight,
         row_number() over (order by source asc nulls last) as rk,
         words * 2.0::double as lim, (sum(words) over ())::double * 1.5::double as total from per
), lv as (
  select *, lim / weight as ratio,
         (total - coalesce(sum(lim) over (order by lim / weight, rk rows between unbounded preceding and 1 preceding), 0.0::double))
         / sum(weight) over (order by lim / weight, rk rows between current row and unbounded following) as level from w
), l as (
  select *, (select arg_min(level, (ratio, rk)) from lv where ratio > level) as lam from lv
), t as (
  select source, rk, words as source_size, least(lim, coalesce(lam * weight, lim)) as target from l
), c as (
  select o.doc_id, o.size, t.source_size, t.target, round(t.target)::bigint as goal,
         case t.rk % 3 when 1 then 0.5::double when 2 then 1.0::double else 1.5::double end as p,
         case t.rk % 3 when 1 then 1.5::double when 2 then 1.0::double else 0.5::double end as q,
         (sum(o.size) over (partition by o.source order by o.k, o.doc_id nulls first, o.size rows between unbounded preceding and current row))::bigint - o.size as b
  from o join t on o.source is not distinct from t.source
), d2 as (
  select *, greatest(0, least(size, goal - b))::bigint as first_taken, greatest(0, least(size, goal - b - source_size))::bigint as again from c
), y as (
  select *, (b + first_taken / 2.0::double) / goal as y1, (b + source_size + again / 2.0::double) / goal as y2 from d2
)
select doc_id, size, source_size, target, first_taken + again as taken, first_taken,
       case when first_taken > 0 then least(1, greatest(0, case when q = p then y1 / p else (sqrt(p * p + (q - p) * y1 * (p + q)) - p) / (q - p) end)) end as position,
       case when again > 0 then least(1, greatest(0, case when q = p then y2 / p else (sqrt(p * p + (q - p) * y2 * (p + q)) - p) / (q - p) end)) end as repeat_position
from y
"""


def op4_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every whole text."""
    return score_documents(_documents(spark, sf_dir, "doc_id", "text"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of near copies of every document."""
    return jaccard_components(_documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every whole text."""
    out = robust_outliers(_documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every hundredth."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text, by a model of the labels outside the held-out fold."""
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without the 50-byte strings of documents before it."""
    return repeated_spans(_documents(spark, sf_dir, "doc_id", "text"))


def op10_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, in pieces, in the padded places of its batches."""
    return pack_buckets(_documents(spark, sf_dir, "doc_id", "text"))


ALL = (op1_repair_tokens, op2_ring_shards, op3_curriculum_mix, op4_ngram_trie, op5_jaccard_join, op6_robust_outliers, op7_ivf_pq, op8_factorization_machine, op9_suffix_dedup, op10_bucket_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_curriculum_mix": OP3_SQL}
