"""Packing with optimal length buckets: dynamic programming over the global length histogram.

Sequences of a bucket are padded to its boundary, and a batch holds as many of them as the token budget allows. The
sequences themselves, the pieces of the texts, stand in the places of their batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, word_count


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries from (length, count) that minimise the padded total; the last is the longest length.

    Of plans of equal total, one with fewer buckets wins.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    count = np.concatenate([[0], np.cumsum([histogram[x] for x in lengths])]).astype(np.float64)
    top = np.array(lengths, np.float64)
    n = len(lengths)
    # best[j]: least padded total of the first j lengths with k buckets; the last bucket covers lengths i..j-1
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back, totals = [], []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + top[j - 1] * (count[j] - count[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        back.append(cut)
        totals.append(best[n])
    k = int(np.argmin(totals))
    out, j = [], n
    for level in range(k, -1, -1):
        out.append(lengths[j - 1])
        j = int(back[level][j])
    return out[::-1]


def file_order(docs: DataFrame) -> tuple[DataFrame, tuple[Column, Column] | None]:
    """``docs`` read from files, with the place of each row in them, as an order to pack in; None for rows of no file."""
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return docs, None
    return rows, (F.struct(F.length("_file"), F.col("_file")), F.col("_at"))


def pack_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, keep: tuple[str, ...] = (), with_text: bool = True, order: tuple[Column, Column] | None = None, longest: int = 8192, step: int = 1, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """Every document, cut into pieces of at most ``longest`` words, in a padded place of a batch.

    Returns id, the columns of ``keep``, piece, first_word, n_words, bucket, padded, batch (global, from 0), batch_row, fill
    (sequences that the batch can hold) and, ``with_text``, the piece's text: the whole text of a document of one piece
    (null if that is null), else its words with single spaces between. Lengths count words; the histogram has
    longest / step bins at most, which is all the driver gets. Null and empty texts are one piece of 0 words, padded to
    the first boundary. Inside a bucket pieces stand in ``order``, a column that ranges are counted by and one that
    orders rows in a range; without it, in that of 256 ranges of a hash. So no bucket is one task. Ties go by hash, id,
    piece and length; rows equal in all of them are interchangeable. Repeated rows stay rows of their own, null ids too.
    An empty table gives no rows.
    """
    if longest % step:
        raise ValueError("longest must be a multiple of step")
    spark = docs.sparkSession
    n = length if length is not None else word_count(F.col(text_col))
    ranges, at = order or (F.lit(None), F.lit(None))
    text = F.col(text_col).cast("string") if with_text else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("_row"), n.alias("_words"), text.alias("_text"), ranges.alias("_given"), at.alias("_place"))
    last = F.greatest(F.lit(0), F.ceil(F.col("_words") / longest) - 1).cast("int")
    cut = F.array(F.col("_text"))
    if with_text:
        words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
        cut = F.when(last > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * longest + 1, longest), " "))).otherwise(cut)
        rows = rows.select("*", F.posexplode(cut).alias("piece", "_piece")).drop("_text")
    else:
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"), F.lit(None).alias("_piece")).drop("_text")
    rows = rows.withColumn("first_word", F.col("piece").cast("long") * longest).withColumn("n_words", F.least(F.col("_words") - F.col("first_word"), F.lit(longest)).cast("long"))
    rows = rows.withColumn("_bin", (F.greatest(F.lit(1), F.ceil(F.col("n_words") / step)) * step).cast("int")).drop("_words")
    slim = rows.drop("_piece")
    histogram = {r["_bin"]: r["count"] for r in slim.groupBy("_bin").count().collect()}
    tops = boundaries(histogram, buckets)
    bucket_of = F.lit(0)
    for b in tops[:-1]:
        bucket_of = bucket_of + F.when(F.col("_bin") > b, 1).otherwise(0)
    base, table = 0, []
    for k, top in enumerate(tops):
        inside = sum(c for x, c in histogram.items() if x <= top and (k == 0 or x > tops[k - 1]))
        fill = max(1, budget // top)
        table.append((k, top, fill, base))
        base += -(-inside // fill)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("bucket", bucket_of.cast("int")).withColumn("_hash", F.xxhash64("_id", "piece", "n_words"))
        return df.withColumn("_range", F.col("_given") if order else F.pmod(F.col("_hash"), F.lit(256)))

    ends = Window.partitionBy("bucket").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = placed(slim).groupBy("bucket", "_range").count().withColumn("_start", F.sum("count").over(ends) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("bucket", "_range").orderBy("_place", "_hash", "_id", "piece", "n_words"))
    plan = spark.createDataFrame(table, "bucket int, padded int, fill int, _base long")
    starts = starts.join(F.broadcast(plan), "bucket")
    rows = placed(rows).withColumn("_rank", rank).join(starts, ["bucket", "_range"]).withColumn("_rank", F.col("_start") + F.col("_rank") - 1)
    batch = F.col("_base") + F.floor(F.col("_rank") / F.col("fill"))
    own = [F.col("_piece").alias(text_col)] if with_text else []
    return rows.select(F.col("_id").alias(id_col), *(F.col(f"_row.`{c}`").alias(c) for c in keep if not with_text or c != text_col), "piece", "first_word", "n_words", "bucket", "padded", batch.cast("long").alias("batch"), (F.col("_rank") % F.col("fill")).cast("int").alias("batch_row"), "fill", *own)
