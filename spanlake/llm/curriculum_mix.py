"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source's weight over training time t in [0, 1] is a linear ramp of mean 1 times its base weight, so its
cumulative demand in words is target * (p t + (q - p) t^2 / 2). A source's documents stand in a fixed pseudo-random
order; the document whose words cover the demand up to D trains at the time t at which the cumulative demand is D,
the inverse of that quadratic. Past the source's last word the order starts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import word_count

WEIGHTS = (3, 1, 2)
RAMPS = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets from (source, words): proportional to weight, at most ``most`` times the source, the excess reshared.

    With sources by the ratio of limit to weight, those up to some place are full and the rest share what is left;
    prefix sums over the sources give that place. Sources are ranked by code point, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", _cycle(F.col("rank"), weights))
    s = s.withColumns({"limit": F.col("words") * F.lit(most), "total": F.sum("words").over(everything) * F.lit(share)})
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", F.col("rank"), F.col("words").alias("source_size"), F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, share: float = 1.5, most: float = 2.0, ordered: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, taken, first_taken, position, repeat_position.

    ``taken``: words the mix takes from the document, of which ``first_taken`` on the first pass through its source;
    a source's taken words add up to its rounded target, the document at the end of the demand is taken in part.
    Positions are training times in [0, 1] (null where nothing is taken). Null texts and texts without words have
    size 0. A null source is a source of its own, the last. Rows are ordered in a source by md5 of id and size, then
    by them; equal rows are interchangeable. A source is cut into 256 ranges of that order, of which only sums pass
    through a window over the source, so a source with a third of all rows is no single task. The number of sources
    is taken to fit one task; that of documents isn't. If ``ordered``, the
    result is sorted by position in ranges.
    """
    mine = ["size", "source_size", "target", "taken", "first_taken", "position", "repeat_position"]
    kept = [c for c in docs.columns if c not in mine]
    words = size if size is not None else word_count(F.col(text_col))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_name"), words.alias("size"))
    named = F.coalesce(F.concat(F.lit("+"), F.col("_name")), F.lit("-"))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.col("size").cast("string")))
    rows = rows.withColumns({"_source": named, "_order": order}).withColumn("_range", F.substring("_order", 1, 2))
    sums = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    ends = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.withColumn("_start", F.sum("_sum").over(ends) - F.col("_sum")).drop("_sum")
    per = sums.groupBy("_source").agg(F.sum("_sum").alias("words")).withColumn("source", F.when(F.col("_source") != "-", F.expr("substring(_source, 2)")))
    targets = source_targets(per.select("source", "words"), weights, share, most)
    targets = targets.select(F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-")).alias("_source"), "rank", "source_size", "target")
    starts = starts.join(targets, "_source")
    inside = Window.partitionBy("_source", "_range").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("size").over(inside)).join(starts, ["_source", "_range"])
    rows = rows.withColumn("_from", F.col("_start") + F.col("_end") - F.col("size")).withColumn("_goal", F.round("target").cast("long"))

    def part(begin: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), F.col("_goal") - begin)).cast("long")

    rows = rows.withColumns({"first_taken": part(F.col("_from")), "_again": part(F.col("_from") + F.col("source_size"))})
    p, q = _cycle(F.col("rank"), tuple(r[0] for r in ramps)), _cycle(F.col("rank"), tuple(r[1] for r in ramps))

    def time(begin: Column, words: Column) -> Column:
        y = (begin + words / 2) / F.col("_goal")
        t = F.when(q == p, y / p).otherwise((F.sqrt(p * p + (q - p) * y * (p + q)) - p) / (q - p))
        return F.when(words > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))

    rows = rows.withColumns({"position": time(F.col("_from"), F.col("first_taken")), "repeat_position": time(F.col("_from") + F.col("source_size"), F.col("_again")), "taken": F.col("first_taken") + F.col("_again")})
    if ordered:  # the documents that nothing is taken from are many and have no position: the order of the source deals them
        rows = rows.repartitionByRange("position", "_order").sortWithinPartitions("position", "_order")
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in kept), *mine)


def training_order(mixed: DataFrame, kept: list[str]) -> DataFrame:
    """The mix as a sequence: one row per taken copy with ``kept`` columns, copy (0, 1) and position, range-sorted.

    A copy counts as taken here if at least half of its words are.
    """
    half = lambda words: F.col("size") <= 2 * words
    first, again = F.col("first_taken"), F.col("taken") - F.col("first_taken")
    copies = F.filter(F.array(F.struct(F.lit(0).alias("copy"), F.col("position").alias("at"), (half(first) & (first > 0)).alias("whole")), F.struct(F.lit(1).alias("copy"), F.col("repeat_position").alias("at"), (half(again) & (again > 0)).alias("whole"))), lambda c: c["whole"])
    rows = mixed.select(*(f"`{c}`" for c in kept), F.explode(copies).alias("_copy"))
    rows = rows.select(*(f"`{c}`" for c in kept), F.col("_copy.copy").alias("_no"), F.col("_copy.at").alias("_at"))
    rows = rows.repartitionByRange(F.col("_at")).sortWithinPartitions("_at", "_no")
    return rows.select(*(f"`{c}`" for c in kept if c not in ("copy", "position")), F.col("_no").alias("copy"), F.col("_at").alias("position"))
