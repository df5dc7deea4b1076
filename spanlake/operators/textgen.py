"""Generators of synthetic long-context tasks, as table-valued DataFrame functions.

Where a generator draws at random, it orders or numbers by a seeded md5 of the row's key: the same on every run, at
every partitioning and in SQL.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.functions.text import seeded_number, token_count

try:  # a third less time for short texts than hashlib's
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: A word: no white space of these kinds in it.
WORD = re.compile(r"[^ \t\n\r\f\x0B]+")
#: Fixed value: the sentence that hides a value.
NEEDLE = "One of the special magic numbers for {key} is: {value}."


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string")))


def needles(keys: DataFrame, values: int = 1, seed: int = 42) -> DataFrame:
    """(sample, key, value_no, value, sentence) from (sample, key)."""
    rows = keys.withColumn("value_no", F.explode(F.sequence(F.lit(0), F.lit(values - 1))))
    rows = rows.withColumn("value", seeded_number(F.concat_ws("/", F.col("sample").cast("string"), "key", F.col("value_no").cast("string")), seed).cast("string"))
    return rows.withColumn("sentence", fill_template(F.lit(NEEDLE), {"key": F.col("key"), "value": F.col("value")}))


def haystack(sentences: DataFrame, hidden: DataFrame, seed: int = 42) -> DataFrame:
    """(sample, input, outputs): needles (sample, sentence, value) between the sentences (sample, pos, sentence).

    A needle's depth is one of 40 evenly spaced ones, by its seeded order. A sample's rows meet in one task: a
    sample is one prompt, bounded by the context length it is made for.
    """
    size = sentences.groupBy("sample").agg(F.count("*").alias("_n"))
    depth = F.pmod(F.conv(F.substring(shuffled(F.concat_ws("/", F.col("sample").cast("string"), "sentence"), seed), 1, 8), 16, 10).cast("long"), F.lit(40))
    at = F.floor(F.round(depth * 100 / 39) * F.col("_n") / 100)
    placed = hidden.join(size, "sample").select("sample", at.cast("long").alias("pos"), F.lit(0).alias("_kind"), "sentence", "value")
    every = placed.unionByName(sentences.select("sample", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("_kind"), "sentence", F.lit(None).cast("string").alias("value")))
    rows = every.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("pos", "_kind", "sentence", "value"))).alias("r"))
    return rows.select("sample", F.array_join(F.transform("r", lambda x: x["sentence"]), " ").alias("input"), F.array_sort(F.transform(F.filter("r", lambda x: x["_kind"] == 0), lambda x: x["value"])).alias("outputs"))


def variable_chains(spark: SparkSession, chains: int, hops: int) -> DataFrame:
    """(chain, hop, var, source, line): ``VAR a = n`` and ``VAR b = VAR a`` for every hop."""
    rows = spark.range(chains).select(F.col("id").alias("chain")).withColumn("hop", F.explode(F.sequence(F.lit(0), F.lit(hops))))
    name = lambda hop: F.concat(F.lit("V"), F.col("chain").cast("string"), F.lit("X"), hop.cast("string"))
    rows = rows.withColumn("var", name(F.col("hop"))).withColumn("source", F.when(F.col("hop") > 0, name(F.col("hop") - 1)))
    value = seeded_number(F.concat_ws("/", F.lit("chain"), F.col("chain").cast("string")), 42, 5).cast("string")
    return rows.withColumn("line", F.when(F.col("hop") == 0, F.concat(F.lit("VAR "), "var", F.lit(" = "), value)).otherwise(F.concat(F.lit("VAR "), "var", F.lit(" = VAR "), "source")))


def closure(edges: DataFrame, roots: DataFrame, most_hops: int = 64) -> DataFrame:
    """(var, root, hop): every variable that reaches a root through assignments, by a recursive common table expression."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("_span_edges")
    roots.createOrReplaceTempView("_span_roots")
    return spark.sql(f"""
        WITH RECURSIVE reach (var, root, hop) AS (
          SELECT var, var, 0 FROM _span_roots
          UNION ALL
          SELECT e.var, r.root, r.hop + 1 FROM _span_edges e JOIN reach r ON e.source = r.var WHERE r.hop < {int(most_hops)}
        ) SELECT var, root, hop FROM reach""")


def common_words(words: DataFrame, common: int, frequent: int, rare: int, seed: int = 42) -> DataFrame:
    """(sample, no, word) from distinct (sample, word): of each sample the first ``common`` words of the seeded order
    ``frequent`` times, all others ``rare`` times, shuffled and numbered from 1. A sample is one prompt."""
    key = F.concat_ws("/", F.col("sample").cast("string"), "word")
    top = F.row_number().over(Window.partitionBy("sample").orderBy(shuffled(key, seed), "word"))
    rows = words.select("sample", "word", F.when(top <= common, frequent).otherwise(rare).alias("_times"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    place = shuffled(F.concat_ws("/", F.col("sample").cast("string"), "word", F.col("_copy").cast("string")), seed)
    return rows.select("sample", F.row_number().over(Window.partitionBy("sample").orderBy(place, "word")).alias("no"), "word")


def _numbered(sample: int | None, words: dict[str, None], common: int, frequent: int, rare: int, seed: int) -> list[str]:
    """A sample's words in the order of ``common_words``; without a sample that of the words alone."""
    start = f"{seed}:{sample}/"
    # keys of different words or copies are different texts
    key = (lambda text: md5((start + text).encode()).digest()) if sample is not None else str
    order = {key(w): w for w in words}
    top = {order[k] for k in heapq.nsmallest(common, order)}
    order = {key(f"{w}/1"): w for w in words}
    order |= {key(f"{w}/{copy}"): w for w in words for copy in range(2, (frequent if w in top else rare) + 1)}
    if sample is None:
        return sorted(order.values())
    return [order[k] for k in sorted(order)]


def common_words_of_texts(texts: DataFrame, common: int, frequent: int, rare: int, seed: int = 42, most_rows: int = 1 << 16) -> DataFrame:
    """``common_words`` of the words of (sample, text), several texts a sample allowed.

    Texts are exchanged and sorted, not their words; a sample's words are put in order when its last text has come.
    """
    schema = pa.schema([("sample", pa.int64()), ("no", pa.int64()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        sample, words, begun = None, {}, False

        def flush() -> pa.RecordBatch:
            size = np.array([len(w) for _, w in out], np.int64)
            no = np.arange(1, held + 1) - np.repeat(np.cumsum(size) - size, size)
            ids = pa.array([x for x, _ in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), size)))
            return pa.RecordBatch.from_arrays([ids, pa.array(no), pa.array(list(chain.from_iterable(w for _, w in out)), pa.string())], schema=schema)

        def close() -> None:
            nonlocal held
            out.append((sample, _numbered(sample, words, common, frequent, rare, seed)))
            held += len(out[-1][1])

        for batch in batches:
            for one, text in zip(batch.column("sample").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if begun and one != sample:
                    close()
                    words = {}
                    if held >= most_rows:
                        yield flush()
                        out, held = [], 0
                sample, begun = one, True
                words.update(dict.fromkeys(WORD.findall(text)))
        if begun:
            close()
            yield flush()

    rows = texts.where(F.col("text").isNotNull()).select(F.col("sample").cast("long").alias("sample"), "text")
    return rows.repartition("sample").sortWithinPartitions("sample").mapInArrow(run, "sample long, no long, word string")


def joined_corpus(texts: DataFrame, order: list[str], separator: int = 2) -> DataFrame:
    """Texts one after the other as one corpus: each row with its number and the character at which it starts.

    Only totals of sorted ranges pass through one task; the corpus itself never becomes one value.
    """
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    size = F.length("text").cast("long") + separator
    total = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(size).alias("_c"))
    ends = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = total.select("_part", (F.sum("_n").over(ends) - F.col("_n")).alias("_n0"), (F.sum("_c").over(ends) - F.col("_c")).alias("_c0"))
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumns({"_i": F.row_number().over(inside) - 1, "_e": F.sum(size).over(upto) - size}).join(F.broadcast(starts), "_part")
    return rows.select(*texts.columns, (F.col("_n0") + F.col("_i")).alias("number"), (F.col("_c0") + F.col("_e")).alias("start"))


def zeta_counts(spark: SparkSession, total: int, alpha: float, vocabulary: int, zeta: float) -> DataFrame:
    """(rank, n): words of rank k stand int(total * k^-alpha / zeta(alpha)) times."""
    k = F.col("rank").cast("double")
    return spark.range(1, vocabulary + 1).select(F.col("id").alias("rank")).select("rank", F.floor(F.lit(float(total)) * F.pow(k, F.lit(-alpha)) / F.lit(zeta)).cast("long").alias("n"))


def with_distractors(questions: DataFrame, docs: DataFrame, size: int, seed: int = 42, draw: int = 4) -> DataFrame:
    """(q, place, doc_idx, gold): each question's documents and distractors, ``size`` together, in seeded order.

    Of the distractors those of ``more_context`` (documents of the same article) come first, where questions have that
    column, then places drawn per question by seeded hash over the document numbers, ``draw`` times as many as are needed;
    what these leave open is filled by the documents from one more such place on, so that only a corpus of fewer documents
    gives fewer rows. No question meets the whole corpus.
    """
    total = docs.agg(F.count("*").alias("_total"))
    kin = F.coalesce(F.col("more_context"), F.array()) if "more_context" in questions.columns else F.array()
    asked = questions.select("q", F.coalesce(F.col("context"), F.array()).cast("array<bigint>").alias("context"), kin.cast("array<bigint>").alias("more"))

    def number(i: Column) -> Column:
        return F.pmod(F.conv(F.substring(shuffled(F.concat_ws("/", F.col("q").cast("string"), i.cast("string")), seed), 1, 12), 16, 10).cast("long"), F.col("_total"))

    def of(source: Column, step: int) -> DataFrame:
        return asked.select("q", F.explode(source).alias("doc_idx"), F.lit(step).alias("_step"))

    counted = asked.crossJoin(F.broadcast(total))
    drawn = counted.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(size * draw)))).select("q", number(F.col("_i")).alias("doc_idx"), F.lit(2).alias("_step"))
    walk = counted.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(size) + F.size("context") + F.size("more"))))
    walk = walk.select("q", ((number(F.lit(0)) + F.col("_i")) % F.col("_total")).alias("doc_idx"), (F.col("_i") + 3).alias("_step"))
    rows = of(F.col("context"), 0).unionByName(of(F.col("more"), 1)).unionByName(drawn).unionByName(walk)
    rows = rows.groupBy("q", "doc_idx").agg(F.min("_step").alias("_step")).withColumn("gold", F.col("_step") == 0)
    fill = Window.partitionBy("q").orderBy("_step", shuffled(F.concat_ws("/", F.col("q").cast("string"), F.col("doc_idx").cast("string")), seed))
    rows = rows.withColumn("_n", F.row_number().over(fill)).where(F.col("_n") <= size)
    place = Window.partitionBy("q").orderBy(shuffled(F.concat_ws("-", F.col("q").cast("string"), F.col("doc_idx").cast("string")), seed + 1))
    return rows.select("q", F.row_number().over(place).alias("place"), "doc_idx", "gold")


def running_sums(rows: DataFrame, by: str, order: str, sums: dict[str, Column], width: int = 1 << 16) -> DataFrame:
    """``rows`` with running sums per ``by`` in order of ``order``, a whole number that is distinct in its group.

    Ranges of ``width`` numbers are summed first; a window over the ranges' totals gives where each starts, windows
    inside a range the rest. So a group that has most rows is as many tasks as ranges.
    """
    rows = rows.withColumns({f"_{name}": value for name, value in sums.items()}).withColumn("_range", F.floor(F.col(order) / width))
    totals = rows.groupBy(by, "_range").agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_start_{name}") for name in sums))
    inside = Window.partitionBy(by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    out = out.withColumns({name: F.col(f"_start_{name}") + F.sum(f"_{name}").over(inside) for name in sums})
    return out.drop("_range", "_by", "_r", *(f"_{name}" for name in sums), *(f"_start_{name}" for name in sums))


def within_budget(units: DataFrame, budget: int, by: str, order: str, text: str = "text") -> DataFrame:
    """Units in order as long as their tokens together stay within the budget."""
    counted = units.withColumn("tokens", token_count(F.col(text)))
    return running_sums(counted, by, order, {"running": F.col("tokens")}).where(F.col("running") <= budget)


def fitting_units(units: DataFrame, most: int, spare: int, step: int, by: str, order: str, text: str = "text") -> DataFrame:
    """(by, units, tokens): how many units, grown by ``step`` and at the end by what is left, fit ``most`` tokens with ``spare`` ones.

    One step beyond the limit is taken back; a group whose first step doesn't fit has 0 units.
    """
    counted = units.withColumn("tokens", token_count(F.col(text))).select(by, order, "tokens")
    every = counted.groupBy(F.col(by).alias("_key")).agg(F.count("*").alias("_all"))
    rows = running_sums(counted, by, order, {"units": F.lit(1).cast("long"), "used": F.col("tokens")})
    rows = rows.join(every, F.col(by).eqNullSafe(F.col("_key")))
    fits = ((F.col("units") % step == 0) | (F.col("units") == F.col("_all"))) & (F.col("used") + spare <= most)
    out = rows.groupBy(by).agg(F.max(F.when(fits, F.struct("units", "used"))).alias("_best"))
    return out.select(by, F.coalesce("_best.units", F.lit(0)).cast("long").alias("units"), F.coalesce("_best.used", F.lit(0)).cast("long").alias("tokens"))


def chunk_sizes(spark: SparkSession, samples: int, chunks: int, seed: int = 42) -> DataFrame:
    """(chunk, n, seed): samples dealt to chunks, the first ones take what is left over."""
    c = F.col("id")
    return spark.range(chunks).select(c.cast("int").alias("chunk"), (F.lit(samples // chunks) + (c < samples % chunks).cast("int")).cast("long").alias("n"), (c + seed).alias("seed"))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by the values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
