"""Softmax attention as aggregation over token rows (head, token_pos, key, value) and queries (head, query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.vectors import dot, sums
from spanlake.operators.cells import causal_states, meet, softmax_states, softmax_weights


def scores(tokens: DataFrame, queries: DataFrame, scale: float, on: tuple[str, ...] = ("head",)) -> DataFrame:
    return tokens.join(queries, list(on)).withColumn("z", dot("key", "query") * F.lit(scale))


def partials(scored: DataFrame, dim: int, by: tuple[str, ...]) -> DataFrame:
    """Per tile the mergeable state (m, l, o): maximum, sum of exponentials, weighted sum of values."""
    m = scored.groupBy(*by).agg(F.max("z").alias("m"))
    rows = scored.join(m, list(by)).withColumn("w", F.exp(F.col("z") - F.col("m")))
    out = rows.groupBy(*by).agg(F.first("m").alias("m"), F.sum("w").alias("l"), *sums("value", dim, F.col("w")))
    return out.select(*by, "m", "l", F.array(*(F.col(f"_s{i}") for i in range(dim))).alias("o"))


def merge(parts: DataFrame, dim: int, by: tuple[str, ...]) -> DataFrame:
    """The states of several tiles as one output vector: weights are rescaled to the common maximum."""
    rows = parts.withColumn("_w", F.exp(F.col("m") - F.max("m").over(Window.partitionBy(*by))))
    out = rows.groupBy(*by).agg(F.sum(F.col("l") * F.col("_w")).alias("_l"), *sums("o", dim, F.col("_w")))
    return out.select(*by, F.array(*(F.col(f"_s{i}") / F.col("_l") for i in range(dim))).alias("out"))


def finished(parts: DataFrame, dim: int, by: tuple[str, ...]) -> DataFrame:
    """The output vectors of states that have nothing to be merged with."""
    return parts.select(*by, F.array(*(F.element_at("o", i + 1) / F.col("l") for i in range(dim))).alias("out"))


def attend(tokens: DataFrame, queries: DataFrame, dim: int, scale: float, by: tuple[str, ...] = ("head",)) -> DataFrame:
    """Exact attention: each query over all tokens of its head. One pass of partial sums after that of the maximum."""
    return finished(partials(scores(tokens, queries, scale), dim, by), dim, by)


def attend_tiled(tokens: DataFrame, queries: DataFrame, dim: int, scale: float, tile: Column, by: tuple[str, ...] = ("head",)) -> DataFrame:
    """The same over tiles of tokens that are merged afterwards; equal to one shot."""
    scored = scores(tokens, queries, scale).withColumn("_tile", tile)
    return merge(partials(scored, dim, (*by, "_tile")), dim, by)


def attend_causal(tokens: DataFrame, queries: DataFrame, dim: int, scale: float, key_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """Each query (head, q_pos, query) over the tokens of its head up to its own place: quadratic by definition.

    Pairs are scored in cells of at most about ``key_rows`` tokens and ``query_rows`` queries, whose states are merged.
    """
    head = dict(tokens.dtypes)["head"]
    schema = f"head {'long' if head == 'bigint' else head}, q_pos long, m double, l double, o array<double>"
    run = causal_states(dim, scale, schema)
    tokens = tokens.where("token_pos is not null").select("head", F.col("token_pos").cast("long").alias("token_pos"), "key", "value")
    queries = queries.where("q_pos is not null").select("head", F.col("q_pos").cast("long").alias("q_pos"), "query")
    parts = meet(tokens, queries, "head", "token_pos", "q_pos", run, schema, key_rows, query_rows)
    return merge(parts, dim, ("head", "q_pos"))


def softmax_rows(tokens: DataFrame, queries: DataFrame, dim: int, scale: float, key_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """(query_id, token_pos, weight): each query's (head, query_id, query) weights over its head's tokens, to 6 digits.

    Maximum and sum of exponentials of a query come first, from cells of the pairs; then the weights, from smaller cells.
    """
    state, out = "query_id long, m double, l double", "query_id long, token_pos long, weight double"
    tokens, queries = tokens.select("head", "token_pos", "key"), queries.select("head", "query_id", "query")
    parts = meet(tokens, queries, "head", "token_pos", "query_id", softmax_states(dim, scale, state), state, key_rows, query_rows)
    parts = parts.withColumn("_m", F.max("m").over(Window.partitionBy("query_id")))
    whole = parts.groupBy("query_id").agg(F.first("_m").alias("m"), F.sum(F.col("l") * F.exp(F.col("m") - F.col("_m"))).alias("l"))
    asked = queries.join(whole, "query_id", "left")
    return meet(tokens, asked, "head", "token_pos", "query_id", softmax_weights(dim, scale, out), out, max(1, key_rows // 4), max(1, query_rows // 16))


def greedy(logits: DataFrame, by: str = "row") -> DataFrame:
    """Token of the largest logit, the smaller token among equals."""
    return logits.groupBy(by).agg(F.min_by("token", F.struct(-F.col("logit"), F.col("token"))).alias("token"))


def filtered(logits: DataFrame, top_k: int | None = None, top_p: float | None = None, temperature: float = 1.0, by: str = "row") -> DataFrame:
    """Tokens left by top-k, then the shortest prefix by probability that reaches top-p; probabilities renormalised."""
    order = Window.partitionBy(by).orderBy(F.desc("logit"), "token")
    everything = Window.partitionBy(by)
    rows = logits.withColumn("rank", F.row_number().over(order))
    if top_k is not None:
        rows = rows.where(F.col("rank") <= top_k)
    rows = rows.withColumn("w", F.exp((F.col("logit") - F.max("logit").over(everything)) / temperature))
    rows = rows.withColumn("p", F.col("w") / F.sum("w").over(everything))
    before = F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("p")
    if top_p is not None:
        rows = rows.withColumn("_before", before).where(F.col("_before") < top_p)
    return rows.select(by, "token", "rank", (F.col("p") / F.sum("p").over(everything)).alias("p"))


def drawn(left: DataFrame, seed: int = 0, by: str = "row") -> DataFrame:
    """One token of each row's filtered probabilities (row, token, rank, p): the first by rank whose running sum exceeds a seeded uniform number."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(by).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    upto = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = left.withColumn("_upto", F.sum("p").over(upto)).withColumn("_last", F.max("rank").over(Window.partitionBy(by)))
    return rows.where((F.col("_upto") > u) | (F.col("rank") == F.col("_last"))).groupBy(by).agg(F.min_by("token", "rank").alias("token"))


def until_stop(steps: DataFrame, stops: list[int], by: str = "seq") -> DataFrame:
    """Generated tokens (seq, step, token) of each sequence up to and with its first stop token."""
    hit = F.col("token").isin(stops).cast("int")
    before = F.max(hit).over(Window.partitionBy(by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("_done", F.coalesce(before, F.lit(0))).where("_done = 0").drop("_done")
