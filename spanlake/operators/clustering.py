"""Clustering of key vectors and construction of inverted multi-indexes as DataFrames.

A token table has ``head``, ``token_pos`` and ``key``. All steps are partitioned by head and, beyond it, by cluster, so
that a head with a third of all tokens is no single task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.params import cluster_counts
from spanlake.functions.vectors import gathered, l2_squared, subvector, sums


def assign(tokens: DataFrame, codebook: DataFrame, vector: str = "key", on: tuple[str, ...] = ("head",)) -> DataFrame:
    """Nearest centroid of each token by squared distance, the lowest id among equals.

    The codebook is grouped into one array per key, so that a token meets its centroids in one row and no pairs are
    shuffled. A codebook is of the order of tokens / 16 per head at most; it is broadcast only as far as Spark's
    own size check allows.
    """
    book = codebook.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("cluster_id", "centroid"))).alias("_book"))
    near = F.array_min(F.transform("_book", lambda c: F.struct(l2_squared(F.col(vector), c["centroid"]).alias("dist2"), c["cluster_id"].alias("cluster_id"))))
    joined = tokens.join(book, list(on)) if on else tokens.crossJoin(F.broadcast(book))
    return joined.withColumn("_near", near).select(*tokens.columns, F.col("_near.cluster_id").alias("cluster_id"), F.col("_near.dist2").alias("dist2"))


def means(assigned: DataFrame, dim: int, vector: str = "key", by: tuple[str, ...] = ("head", "cluster_id")) -> DataFrame:
    """Size and mean vector of each cluster, by partial sums; null vectors count for the size alone."""
    out = assigned.groupBy(*by).agg(F.count("*").alias("size"), F.nullif(F.count(vector), F.lit(0)).alias("_known"), *sums(vector, dim))
    return out.select(*by, "size", gathered(dim, F.col("_known")).alias("centroid"))


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int, least_rounds: int = 1, tol: float = 1e-4, rel_tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Seeded k-means++ start, then Lloyd steps with early stopping and a final assignment; (centroids, labels, inertias).

    Empty clusters are seeded anew from random samples. Ties go to the lowest id.
    """
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    k = min(k, len(x))
    centre = [x[rng.integers(len(x))]]
    gap = ((x - centre[0]) ** 2).sum(1)
    while len(centre) < k:
        total = gap.sum()
        pick = int(np.searchsorted(np.cumsum(gap), rng.random() * total)) if total > 0 else int(rng.integers(len(x)))
        centre.append(x[min(pick, len(x) - 1)])
        gap = np.minimum(gap, ((x - centre[-1]) ** 2).sum(1))
    c, last, inertias = np.stack(centre), np.inf, []

    def nearest() -> tuple[np.ndarray, float]:
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]
        label = d.argmin(1)
        return label, float(np.maximum(d[np.arange(len(x)), label], 0).sum())

    for step in range(1, rounds + 1):
        label, now = nearest()
        inertias.append(now)
        if step >= least_rounds and (abs(last - now) <= tol or (np.isfinite(last) and last > 0 and abs(last - now) / last <= rel_tol)):
            break
        last = now
        size = np.bincount(label, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        full = size > 0
        c[full] = total[full] / size[full][:, None]
        for empty in np.flatnonzero(~full):
            c[empty] = x[rng.integers(len(x))]
    label, now = nearest()
    return c, label, [*inertias, now]


@dataclass(frozen=True)
class ImiIndex:
    """codes (head, token_pos, code0.., global_id), codebook (head, part, code, centroid), clusters and lists."""

    codes: DataFrame
    codebook: DataFrame
    clusters: DataFrame
    lists: DataFrame


def product_id(codes: list[Column], counts: tuple[int, ...]) -> Column:
    """Mixed-radix combination of the parts' codes, as a BIGINT."""
    out = codes[0].cast("long")
    for c, k in zip(codes[1:], counts[1:], strict=True):
        out = out * k + c
    return out


def seeded_codebook(tokens: DataFrame, counts: tuple[int, ...], dim: int, vector: str = "key") -> DataFrame:
    """The first k tokens of each head as centroids of each part: a deterministic start of one step."""
    parts = len(counts)
    width = dim // parts
    rank = F.row_number().over(Window.partitionBy("head").orderBy("token_pos")) - 1
    first = tokens.withColumn("cluster_id", rank).where(F.col("cluster_id") < max(counts))
    rows = first.select("head", "cluster_id", F.posexplode(F.array(*(subvector(vector, p, width) for p in range(parts)))).alias("part", "centroid"))
    limit = F.element_at(F.array(*map(F.lit, counts)), F.col("part") + 1)
    return rows.where(F.col("cluster_id") < limit).select("head", "part", "cluster_id", "centroid")


def trained_codebook(tokens: DataFrame, counts: tuple[int, ...], dim: int, vector: str = "key", rounds: int = 20, seed: int = 42, sample: int = 65536) -> DataFrame:
    """k-means of each head and part on at most ``sample`` tokens of it (those of smallest hash); seeds differ by part."""
    parts = len(counts)
    width = dim // parts
    drawn = F.row_number().over(Window.partitionBy("head").orderBy(F.xxhash64("token_pos"), "token_pos"))
    rows = tokens.withColumn("_drawn", drawn).where(F.col("_drawn") <= sample)
    rows = rows.select("head", "token_pos", F.posexplode(F.array(*(subvector(vector, p, width) for p in range(parts)))).alias("part", "sub"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token_pos")
        c, _, _ = lloyd(np.stack(pdf["sub"].to_numpy()), counts[int(key[1])], rounds, seed + int(key[1]))
        return pd.DataFrame({"head": key[0], "part": key[1], "cluster_id": np.arange(len(c)), "centroid": list(c.tolist())})

    kind = dict(tokens.dtypes)["head"]
    return rows.groupBy("head", "part").applyInPandas(run, f"head {kind}, part int, cluster_id int, centroid array<double>")


def encode(tokens: DataFrame, codebook: DataFrame, counts: tuple[int, ...], dim: int, vector: str = "key") -> DataFrame:
    """Codes of each part and their product id, one row per token."""
    parts = len(counts)
    width = dim // parts
    book = codebook.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("part", "cluster_id", "centroid"))).alias("_book"))
    rows = tokens.join(book, "head")

    def code(p: int) -> Column:
        mine = F.filter("_book", lambda c: c["part"] == p)
        gaps = F.transform(mine, lambda c: F.struct(l2_squared(subvector(vector, p, width), c["centroid"]).alias("d"), c["cluster_id"].alias("cluster_id")))
        return F.array_min(gaps)["cluster_id"]

    rows = rows.withColumns({f"code{p}": code(p) for p in range(parts)})
    return rows.select(*tokens.columns, *(f"code{p}" for p in range(parts)), product_id([F.col(f"code{p}") for p in range(parts)], counts).alias("global_id"))


def compact(codes: DataFrame) -> DataFrame:
    """Used product ids of each head renumbered from 0 in ascending order, with sizes and exclusive offsets.

    Clusters are counted first; windows then run over clusters, not tokens.
    """
    used = codes.groupBy("head", "global_id").agg(F.count("*").alias("size"))
    order = Window.partitionBy("head").orderBy("global_id")
    ends = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return used.select("head", "global_id", (F.row_number().over(order) - 1).cast("long").alias("cluster_id"), "size", (F.sum("size").over(ends) - F.col("size")).alias("offset"))


def merged_centroids(clusters: DataFrame, codebook: DataFrame, counts: tuple[int, ...]) -> DataFrame:
    """Each used cluster's centroid: its parts' centroids one after the other."""
    left, rows = F.col("global_id"), clusters
    for p in range(len(counts) - 1, 0, -1):
        rows = rows.withColumn(f"_c{p}", F.pmod(left, F.lit(counts[p])).cast("int"))
        left = F.floor(left / counts[p]).cast("long")
    rows = rows.withColumn("_c0", left.cast("int"))
    for p in range(len(counts)):
        part = codebook.where(F.col("part") == p).select("head", F.col("cluster_id").alias(f"_c{p}"), F.transform("centroid", lambda x: x.cast("double")).alias(f"_v{p}"))
        rows = rows.join(part, ["head", f"_c{p}"])
    return rows.select(*clusters.columns, F.concat(*(F.col(f"_v{p}") for p in range(len(counts)))).alias("centroid"))


def reorganize(codes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Tokens in cluster-contiguous order, original order inside a cluster: ``list_pos`` = offset + rank in the cluster."""
    rank = F.row_number().over(Window.partitionBy("head", "global_id").orderBy("token_pos")) - 1
    rows = codes.withColumn("_rank", rank).join(clusters.select("head", "global_id", "cluster_id", "offset"), ["head", "global_id"])
    return rows.select(*codes.columns, "cluster_id", (F.col("offset") + F.col("_rank")).alias("list_pos"))


def build_index(tokens: DataFrame, dim: int, parts: int = 2, counts: tuple[int, ...] | None = None, trained: bool = True, rounds: int = 20, seed: int = 42) -> ImiIndex:
    """Codebooks, codes, cluster metadata and reorganised lists of a token table (the union of all its chunks)."""
    if counts is None:
        most = tokens.groupBy("head").count().agg(F.max("count")).first()[0] or 0
        counts = cluster_counts(most, parts)
    book = trained_codebook(tokens, counts, dim, rounds=rounds, seed=seed) if trained else seeded_codebook(tokens, counts, dim)
    codes = encode(tokens, book, counts, dim)
    clusters = merged_centroids(compact(codes), book, counts)
    return ImiIndex(codes, book, clusters, reorganize(codes, clusters))


def append(clusters: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cluster metadata with newly built clusters after the last: ids and offsets shifted by what each head has."""
    have = clusters.groupBy("head").agg(F.count("*").alias("_n"), F.sum("size").alias("_t"))
    moved = fresh.join(have, "head", "left").select("head", "global_id", (F.col("cluster_id") + F.coalesce("_n", F.lit(0))).alias("cluster_id"), "size", (F.col("offset") + F.coalesce("_t", F.lit(0))).alias("offset"))
    return clusters.select("head", "global_id", "cluster_id", "size", "offset").unionByName(moved)


def index_stats(clusters: DataFrame, capacity: DataFrame, target: int = 16, dim: int = 64) -> DataFrame:
    """Ideal and real number of clusters, share of non-empty ones and bytes of centroids."""
    total = capacity.groupBy("head").count().agg(F.sum(F.col("count") / target).alias("ideal"))
    real = clusters.agg(F.count("*").alias("clusters"), F.sum((F.col("size") > 0).cast("long")).alias("non_empty"), F.max("size").alias("largest"))
    return real.crossJoin(total).select("clusters", F.round("ideal", 6).alias("ideal"), F.round(F.col("non_empty") / F.col("clusters"), 6).alias("non_empty_ratio"), "largest", (F.col("clusters") * dim * 4).alias("centroid_bytes"))
