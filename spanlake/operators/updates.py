"""Incremental maintenance of centroids while tokens arrive, and the ring of recent tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent(tokens: DataFrame, size: int = 512, by: str = "head") -> DataFrame:
    """The last ``size`` tokens of each group."""
    order = Window.partitionBy(by).orderBy(F.desc("token_pos"))
    return tokens.withColumn("_back", F.row_number().over(order)).where(F.col("_back") <= size).drop("_back")


def delta_members(recent_tokens: DataFrame, selected: DataFrame, room: int | None = None, by: str = "head") -> DataFrame:
    """Recent tokens whose cluster was selected, at most ``room`` of each group in order of place."""
    rows = recent_tokens.join(selected.select(by, "cluster_id"), [by, "cluster_id"], "left_semi")
    if room is None:
        return rows
    place = F.row_number().over(Window.partitionBy(by).orderBy("token_pos"))
    return rows.withColumn("_place", place).where(F.col("_place") <= room).drop("_place")


class Centroids:
    """Centroids of one group under incremental update.

    A full batch of keys is assigned by inner product to the centroids from before the batch (empty clusters and ties:
    never, lowest id); a cluster whose pending keys reach the threshold takes them into its mean.
    """

    def __init__(self, centroid: np.ndarray, size: np.ndarray, threshold: int = 16, batch: int = 16):
        self.c, self.n = centroid.astype(np.float64).copy(), size.astype(np.int64).copy()
        self.threshold, self.batch = threshold, batch
        self.pending, self.total = np.zeros(len(self.n), np.int64), np.zeros_like(self.c)
        self.waiting: list[np.ndarray] = []

    def add(self, key: np.ndarray) -> list[int]:
        """Cluster ids of a completed batch, in order; empty until it is complete."""
        self.waiting.append(np.asarray(key, np.float64))
        if len(self.waiting) < self.batch:
            return []
        keys, self.waiting = np.stack(self.waiting), []
        near = np.where(self.n > 0, keys @ self.c.T, -np.inf).argmax(1)
        np.add.at(self.pending, near, 1)
        np.add.at(self.total, near, keys)
        full = np.flatnonzero(self.pending >= self.threshold)
        n = self.n[full] + self.pending[full]
        self.c[full] = (self.c[full] * self.n[full][:, None] + self.total[full]) / np.maximum(n, 1)[:, None]
        self.n[full] = n
        self.pending[full], self.total[full] = 0, 0
        return near.tolist()


def fold(tokens: DataFrame, clusters: DataFrame, threshold: int = 16, batch: int = 16) -> DataFrame:
    """Centroids after all tokens of each head, added in order of place: (head, cluster_id, size, pending, centroid).

    A head's tokens stream through its task in batches of rows; only its centroids stay in memory.
    """
    kind = dict(clusters.dtypes)["head"]
    # clusters first, then tokens, of each head
    rows = clusters.select("head", F.lit(0).alias("_kind"), F.col("cluster_id").cast("long").alias("_at"), F.col("size").cast("long").alias("_n"), F.col("centroid").cast("array<double>").alias("_v"))
    rows = rows.unionByName(tokens.select("head", F.lit(1).alias("_kind"), F.col("token_pos").cast("long").alias("_at"), F.lit(0).cast("long").alias("_n"), F.col("key").cast("array<double>").alias("_v")))
    rows = rows.repartition("head").sortWithinPartitions("head", "_kind", "_at")
    names = ["head", "cluster_id", "size", "pending", "centroid"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, ids, sizes, centres, state = None, [], [], [], None

        def opened() -> Centroids:
            return Centroids(np.stack(centres), np.array(sizes), threshold, batch)

        def closed() -> pd.DataFrame:
            s = state or opened()
            return pd.DataFrame({"head": head, "cluster_id": ids, "size": s.n, "pending": s.pending, "centroid": list(s.c.tolist())})[names]

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r[0] != head:
                    if ids:
                        yield closed()
                    head, ids, sizes, centres, state = r[0], [], [], [], None
                if r[1] == 0:
                    ids.append(r[2])
                    sizes.append(r[3])
                    centres.append(np.asarray(r[4]))
                elif ids:
                    state = state or opened()
                    state.add(r[4])
        if ids:
            yield closed()

    return rows.mapInPandas(run, f"head {kind}, cluster_id long, size long, pending long, centroid array<double>")


def reset_sequences(state: DataFrame, asked: DataFrame) -> DataFrame:
    """(seq_id, reused, capacity, heads, tokens) for the next requests (seq_id, length, heads).

    A state (seq_id, capacity, heads, tokens) of enough capacity and as many heads is kept and emptied; otherwise, and
    where there is none, a new one of the request's length takes its place.
    """
    fits = (F.col("s.capacity") >= F.col("a.length")) & (F.col("s.heads") == F.col("a.heads"))
    rows = asked.alias("a").join(state.alias("s"), "seq_id", "left").withColumn("reused", F.coalesce(fits, F.lit(False)))
    return rows.select("seq_id", "reused", F.when(F.col("reused"), F.col("s.capacity")).otherwise(F.col("a.length")).cast("long").alias("capacity"), F.col("a.heads").alias("heads"), F.lit(0).cast("long").alias("tokens"))
