"""Operators with state per group: the page cache over decode steps, and centroids under incremental update."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanlake.operators.retrieval import PageCache
from spanlake.operators.updates import Centroids


def cache_hits(accesses: DataFrame, capacity: int, hot: int, buffer_pages: int) -> DataFrame:
    """Hits and misses of every step of a stream (group, step, ord, cluster_id, pages).

    The state is the cache's two lists, bounded by its capacity. A step's rows come in one micro-batch; steps of a
    group arrive in order from one batch to the next.
    """
    kind = dict(accesses.dtypes)["group"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = PageCache.of(capacity, hot, json.loads(state.get[0])) if state.exists else PageCache(capacity, hot)
        pdf = pd.concat(list(frames)).sort_values(["step", "ord"], kind="stable")
        out = []
        for step, part in pdf.groupby("step", sort=True):
            hits, misses = cache.step([(int(c), int(p)) for c, p in zip(part["cluster_id"], part["pages"], strict=True)], buffer_pages)
            out.append((key[0], int(step), len(hits), len(misses)))
        state.update((json.dumps(cache.state()),))
        yield pd.DataFrame(out, columns=["group", "step", "hits", "misses"])

    return accesses.groupBy("group").applyInPandasWithState(run, f"group {kind}, step long, hits long, misses long", "cache string", "append", GroupStateTimeout.NoTimeout)


def centroid_updates(keys: DataFrame, start: dict, threshold: int = 16, batch: int = 16) -> DataFrame:
    """Cluster sizes of each head after every micro-batch of (head, token_pos, key).

    ``start``: head to (centroids, sizes), the index's own metadata. Tokens that don't fill a batch wait in the state.
    """
    kind = dict(keys.dtypes)["head"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        centroid, size = start[key[0]]
        now = Centroids(np.asarray(centroid), np.asarray(size), threshold, batch)
        if state.exists:
            held = json.loads(state.get[0])
            now.c, now.n, now.pending, now.total = (np.array(held[k]) for k in ("c", "n", "pending", "total"))
            now.waiting = [np.array(x) for x in held["waiting"]]
        for v in pd.concat(list(frames)).sort_values("token_pos")["key"]:
            now.add(v)
        state.update((json.dumps({"c": now.c.tolist(), "n": now.n.tolist(), "pending": now.pending.tolist(), "total": now.total.tolist(), "waiting": [x.tolist() for x in now.waiting]}),))
        yield pd.DataFrame({"head": key[0], "cluster_id": np.arange(len(now.n)), "size": now.n, "pending": now.pending, "waiting": len(now.waiting)})

    return keys.groupBy("head").applyInPandasWithState(run, f"head {kind}, cluster_id long, size long, pending long, waiting long", "centroids string", "update", GroupStateTimeout.NoTimeout)
