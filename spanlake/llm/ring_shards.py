"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING_BITS, SPREAD_BITS = 12, 4


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """Virtual nodes as (place on the ring, shard), in clockwise order. A shard's nodes don't depend on the others."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big") >> (32 - RING_BITS)
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual))


def loads(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard. No slack: as even as can be, at most one apart."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil((1 + slack) * rows / shards)] * shards


def place(counts: dict[int, int], shards: int, virtual: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """Intervals (cell, first rank, rank after the last, shard, first slot) that put every row of each cell.

    Cells are taken clockwise. A cell's rows go to the next virtual node's shard; what a full shard can't take goes
    on clockwise. The work is that of the ring's cells, whatever the number of rows.
    """
    nodes = ring(shards, virtual)
    places = [p for p, _ in nodes]
    room, used, out = loads(sum(counts.values()), shards, slack), [0] * shards, []
    for cell in sorted(counts):
        at, first, left = bisect.bisect_left(places, cell >> SPREAD_BITS), 0, counts[cell]
        for step in range(len(nodes)):
            if not left:
                break
            s = nodes[(at + step) % len(nodes)][1]
            if n := min(left, room[s] - used[s]):
                out.append((cell, first, first + n, s, used[s]))
                used[s], first, left = used[s] + n, first + n, left - n
    return out


def ring_shards(df: DataFrame, key: str, spread: Column, shards: int = 24, virtual: int = 64, slack: float = 0.0, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with the shard of each row and its place in the shard, gapless from 0.

    Law: row counts. With ``slack`` 0 they are at most one apart; with more, no shard exceeds (1 + slack) times the
    mean and fewer rows move when a shard is added. A key's hash is its place on the ring; rows of one key (null is a
    key) that stand in one place are dealt over 16 cells by ``spread``, so a hot key is no hot task. Only the counts
    of the ring's 65536 cells at most reach the driver, and only their intervals are broadcast, whatever the input.
    An empty table gives no rows. Existing columns named like the new ones are replaced.
    """
    spark = df.sparkSession
    h = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - RING_BITS)
    cell = (h * (1 << SPREAD_BITS) + F.pmod(F.xxhash64(spread), F.lit(1 << SPREAD_BITS))).cast("int")
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(key).alias("_key"), cell.alias("_cell"), spread.alias("_spread"))
    counts = {r["_cell"]: r["count"] for r in rows.groupBy("_cell").count().collect()}
    cuts = place(counts, shards, virtual, slack)
    table = spark.createDataFrame(cuts, "_cell int, _from long, _to long, _shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(F.xxhash64("_key", "_spread"), "_key", "_spread")).cast("long") - 1
    found = rows.withColumn("_rank", rank).join(F.broadcast(table), "_cell").where("_rank >= _from and _rank < _to")
    return found.select(*(F.col(f"_row.`{c}`").alias(c) for c in kept), F.col("_shard").alias(shard_col), (F.col("_slot") + F.col("_rank") - F.col("_from")).alias(slot_col))
