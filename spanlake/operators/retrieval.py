"""Budgeted retrieval of clusters: scoring, selection, page planning, joins to lists, and a cache simulator."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.params import PAGE
from spanlake.functions.vectors import dot, gathered, sums
from spanlake.operators.cells import best_products, meet


def group_similarity(queries: DataFrame, clusters: DataFrame, dim: int) -> DataFrame:
    """Inner product of each centroid with the sum of its head's queries (neither averaged nor normalised).

    A head's queries are few (the query group of one decode step), so their sums are one small row a head.
    """
    q = queries.groupBy("head").agg(*sums("query", dim)).select("head", gathered(dim).alias("_q"))
    return clusters.join(q, "head").withColumn("similarity", dot("centroid", "_q")).drop("_q")


def select_clusters(scored: DataFrame, probes: int, token_budget: int, by: str = "head") -> DataFrame:
    """The ``probes`` best clusters of each head, kept while the tokens before them are under the budget.

    The cluster that crosses the budget stays; empty clusters go. Ties: smaller id. ``rank`` counts from 1.
    """
    order = Window.partitionBy(by).orderBy(F.desc("similarity"), "cluster_id")
    ends = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= probes)
    return top.withColumn("prefix", F.sum("size").over(ends) - F.col("size")).where((F.col("size") > 0) & (F.col("prefix") < token_budget))


def page_count(size: Column | str, page: int = PAGE) -> Column:
    c = F.col(size) if isinstance(size, str) else size
    return F.ceil(c / page).cast("long")


def page_gate(selected: DataFrame, buffer_pages: int, by: str = "head", page: int = PAGE) -> DataFrame:
    """Clusters in rank order until their pages together exceed the buffer."""
    ends = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = selected.withColumn("pages", page_count("size", page)).where("pages > 0")
    return rows.withColumn("running_pages", F.sum("pages").over(ends)).where(F.col("running_pages") <= buffer_pages)


def expand_blocks(clusters: DataFrame, by: str = "head", page: int = PAGE) -> DataFrame:
    """One row per page: full pages, then what is left; ``dst_offset`` is where its first vector goes."""
    rows = clusters.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), page_count("size", page) - 1)))
    rows = rows.withColumn("block_size", F.least(F.lit(page).cast("long"), F.col("size") - F.col("block") * page))
    ends = Window.partitionBy(by).orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("dst_offset", F.sum("block_size").over(ends) - F.col("block_size"))


def cluster_tiles(selected: DataFrame, buffer_pages: int, by: str = "head", page: int = PAGE) -> DataFrame:
    """Greedy tiles of clusters in rank order, each within the buffer; a cluster above it ends the packing of its head."""
    kind = dict(selected.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        tiles, tile, used = [], 0, 0
        for size in pdf["size"]:
            need = -(-int(size) // page)
            if need > buffer_pages:
                break
            if used + need > buffer_pages:
                tile, used = tile + 1, 0
            used += need
            tiles.append(tile)
        return pdf.head(len(tiles)).assign(tile=tiles)[[by, "rank", "cluster_id", "size", "tile"]]

    return selected.groupBy(by).applyInPandas(run, f"{by} {kind}, rank int, cluster_id long, size long, tile int")


def members(selected: DataFrame, lists: DataFrame) -> DataFrame:
    """Tokens of the selected clusters, by an equi-join on head and cluster."""
    return lists.join(selected.select("head", "cluster_id", "rank"), ["head", "cluster_id"])


def members_by_range(selected: DataFrame, lists: DataFrame, bucket: int = 64) -> DataFrame:
    """The same by place ranges [offset, offset + size): both sides meet in buckets of places, then the range is tested."""
    last = F.floor((F.col("offset") + F.col("size") - 1) / bucket)
    spans = selected.where("size > 0").select("head", "cluster_id", "rank", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / bucket), last)).alias("_bucket"))
    places = lists.drop("cluster_id").withColumn("_bucket", F.floor(F.col("list_pos") / bucket))
    found = places.join(spans, ["head", "_bucket"]).where("list_pos >= offset and list_pos < offset + size")
    return found.drop("_bucket", "offset", "size")


def concat_sources(parts: list[tuple[str, DataFrame]], by: str = "head", order: str = "token_pos", most: int | None = None) -> DataFrame:
    """Steady, missed and cached tokens one after the other, with their source and place in the execution buffer."""
    rows = None
    for i, (name, df) in enumerate(parts):
        part = df.withColumns({"source": F.lit(name), "_source": F.lit(i)})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(by).orderBy("_source", order)) - 1
    rows = rows.withColumn("dst_pos", place.cast("long")).drop("_source")
    return rows if most is None else rows.where(F.col("dst_pos") < most)


def gather_window(tokens: DataFrame, index: DataFrame, start: int, length: int, by: str = "head") -> DataFrame:
    """Tokens by a window of an index list (head, i, idx): each with its place in the window, by an equi-join."""
    window = index.where((F.col("i") >= start) & (F.col("i") < start + length)).select(by, "idx", (F.col("i") - start).alias("dst_pos"))
    return tokens.join(window, (tokens[by] == window[by]) & (tokens["token_pos"] == window["idx"])).drop(window[by])


def by_priority(jobs: DataFrame, layer: str, arrival: str) -> DataFrame:
    """Jobs with their place, from 0, in order of layer and arrival; only totals of sorted ranges pass through one task."""
    ranged = jobs.repartitionByRange(layer, arrival).sortWithinPartitions(layer, arrival).withColumn("_part", F.spark_partition_id())
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(layer, arrival))
    return ranged.withColumn("_i", inside - 1).join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")


def warm_up(clusters: DataFrame, k: int, seed: int = 0, by: str = "head") -> DataFrame:
    """Up to ``k`` non-empty clusters of each head in a seeded pseudo-random order."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(by), F.col("cluster_id"))), "cluster_id")
    return clusters.where("size > 0").withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= k)


def best_by_product(keys: DataFrame, queries: DataFrame, dim: int, top: int, key_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """(qid, vec_id, label): the ``top`` keys (vec_id, embedding, label) of each query (qid, qv) by inner product, ties by id.

    All pairs, in cells of bounded size; each hands on its own best ones.
    """
    schema = "qid long, vec_id long, label int, s double"
    one = lambda df: df.withColumn("_all", F.lit(0))
    found = meet(one(keys), one(queries), "_all", "vec_id", "qid", best_products(dim, top, schema), schema, key_rows, query_rows)
    order = Window.partitionBy("qid").orderBy(F.desc("s"), F.asc_nulls_last("vec_id"))
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).select("qid", "vec_id", "label")


class PageCache:
    """Two-tier page cache of clusters: a hot list and a cold list, most recent first.

    A hit moves to the hot head (a cluster larger than the hot tier goes to the cold head); the hot tail falls to the
    cold head while the hot tier is over its capacity. Missed clusters are admitted in order as long as their pages
    together fit the cache, after the cold tail, then the hot tail, made room.
    """

    def __init__(self, capacity: int, hot: int):
        self.capacity, self.hot_capacity = capacity, hot
        self.hot: OrderedDict = OrderedDict()
        self.cold: OrderedDict = OrderedDict()

    def used(self) -> int:
        return sum(self.hot.values()) + sum(self.cold.values())

    def step(self, wanted: list[tuple[int, int]], buffer_pages: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(hits, misses) of clusters with their pages, in order, up to the buffer; then the cache changes."""
        taken, total = [], 0
        for name, need in wanted:
            if need == 0:
                continue
            total += need
            if total > buffer_pages:
                break
            taken.append((name, need))
        hits = [x for x in taken if x[0] in self.hot or x[0] in self.cold]
        misses = [x for x in taken if x[0] not in self.hot and x[0] not in self.cold]
        for name, need in reversed(hits):
            if name in self.hot:
                self.hot.move_to_end(name)
            elif need > self.hot_capacity:
                self.cold.move_to_end(name)
            else:
                del self.cold[name]
                self.hot[name] = need
                while sum(self.hot.values()) > self.hot_capacity:
                    old, size = self.hot.popitem(last=False)
                    self.cold[old] = size
        admitted, room = deque(), 0
        for name, need in misses:
            if room + need > self.capacity:
                break
            room += need
            admitted.append((name, need))
        free = self.capacity - self.used()
        while admitted and free < room:
            free += (self.cold or self.hot).popitem(last=False)[1]
        self.cold.update(admitted)
        return hits, misses

    def state(self) -> dict:
        return {"hot": [list(x) for x in self.hot.items()], "cold": [list(x) for x in self.cold.items()]}

    @classmethod
    def of(cls, capacity: int, hot: int, state: dict) -> PageCache:
        out = cls(capacity, hot)
        out.hot.update((a, b) for a, b in state["hot"])
        out.cold.update((a, b) for a, b in state["cold"])
        return out


def replay(trace: DataFrame, capacity: int, hot: int, buffer_pages: int) -> DataFrame:
    """Hits and misses of each step of a trace (group, step, ord, cluster_id, pages), one sequential fold per group.

    The fold's batches arrive in order of steps; only the cache's state, of bounded size, is kept between them.
    """
    kinds = dict(trace.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, group, step, wanted = PageCache(capacity, hot), None, None, []

        def close() -> list[tuple]:
            hits, misses = cache.step(wanted, buffer_pages)
            return [(group, step, len(hits), len(misses), sum(x[1] for x in hits), sum(x[1] for x in misses))]

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.group, r.step) != (group, step):
                    if step is not None:
                        out += close()
                    if r.group != group:
                        cache = PageCache(capacity, hot)
                    group, step, wanted = r.group, r.step, []
                wanted.append((r.cluster_id, r.pages))
            yield pd.DataFrame(out, columns=["group", "step", "hits", "misses", "hit_pages", "miss_pages"])
        if step is not None:
            yield pd.DataFrame(close(), columns=["group", "step", "hits", "misses", "hit_pages", "miss_pages"])

    rows = trace.repartition("group").sortWithinPartitions("group", "step", "ord")
    return rows.mapInPandas(run, f"group {kinds['group']}, step {kinds['step']}, hits long, misses long, hit_pages long, miss_pages long")
