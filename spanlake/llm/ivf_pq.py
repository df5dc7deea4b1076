"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the codebooks of residual parts are fitted on a bounded sample; every vector is indexed in the
list of its nearest centroid. The number of lists follows the root of the number of vectors. How many lists a query
looks into, and how many vectors are reranked, is measured: for a bounded part of the queries asked, over all vectors, the
fewest that find the wanted share of true neighbours. A query looks into its nearest lists: asymmetric distance tables between the query's residual
and the codebooks rate every vector there by its code; of all its lists together the best rated are reranked exactly on
the original vectors in double precision. Original vectors are only read for those. Lists are
rated twice: first each tells a query its 1st, 2nd, 4th, 8th, ... least rating, which bounds the last rating to rerank;
then it hands on the vectors within that bound, about twice as many as are reranked, however near the lists are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

CODES = 256


def usable(vector: Column, dim: int) -> Column:
    """Not null, of ``dim`` finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of every row of a to every row of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        size = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(size)
        c[full] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size[full])[:-1]]), axis=0) / size[full][:, None]
    return c


class Model:
    """Centroids (lists, dim) and codebooks (parts, CODES, dim / parts): of fixed size."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, rounds: int = 10, seed: int = 11):
        self.centroids = kmeans(sample, lists, rounds, seed)
        rest = sample - self.centroids[distances(sample, self.centroids).argmin(1)]
        self.books = [kmeans(p, CODES, rounds, seed + 1 + i) for i, p in enumerate(np.split(rest, parts, axis=1))]

    def decode(self, near: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centroids[near] + np.concatenate([b[code[:, m]] for m, b in enumerate(self.books)], axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = distances(x, self.centroids).argmin(1)
        rest = np.split(x - self.centroids[near], len(self.books), axis=1)
        return near, np.stack([distances(p, b).argmin(1) for p, b in zip(rest, self.books, strict=True)], 1).astype(np.uint8)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _codes(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)


def _index(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near, code = model.value.encode(_matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("vec_id"), batch.column("row")], ["list", "code", "vec_id", "row"])

    return run


def _probe(model, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = distances(_matrix(batch.column("vector")), model.value.centroids)
                k = min(probes, d.shape[1])
                near = np.argpartition(d, k - 1, axis=1)[:, :k].astype(np.int32)
                rows = pa.array(np.repeat(np.arange(len(batch)), k))
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1)), batch.column("query_id").take(rows), batch.column("vector").take(rows)], ["list", "query_id", "vector"])

    return run


def rate(model: Model, centre: np.ndarray, query: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Asymmetric squared distances of every query to the vectors of one list, by their codes."""
    out = np.zeros((len(query), len(code)), np.float32)
    for m, (part, book) in enumerate(zip(np.split(query - centre, len(model.books), axis=1), model.books, strict=True)):
        out += distances(part, book).astype(np.float32)[:, code[:, m]]
    return out


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest, those of ties by place."""
    if len(x) <= k:
        return np.arange(len(x))
    edge = np.partition(x, k - 1)[k - 1]
    closer = np.flatnonzero(x < edge)
    return np.concatenate([closer, np.flatnonzero(x == edge)[: k - len(closer)]])


def _truth(ask: np.ndarray, who: np.ndarray, top: int):
    """Of a partition's vectors the ``top`` nearest of each trial query, other than its own id."""
    names = ["trial", "gap", "vec_id", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap, ids, best = np.empty((len(ask), 0)), np.empty((len(ask), 0), np.int64), np.empty((len(ask), 0, ask.shape[1]))
        for batch in batches:
            if not len(batch):
                continue
            x, own = _matrix(batch.column("vector")), batch.column("vec_id").to_numpy()
            d = distances(ask, x)
            d[who[:, None] == own[None]] = np.inf
            k = min(top, len(x))
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            gap = np.concatenate([gap, np.take_along_axis(d, near, 1)], 1)
            keep = np.argsort(gap, axis=1, kind="stable")[:, :top]
            ids, best = np.concatenate([ids, own[near]], 1), np.concatenate([best, x[near]], 1)
            gap, ids, best = (np.take_along_axis(gap, keep, 1), np.take_along_axis(ids, keep, 1), np.take_along_axis(best, keep[:, :, None], 1))
        r, c = np.nonzero(np.isfinite(gap))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(gap[r, c]), pa.array(ids[r, c]), pa.array(list(best[r, c]), pa.list_(pa.float64()))], names)

    return run


def _better(model, ask: np.ndarray, who: np.ndarray, place: np.ndarray, probes: int, trial: np.ndarray, rated: np.ndarray):
    """How many vectors of a partition, in the lists a trial query looks into, are rated no worse than each of its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(trial), np.int64)
        for batch in batches:
            if len(batch):
                near, own = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy()
                d = distances(ask, model.value.decode(near, _codes(batch.column("code"))))
                d[(place[:, near] >= probes) | (who[:, None] == own[None])] = np.inf
                for a in range(0, len(trial), 256):
                    count[a : a + 256] += (d[trial[a : a + 256]] <= rated[a : a + 256, None]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trial), dtype=np.int32)), pa.array(count)], ["pair", "n"])

    return run


def effort(model, rows: DataFrame, index: DataFrame, asked: DataFrame, top: int, recall: float, probes: int | None = None, most_queries: int = 200) -> tuple[int, int]:
    """The fewest probed lists, and then vectors to rerank, that find ``recall`` of the true neighbours of ``most_queries``
    of the queries asked among all vectors: neither other queries nor a sample, in which neighbours lie otherwise."""
    fitted = model.value
    lists, by = len(fitted.centroids), F.xxhash64("query_id")
    trial = asked.orderBy(by, "query_id", F.xxhash64("vector")).limit(most_queries).toArrow()
    if not len(trial):
        return probes or lists, top
    ask, who = _matrix(trial.column("vector").combine_chunks()), trial.column("query_id").to_numpy()
    best = F.row_number().over(Window.partitionBy("trial").orderBy("gap", "vec_id"))
    true = rows.select("vec_id", "vector").mapInArrow(_truth(ask, who, top), "trial int, gap double, vec_id long, vector array<double>")
    true = true.withColumn("_n", best).where(F.col("_n") <= top).select("trial", "vector").toArrow()
    if not len(true):
        return probes or lists, top
    of, x = true.column("trial").to_numpy(), _matrix(true.column("vector").combine_chunks())
    order = np.argsort(distances(ask, fitted.centroids), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(lists), order.shape), axis=1)
    near, code = fitted.encode(x)
    # a neighbour is found once its list is among those probed
    depth = place[of, near]
    if probes is None:
        probes = int(np.sort(depth)[int(np.ceil(recall**0.5 * len(depth))) - 1]) + 1
    there = np.flatnonzero(depth < probes)
    if not len(there):
        return probes, top
    rated = ((ask[of] - fitted.decode(near, code)) ** 2).sum(1)[there] * (1 + 1e-5) + 1e-9
    ranks = index.mapInArrow(_better(model, ask, who, place, probes, of[there], rated), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    ranks = np.sort(ranks.select("n").toArrow().column("n").to_numpy())
    return probes, max(int(ranks[min(len(ranks), int(np.ceil(recall * len(depth)))) - 1]), top)


def _rated(model, vectors: pa.Table, queries: pa.Table, c: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each query's place and its ratings of a list's vectors, infinite for its own id."""
    ids = vectors.column("vec_id").to_numpy()
    code = _codes(vectors.column("code"))
    q, who = _matrix(queries.column("vector").combine_chunks()), queries.column("query_id").to_numpy()
    for a in range(0, len(q), 64):
        for r, rated in enumerate(rate(model.value, model.value.centroids[c], q[a : a + 64], code)):
            rated[ids == who[a + r]] = np.inf
            yield a + r, rated


def _bound(model, rerank: int):
    """Each query's 1st, 2nd, 4th, 8th, ... least rating in a list, up to the number to rerank."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        least = []
        if len(vectors) and len(queries):
            for _, rated in _rated(model, vectors, queries, key[0].as_py()):
                rated = np.sort(rated[np.isfinite(rated)])[:rerank]
                least.append(rated[(1 << np.arange(len(rated).bit_length())) - 1])
        who = queries.column("query_id") if least else pa.array([], pa.int64())
        return pa.table({"query_id": who, "rated": pa.array(least, pa.list_(pa.float32()))})

    return run


def _search(model, rerank: int):
    """Of a list's vectors, those that a query may rerank: rated no worse than its bound ``most``."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("rated", pa.float32())])

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return schema.empty_table()
        vectors = vectors.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        ids, rows = vectors.column("vec_id").to_numpy(), vectors.column("row").to_numpy()
        who, most, out = queries.column("query_id").to_numpy(), queries.column("most").to_numpy(), []
        for r, rated in _rated(model, vectors, queries, key[0].as_py()):
            pick = np.flatnonzero((rated <= most[r]) & np.isfinite(rated))
            pick = pick[_least(rated[pick], rerank)]
            out.append((np.full(len(pick), who[r]), ids[pick], rows[pick], rated[pick]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return run


def found_in_lists(index: DataFrame, sizes: DataFrame, ask: DataFrame, model, rerank: int, cell_rows: int, cell_queries: int) -> DataFrame:
    """(query_id, vec_id, row, rated): all that may be among a query's ``rerank`` best rated, and not much more.

    Of a list's ratings up to x at least half stand in its powers of two; where those add up to ``rerank``, x bounds the
    ``rerank``-th rating of all lists. A query of fewer has no bound.
    """
    cells = sizes.join(ask.groupBy("list").agg(F.count("*").alias("k")), "list")
    cells = F.broadcast(cells.select("list", F.ceil(F.col("n") / cell_rows).cast("int").alias("v"), F.ceil(F.col("k") / cell_queries).cast("int").alias("q")))
    own = F.pmod(F.xxhash64("vec_id"), F.col("v")).cast("int")
    left = index.join(cells, "list").select("list", own.alias("vs"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qs"), "code", "vec_id", "row")
    mine = F.pmod(F.xxhash64("query_id"), F.col("q")).cast("int")
    keys = ["list", "vs", "qs"]

    def rated(ask: DataFrame, run, schema: str) -> DataFrame:
        own = [c for c in ask.columns if c != "list"]
        right = ask.join(cells, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("vs"), mine.alias("qs"), *own)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)

    weight = lambda i: F.when(i == 0, 1).otherwise(F.pow(F.lit(2), i - 1)).cast("long")
    least = rated(ask, _bound(model, rerank), "query_id long, rated array<float>")
    least = least.select("query_id", F.transform("rated", lambda x, i: F.struct(x.cast("double").alias("x"), weight(i).alias("n"))).alias("r"))
    least = least.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("r"))).alias("r"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("x"))
    step = lambda s, e: F.struct((s.n + e.n).alias("n"), F.when((s.n < rerank) & (s.n + e.n >= rerank), e.x).otherwise(s.x).alias("x"))
    # a rating may differ in its last digits from run to run of the same product
    bound = least.select("query_id", (F.aggregate("r", start, step, lambda s: s.x) * (1 + 1e-5) + 1e-9).alias("most"))
    ask = ask.join(bound, "query_id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    return rated(ask, _search(model, rerank), "query_id long, vec_id long, row long, rated float")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, top: int = 10, lists: int | None = None, probes: int | None = None, parts: int = 16, rerank: int | None = None, recall: float = 0.97, sample: int = 16384, most_lists: int = 4096, cell_rows: int = 16384, cell_queries: int = 4096) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's ``top`` nearest of all vectors but its own id, by Euclidean distance.

    Ties go to the smaller id. Vectors that are null, zero, of another dimension or hold null or non-finite components,
    and null ids, take no part, neither as query nor as candidate. Repeated ids are candidates of their own. The
    sample is the ``sample`` vectors of smallest hash. ``lists`` is the root of the number of vectors unless given, at
    most ``most_lists`` and a sixteenth of the sample. ``probes`` and ``rerank`` are measured for ``recall`` unless given,
    on 200 of the queries and all vectors. Lists larger than ``cell_rows``, and probed by more than ``cell_queries`` queries,
    are dealt over cells, so a vector that a third of all rows repeat is no single task. Vectors rated alike by code are
    ordered by id; beyond the last rank to rerank those of larger ids are left out, as are exact copies of each other past
    the ``top``. Queries that find fewer than ``top`` look into every list. An empty table gives no rows.
    """
    sc = vectors.sparkSession.sparkContext
    out = "query_id long, rank int, vec_id long, score double"

    def clean(df: DataFrame, name: str) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias(name), v.alias("vector")).where(F.col(name).isNotNull() & usable(F.col("vector"), dim))

    base, asked = clean(vectors, "vec_id"), clean(queries, "query_id")
    total = base.count()
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vector")).limit(sample).select("vector").toArrow()
    if not len(drawn):
        return vectors.sparkSession.createDataFrame([], out)
    drawn = _matrix(drawn.column("vector").combine_chunks())
    lists = lists or int(min(max(8, round(total**0.5)), most_lists, max(1, len(drawn) // 16)))
    fitted = Model(drawn, lists, parts)
    model = sc.broadcast(fitted)
    # a vector's row: rows that share an id and the vector are one candidate, with the number of its copies
    rows = base.groupBy("vec_id", "vector").agg(F.count("*").cast("int").alias("copies")).withColumn("row", F.xxhash64("vec_id", "vector"))
    rows = stash(rows, "vectors")
    index = stash(rows.mapInArrow(_index(model), "list int, code binary, vec_id long, row long"), "index")
    sizes = index.groupBy("list").agg(F.count("*").alias("n"))
    if probes is None or rerank is None:
        measured = effort(model, rows, index, asked, top, recall, probes)
        probes, rerank = probes or measured[0], rerank or measured[1]

    def search(asked: DataFrame, probes: int) -> DataFrame:
        ask = stash(asked.mapInArrow(_probe(model, probes), "list int, query_id long, vector array<double>"), "probes")
        found = found_in_lists(index, sizes, ask, model, rerank, cell_rows, cell_queries)
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("rated", "vec_id", "row"))
        found = found.withColumn("_n", best).where(F.col("_n") <= rerank).select("query_id", "vec_id", "row")
        pairs = found.join(rows.select("vec_id", "row", F.col("vector").alias("x"), "copies"), ["vec_id", "row"]).join(asked.select("query_id", F.col("vector").alias("y")).distinct(), "query_id")
        gap = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)
        pairs = pairs.select("query_id", "vec_id", F.sqrt(gap).alias("score"), F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(top)))).alias("_copy"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

    first = stash(search(asked, probes), "nearest")
    short = asked.join(first.where(F.col("rank") == top).select("query_id"), "query_id", "left_anti")
    if probes >= lists or short.isEmpty():
        return first
    return first.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(search(short, lists))
