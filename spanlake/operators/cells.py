"""Every query of a group with every key of it, in cells of bounded size: products of matrices instead of rows of pairs.

The pairs stay as many as they are; only a cell's keys and queries travel and meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries whose scores over a cell's keys are held at a time.
STEP = 256


def matrix(col: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and which are not null; null ones are zeros."""
    col = col.combine_chunks()
    there = col.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), dim))
    out[there] = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return out, there


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.reshape(-1))


def meet(keys: DataFrame, queries: DataFrame, by: str, key_id: str, query_id: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, key_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """``run(keys, queries)`` of every cell. Groups of more than ``key_rows`` keys or ``query_rows`` queries are dealt over
    cells by the hashes of their ids; only the counts of those are broadcast. Null groups meet nothing."""
    keys, queries = keys.where(F.col(by).isNotNull()), queries.where(F.col(by).isNotNull())
    count = lambda df, most, name: df.groupBy(by).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    large = F.broadcast(count(keys, key_rows, "_v").join(count(queries, query_rows, "_q"), by).where("_v > 1 or _q > 1"))
    one = {name: F.coalesce(name, F.lit(1)) for name in ("_v", "_q")}

    def dealt(df: DataFrame, own: str, of: str, at: str, other: str, to: str) -> DataFrame:
        df = df.select(*(F.col(c).alias(c) for c in df.columns))  # both sides may be the same table
        rows = df.join(large, by, "left").withColumns(one).withColumn(at, F.pmod(F.xxhash64(own), F.col(of)).cast("int"))
        return rows.withColumn(to, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_v", "_q").groupBy(by, "_vs", "_qs")

    left, right = dealt(keys, key_id, "_v", "_vs", "_q", "_qs"), dealt(queries, query_id, "_q", "_qs", "_v", "_vs")
    empty = run_schema(schema)

    def cell(k: pa.Table, q: pa.Table) -> pa.Table:
        parts = run(k, q) if len(k) and len(q) else []
        return pa.concat_tables(parts) if parts else empty

    return left.cogroup(right).applyInArrow(cell, schema)


def run_schema(schema: str) -> pa.Table:
    """An empty Arrow table of a schema in words."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]).empty_table()


def causal_states(dim: int, scale: float, schema: str):
    """Per query the mergeable state (m, l, o) over the tokens up to its own place; a null query has null states."""
    kind = run_schema(schema).schema

    def run(tokens: pa.Table, queries: pa.Table) -> list[pa.Table]:
        tokens, queries = tokens.sort_by("token_pos"), queries.sort_by("q_pos")
        (k, known), (v, _) = matrix(tokens["key"], dim), matrix(tokens["value"], dim)
        k, v, pos = k[known], v[known], tokens["token_pos"].to_numpy()[known]
        (q, asked), at, out = matrix(queries["query"], dim), queries["q_pos"].to_numpy(), []
        for a in range(0, len(q), STEP):
            b = min(a + STEP, len(q))
            some, every = np.searchsorted(pos, at[b - 1], "right"), np.searchsorted(pos, at[a], "right")
            seen = np.searchsorted(pos, at[a:b], "right") > 0
            if not some:
                continue
            z = q[a:b] @ k[:some].T
            z *= scale
            z[:, every:][pos[None, every:some] > at[a:b, None]] = -np.inf
            m = z.max(1)
            z -= np.where(seen, m, 0)[:, None]
            np.exp(z, out=z)
            rows, null = pa.array(np.flatnonzero(seen) + a), ~asked[a:b][seen]
            state = [queries["head"].take(rows), queries["q_pos"].take(rows), pa.array(m[seen], mask=null), pa.array(z.sum(1)[seen], mask=null)]
            o = lists((z @ v[:some])[seen])
            if null.any():
                o = pa.array([None if gone else x for x, gone in zip(o.to_pylist(), null, strict=True)], o.type)
            out.append(pa.table([*state, o], names=kind.names).cast(kind))
        return out

    return run


def softmax_states(dim: int, scale: float, schema: str):
    """Per query the mergeable state (m, l) over all keys of its cell that are not null."""
    kind = run_schema(schema).schema

    def run(tokens: pa.Table, queries: pa.Table) -> list[pa.Table]:
        k, known = matrix(tokens["key"], dim)
        q, asked = matrix(queries["query"], dim)
        k, q, ids, out = k[known], q[asked], queries["query_id"].to_numpy()[asked], []
        for a in range(0, len(q) if len(k) else 0, STEP):
            z = q[a : a + STEP] @ k.T
            z *= scale
            m = z.max(1)
            z -= m[:, None]
            out.append(pa.table([pa.array(ids[a : a + STEP]), pa.array(m), pa.array(np.exp(z, out=z).sum(1))], schema=kind))
        return out

    return run


def softmax_weights(dim: int, scale: float, schema: str, digits: int = 6):
    """The weight of every pair of a cell, rounded, where queries come with (m, l) over all their keys."""
    kind, unit = run_schema(schema).schema, 10.0**digits

    def run(tokens: pa.Table, queries: pa.Table) -> list[pa.Table]:
        (k, known), (q, asked) = matrix(tokens["key"], dim), matrix(queries["query"], dim)
        m, total = (queries[c].to_numpy().astype(np.float64) for c in ("m", "l"))
        z = q @ k.T
        z *= scale
        z -= m[:, None]
        np.exp(z, out=z)
        z /= total[:, None]
        z = np.floor(z * unit + 0.5) / unit
        null = None if known.all() and asked.all() else ~(asked[:, None] & known[None]).reshape(-1)
        ids, pos = queries["query_id"].to_numpy(), tokens["token_pos"].to_numpy(zero_copy_only=False)
        if tokens["token_pos"].null_count:
            pos = tokens["token_pos"].take(pa.array(np.tile(np.arange(len(k)), len(q)))).combine_chunks()
        else:
            pos = pa.array(np.tile(pos, len(q)))
        return [pa.table([pa.array(np.repeat(ids, len(k))), pos, pa.array(z.reshape(-1), mask=null)], schema=kind)]

    return run


def best_products(dim: int, top: int, schema: str):
    """Per query the ``top`` keys of its cell by inner product, then id; null products last.

    Products of matrices choose whatever may be among them; those are summed again component by component, as SQL does,
    so that equal vectors tie.
    """
    kind = run_schema(schema).schema

    def run(keys: pa.Table, queries: pa.Table) -> list[pa.Table]:
        keys = keys.sort_by("vec_id")
        (k, known), (q, asked) = matrix(keys["embedding"], dim), matrix(queries["qv"], dim)
        long = np.sqrt((k * k).sum(1).max(initial=0)), np.sqrt((q * q).sum(1))
        out, n = [], len(k)
        for a in range(0, len(q), STEP):
            part = q[a : a + STEP]
            z = part @ k.T
            z[:, ~known] = -np.inf
            z[~asked[a : a + STEP]] = -np.inf
            z[np.isnan(z)] = np.inf
            edge = np.partition(z, n - top, axis=1)[:, n - top] if n > top else np.full(len(z), -np.inf)
            r, c = np.nonzero(z >= (edge - 1e-9 * long[0] * long[1][a : a + STEP])[:, None])
            s = np.zeros(len(r))
            for i in range(dim):
                s += part[r, i] * k[c, i]
            null = ~(known[c] & asked[a + r])
            order = np.lexsort((c, np.where(null, np.inf, np.where(np.isnan(s), -np.inf, -s)), r))
            r, c, s, null = r[order], c[order], s[order], null[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < top
            r, c, s, null = pa.array(r[first] + a), pa.array(c[first]), s[first], null[first]
            out.append(pa.table([queries["qid"].take(r), keys["vec_id"].take(c), keys["label"].take(c), pa.array(s, mask=null)], names=kind.names).cast(kind))
        return out

    return run
