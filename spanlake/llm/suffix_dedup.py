"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``least`` (50) bytes that covers it also starts in a document with a smaller id.

The corpus has no single suffix array. Every window of 50 bytes is dealt by its minimiser, the smallest hash among its
k-byte pieces, so equal windows meet; neighbouring windows with one minimiser travel as one string. Three passes over
documents, each dealt by chunks of bounded size:

1. every chunk sends its distinct minimisers; those found in one document only can't mark a repeat and fall away; the
   strings of one that stands ``hot`` times or more go on window by window, dealt by the windows' own hashes, so that
   a piece in a third of all documents, each time in other surroundings, is no single block;
2. every chunk sends the distinct strings of the others with the smallest document id it has seen; where one minimiser
   has several distinct strings, their suffixes are sorted, the Burrows-Wheeler transform is formed, and intervals of
   common prefixes grow by one byte a step, breadth first, by backward extension, until the length is reached; each
   interval's smallest id is the first document of that window;
3. every chunk marks its documents' windows whose first document is smaller.

Copies collapse inside a chunk before they travel, so a passage in a third of all documents costs a chunk one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import chunk_for, free_shuffles, shards_for, stash, text_bytes

U = np.uint64
LAST = np.iinfo(np.int64).max
PIECE = 24
MOST_RUN = 64
SEED = 7


def _runs(buf: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: (first window, windows, document, minimiser), windows at every byte."""
    k = min(PIECE, least)
    none = np.zeros(0, np.int64)
    if len(buf) < least:
        return none, none, none, none.astype(U)
    s = B.prefix(buf)
    h = B.every_span_hash(s, k)
    span, width = 1, least - k + 1
    low = h
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    ok = np.arange(len(low)) <= np.repeat(off[1:] - least, np.diff(off))[: len(low)]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~ok[:-1]
    new[off[:-1][off[:-1] < len(low)]] = True
    new &= ok
    edge = new | ~ok
    first = np.flatnonzero(new)
    ends = np.flatnonzero(np.append(edge, True))
    count = ends[np.searchsorted(ends, first, "right")] - first
    if len(count) and count.max() > MOST_RUN:  # a periodic text repeats its minimiser
        parts = -(-count // MOST_RUN)
        base, step = np.repeat(first, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        count = np.minimum(np.repeat(count, parts) - step * MOST_RUN, MOST_RUN)
        first = base + step * MOST_RUN
    return first, count, np.searchsorted(off, first, "right") - 1, low[first]


def _sliced(table: pa.Table | pa.RecordBatch, least: int):
    buf, off = B.column(table, "text")
    for i, j in B.slices(off):
        part = buf[off[i] : off[j]]
        yield i, j, part, off[i : j + 1] - off[i], *_runs(part, off[i : j + 1] - off[i], least)


def _ids(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    col = table.column("doc_id")
    return np.array([LAST if x is None else x for x in col.to_pylist()], np.int64) if col.null_count else col.to_numpy().astype(np.int64)


def _share(x: np.ndarray, width: int) -> np.ndarray:
    """Share of minimisers below x (of 1), each counted once, of windows of ``width`` uniform hashes.

    A hash x is some window's minimum if at least width - 1 larger ones stand next to it, left and right together:
    with probability (1 - x)^(width - 1) (1 + (width - 1) x). This is the integral of that, over its total.
    """
    return 1 - (1 - x) ** width * (1 + x * (width - 1) / 2)


def _below(share: np.ndarray, width: int) -> np.ndarray:
    """The hash below which that share of minimisers lies."""
    a, b = np.zeros(len(share)), np.ones(len(share))
    for _ in range(60):
        m = (a + b) / 2
        low = _share(m, width) < share
        a, b = np.where(low, m, a), np.where(low, b, m)
    return (b * 2.0**63).astype(U) << U(1)


def _cut(sorted_hash: np.ndarray, shards: int, least: int) -> np.ndarray:
    """Where each shard begins among ascending minimisers: ranges that hold equal shares of them, and their end."""
    edges = _below(np.arange(1, shards) / shards, least - min(PIECE, least) + 1)
    return np.concatenate([[0], np.searchsorted(sorted_hash, edges), [len(sorted_hash)]])


def _split(first: np.ndarray, count: np.ndarray, doc: np.ndarray, low: np.ndarray, hot: np.ndarray, buf: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs, those of hot minimisers cut into their windows, each with its own hash for a minimiser."""
    if not hot.any():
        return first, count, doc, low
    n = count[hot]
    window = np.repeat(first[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own = B.span_hash(B.prefix(buf), window, window + least)  # spread over the range like minimisers are
    own = _below((own >> U(11)) / 2.0**53, least - min(PIECE, least) + 1)
    cool = ~hot
    return np.concatenate([first[cool], window]), np.concatenate([count[cool], np.ones(len(window), np.int64)]), np.concatenate([doc[cool], np.repeat(doc[hot], n)]), np.concatenate([low[cool], own])


def _anchors(least: int, shards: int):
    """Pass 1: a chunk's distinct minimisers, and how often those stand that two of its documents have."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        B.release()
        ids, value, who = _ids(table), [], []
        for i, _, _, _, _, _, doc, low in _sliced(table, least):
            value.append(low)
            who.append(ids[doc + i])
        value, who = np.concatenate(value or [np.zeros(0, U)]), np.concatenate(who or [np.zeros(0, np.int64)])
        order = np.argsort(value, kind="stable")
        value, who = value[order], who[order]
        start = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        if len(start):
            many = np.where(np.minimum.reduceat(who, start) != np.maximum.reduceat(who, start), np.diff(np.append(start, len(value))), 0).astype(np.uint32)
            value = value[start]
        else:
            many = np.zeros(0, np.uint32)
        cut = _cut(value, shards, least)
        rows = [(s, B.pack(_deltas(value[a:b]), many[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _deltas(value: np.ndarray) -> np.ndarray:
    """Ascending values cut to their upper 48 bits, as differences: small numbers, whose upper byte planes pack well."""
    x = value >> U(16)
    return np.diff(x, prepend=U(0)) if len(x) else x


def _repeated(hot: int):
    """Pass 1, by shard: for each chunk, which of its minimisers stand in two documents, and which of them are hot."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.release()
        chunk, value, many = [], [], []
        for batch in batches:
            chunk += batch.column("chunk").to_pylist()
            for block in batch.column("block"):
                d, m = B.unpack(block.as_py())
                value.append(np.cumsum(d, dtype=U))
                many.append(m)
        sizes = [len(v) for v in value]
        every, often = np.concatenate(value), np.concatenate(many)
        order = np.argsort(every, kind="stable")
        s = every[order]
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        times = np.add.reduceat(np.maximum(often, 1)[order].astype(np.int64), start)
        n = np.diff(np.append(start, len(s)))
        kind = ((n > 1) | (np.maximum.reduceat(often[order], start) > 0)).astype(np.uint8)
        kind[(kind > 0) & (times >= hot)] = 2
        hit = np.zeros(len(s), np.uint8)
        hit[order] = np.repeat(kind, n)
        del order, s
        at, out = 0, []
        for c, size, v in zip(chunk, sizes, value, strict=True):
            mine = hit[at : at + size]
            at += size
            good = mine > 0
            if good.any():
                out.append((c, B.pack(np.diff(v[good], prepend=U(0)), mine[good])))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["chunk", "block"])

    return run


def _pieces(buf: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of spans, one after the other."""
    at = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return buf[at]


def _strings(least: int, shards: int):
    """Pass 2: a chunk's distinct strings of repeated minimisers, with the smallest and largest id that has each."""

    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        B.release()
        empty = pa.table({"shard": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "block": pa.array([], pa.binary())})
        if not len(told) or not len(table):
            return empty
        told = [B.unpack(x.as_py()) for x in told.column("block")]
        known, kind = np.concatenate([np.cumsum(d, dtype=U) for d, _ in told]), np.concatenate([k for _, k in told])
        order = np.argsort(known, kind="stable")
        known, kind = known[order], kind[order]
        ids, parts = _ids(table), []
        for i, _, buf, _, first, count, doc, low in _sliced(table, least):
            at = np.searchsorted(known, low >> U(16))
            at[at == len(known)] = 0
            ok = known[at] == low >> U(16)
            first, count, doc, low = _split(first[ok], count[ok], doc[ok], low[ok], kind[at[ok]] == 2, buf, least)
            if not len(first):
                continue
            length = count + least - 1
            name = B.span_hash(B.prefix(buf), first, first + length)
            order = np.lexsort((ids[doc + i], name))
            start = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
            who = ids[doc + i][order]
            pick = order[start]
            parts.append((name[pick], low[pick], count[pick], who[start], np.maximum.reduceat(who, start), _pieces(buf, first[pick], length[pick])))
        if not parts:
            return empty
        name, low, count, least_id, most_id, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        length = count + least - 1
        at = np.cumsum(length) - length
        order = np.lexsort((name, low))
        start = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
        pick = order[start]
        least_id, most_id = np.minimum.reduceat(least_id[order], start), np.maximum.reduceat(most_id[order], start)
        name, low, count, at = name[pick], low[pick], count[pick], at[pick]
        cut, rows = _cut(low, shards, least), []
        if (kind == 2).any():  # goes through a shard back to this chunk
            rows.append((key[0].as_py() % shards, B.pack(known[kind == 2])))
        for s in range(shards):
            a, b = cut[s], cut[s + 1]
            if b > a:
                rows.append((s, B.pack(name[a:b], low[a:b], count[a:b].astype(np.uint8), least_id[a:b], most_id[a:b], _pieces(body, at[a:b], count[a:b] + least - 1))))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})

    return run


def suffix_order(sym: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (of symbols 0..256) in order of their first ``depth`` symbols, and their ranks by the first SEED."""
    n = len(sym)
    bits, half = n.bit_length(), SEED // 2 + 1
    pad = np.concatenate([sym.astype(U), np.zeros(half, U)])
    key = np.zeros(n, U)
    for j in range(half):
        key = (key << U(9)) | pad[j : j + n]

    def ranked(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width + bits <= 64:  # the place fits below the key: one sort of plain numbers
            s = (key << U(bits)) | np.arange(n, dtype=U)
            s.sort()
            order = (s & U((1 << bits) - 1)).astype(np.int64)
            s >>= U(bits)
        else:
            order = np.argsort(key, kind="stable")
            s = key[order]
        rank = np.zeros(n, U)
        rank[order] = np.cumsum(np.append(True, s[1:] != s[:-1]), dtype=U)
        return order, rank

    order, rank = ranked(key, 9 * half)
    seed, have = rank, half
    while have < max(depth, SEED):
        step = min(have, (SEED if have < SEED else depth) - have)
        nxt = np.zeros(n, U)
        nxt[: n - step] = rank[step:]
        order, rank = ranked((rank << U(bits)) | nxt, 2 * bits)
        have += step
        if have == SEED:
            seed = rank
    return order, seed.astype(np.int64)


def common_prefix_intervals(sym: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the suffix order whose suffixes share at least ``least`` symbols, none of them the separator 0.

    Returns (suffix order, interval id of each place or -1). Breadth-first backward extension: the intervals of
    common length m + 1 come from those of length m through the last-to-first mapping of the Burrows-Wheeler
    transform; intervals of one suffix and those that would take in a separator end there.
    """
    order, seed = suffix_order(sym, least)
    n = len(sym)
    kind = np.int32 if n < 1 << 22 else np.int64  # holds an interval's number times 257
    last = sym[order - 1]  # the transform: the symbol before each suffix, cyclic
    to = np.empty(n, kind)
    to[np.argsort(last, kind="stable")] = np.arange(n)  # last-to-first mapping
    last = last.astype(kind)
    clean = np.cumsum(sym == 0)
    end = np.minimum(order + SEED, n) - 1
    before = np.where(order > 0, clean[order - 1], 0)
    name = np.where((clean[end] == before) & (order + SEED <= n), seed[order], 0)
    place = np.flatnonzero(name)
    name = name[place].astype(kind)
    scratch, live = np.zeros(n, kind), np.zeros(n, bool)

    def closed(place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring places with one name form an interval; those of one suffix end."""
        if not len(place):
            return place, name
        new = np.append(True, name[1:] != name[:-1])
        ok = ~(new & np.append(new[1:], True))
        return place[ok], np.cumsum(new, dtype=kind)[ok]

    place, name = closed(place, name)
    for _ in range(min(SEED, least), least):
        by = last[place]
        ok = by > 0
        place, name, by = place[ok], name[ok], by[ok]
        moved = to[place]
        scratch[moved] = name * 257 + by
        if len(moved) * 16 > n:  # in order: by a look at all places, or a sort of the few
            live[moved] = True
            moved = np.flatnonzero(live)
            live[moved] = False
        else:
            moved.sort()
        place, name = closed(moved, scratch[moved])
    out = np.full(n, -1, np.int64)
    out[place] = name
    return order, out


def first_documents(count: np.ndarray, owner: np.ndarray, body: np.ndarray, least: int) -> np.ndarray:
    """For every window of the strings, one after the other, the smallest owner of an equal window."""
    length = count + least - 1
    wide = length + 1
    at = np.cumsum(wide) - wide
    sym = np.zeros(int(wide.sum()), np.uint16)
    inside = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(len(body))
    sym[inside] = body.astype(np.uint16) + 1
    string = np.repeat(np.arange(len(count)), wide)
    order, interval = common_prefix_intervals(sym, least)
    places = np.flatnonzero(interval >= 0)
    best = owner[string]
    if len(places):
        ids = interval[places]
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        low = np.minimum.reduceat(owner[string[order[places]]], start)
        best[order[places]] = np.repeat(low, np.diff(np.append(start, len(places))))
    return best[np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]


def _firsts(least: int):
    """Pass 2, by shard: for each chunk, its strings that hold windows first seen in a smaller document."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.release()
        chunk, got, where = [], [], []
        for batch in batches:
            for c, block in zip(batch.column("chunk").to_pylist(), batch.column("block").to_pylist(), strict=True):
                parts = B.unpack(block)
                if len(parts) == 1:  # a chunk's hot minimisers, for its last pass
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([block], pa.binary())], ["chunk", "block"])
                    continue
                name, low, count, lo, hi, body = parts
                got.append((name, low, count.astype(np.int64), lo, hi))
                where.append(body)
                chunk.append(c)
        if not got:
            return
        sizes = [len(g[0]) for g in got]
        name, low, count, lo, hi = (np.concatenate(x) for x in zip(*got, strict=True))
        body = np.concatenate(where)
        at = np.cumsum(count + least - 1) - (count + least - 1)
        del got, where, batch, block, parts
        order = np.lexsort((name, low))
        start = np.flatnonzero(np.append(True, (name[order][1:] != name[order][:-1]) | (low[order][1:] != low[order][:-1])))
        of = np.zeros(len(name), np.int64)
        of[order] = np.cumsum(np.bincount(start, minlength=len(name))) - 1
        one, owner = order[start], np.minimum.reduceat(lo[order], start)  # distinct strings, sorted by minimiser
        group = np.append(True, low[one][1:] != low[one][:-1])
        several = np.bincount(np.cumsum(group) - 1)[np.cumsum(group) - 1] > 1
        counts = count[one]
        firsts = np.repeat(owner, counts)
        base = np.cumsum(counts) - counts
        hard = np.flatnonzero(several)
        # whole minimisers at a time, in blocks of bounded size
        edge = np.flatnonzero(group[hard])
        weight = np.cumsum(counts[hard] + least)
        i = 0
        while i < len(hard):
            limit = int(np.searchsorted(weight, (weight[i - 1] if i else 0) + (1 << 19)))
            j = int(edge[np.searchsorted(edge, max(limit, i + 1))]) if edge[-1] >= max(limit, i + 1) else len(hard)
            part = hard[i:j]
            window = np.repeat(base[part] - (np.cumsum(counts[part]) - counts[part]), counts[part]) + np.arange(int(counts[part].sum()))
            firsts[window] = first_documents(counts[part], owner[part], _pieces(body, at[one[part]], counts[part] + least - 1), least)
            i = j
        lowest = np.minimum.reduceat(firsts, base) if len(base) else firsts
        out, k = [], 0
        for c, size in zip(chunk, sizes, strict=True):
            rows = np.arange(k, k + size)
            k += size
            rows = rows[lowest[of[rows]] < hi[rows]]
            if len(rows):
                u = of[rows]
                window = np.repeat(base[u] - (np.cumsum(counts[u]) - counts[u]), counts[u]) + np.arange(int(counts[u].sum()))
                f = firsts[window]
                same = np.minimum.reduceat(f, np.cumsum(counts[u]) - counts[u]) == np.maximum.reduceat(f, np.cumsum(counts[u]) - counts[u])
                short = np.where(same, 1, counts[u])
                keep = np.repeat(~same, counts[u])
                keep[np.cumsum(counts[u]) - counts[u]] = True
                out.append((c, B.pack(name[rows], short.astype(np.uint8), f[keep])))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["chunk", "block"])

    return run


def _marks(least: int, with_text: bool):
    """Pass 3: what is left of every document of a chunk."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        B.release()
        name, values, count = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        told = [B.unpack(x.as_py()) for x in told.column("block")]
        hot = np.sort(np.concatenate([x[0] for x in told if len(x) == 1] or [np.zeros(0, U)]))
        told = [x for x in told if len(x) == 3]
        if told:
            name, count, values = (np.concatenate(x) for x in zip(*told, strict=True))
            count = count.astype(np.int64)
        base = np.cumsum(count) - count
        order = np.argsort(name, kind="stable")
        known = name[order]
        ids = _ids(table)
        sizes, removed, spans, digest, kept = [], [], [], [], []
        for i, j, buf, off, first, runs, doc, low in _sliced(table, least):
            change = np.zeros(len(buf) + 1, np.int64)
            if len(known) and len(first):
                if len(hot):
                    first, runs, doc, _ = _split(first, runs, doc, low, np.isin(low >> U(16), hot), buf, least)
                names = B.span_hash(B.prefix(buf), first, first + runs + least - 1)
                at = np.searchsorted(known, names)
                at[at == len(known)] = 0
                ok = np.flatnonzero(known[at] == names)
                row = order[at[ok]]
                n = runs[ok]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                seen = values[np.repeat(base[row], n) + np.where(np.repeat(count[row], n) == 1, 0, inner)]
                start = (np.repeat(first[ok], n) + inner)[seen < np.repeat(ids[doc[ok] + i], n)]
                np.add.at(change, start, 1)
                np.add.at(change, start + least, -1)
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            full = np.flatnonzero(np.diff(off) > 0)
            head[off[:-1][full]] = gone[off[:-1][full]]
            heads = np.concatenate([[0], np.cumsum(head)])
            sizes.append(np.diff(off))
            removed.append(total[off[1:]] - total[off[:-1]])
            spans.append(heads[off[1:]] - heads[off[:-1]])
            left = buf[~gone]
            cut = off - total[off]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                raw = left[a:b].tobytes()
                digest.append(hashlib.sha256(raw).hexdigest())
                if with_text:
                    kept.append(raw.decode("utf-8", "ignore"))
        join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        own = [c for c in table.column_names if c not in ("text", "chunk")]
        out = {c: table.column(c) for c in own} | {"n_bytes": join(sizes), "n_removed": join(removed), "n_spans": join(spans), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"text": pa.array(kept, pa.string())} if with_text else {}))

    return run


def dealt(total: int, chunk_bytes: int) -> tuple[int, int]:
    """Chunks and shards for ``total`` bytes of text; a block goes from each to each, so both grow with its root from 512 MiB on."""
    chunk_bytes = chunk_for(total, chunk_bytes, early=1 << 29)
    return max(1, -(-total // chunk_bytes)), shards_for(total, max(4 << 20, chunk_bytes))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, chunk_bytes: int = 4 << 20, hot: int = 1 << 14, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per document doc_id, the columns of ``keep``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the remaining text.

    Null text counts as empty. A null id is larger than every other: such a row loses what documents with ids hold
    and takes nothing from others. Rows with one id take nothing from each other. ``text`` is the remaining bytes as
    UTF-8, without characters of which bytes were cut off. Other columns are not read.
    """
    given = [F.col(f"`{c}`").alias(f"_kept{i}") for i, c in enumerate(keep)]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *given)
    total = docs.select(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    chunks, shards = dealt(total, chunk_bytes)
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))
    slim = docs.select("chunk", "doc_id", "text")
    sent = slim.groupBy("chunk").applyInArrow(_anchors(least, shards), "shard int, chunk long, block binary")
    told = sent.groupBy("shard").applyInArrow(_repeated(hot), "chunk long, block binary")
    strings = slim.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_strings(least, shards), "shard int, chunk long, block binary")
    firsts = stash(strings.groupBy("shard").applyInArrow(_firsts(least), "chunk long, block binary"), "firsts")
    del sent, told, strings
    free_shuffles(docs.sparkSession)
    kinds = dict(docs.dtypes)
    kept = "".join(f"_kept{i} {kinds[f'_kept{i}']}, " for i in range(len(keep)))
    schema = f"doc_id long, {kept}n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    out = docs.groupBy("chunk").cogroup(firsts.groupBy("chunk")).applyInArrow(_marks(least, with_text), schema)
    return out.select("doc_id", *(F.col(f"_kept{i}").alias(c) for i, c in enumerate(keep)), *out.columns[1 + len(keep) :])
