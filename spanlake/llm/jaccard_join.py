"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

A document's set holds the 64-bit hashes of its distinct word 5-grams. Two sets of sizes a <= b with Jaccard
similarity of at least t differ in at most (a + b)(1 - t)/(1 + t) elements. Sizes fall into geometric bands. In each
band the hash universe is cut into m equal ranges (segments); a set takes part in the bands of all partner sizes no
larger than its own. If sets r and s differ in at most H elements, at most H segments differ, so

* wide bands: with T non-empty segments, r shares at least T - H of them with s. Under one global order (segments with
  more elements first, they are rarer and cost less) both sides index only their first H + 1 segments and still share
  one. A set with too few non-empty segments indexes all segments, empty ones too.
* narrow bands: m = ceil((H + 1) / 2) segments; some segment differs in at most one element, so each segment goes in
  whole and with each element deleted once, and one side of a match must be whole.

The band's allocation is the cheaper of the two by the signatures it indexes. Sets that share a signature form a
group; each member is verified against the group's pivot, then, in a few turns, against other pivots as far as no
chain of verified links joins the two yet. By the triangle inequality of the Jaccard distance, only pairs whose distances
to the first pivot are within 1 - t of each other can link; those of them that are still in different components are
verified last. So components are exact while no group is expanded into all its pairs.

The cost of a segment also counts how common it is: segments made only of shingles that very many documents hold come
last in the order, so a passage in a third of all documents makes no group as long as a set has enough others. Before
two sets are compared, their parity sketches are: each element flips one bit, so two sketches differ in no more bits
than the sets in elements, and a pair beyond the bound can't link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import components, drop, free_shuffles, shards_for, stash, text_bytes

U = np.uint64


class Bands:
    """Size bands for a threshold of num/den, and how each cuts the universe."""

    def __init__(self, num: int, den: int, ratio: float = 4 / 3, most: int = 1 << 31):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < most:
            edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
        self.edges = np.array(edges, np.int64)  # band k: edges[k] <= size < edges[k + 1]
        top = self.edges[1:] - 1
        self.differ = self.most_differ(top, self.partner(top))
        narrow = -(-(self.differ + 1) // 2)
        wide = 2 * self.differ + 2
        # signatures of a set: narrow: every element deleted once, and each segment whole; wide: H + 1, of little meaning with few segments
        self.narrow = (top + narrow <= 4 * (self.differ + 1)) & (self.differ <= 4)
        self.cuts = np.where(self.narrow, narrow, wide)

    def partner(self, n: np.ndarray) -> np.ndarray:
        """The largest size that can link with size n."""
        return n * self.den // self.num

    def most_differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1


def sets_of(table: pa.Table | pa.RecordBatch, size: int, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct shingle hashes, bounds) by slices of rows."""
    buf, off = B.column(table, text)
    for i, j in B.slices(off):
        h, _, _, at = B.words(buf[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        yield i, j, *B.sort_rows(*B.windows(h, at, size))


def class_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit key of each set: equal sets have equal keys."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(B.mix(h + U(77)), dtype=U)])
    n = np.diff(at)
    return B.mix(total[at[1:]] - total[at[:-1]] + n.astype(U) * U(0x9E3779B97F4A7C15))


def sketch(h: np.ndarray) -> bytes:
    """Parity of the elements per bit; as many bits as the power of two from twice the elements up, 64 at least."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits((np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_gap(a: bytes, b: bytes) -> int:
    """At most the number of elements that only one of the two sets has."""
    width = min(len(a), len(b))
    return int(np.bitwise_count(folded(np.frombuffer(a, np.uint8), width) ^ folded(np.frombuffer(b, np.uint8), width)).sum())


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """The sketch of the same set with fewer bits."""
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _classes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            n, key, body = [], [], []
            for _, _, h, at in sets_of(batch, size):
                n.append(np.diff(at))
                key.append(B.signed(class_keys(h, at)))
                body += [sketch(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if n:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n)), pa.array(np.concatenate(key)), pa.array(body, pa.binary())], ["doc_id", "n_shingles", "class_key", "sketch"])

    return run


def _common(size: int, least: int):
    """Shingles that at least ``least`` documents of a batch hold, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            every = [h for _, _, h, _ in sets_of(batch, size)]
            if every:
                s = np.concatenate(every)
                s.sort()
                start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
                count = np.diff(np.append(start, len(s)))
                often = count >= least
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(s[start[often]])), pa.array(count[often].astype(np.int64))], ["h", "n"])

    return run


def _segments(h: np.ndarray, doc: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of one (set, segment) among sorted hashes; segment, element count and content sum of each run."""
    seg = ((h >> U(32)) * m[doc].astype(U) >> U(32)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    total = np.concatenate([np.zeros(1, U), np.cumsum(B.mix(h ^ U(0x5BF03635)), dtype=U)])
    end = np.append(start[1:], len(h))
    return start, seg[start], end - start, total[end] - total[start]


def signatures(h: np.ndarray, at: np.ndarray, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets: (64-bit signature, set, whole) arrays. whole is false for a segment with one element deleted."""
    n = np.diff(at)
    own = bands.of(np.maximum(n, 1))
    least = -(-n * bands.num // bands.den)
    low = bands.of(np.maximum(least, 1))
    sig, who, whole = [], [], []
    rare = np.ones(len(h), bool)
    if len(common) and len(h):
        place = np.searchsorted(common, h)
        place[place == len(common)] = 0
        rare = common[place] != h
    for back in range(int((own - low).max(initial=0)) + 1):
        band = own - back
        part = np.flatnonzero((n > 0) & (band >= low))
        if not len(part):
            continue
        k, size = band[part], n[part]
        # the largest set that this band pairs with this one
        other = np.maximum(np.where(back == 0, bands.partner(size), bands.edges[k + 1] - 1), 1)
        differ = np.minimum(bands.most_differ(size, other), bands.differ[k])
        rows = np.concatenate([np.arange(at[p], at[p + 1]) for p in part])
        doc = np.repeat(np.arange(len(part)), size)
        hh = h[rows]
        start, seg, count, content = _segments(hh, doc, bands.cuts[k])
        at_doc = doc[start]
        salt = B.mix((k[at_doc].astype(U) << U(32)) + seg.astype(U) + U(1))
        token = B.mix(content + salt)
        slim = bands.narrow[k]
        # narrow bands: whole segments, empty ones too, and each element deleted once
        if slim.any():
            pick = slim[at_doc]
            sig.append(token[pick])
            who.append(part[at_doc[pick]])
            whole.append(np.ones(int(pick.sum()), bool))
            run = np.repeat(np.arange(len(start)), count)
            pick = slim[doc]
            sig.append(B.mix(content[run[pick]] - B.mix(hh[pick] ^ U(0x5BF03635)) + salt[run[pick]]))
            who.append(part[doc[pick]])
            whole.append(np.zeros(int(pick.sum()), bool))
        # wide bands: the first H + 1 of the non-empty segments
        wide = ~slim[at_doc]
        if wide.any():
            some = np.add.reduceat(rare[rows].astype(np.int64), start) > 0
            d, t, c = at_doc[wide], token[wide], np.minimum(count[wide], 255) + 256 * some[wide]
            order = np.lexsort((t, -c, d))
            d, t = d[order], t[order]
            first = np.searchsorted(d, np.arange(len(part)))
            pick = np.arange(len(d)) - first[d] <= differ[d]
            sig.append(t[pick])
            who.append(part[d[pick]])
            whole.append(np.ones(int(pick.sum()), bool))
        filled = np.bincount(at_doc, minlength=len(part))
        short = np.flatnonzero(np.where(slim, filled < bands.cuts[k], filled <= differ))
        for p in short.tolist():
            have = seg[at_doc == p]
            empty = np.setdiff1d(np.arange(bands.cuts[k[p]]), have)
            sig.append(B.mix(B.mix((U(int(k[p])) << U(32)) + empty.astype(U) + U(1))))
            who.append(np.full(len(empty), part[p]))
            whole.append(np.ones(len(empty), bool))
    if not sig:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(sig), np.concatenate(who), np.concatenate(whole)


def _emit(size: int, bands: Bands, shards: int, common):
    bits = shards.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            keys, sizes, got = [], [], []
            base = 0
            for _, _, h, at in sets_of(batch, size):
                key = class_keys(h, at)
                _, one = np.unique(key, return_index=True)  # copies within the batch stand once
                fresh = np.zeros(len(key), bool)
                fresh[one] = True
                sig, who, whole = signatures(h, at, bands, common.value)
                ok = fresh[who]
                got.append((sig[ok], (who[ok] + base).astype(np.uint32), whole[ok]))
                keys.append(key)
                sizes.append(np.diff(at))
                base += len(key)
            if not base:
                continue
            key, n = np.concatenate(keys), np.concatenate(sizes)
            sig, who, whole = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(sig, kind="stable")
            sig, who, whole = sig[order], who[order], whole[order]
            cut = np.searchsorted(sig, np.arange(shards, dtype=U) << U(64 - bits) if bits else np.zeros(1, U))
            cut = np.append(cut, len(sig))
            rows = []
            for s in range(shards):
                a, b = cut[s], cut[s + 1]
                if a == b:
                    continue
                used, local = np.unique(who[a:b], return_inverse=True)
                local = local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                body = ((sig[a:b] << U(bits)) >> U(16)).astype(U)  # 48 bits beyond those of the shard
                six = body.view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((s, B.pack(np.ascontiguousarray(six).view("V6").reshape(-1), local, whole[a:b].astype(np.uint8), key[used], n[used].astype(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "block"])

    return run


def _spread(count: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows of runs of ``count`` rows from ``start``, one run after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _distinct(count: np.ndarray, cls: np.ndarray, whole: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct member list once."""
    start = np.cumsum(count) - count
    print_of = np.add.reduceat(B.mix(cls + whole.astype(U)), start) + count.astype(U)
    _, pick = np.unique(print_of, return_index=True)
    rows = _spread(count[pick], start[pick])
    return count[pick], cls[rows], whole[rows], n[rows]


def _groups(shards: int):
    """Groups of at least two classes that share a signature in one shard, dealt on by their pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _grouped(batches)
        if found is None:
            return
        count, cls, whole, n = found
        pivot, _ = _pivots(count, whole)
        to = (B.mix(cls[pivot]) % U(shards)).astype(np.int64)
        start = np.cumsum(count) - count
        out = []
        for s in np.unique(to).tolist():
            mine = np.flatnonzero(to == s)
            rows = _spread(count[mine], start[mine])
            out.append((s, B.pack(count[mine], cls[rows], whole[rows], n[rows])))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["shard", "block"])

    return run


def _regroup(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All groups of one pivot, from every shard of signatures, each distinct member list once."""
    parts = [B.unpack(block.as_py()) for batch in batches for block in batch.column("block")]
    found = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([B.pack(*found)], pa.binary())], ["shard", "block"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """(members per group, classes, whole, sizes) of signatures that several classes have, at least one of them whole."""
    B.release()
    sig, cls, whole, n = [], [], [], []
    for batch in batches:
        for block in batch.column("block"):
            six, local, full, keys, sizes = B.unpack(block.as_py())
            wide = np.zeros((len(six), 8), np.uint8)
            wide[:, :6] = six.view(np.uint8).reshape(-1, 6)
            sig.append(wide.reshape(-1).view(U))
            cls.append(keys[local])
            whole.append(full)
            n.append(sizes[local].astype(np.int32))
    sig = np.concatenate(sig)
    # a signature that stands once can't be shared
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    same = np.zeros(len(s), bool)
    same[1:] |= s[1:] == s[:-1]
    same[:-1] |= s[1:] == s[:-1]
    order = order[same]
    sig, cls, whole, n = sig[order], np.concatenate(cls)[order], np.concatenate(whole)[order], np.concatenate(n)[order]
    order = np.lexsort((1 - whole, cls, sig))
    sig, cls, whole, n = sig[order], cls[order], whole[order], n[order]
    one = np.ones(len(sig), bool)
    one[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])  # each class once, whole if it is so in any row
    sig, cls, whole, n = sig[one], cls[one], whole[one], n[one]
    if not len(sig):
        return None
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    count = np.diff(np.append(start, len(sig)))
    good = (count > 1) & (np.add.reduceat(whole.astype(np.int64), start) > 0)
    rows = _spread(count[good], start[good])
    return _distinct(count[good], cls[rows], whole[rows], n[rows]) if len(rows) else None


def _fits(bands: Bands, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) * bands.den >= np.maximum(a, b) * bands.num


def _pivots(count: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's pivot row (its first whole member) and the group of each row."""
    group = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(whole)
    g, first = np.unique(group[at], return_index=True)
    out = np.zeros(len(count), np.int64)
    out[g] = at[first]
    return out, group


def _stars(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            for shard, block in zip(batch.column("shard").to_pylist(), batch.column("block"), strict=True):
                count, cls, whole, n = B.unpack(block.as_py())
                pivot, group = _pivots(count, whole)
                p = pivot[group]
                ok = (cls != cls[p]) & _fits(bands, n, n[p])
                pair = np.unique(np.stack([cls[p[ok]], cls[ok]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), shard, np.int32)), pa.array(B.signed(pair[:, 0].copy())), pa.array(B.signed(pair[:, 1].copy()))], ["shard", "k1", "k2"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block in zip(batch.column("shard").to_pylist(), batch.column("block"), strict=True):
            key = np.unique(B.unpack(block.as_py())[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), shard, np.int32)), pa.array(B.signed(key))], ["shard", "key"])


def _next(bands: Bands, turn: int | None):
    """Pairs of a group's members in different components that may link: with the pivot of this turn, or all of them.

    ``known`` holds each member's component (k1 = k2) and the bounds of the distances that are known.
    """

    def run(groups: pa.Table, known: pa.Table) -> pa.Table:
        B.release()
        pairs = [np.zeros((0, 2), U)]
        k = np.stack([known.column(c).to_numpy() for c in ("k1", "k2")], 1).view(U)
        near, far, comp = (known.column(c).to_numpy() for c in ("near", "far", "component"))
        own = k[:, 0] == k[:, 1]
        order = np.argsort(k[own, 0])
        names, comps = k[own, 0][order], comp[own][order]
        prints = known.column("sketch").to_pylist()
        prints = [prints[i] for i in np.flatnonzero(own)[order].tolist()]
        at = {x: i for i, x in zip(np.flatnonzero(~own).tolist(), map(tuple, k[~own].tolist()), strict=True)}
        slack = 1 - bands.num / bands.den + 1e-9
        for block in groups.column("block"):
            count, cls, whole, n = B.unpack(block.as_py())
            if not len(count):
                continue
            pivot, _ = _pivots(count, whole)
            who = np.searchsorted(names, cls)
            c = comps[who]
            start = np.concatenate([[0], np.cumsum(count)])
            hard = np.minimum.reduceat(c, start[:-1]) != np.maximum.reduceat(c, start[:-1])
            for g in np.flatnonzero(hard).tolist():
                rows = np.arange(start[g], start[g + 1])
                p = int(pivot[g])
                ids = np.array([at.get((int(cls[p]), x), -1) for x in cls[rows].tolist()], np.int64)
                # bounds of the distances from the first pivot; where the sizes don't fit, only that it exceeds the slack is known
                lo = np.where(rows == p, 0.0, np.where(ids >= 0, near[ids], slack))
                hi = np.where(rows == p, 0.0, np.where(ids >= 0, far[ids], 1.0))
                width = min(len(prints[w]) for w in who[rows])
                bits = np.stack([folded(np.frombuffer(prints[w], np.uint8), width) for w in who[rows]])
                if turn is None:
                    here = np.flatnonzero(rows != p)
                    here = here[np.argsort(n[rows[here]], kind="stable")]
                    starts = range(len(here))
                else:
                    full = np.flatnonzero(whole[rows])
                    q = int(full[np.argmin(B.mix(cls[rows[full]] + U(turn)))])
                    here = np.append(q, np.delete(np.arange(len(rows)), q))
                    starts = range(1)
                for x in starts:
                    i, js = here[x], here[x + 1 :]
                    ok = (c[rows[js]] != c[rows[i]]) & ((whole[rows[js]] | whole[rows[i]]) > 0) & _fits(bands, n[rows[js]], n[rows[i]])
                    js = js[ok & (lo[js] - hi[i] <= slack) & (lo[i] - hi[js] <= slack)]
                    if len(js):
                        gap = np.bitwise_count(bits[js] ^ bits[i]).sum(1)
                        js = js[gap <= bands.most_differ(n[rows[js]], n[rows[i]])]
                    if len(js):
                        u, v = cls[rows[i]], cls[rows[js]]
                        pairs.append(np.stack([np.minimum(u, v), np.maximum(u, v)], 1))
            if len(pairs) > 64:
                pairs = [np.unique(np.concatenate(pairs), axis=0)]
        pair = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"k1": B.signed(pair[:, 0].copy()), "k2": B.signed(pair[:, 1].copy())})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            for _, _, h, at in sets_of(batch, size):
                key = B.signed(class_keys(h, at))
                body = [h[at[r] : at[r + 1]].tobytes() for r in range(len(key))]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(body, pa.binary())], ["key", "elements"])

    return run


def _sift(bands: Bands):
    """Whether two sketches let their sets link, and a lower bound of the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            gap = np.array([sketch_gap(a, b) for a, b in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)], np.int64)
            n1, n2 = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array((gap <= bands.most_differ(n1, n2)) & _fits(bands, n1, n2)), pa.array(2 * gap / np.maximum(n1 + n2 + gap, 1))], ["k1", "k2", "may", "near"])

    return run


def _verify(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            link, far = [], []
            for a, b in zip(batch.column("e1"), batch.column("e2"), strict=True):
                x, y = np.frombuffer(a.as_py(), U), np.frombuffer(b.as_py(), U)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                inter = int((y[at] == x).sum())
                union = len(x) + len(y) - inter
                link.append(bands.den * inter >= bands.num * union)
                far.append(1 - inter / union)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(link, pa.bool_()), pa.array(far, pa.float64())], ["k1", "k2", "linked", "distance"])

    return run


def _checked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, bands: Bands) -> DataFrame:
    """pairs (k1, k2) with linked and bounds near and far of the distance: by sketches, then by the documents' own sets."""

    def side(i: int) -> DataFrame:
        return classes.select(F.col("class_key").alias(f"k{i}"), F.col("sketch").alias(f"s{i}"), F.col("n").alias(f"n{i}"))

    sifted = pairs.join(side(1), "k1").join(side(2), "k2").select("k1", "k2", "s1", "s2", "n1", "n2")
    sifted = stash(sifted.mapInArrow(_sift(bands), "k1 long, k2 long, may boolean, near double"), "sifted")
    may = sifted.where("may").select("k1", "k2")
    need = may.select(F.col("k1").alias("class_key")).union(may.select("k2")).distinct()
    reps = classes.join(need, "class_key", "left_semi").select("doc_id").distinct()
    sets = docs.join(reps, "doc_id", "left_semi").mapInArrow(_sets(size), "key long, elements binary").groupBy("key").agg(F.first("elements").alias("elements"))
    sets = stash(sets, "sets")
    both = may.join(sets.select(F.col("key").alias("k1"), F.col("elements").alias("e1")), "k1")
    both = both.join(sets.select(F.col("key").alias("k2"), F.col("elements").alias("e2")), "k2")
    exact = stash(both.select("k1", "k2", "e1", "e2").mapInArrow(_verify(bands), "k1 long, k2 long, linked boolean, distance double"), "links")
    out = sifted.join(exact, ["k1", "k2"], "left")
    out = stash(out.select("k1", "k2", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("distance", "near").alias("near"), F.coalesce("distance", F.lit(1.0)).alias("far")), "checked")
    drop(sifted, sets, exact)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 75, den: int = 100, common: int = 100_000, turns: int = 2) -> DataFrame:
    """Documents with their set size and the component that links of similarity >= num/den make.

    Returns doc_id, n_shingles, component_id, class_key (equal for equal sets). Null or empty texts and texts without
    words have no set: n_shingles 0, their own component. Fewer than ``shingle`` words: one shingle of all. Rows with
    a null id keep their row with a null component and link with nothing. Repeated ids are rows of their own that
    share what their sets link. ``common``: shingles, the most frequent, that the order of segments puts last; it
    changes cost only. Other columns of ``docs`` are not read.
    """
    bands = Bands(num, den)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.select(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    shards = shards_for(total, 24 << 20)
    rows = stash(docs.mapInArrow(_classes(shingle), "doc_id long, n_shingles long, class_key long, sketch binary"), "classes")
    known = docs.where("doc_id is not null")
    classes = rows.where("doc_id is not null and n_shingles > 0").groupBy("class_key").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    classes = stash(classes, "classes")
    often = known.mapInArrow(_common(shingle, 8), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(common)
    often = np.sort(often.select("h").toArrow().column("h").to_numpy().view(U))  # only the order of segments depends on it
    blocks = known.mapInArrow(_emit(shingle, bands, shards, docs.sparkSession.sparkContext.broadcast(often)), "shard int, block binary")
    groups = blocks.groupBy("shard").applyInArrow(_groups(shards), "shard int, block binary")
    groups = stash(groups.groupBy("shard").applyInArrow(_regroup, "shard int, block binary"), "groups")
    asked = stash(groups.mapInArrow(_stars(bands), "shard int, k1 long, k2 long"), "stars")
    members = groups.mapInArrow(_members, "shard int, key long")
    members = stash(members.join(classes.select(F.col("class_key").alias("key"), "sketch"), "key").select("shard", "key", "sketch"), "members")
    first = _checked(asked.select("k1", "k2").distinct(), known, classes, shingle, bands)
    tried, links = first, first.where("linked").select(F.col("k1").alias("a"), F.col("k2").alias("b"))
    comp = stash(components(links), "comps")
    free_shuffles(docs.sparkSession)  # and what some hundred small jobs left on the driver
    for turn in (*range(1, turns + 1), None):
        own = members.join(comp.withColumnRenamed("node", "key"), "key", "left").select("shard", F.col("key").alias("k1"), F.col("key").alias("k2"), F.lit(0.0).alias("near"), F.lit(0.0).alias("far"), F.coalesce("component", "key").alias("component"), "sketch")
        gaps = asked.join(first, ["k1", "k2"]).select("shard", "k1", "k2", "near", "far", F.lit(0).cast("long").alias("component"), F.lit(None).cast("binary").alias("sketch"))
        more = groups.groupBy("shard").cogroup(own.union(gaps).groupBy("shard")).applyInArrow(_next(bands, turn), "k1 long, k2 long").distinct()
        pair = tried.select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2"))
        more = stash(more.select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct().join(pair, ["k1", "k2"], "left_anti"), "more")
        if more.isEmpty():
            continue
        again = _checked(more, known, classes, shingle, bands)
        tried = tried.unionByName(again)
        fresh = again.where("linked").select(F.col("k1").alias("a"), F.col("k2").alias("b"))
        if not fresh.isEmpty():
            comp = stash(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(fresh)), "comps")
        free_shuffles(docs.sparkSession)
    drop(groups, asked, members)
    named = classes.join(comp.withColumnRenamed("node", "class_key"), "class_key", "left").withColumn("component", F.coalesce("component", "class_key"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    lookup = named.join(least, "component").select("class_key", "component_id")
    out = rows.join(lookup, "class_key", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.cast("long").alias("component_id"), "class_key")
