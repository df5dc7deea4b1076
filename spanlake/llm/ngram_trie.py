"""LM scoring with an Elias-Fano n-gram trie.

The model, of trigrams unless told otherwise, uses absolute discounting and is backed off to the add-half unigram model:
p(w | h) = max(c(h, w) - D, 0) / c(h) + D * n(h) / c(h) * p(w | h without its first word), n(h) being the number of
different successors of h, and p(w | h) = p(w | h without its first word) for a history never seen. It grows with the
corpus, so it is dealt over shards by the first word of an n-gram. A word that begins more than a shard's share of them,
by a sample, has its n-grams dealt over as many shards as it has shares, by their second word: each of these has a part of
its successors with all that stands below them, and the parts of its weights are put together by their counts. Each shard is a trie: its first words, and on every
level below the successors of each node above, all as Elias-Fano sequences (a successor's value is taken relative to its
parent's place, which keeps the whole level monotone), with monotone pointers from one level to the next, which bound
the search for a node's successors, and log probabilities quantised to 12 bits. A shard is one block of bytes that
``TrieShard.open`` reads in place, from memory or from a memory-mapped file.

Documents are dealt into chunks of bounded size. A chunk sends every shard its distinct n-grams, as a trie too, with
counts from its training documents; the shard adds the counts up, builds its trie and answers each chunk's n-grams by
successor search, level by level; the chunk, dealt by the same exchange, adds up its documents' scores. Each n-gram
travels once a chunk however often it stands there. The shorter history that a place backs off to begins at the place
after, whose own n-gram is asked for anyway. Trigrams are exchanged in two parts, by ranges of shards.

Words are known by hashes: 56 bits as first words, 40 as second ones, 32 below, where only words after one history must differ.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import chunk_for, free_shuffles, shards_for, stash, text_bytes

U = np.uint64
BEGIN, END = U(0), U((1 << 64) - 1)
NEXT_BITS = (40, 32)  # of a word on the second level, and on those below
DISCOUNT = 0.75
CODE_BITS = 12
TOP = (1 << CODE_BITS) - 1
STEP = 8 / (TOP - 1)  # of quantised log10 probabilities, from 0 down to -8; code 0: none


def quantise(p: np.ndarray) -> np.ndarray:
    code = np.rint(TOP + np.log10(np.maximum(p, 1e-300)) / STEP)
    return np.where(p > 0, np.clip(code, 1, TOP), 0).astype(np.uint16)


LEVELS = np.concatenate([[0.0], 10.0 ** ((np.arange(1, TOP + 1) - TOP) * STEP)])


def next_bits(level: int) -> int:
    """Bits of a word's hash among the successors of level ``level``, counted from 0."""
    return NEXT_BITS[min(level, len(NEXT_BITS) - 1)]


def _bits(x: np.ndarray, width: int) -> np.ndarray:
    """The lower ``width`` bits of every number, one after the other in 64-bit words, and a word more."""
    if not width or not len(x):
        return np.zeros(2, U)
    raw = [np.packbits((part[:, None] >> np.arange(width, dtype=U) & U(1)).astype(np.uint8).reshape(-1), bitorder="little") for part in np.split(x, range(1 << 16, len(x), 1 << 16))]
    raw = np.concatenate(raw)  # parts of 2^16 numbers end at whole bytes
    return np.concatenate([raw, np.zeros(-len(raw) % 8 + 8, np.uint8)]).view(U)


def _take(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    """The i-th numbers of what ``_bits`` gave."""
    if not width:
        return np.zeros(len(i), U)
    place = i * width
    w, off = place >> 6, (place & 63).astype(U)
    high = np.where(off > 0, words[w + 1] << (U(64) - np.maximum(off, U(1))), U(0))
    return (words[w] >> off | high) & U((1 << width) - 1)


class EliasFano:
    """An ascending sequence below a universe: upper parts in unary, lower parts in as many bits as they need.

    It is queried as it is stored, in 64-bit words; beside them is only the number of ones before every word.
    """

    def __init__(self, n: int, width: int, upper: np.ndarray, lower: np.ndarray):
        self.n, self.width, self.upper, self.lower = n, width, upper, lower
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
        self.zeros = 64 * np.arange(len(upper) + 1) - self.before

    @staticmethod
    def build(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> U(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        bits = np.zeros(-(-(int(high[-1]) + n + 1 if n else 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        return width, np.packbits(bits, bitorder="little").view(U), _bits(values, width)

    def _select(self, i: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the i-th one (zero, if ``flip``) of the upper bits."""
        w = np.minimum(np.searchsorted(before, i, "right") - 1, len(self.upper) - 1)
        word = ~self.upper[w] if flip else self.upper[w]
        left, at = i - before[w], np.zeros(len(i), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & U((1 << step) - 1)).astype(np.int64)
            over = left >= count
            left -= np.where(over, count, 0)
            at += np.where(over, step, 0)
            word = np.where(over, word >> U(step), word)
        return 64 * w + at

    def low_at(self, i: np.ndarray) -> np.ndarray:
        return _take(self.lower, self.width, i)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th elements."""
        return ((self._select(i, self.before, False) - i).astype(U) << U(self.width)) | self.low_at(i)

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Successor search among the elements [first, last): place of the first one >= x in x's upper part, and whether it is x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> U(self.width)).astype(np.int64)
        low = x & U((1 << self.width) - 1)
        known = high < self.zeros[-1]
        high = np.where(known, high, 0)
        a = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - high + 1, 0)
        b = self._select(high, self.zeros, True) - high
        a, b = np.maximum(a, first), np.where(known, np.minimum(b, self.n if last is None else last), 0)
        stop = b.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) // 2
            less = self.low_at(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        hit = a < stop
        hit[hit] = self.low_at(a[hit]) == low[hit]
        return a, hit


class TrieShard:
    """First words of one shard, and levels of successors below them."""

    MAGIC = b"EFT3trie"

    @staticmethod
    def build(context: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], discount: float = DISCOUNT) -> bytes:
        """From ascending first words (56 bits) and, per level, pointers from the nodes above, successors and their counts."""
        sums = [_sums(pointer, count) for pointer, _, count in levels]
        parts = [sums[0].astype(np.int64), *_sequence(context, 1 << 56)]
        for level, ((pointer, successor, count), total) in enumerate(zip(levels, sums, strict=True)):
            bits = next_bits(level)
            parent = np.repeat(np.arange(len(total)), np.diff(pointer))
            gamma = quantise(discount * np.diff(pointer) / np.maximum(total, 1))
            alpha = quantise((count - discount) / total[parent])
            parts += [*_sequence((parent.astype(U) << U(bits)) | successor, max(1, len(total)) << bits), *_sequence(pointer.astype(U), int(pointer[-1]) + 1), _bits(gamma.astype(U), CODE_BITS), _bits(alpha.astype(U), CODE_BITS)]
        out = [TrieShard.MAGIC]
        for x in parts:
            raw = np.ascontiguousarray(x).tobytes()
            out += [len(raw).to_bytes(8, "little"), raw]
        return b"".join(out)

    @classmethod
    def open(cls, block) -> TrieShard:
        """``block``: bytes, or a path to map into memory."""
        raw = np.memmap(block, np.uint8, "r") if isinstance(block, str) else np.frombuffer(block, np.uint8)
        if raw[:8].tobytes() != cls.MAGIC:
            raise ValueError("not a trie shard")
        at, parts = 8, []
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 8].tobytes(), "little")
            parts.append(raw[at + 8 : at + 8 + n])
            at += 8 + n

        def sequence(i: int) -> EliasFano:
            n, low = np.frombuffer(parts[i].tobytes(), np.int64).tolist()
            return EliasFano(n, low, parts[i + 1].view(U), parts[i + 2].view(U))

        self = cls()
        self.total, self.contexts = np.frombuffer(parts[0].tobytes(), np.int64), sequence(1)
        below = range(4, len(parts), 8)
        self.successors, self.pointers = [sequence(i) for i in below], [sequence(i + 3) for i in below]
        self._gamma, self._alpha = [parts[i + 6].view(U) for i in below], [parts[i + 7].view(U) for i in below]
        return self

    def context(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each first word, -1: unknown; its token count."""
        at, hit = self.contexts.find(x)
        at = np.where(hit, at, -1)
        return at, np.where(at >= 0, self.total[np.maximum(at, 0)], 0) if len(self.total) else np.zeros(len(at), np.int64)

    def gamma(self, level: int, parent: np.ndarray) -> np.ndarray:
        """Quantised weight that nodes leave to shorter histories; 0 for place -1 and nodes without successors."""
        return _codes(self._gamma[level], parent)

    def alpha(self, level: int, at: np.ndarray) -> np.ndarray:
        """Quantised discounted probability of successors; 0 for place -1."""
        return _codes(self._alpha[level], at)

    def down(self, level: int, parent: np.ndarray, n: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Place of the successors asked for, ``n`` of each parent's (-1: unknown), on the level below; -1: none.

        A node's pointers bound its successors; they are searched for in that range only.
        """
        known = parent >= 0
        p = np.where(known, parent, 0)
        pointers = self.pointers[level]
        first, last = pointers.at(p).astype(np.int64), pointers.at(np.minimum(p + 1, pointers.n - 1)).astype(np.int64)
        last = np.where(known, last, first)
        at, hit = self.successors[level].find((np.repeat(p, n).astype(U) << U(next_bits(level))) | successor, np.repeat(first, n), np.repeat(last, n))
        return np.where(hit, at, -1)


def _sequence(values: np.ndarray, universe: int) -> list[np.ndarray]:
    low, upper, lower = EliasFano.build(values, universe)
    return [np.array([len(values), low], np.int64), upper, lower]


def _sums(pointer: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of the counts between every two pointers."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(count, dtype=np.int64)])
    return total[pointer[1:]] - total[pointer[:-1]]


def _codes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, _take(words, CODE_BITS, np.maximum(at, 0)), U(0)).astype(np.uint16)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and token of every place of every document, and bounds of documents."""
    buf, off = B.column(table, "text")
    hashes, sizes = [], []
    for i, j in B.slices(off):
        h, _, _, at = B.words(buf[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        hashes.append(np.clip(h, U(1 << 8), U((1 << 64) - (1 << 9))))
        sizes.append(np.diff(at))
    h, n = np.concatenate(hashes), np.concatenate(sizes)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    token = np.full(int(bounds[-1]), END, U)
    inner = np.ones(len(token), bool)
    inner[bounds[1:] - 1] = False
    token[inner] = h
    context = np.concatenate([[BEGIN], token[:-1]])
    context[bounds[:-1]] = BEGIN
    return context, token, bounds


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each first word (56 bits) begins n-grams; word null: all of them."""
    for batch in batches:
        B.release()
        if batch.num_rows:
            word, n = np.unique(_tokens(pa.Table.from_batches([batch]))[0] >> U(8), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([None, *word.tolist()], pa.int64()), pa.array([int(n.sum()), *n.tolist()], pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """First words (56 bits, ascending) that begin more than a shard's share of the n-grams, and over how many shards, a power of two, theirs are dealt.

    They are fewer than shards. Counted in a sample, which only balances the shards: about 4 KB of text for each of them, 16 MB at least.
    """
    every = max(1, total // max(16 << 20, shards << 12))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")
    counts = some.mapInArrow(_first_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), F.asc_nulls_first("word")).limit(shards + 1).toArrow().to_pydict()
    whole = dict(zip(most["word"], most["n"], strict=True)).get(None, 0)
    fan = {w: min(shards, 1 << (-(-n * shards // whole) - 1).bit_length()) for w, n in zip(most["word"], most["n"], strict=True) if w is not None and n * shards > whole}
    return np.array(sorted(fan), U), np.array([fan[w] for w in sorted(fan)], np.int64)


def _heads(context: np.ndarray, token: np.ndarray, shards: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct first words (56 bits) and which one each place has; shard and word of every head, by shards, and which head each place has.

    A head is a first word in one of its shards. A frequent word has a head in each of its shards, be there a place for it or not.
    """
    names, which = np.unique(context >> U(8), return_inverse=True)
    words, fans = frequent
    fan = np.ones(len(names), np.int64)
    known = np.isin(names, words)
    fan[known] = fans[np.searchsorted(words, names[known])]
    start = np.cumsum(fan) - fan
    word = np.repeat(np.arange(len(names)), fan)
    shard = ((names >> U(56 - (shards.bit_length() - 1))).astype(np.int64)[word] + np.arange(len(word)) - start[word]) % shards
    order = np.argsort(shard, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    place = start[which]
    spread = np.flatnonzero(known[which])
    place[spread] += (B.mix(token[spread]) % fan[which[spread]].astype(U)).astype(np.int64)
    return names, which, shard[order], word[order], at[place]


def _levels(head: np.ndarray, token: np.ndarray, bounds: np.ndarray, order: int) -> list:
    """The n-grams that begin at each place, as levels of a trie below their heads (-1: another part's).

    Per level the parents and successors of its nodes and which one each place has, -1 where the document ends before.
    """
    end = np.repeat(bounds[1:], np.diff(bounds))
    node, levels = head, []
    for level in range(order - 1):
        bits = U(next_bits(level))
        here = np.flatnonzero((node >= 0) & (np.arange(len(token)) + level < end))
        pair, which = np.unique((node[here].astype(U) << bits) | (token[here + level] >> (U(64) - bits)), return_inverse=True)
        node = np.full(len(token), -1, np.int64)
        node[here] = which
        levels.append(((pair >> bits).astype(np.int64), pair & ((U(1) << bits) - U(1)), node))
    return levels


def _ask(shards: int, order: int, frequent: tuple[np.ndarray, np.ndarray], part: int = 0, parts: int = 1):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        B.release()
        context, token, bounds = _tokens(table)
        train = np.repeat(~np.array(table.column("held_out").to_pylist(), bool), np.diff(bounds))
        names, _, shard, word, head = _heads(context, token, shards, frequent)
        mine = np.arange(shards * part // parts, shards * (part + 1) // parts)
        cut = np.searchsorted(shard, np.append(mine, mine[-1] + 1))
        names = names[word[cut[0] : cut[-1]]]
        head, cut = np.where((head >= cut[0]) & (head < cut[-1]), head - cut[0], -1), cut - cut[0]
        size, sent = len(names), []
        for level, (parent, successor, node) in enumerate(_levels(head, token, bounds, order)):
            n = np.bincount(parent, minlength=size).astype(np.uint32)
            count = np.bincount(node[train & (node >= 0)], minlength=len(parent)).astype(np.uint32)
            width = next_bits(level) // 8
            slim = np.ascontiguousarray(successor.view(np.uint8).reshape(-1, 8)[:, :width]).view(f"V{width}").reshape(-1)
            sent.append((n, np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), slim, count))
            size = len(parent)
        blocks = []
        for s, a, b in zip(mine.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a == b:
                continue
            arrays = [np.diff(names[a:b], prepend=U(0))]
            for n, edge, slim, count in sent:
                arrays.append(n[a:b])
                a, b = edge[a], edge[b]
                arrays += [slim[a:b], count[a:b]]
            blocks.append((s, B.pack(*arrays)))
        return pa.table({"shard": pa.array([x for x, _ in blocks], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(blocks), pa.int64()), "block": pa.array([x for _, x in blocks], pa.binary())})

    return run


def _unfold(block: bytes) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """First words, and per level the number of each parent's successors, the successors and their counts."""
    delta, *rest = B.unpack(block)
    levels = []
    for n, slim, count in zip(rest[::3], rest[1::3], rest[2::3], strict=True):
        wide = np.zeros((len(slim), 8), np.uint8)
        wide[:, : slim.itemsize] = slim.view(np.uint8).reshape(-1, slim.itemsize)
        levels.append((n.astype(np.int64), wide.reshape(-1).view(U), count))
    return np.cumsum(delta, dtype=U), levels


def merged(parts: list) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """First words and, per level, pointers, successors and counts of the n-grams that training documents hold."""
    context = np.unique(np.concatenate([np.repeat(names, levels[0][0])[levels[0][2] > 0] for names, levels in parts]))
    above = [np.searchsorted(context, names) for names, _ in parts]  # of those that training doesn't hold any place will do
    size, out = len(context), []
    for level in range(len(parts[0][1])):
        bits = U(next_bits(level))
        key, count, seen = [], [], []
        for up, (_, levels) in zip(above, parts, strict=True):
            n, successor, c = levels[level]
            ok = c > 0
            key.append((np.repeat(up, n)[ok].astype(U) << bits) | successor[ok])
            count.append(c[ok])
            seen.append(ok)
        key, which = np.unique(np.concatenate(key), return_inverse=True)
        total = np.bincount(which, np.concatenate(count), len(key)).astype(np.int64)
        pointer = np.searchsorted(key >> bits, np.arange(size + 1, dtype=U))
        out.append((pointer, key & ((U(1) << bits) - U(1)), total))
        size, at, above = len(key), 0, []
        for ok in seen:
            up = np.zeros(len(ok), np.int64)
            k = int(ok.sum())
            up[ok] = which[at : at + k]
            at += k
            above.append(up)
    return context, out


def _answer(discount: float, frequent: np.ndarray):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.release()
        chunks, blocks = [], []
        for batch in batches:
            chunks += batch.column("chunk").to_pylist()
            blocks += batch.column("block").to_pylist()
        context, levels = merged([_unfold(b) for b in blocks])
        trie = TrieShard.open(TrieShard.build(context, levels, discount))
        words = context != BEGIN
        spread = words & np.isin(context, frequent)  # in other shards too: counted once, by name
        tokens, kinds, often = int(trie.total[words].sum()), int((words & ~spread).sum()), context[spread].tolist()
        del context, levels
        for i, (c, block) in enumerate(zip(chunks, blocks, strict=True)):
            names, asked = _unfold(block)
            at, have = trie.context(names)
            answer = [have]
            for level, (n, successor, _) in enumerate(asked):
                answer.append(trie.gamma(level, at))
                at = trie.down(level, at, n, successor)
                answer.append(trie.alpha(level, at))
            # the shard's totals stand in one of its rows
            stats = [pa.array([x if i == 0 else 0], pa.int64()) for x in (tokens, kinds)]
            stats.append(pa.array([often if i == 0 else []], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), key_array(key), pa.array([B.pack(*answer)], pa.binary()), *stats], ["chunk", "shard", "block", "tokens", "kinds", "often"])

    return run


def key_array(key: tuple) -> pa.Array:
    return pa.array([key[0].as_py()], pa.int32())


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(tokens: int, kinds: int, *how):
    return lambda table, told: _scored(table, told, tokens, kinds, *how)


def _scored(table: pa.Table, told: pa.Table, tokens: int, kinds: int, shards: int, order: int, frequent: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    B.release()
    context, token, bounds = _tokens(table)
    names, which, _, word, head = _heads(context, token, shards, frequent)
    levels = _levels(head, token, bounds, order)
    told = told.sort_by("shard")
    have, *codes = (np.concatenate(x) for x in zip(*(B.unpack(x.as_py()) for x in told.column("block")), strict=True))
    total = np.zeros(len(names), np.int64)
    np.add.at(total, word, have)
    share = have / np.maximum(total[word], 1)  # of a first word's count that the head has; 1 but for frequent words
    docs = int(total[0])  # the first context is the beginning, seen once a training document, as often as the end
    tokens, kinds = tokens + docs, kinds + (docs > 0)
    # a place's own count is that of the next place's context
    count = np.append(total[which][1:], 0)
    count[bounds[1:] - 1] = docs
    base = (count + 0.5) / (tokens + 0.5 * (kinds + 1))
    p, above = base.copy(), head
    for level, (_, _, node) in enumerate(levels):
        here = np.flatnonzero(node >= 0)  # the n-gram that begins here predicts the token ``level`` places on
        gamma, alpha = LEVELS[codes[2 * level]], LEVELS[codes[2 * level + 1][node[here]]]
        if level:
            gamma = gamma[above[here]]
        else:
            gamma, alpha = np.bincount(word, gamma * share, len(names))[which[here]], alpha * share[head[here]]
        p[here + level] = np.where(gamma > 0, alpha + gamma * p[here + level], p[here + level])
        above = node
    out = {c: table.column(c) for c in ("doc_id", "held_out")}
    start = bounds[:-1]
    out |= {"n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), start)), "train_tokens": pa.array(np.full(len(start), tokens, np.int64))}
    return pa.table(out | {"base_score": pa.array(np.add.reduceat(np.log10(base), start)), "score": pa.array(np.add.reduceat(np.log10(np.minimum(p, 1.0)), start))})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, discount: float = DISCOUNT, order: int = 3, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Log10 probability of every document under a model of those not held out (crc32 of the id as text, mod folds).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram), score (of the
    trie). ``order``: words of the longest n-gram, two at least. Words are lower-cased (A-Z) runs of bytes other than
    ASCII white space, then one end token. Null and empty texts: the end token only. A null id is in training. Repeated
    rows count as often as they stand. An empty table gives no rows. Other columns are not read.
    """
    if order < 2:
        raise ValueError("a trie has two levels at least")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.select(F.sum(text_bytes(F.col("text")) + 8)).first()[0] or 0
    chunk_bytes = chunk_for(total, chunk_bytes)
    shards = shards_for(total, max(8 << 20, chunk_bytes))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    docs = docs.withColumn("held_out", out).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-total // chunk_bytes)))).cast("long"))
    # what an order above 2 adds to the exchange is made up for by doing it in parts, one after the other, so disk holds one
    parts, answers = min(shards, 1 << (order - 2).bit_length()), []
    frequent = frequent_words(docs, total, shards)
    for part in range(parts):
        asked = docs.groupBy("chunk").applyInArrow(_ask(shards, order, frequent, part, parts), "shard int, chunk long, block binary")
        answers.append(stash(asked.groupBy("shard").applyInArrow(_answer(discount, frequent[0]), "chunk long, shard int, block binary, tokens long, kinds long, often array<long>"), "answers"))
        del asked
        free_shuffles(docs.sparkSession)
    told = functools.reduce(DataFrame.unionByName, answers)
    tokens, kinds = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    kinds += told.select(F.explode("often")).distinct().count()
    answers = told.select("chunk", "shard", "block")
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(tokens, kinds, shards, order, frequent), OUT)
