"""Token-id output compressed by Re-Pair grammars, one a shard, with random-access decoding.

A shard holds the ids of consecutive documents. Round after round the frequent pairs of neighbouring symbols become
nonterminals, until no pair stands twice: a round counts all pairs that may stand twice, takes the most frequent ones,
of overlapping occurrences that of the more frequent pair, and leaves pairs with too few occurrences to later rounds.
The file keeps, per shard, the rules, each rule's expansion length, the packed
final sequence and the documents' lengths. A shard is one binary value in a Parquet file, so any store that Spark
writes will do, and a lost executor's work is redone by Spark's commit protocol.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B

U = np.uint64
MAGIC = b"RPG1"


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers: count, bits, the lower 16 bits (8, if they do), then a bit plane for every further bit."""
    x = np.asarray(x, np.uint32)
    width = max(1, int(x.max(initial=0)).bit_length())
    low = x.astype("<u1" if width <= 8 else "<u2").tobytes()
    return len(x).to_bytes(8, "little") + bytes([width]) + low + b"".join(np.packbits((x >> j & 1).astype(np.uint8)).tobytes() for j in range(16, width))


def _unpacked(raw: memoryview, at: int) -> tuple[np.ndarray, int]:
    n, width, at = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8], at + 9
    kind = np.dtype("<u1" if width <= 8 else "<u2")
    x = np.frombuffer(raw, kind, n, at).astype(np.uint32)
    at += n * kind.itemsize
    for j in range(16, width):
        x |= np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(np.uint32) << np.uint32(j)
        at += -(-n // 8)
    return x, at


def _sorted_pairs(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, ordered by the pair that begins there and then by place, and the first of each pair among them."""
    width, bits = int(seq.max()).bit_length(), len(seq).bit_length()
    key = (seq[at].astype(U) << U(width)) | seq[at + 1]
    if 2 * width + bits <= 64:  # the place fits below the pair: one sort of plain numbers
        key = (key << U(bits)) | at.astype(U)
        key.sort()
        at = (key & U((1 << bits) - 1)).astype(np.int64)
        key >>= U(bits)
    else:
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
    return at, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])


def _apart(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of which no two touch: again and again those that outrank both neighbours. ``rank`` is 0 elsewhere and gets used up."""
    taken = []
    while len(at):
        r = rank[at]
        best = at[(r > rank[at - 1]) & (r > rank[at + 1])]
        taken.append(best)
        rank[best - 1] = rank[best] = rank[best + 1] = 0
        at = at[rank[at] > 0]
    return np.sort(np.concatenate(taken))


def grammar(seq: np.ndarray, base: int, rounds: int | None, most: int, least: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Final sequence, rules (pairs of symbols; rule r is symbol base + r) and the first rule of each round.

    Ends when no pair stands ``least`` times without overlap, or after ``rounds`` if that is a number. Of overlapping
    occurrences the more frequent pair's is taken; so all those of the most frequent one are, and no round is in vain.
    A pair of old symbols never gets more frequent: once it stands too seldom, its places aren't counted again.
    """
    seq = np.ascontiguousarray(seq, np.uint32)
    rules, firsts, top = [], [], base
    live = np.ones(max(len(seq) - 1, 0), bool)  # places whose pair may still be frequent
    while (rounds is None or len(firsts) < rounds) and live.any():
        at = np.flatnonzero(live)
        # in a run of one symbol every other place counts
        equal = at[seq[at] == seq[at + 1]]
        if len(equal):
            fresh = np.ones(len(equal), bool)
            np.not_equal(equal[1:], equal[:-1] + 1, out=fresh[1:])
            place = np.arange(len(equal))
            odd = equal[((place - np.maximum.accumulate(np.where(fresh, place, 0))) & 1) == 1]
            live[odd] = False
            at = np.flatnonzero(live)
            live[odd] = True
        at, start = _sorted_pairs(seq, at)
        count = np.diff(np.append(start, len(at)))
        live[at[np.repeat(count < least, count)]] = False
        good = np.flatnonzero(count >= least)
        if len(good) > most:
            good = good[np.argpartition(-count[good], most)[:most]]
        if not len(good):
            break
        good = good[np.argsort(count[good], kind="stable")]
        number = np.zeros(len(start), np.int32)
        number[good] = np.arange(1, len(good) + 1)
        rank = np.zeros(len(seq) + 2, np.int32)  # of the place before; none outranks what lies outside
        number = np.repeat(number, count)
        at, number = at[number > 0], number[number > 0]
        rank[at + 1] = number
        which = rank.copy()
        at = _apart(rank, at + 1) - 1
        which = which[at + 1]
        often = np.bincount(which, minlength=len(good) + 1) >= least
        at, which = at[often[which]], which[often[which]]
        used = np.flatnonzero(often)
        one = np.zeros(len(good) + 1, np.int64)
        one[which] = at
        pairs = np.stack([seq[one[used]], seq[one[used] + 1]], 1).astype(np.int64)
        name = np.zeros(len(good) + 1, np.uint32)
        name[used] = np.arange(top, top + len(used))
        seq = seq.copy()
        seq[at] = name[which]
        live = np.append(live, False)
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, live = seq[keep], live[keep][: max(int(keep.sum()) - 1, 0)]
        firsts.append(top - base)
        rules.append(pairs)
        top += len(used)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), firsts


def encode_shard(ids: np.ndarray, lengths: np.ndarray, base: int, rounds: int | None = None, most: int = 8192, least: int = 2) -> bytes:
    """A shard's block: document lengths, round starts, rules, expansion lengths, final sequence."""
    seq, rules, firsts = grammar(ids, base, rounds, most, least)
    size = np.ones(base + len(rules), np.int64)
    for a, b in zip(firsts, [*firsts[1:], len(rules)], strict=False):
        size[base + a : base + b] = size[rules[a:b, 0]] + size[rules[a:b, 1]]
    parts = [_packed(x) for x in (lengths, np.array(firsts), rules[:, 0], rules[:, 1], size[base:], seq)]
    return MAGIC + base.to_bytes(4, "little") + b"".join(parts)


class Shard:
    """A shard opened for decoding."""

    def __init__(self, block: bytes):
        raw = memoryview(block)
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a Re-Pair shard")
        self.base, at, parts = int.from_bytes(raw[4:8], "little"), 8, []
        for _ in range(6):
            x, at = _unpacked(raw, at)
            parts.append(x)
        lengths, firsts, a, b, size, self.seq = parts
        self.lengths, self.firsts = lengths.astype(np.int64), firsts.astype(np.int64)
        self.rules = np.stack([a, b], 1)
        self.size = np.concatenate([np.ones(self.base, np.int64), size.astype(np.int64)])
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        self._ends = None

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.size[seq])
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        at = ends - self.size[seq]
        while len(seq):  # a step down all parse trees at once; ids go to their places
            leaf = seq < self.base
            out[at[leaf]] = seq[leaf]
            rule, at = self.rules[seq[~leaf] - self.base], at[~leaf]
            seq, at = np.concatenate([rule[:, 0], rule[:, 1]]), np.concatenate([at, at + self.size[rule[:, 0]]])
        return out

    def ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids at places [start, stop) of the shard; only the symbols that cover them are expanded."""
        if self._ends is None:
            self._ends = np.cumsum(self.size[self.seq])
        if stop <= start:
            return np.zeros(0, np.int64)
        a = int(np.searchsorted(self._ends, start, "right"))
        b = int(np.searchsorted(self._ends, stop, "left"))
        before = int(self._ends[a - 1]) if a else 0
        return self._expand(self.seq[a : b + 1])[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.bounds[i]), int(self.bounds[i + 1]))


def _byte_letters() -> str:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join([chr(b if b in own else next(rest)) for b in range(256)])


class _Pieces(dict):
    """Ids of pieces; a piece that isn't there yet is taken from the generation before, or encoded, when it is asked for."""

    def __init__(self, encode, old: dict | None = None):
        super().__init__({"": b""})
        self.encode, self.old = encode, old or {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.encode(piece)
        self[piece] = out
        return out

    def younger(self, most: int) -> "_Pieces":
        """Itself, or once it has over ``most`` pieces a new generation, which drops the one before this."""
        if len(self) <= most:
            return self
        self.old = {}
        return _Pieces(self.encode, self)


class Encoder:
    """Ids of texts, as bytes of little-endian 32-bit numbers.

    Texts are cut at spaces and line ends, at which the tokenizer cuts anyway; Arrow numbers the distinct pieces of a
    batch, each is looked up or encoded once, and the ids of all places are gathered from those. Of a piece of plain letters with marks around them, letters and marks are looked up on their own, and the
    library's model encodes the letters, without the machinery around it; whether that gives what the whole
    tokenizer gives is tried when it is opened, and pieces of other kinds, or with one of the tokenizer's added tokens
    in them, go through the whole tokenizer.
    """

    #: Marks: ASCII punctuation but the apostrophe, which joins letters to contractions.
    PLAIN = re.compile("([!-&(-/:-@\\[-`{-~]*)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
    TRIALS = ("a", "Ab", "the", "Tion,", "(word.", "It", "s", "re", "\u00e9t\u00e9", "ci\u00f3n;", "\u00c4rger", "stra\u00dfe:", "won|$$", "ll", "ve?!", "<THEM>", "#x", "<|startoftext|>", "(<|endoftext|>).")

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE).search
        self.split = True
        self._clear()
        try:
            self.split = all(self._piece(w) == self._whole(w) for w in self.TRIALS)
        except Exception:  # a model of another kind
            self.split = False
        self._clear()

    def _clear(self) -> None:
        self.known, self.marks = _Pieces(self._piece), _Pieces(self._whole)

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, stem: str) -> bytes:
        letters = stem if stem.isascii() else codecs.charmap_decode(stem.encode(), "strict", self.letters)[0]
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if self.split and not self.added(piece):
            if piece.isascii() and piece.isalpha():
                return self._stem(piece.lower())
            if found := self.PLAIN(piece):
                before, stem, after = found.groups()
                return self.marks[before] + self._stem(stem.lower()) + self.marks[after]
        return self._whole(piece)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's; null: none."""
        self.known = self.known.younger(self.most)
        pieces = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        found = [self.known[x] for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat(first[which] - ends[:-1], n) + np.arange(int(ends[-1]))
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        return np.frombuffer(b"".join(found), "<u4")[places], np.diff(ends[offsets - offsets[0]])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        flat, size = self.ids(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])] if len(size) else []


#: One encoder a worker process and tokenizer: its pieces serve the tasks that follow.
_ENCODERS: dict[str, Encoder] = {}


def _write(path: str, end: int, shard_tokens: int, base: int, how: dict):
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_token", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder, part = _ENCODERS[path], TaskContext.get().partitionId()
        held, sizes, names, first, shard = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids, lengths = np.concatenate(held), np.concatenate(sizes)
            block = encode_shard(ids, lengths, base, **how)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, shard, first, np.concatenate(names), len(ids), block), schema, strict=True)], schema=schema)

        size = 0
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            doc = batch.column("doc_id")
            _, off = B.column(batch, "text")
            for i, j in B.slices(off, 8 << 20):
                ids, n = encoder.ids(text.slice(i, j - i))
                ends = np.cumsum(n + 1)
                full = np.full(int(ends[-1]), end, np.uint32)
                inner = np.ones(len(full), bool)
                inner[ends - 1] = False
                full[inner] = ids
                a = 0
                while a < j - i:  # a shard ends after the document that fills it
                    before = int(ends[a - 1]) if a else 0
                    b = min(int(np.searchsorted(ends, before + shard_tokens - size)) + 1, j - i)
                    held.append(full[before : int(ends[b - 1])])
                    sizes.append(n[a:b] + 1)
                    names.append(np.array(doc.slice(i + a, b - a).to_pylist(), object))
                    size, a = size + len(held[-1]), b
                    if size >= shard_tokens:
                        yield flush()
                        held, sizes, names, first, size, shard = [], [], [], first + size, 0, shard + 1
        if size:
            yield flush()

    return run


WRITTEN = "part int, shard int, first_token long, doc_ids array<long>, n_tokens long, block binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, base: int = 1 << 16, shard_tokens: int = 1 << 20, **how) -> None:
    """Encode whole texts and write their grammars under ``path``, in ascending order of ids (null first).

    Null text counts as empty and has the end id only. Repeated ids stand next to each other, ordered by text.
    ``base``: first nonterminal, above every token id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_write(tokenizer, end, shard_tokens, base, how), WRITTEN).write.option("compression", "uncompressed").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, names, block in zip(*(batch.column(c).to_pylist() for c in ("part", "first_token", "doc_ids", "block")), strict=True):
            shard = Shard(block)
            raw = memoryview(shard.ids().astype("<u4", copy=False)).cast("B")
            at = (4 * shard.bounds).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(first + shard.bounds[:-1]), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written path: doc_id, start (ids before it), n_tokens, ids_crc32, decoded from the grammars.

    Only the totals of the writer's partitions pass through one task.
    """
    from pyspark.sql import Window

    files = spark.read.schema(WRITTEN).parquet(path)
    ends = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(ends) - F.col("n")).drop("n")
    rows = files.select("part", "first_token", "doc_ids", "block").mapInArrow(_read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(parts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
