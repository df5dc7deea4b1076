"""Vectorised work on UTF-8 bytes: words, hashes, spans. Used inside Arrow batches on executors."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW: dict[str, np.ndarray] = {}


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def release() -> None:
    """Give free memory back to the system: Python workers live on from task to task, beside others."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_STEP = np.arange(1, 65, dtype=U) * _BASE
_CODE = mix(np.arange(1, 257, dtype=U) * _BASE)


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, U)
        have[0] = 1
        np.cumprod(have, out=have)
        _POW[name] = have
    return have[:n]


def column(table: pa.Table | pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null: empty."""
    col = table.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 19, rows: int = 30_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes; one longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j
        i = j


def prefix(buf: np.ndarray) -> np.ndarray:
    """S with hash of bytes [s, e) = (S[e] - S[s]) * inverse power s; see span_hash."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_CODE[buf] * powers("up", _BASE, len(buf)), out=out[1:])
    return out


def span_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((s[ends] - s[starts]) * powers("down", _INV, len(s))[starts])


def every_span_hash(s: np.ndarray, k: int) -> np.ndarray:
    """``span_hash`` of the k bytes from every place on."""
    n = len(s) - k
    return mix((s[k:] - s[:n]) * powers("down", _INV, len(s))[:n])


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row: their hashes, starts and ends, and n + 1 bounds of the rows among them."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, np.zeros(len(offsets), np.int64)
    if lower:
        buf = _LOWER[buf]
    white = _WHITE[buf]
    first, last = ~white, ~white
    first[1:] &= white[:-1]
    last[:-1] &= white[1:]
    full = np.flatnonzero(np.diff(offsets) > 0)
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a], last[b] = ~white[a], ~white[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hash(prefix(buf), starts, ends), starts, ends, np.searchsorted(starts, offsets)


def windows(values: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` values inside a row, and n + 1 bounds; a row with 1 to size - 1 values gives one hash of all."""
    n = np.diff(bounds)
    if not len(values):
        return np.zeros(0, U), np.zeros(len(bounds), np.int64)
    pad = np.concatenate([values, np.zeros(size - 1, U)])
    h = np.zeros(len(values), U)
    for j in range(size):
        h += mix(pad[j : j + len(values)] + _STEP[j]) * U(2 * j + 3)
    pos = np.arange(len(values)) - np.repeat(bounds[:-1], n)
    keep = pos <= np.repeat(n - size, n)
    for r in np.flatnonzero((n > 0) & (n < size)):
        s, e = bounds[r], bounds[r + 1]
        h[s] = U(int((mix(values[s:e] + np.arange(1, e - s + 1, dtype=U) * _BASE) * np.arange(3, 2 * (e - s) + 3, 2, dtype=U)).sum(dtype=U)) ^ (0xA5A5 + int(e - s)))
        keep[s] = True
    return mix(h[keep]), np.concatenate([[0], np.cumsum(np.where(n >= size, n - size + 1, (n > 0).astype(np.int64)))])


def sort_rows(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of every row in ascending order, and their bounds."""
    values = values.copy()
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s > 1:
            values[s:e].sort()
    if not len(values):
        return values, bounds
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one block: byte planes, compressed."""
    import zstandard

    out = [len(arrays).to_bytes(1, "little")]
    for x in arrays:
        x = np.ascontiguousarray(x)
        head = x.dtype.str.encode()
        data = x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""
        out += [len(head).to_bytes(1, "little"), head, len(x).to_bytes(8, "little"), data]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(block: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    at, out = 1, []
    for _ in range(raw[0]):
        k = raw[at]
        kind = np.dtype(raw[at + 1 : at + 1 + k].decode())
        at += 1 + k
        n = int.from_bytes(raw[at : at + 8], "little")
        at += 8
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
    return out
