"""Counts over whole texts that quality operators share; vectorised over slices of an Arrow batch."""

from __future__ import annotations

import numpy as np

from . import bytesops as B

U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def per_row(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def repeated_words(values: np.ndarray, bounds: np.ndarray, size: int = 5) -> np.ndarray:
    """Words inside ``size``-word windows that stand twice or more in their row."""
    n = len(values)
    if n < size:
        return np.zeros(len(bounds) - 1, np.int64)
    pos = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ok = np.flatnonzero(pos <= np.repeat(np.diff(bounds) - size, np.diff(bounds)))
    h = np.zeros(len(ok), U)
    for j in range(size):
        h = B.mix(h * U(0x9E3779B97F4A7C15) + values[ok + j])
    h ^= B.mix(row[ok].astype(U) + U(1))  # a row's windows only meet each other
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(s), bool)
    same[1:] |= s[1:] == s[:-1]
    same[:-1] |= s[1:] == s[:-1]
    at = ok[order[same]]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return per_row(np.cumsum(change[:-1]) > 0, bounds)


def lines(buf: np.ndarray, off: np.ndarray, s: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines, and lines with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(buf == 10)
    per = np.searchsorted(breaks, off)
    count = np.diff(per) + 1
    row = np.repeat(np.arange(len(count)), count)
    starts, ends = np.sort(np.concatenate([off[:-1], breaks + 1])), np.sort(np.concatenate([breaks, off[1:]]))
    words = np.concatenate([[0], np.cumsum(~white, dtype=np.int64)])
    full = words[ends] > words[starts]
    h = B.span_hash(s, starts[full], ends[full]) ^ B.mix(row[full].astype(U) + U(1))
    _, first = np.unique(h, return_index=True)
    return count, np.bincount(row[full], minlength=len(count)) - np.bincount(row[full][first], minlength=len(count))


def counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Per row n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bytes, and raw word hashes with bounds."""
    h, starts, _, bounds = B.words(buf, off, lower=False)
    white = B._WHITE[buf]
    s = B.prefix(buf)
    n_lines, dup = lines(buf, off, s, white)
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_row(~white & ((buf & 0xC0) != 0x80), off),
        "n_symbols": per_row(_SYMBOL[buf], off),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(h, bounds),
        "n_lines": n_lines,
        "n_bytes": np.diff(off),
        "n_digits": per_row(_DIGIT[buf], off),
        "n_upper": per_row(_UPPER[buf], off),
        "n_marks": per_row(_MARK[buf], off),
        "hashes": h,
        "bounds": bounds,
    }
