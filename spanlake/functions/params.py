"""Derivations of index and budget parameters from the number of indexed tokens."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Target vectors a cluster, vectors a page.
CLUSTER_TARGET = 16
PAGE = 8


def half_away(x: float) -> int:
    """Rounding of halves away from zero, as cluster counts use it (budgets round halves to even)."""
    return int(math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1))


def cluster_counts(tokens: int, parts: int, target: int = CLUSTER_TARGET, override: tuple[int, ...] | None = None) -> tuple[int, ...]:
    """Clusters of each subspace: one for a plain inverted file (0 parts), two or four for a multi-index."""
    if parts not in (0, 2, 4):
        raise ValueError("parts must be 0, 2 or 4")
    if override:
        return tuple(override[: max(parts, 1)])
    ratio = tokens / target
    if parts == 0:
        return (max(half_away(ratio), 1),)
    if parts == 2:
        return (max(int(math.sqrt(ratio)), 32),) * 2
    return (max(half_away(ratio**0.25), 2),) * 4


@dataclass(frozen=True)
class Budget:
    """What one retrieval step may touch."""

    centroids: int
    probes: int
    tokens: int
    cache_pages: int
    buffer_pages: int


def pages(tokens: int, page: int = PAGE) -> int:
    return -(-tokens // page)


def list_capacity(max_length: int, max_new: int, start: int, end: int) -> int:
    """Tokens that the inverted lists can hold; 0: attention stays dense."""
    return max(max_length - max_new - (start + end), 0)


def budget(centroids: int, capacity: int, share: float, cache_ratio: float = 0.0, pages_per_cluster: int = 2, buffer_clusters: int = 0) -> Budget:
    """``centroids`` counts real clusters, without padding."""
    probes = min(max(round(centroids * share), 1), centroids)
    tokens = max(int(share * capacity), 1)
    cached = round((centroids + 1) * cache_ratio) if cache_ratio > 0 else 3 * probes
    return Budget(centroids, probes, tokens, max(cached * pages_per_cluster, 1), max(buffer_clusters, pages(tokens)))


def hot_capacity(capacity: int, ratio: float = 0.3) -> int:
    return max(int(capacity * min(ratio, 1.0)), 1)


def prefetch_clusters(probes: int, ratio: float, centroids: int) -> int:
    """Clusters that a warm-up touches; a ratio of 0 or less turns it off."""
    return 0 if ratio <= 0 else min(max(int(probes * ratio), 1), centroids)
