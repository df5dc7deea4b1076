"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from . import attention, clustering, corpora, relational, retrieval, tasksets, updates, vectors  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
