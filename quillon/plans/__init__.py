"""Queries by name, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from quillon.plans import search_queries, store_queries, text_queries  # noqa: F401  they register
from quillon.plans.registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """Hybrid retrieval: BM25 and hash-embedding rankings, fused, with content."""
    return search_queries.hydrated(spark, sf_dir, 5).select("qid", "key", "rank", "score", "content")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
