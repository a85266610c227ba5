"""All registered table queries."""

from __future__ import annotations

from . import feed_queries, listing_queries, price_queries, stream_queries
from .price_queries import deal_screen
from .registry import QUERIES, SQL

MODULES = (listing_queries, price_queries, feed_queries, stream_queries)
__all__ = ["MODULES", "deal_screen", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
