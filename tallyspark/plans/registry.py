"""Registered queries and their SQL."""

from __future__ import annotations

from . import engine_queries, filing_queries, offer_queries, series, statements, tables  # noqa: F401
from .base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
