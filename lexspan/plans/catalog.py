"""All queries of the library by name, and the SQL that each of them equals."""

from __future__ import annotations

from . import evaluation, extraction, joins, numbering, quality, relational, retrieval, streams, text_queries, windows  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
