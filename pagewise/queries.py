"""All queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from .plans import queries_attention, queries_evaluation, queries_paging, queries_selection  # noqa: F401
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
