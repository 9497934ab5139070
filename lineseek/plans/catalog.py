"""All registered queries and their SQL."""

from __future__ import annotations

from lineseek.plans import catalog_requests, catalog_search, catalog_streaming, catalog_telemetry  # noqa: F401
from lineseek.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
