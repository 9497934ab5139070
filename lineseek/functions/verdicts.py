"""Verdict text of a lookup: building it and reading it back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The answers a client can get.
EXISTS = "STRING EXISTS"
NOT_FOUND = "STRING NOT FOUND"
RATE_LIMITED = "RATE LIMIT EXCEEDED"
FAILED = "SERVER ERROR"


def verdict(found: Column) -> Column:
    return F.when(found, F.lit(EXISTS)).otherwise(F.lit(NOT_FOUND))


def response_text(verdict_col: Column, duration_ms: Column) -> Column:
    return F.format_string("%s;%.2f", verdict_col, duration_ms)


def parse_response(response: Column) -> tuple[Column, Column]:
    """(verdict, duration_ms). A bare verdict counts as 0.0 ms."""
    parts = F.split(F.btrim(response), ";")
    ms = F.get(parts, F.lit(1)).try_cast("double")
    return F.get(parts, F.lit(0)), F.coalesce(ms, F.lit(0.0))
