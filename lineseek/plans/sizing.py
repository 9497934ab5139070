"""Broadcast decisions: only for tables whose size has been looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when the whole table stays within both bounds.

    Reads at most ``max_rows + 1`` rows, so the check itself stays small.
    """
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        size = F.octet_length(field.name) if isinstance(field.dataType, (StringType, BinaryType)) else F.lit(16)
        width = width + F.coalesce(size, F.lit(0))
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return n <= max_rows and (total or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, **bounds: int) -> DataFrame:
    """Mark for broadcast when it fits; otherwise leave the join to AQE."""
    return F.broadcast(df) if fits(df, **bounds) else df
