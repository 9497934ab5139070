"""Joins that put group results back on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys where null equals null, so that rows of a null group stay.

    It also keeps Spark from adding not-null filters below one of two uses of the
    same aggregate, which lets both share one shuffle. ``small``: the caller has
    checked that ``right`` may be broadcast.
    """
    side = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(F.broadcast(side) if small else side, same, how).drop(*[f"__r_{k}" for k in keys])
