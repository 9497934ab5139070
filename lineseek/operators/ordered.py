"""Running values over time that do not depend on one task per key.

A window ordered by time puts every row of a key in one task. Here a key's rows
are first split into time slices; sums per slice are small, so their running
totals give each slice what came before it, and the ordered work happens inside
a slice. A key that owns a third of all rows is spread over as many tasks as it
has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lineseek.plans.joins import join_groups

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Event time as whole microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def slice_of(ts_us: Column, slice_seconds: int) -> Column:
    return F.floor(ts_us / (slice_seconds * MICROS)).cast("bigint")


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column],
    slice_seconds: int = 3600,
    newest_first: bool = False,
) -> DataFrame:
    """Add running totals (current row included) in ``order`` within ``keys``.

    ``order[0]`` is a microsecond column; the rest breaks ties. Rows are
    shuffled once, by (keys, slice).
    """
    def direction(name: str) -> Column:
        return F.col(name).desc() if newest_first else F.col(name).asc()

    sliced = df.withColumn("__slice", slice_of(F.col(order[0]), slice_seconds))
    for name, value in totals.items():
        sliced = sliced.withColumn(f"__v_{name}", value)
    per_slice = sliced.groupBy(*keys, "__slice").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    before = W.partitionBy(*keys).orderBy(direction("__slice")).rowsBetween(W.unboundedPreceding, -1)
    bases = per_slice.select(
        *keys, "__slice", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in totals]
    )
    inside = (
        W.partitionBy(*keys, "__slice")
        .orderBy(*[direction(o) for o in order])
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    out = join_groups(sliced, bases, [*keys, "__slice"])
    for name in totals:
        out = out.withColumn(name, F.col(f"__b_{name}") + F.sum(f"__v_{name}").over(inside))
    return out.drop("__slice", *[f"__v_{n}" for n in totals], *[f"__b_{n}" for n in totals])


def with_rank(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "rn",
    slice_seconds: int = 3600,
    newest_first: bool = False,
) -> DataFrame:
    """1-based row number within ``keys``, computed slice by slice."""
    return with_running(
        df, keys, order, {name: F.lit(1).cast("bigint")}, slice_seconds, newest_first
    )


def with_overlap(df: DataFrame, keys: list[str], rank: str, block: int, reach: int) -> DataFrame:
    """Cut each key into blocks of ``block`` ranks, each preceded by a copy of the
    ``reach`` rows before it (``__context`` = True), for frames that look back."""
    if reach > block:
        raise ValueError("a block must be at least as long as the frame reaches back")
    own = F.floor((F.col(rank) - 1) / block).cast("bigint")
    feeds_next = (F.col(rank) - 1) % block >= block - reach
    return (
        df.withColumn("__own", own)
        .withColumn("__block", F.explode(F.when(feeds_next, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn("__context", F.col("__block") > F.col("__own"))
        .drop("__own")
    )
