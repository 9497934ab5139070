"""Metric history: retention, trailing windows, rolling and cumulative values."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lineseek.operators.ordered import MICROS, slice_of, with_overlap, with_rank, with_running
from lineseek.plans.joins import join_groups

# History length, red line of a gauge, error-rate limit.
KEEP_LAST = 1000
GAUGE_RED = 80.0
ERROR_RATE_LIMIT = 0.1


def keep_newest(
    df: DataFrame, keys: list[str], order: list[str], n: int = KEEP_LAST, slice_seconds: int = 3600
) -> DataFrame:
    """Newest n samples of every series (``order`` = microseconds, tie breakers).

    Counts per time slice show which slices can still hold one of the newest n;
    only their rows are shuffled and ranked.
    """
    if not keys:
        return df.orderBy(*[F.col(o).desc() for o in order]).limit(n)
    sliced = df.withColumn("__slice", slice_of(F.col(order[0]), slice_seconds))
    newer = W.partitionBy(*keys).orderBy(F.col("__slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    per_slice = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    live = (
        per_slice.withColumn("__newer", F.coalesce(F.sum("__n").over(newer), F.lit(0)))
        .where(F.col("__newer") < n)
        .drop("__n")
    )
    inside = W.partitionBy(*keys, "__slice").orderBy(*[F.col(o).desc() for o in order])
    return (
        join_groups(sliced, live, [*keys, "__slice"])
        .withColumn("__rn", F.col("__newer") + F.row_number().over(inside))
        .where(F.col("__rn") <= n)
        .drop("__slice", "__newer", "__rn")
    )


def trailing(df: DataFrame, ts: str, now: Column, seconds: float | None) -> DataFrame:
    """Samples of the last ``seconds`` before ``now``; the bound is included."""
    if seconds is None:
        return df
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL '{seconds}' SECOND"))


def expire(df: DataFrame, ts: str, now: Column, retention: dt.timedelta) -> DataFrame:
    """Retention by age (metrics 3600 s, alerts 86400 s by default elsewhere)."""
    return trailing(df, ts, now, int(retention.total_seconds()))


def rolling_mean(
    df: DataFrame, keys: list[str], order: list[str], value: str, n: int = KEEP_LAST, slice_seconds: int = 3600,
    block: int = 20_000,
) -> DataFrame:
    """Mean of the last n values up to each row (``rolling_mean``).

    Ranks cut a key into blocks that carry the n-1 rows before them. In a block
    the mean is the difference of two running sums: constant work per row for any
    n, on sums short enough to stay accurate.
    """
    ranked = with_rank(df, keys, order, "__rn", slice_seconds)
    blocks = with_overlap(ranked, keys, "__rn", block, n - 1)
    w = W.partitionBy(*keys, "__block").orderBy("__rn")
    running = blocks.withColumn("__sum", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("__sum", n).over(w), F.lit(0.0))
    count = F.least(F.col("__rn"), F.lit(n))
    return (
        running.withColumn("rolling_mean", (F.col("__sum") - before) / count)
        .where(~F.col("__context"))
        .drop("__rn", "__block", "__context", "__sum")
    )


def cumulative_rate(
    df: DataFrame, keys: list[str], order: list[str], start_us: Column, slice_seconds: int = 3600
) -> DataFrame:
    """Requests per second since start at each request; null at elapsed 0."""
    elapsed = (F.col(order[0]) - start_us) / MICROS
    return (
        with_rank(df, keys, order, "request_count", slice_seconds)
        .withColumn("requests_per_second", F.when(elapsed > 0, F.col("request_count") / elapsed))
    )


def running_found_rate(
    df: DataFrame, keys: list[str], order: list[str], found: str = "found", slice_seconds: int = 3600
) -> DataFrame:
    """Found rate in percent after each request."""
    totals = {"total_searches": F.lit(1).cast("bigint"), "found_so_far": F.col(found).cast("bigint")}
    return with_running(df, keys, order, totals, slice_seconds).withColumn(
        "found_rate", F.col("found_so_far") * 100.0 / F.col("total_searches")
    )


def _with_lookback(df: DataFrame, ts_us: str, seconds: int, slice_seconds: int) -> DataFrame:
    """Copies each row into the later slices whose range frames can reach it."""
    if slice_seconds < seconds:
        raise ValueError("a slice must be at least as long as the frame")
    own = slice_of(F.col(ts_us), slice_seconds)
    next_start = (own + 1) * (slice_seconds * MICROS)
    reaches = F.col(ts_us) >= next_start - seconds * MICROS
    return (
        df.withColumn("__own", own)
        .withColumn("__slice", F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn("__context", F.col("__slice") > F.col("__own"))
        .drop("__own")
    )


def _up_to(keys: list[str], ts_us: str, back_us: int):
    """Frame from the start of the slice to ``back_us`` before the row. It only
    grows, so Spark adds each row to it once, however many rows it spans."""
    return W.partitionBy(*keys, "__slice").orderBy(ts_us).rangeBetween(W.unboundedPreceding, -back_us)


def trailing_mean_alarm(
    df: DataFrame,
    keys: list[str],
    ts_us: str,
    value: str,
    seconds: int = 60,
    limit: float = ERROR_RATE_LIMIT,
    slice_seconds: int = 3600,
) -> DataFrame:
    """Mean of the samples of the last ``seconds`` at each sample, and whether it
    is above the limit (strictly).

    Time slices carry the tail of the slice before, so one busy series is many
    tasks. The mean is a difference of two growing sums, kept in decimals so that
    a mean that equals the limit does not trip it.
    """
    now = _up_to(keys, ts_us, 0)
    past = _up_to(keys, ts_us, seconds * MICROS + 1)
    exact = F.col(value).cast("decimal(28,12)")

    def between(agg) -> Column:
        return agg(exact).over(now) - F.coalesce(agg(exact).over(past), F.lit(0))

    return (
        _with_lookback(df, ts_us, seconds, slice_seconds)
        .withColumn("trailing_mean", between(F.sum).cast("double") / between(F.count))
        .where(~F.col("__context"))
        .drop("__slice", "__context")
        .withColumn("alarm", F.col("trailing_mean") > limit)
    )


def counter_rate(
    df: DataFrame, keys: list[str], order: list[str], value: str, seconds: int = 300, slice_seconds: int = 3600
) -> DataFrame:
    """Per-second increase of a counter over the last ``seconds`` at each sample.

    A drop means the counter restarted: the new value is the increase. The
    increase runs from the first to the last sample inside the range; there is
    no extrapolation to the edges of the range.
    """
    ts_us = order[0]
    ordered = W.partitionBy(*keys, "__slice").orderBy(*order)
    prev = F.lag(value).over(ordered)
    step = F.when(prev.isNull(), F.lit(0)).when(F.col(value) >= prev, F.col(value) - prev).otherwise(F.col(value))
    # __total never falls, so the largest total up to a time is the last one
    first_inside = F.coalesce(
        F.max("__next").over(_up_to(keys, ts_us, seconds * MICROS + 1)),
        F.min("__total").over(W.partitionBy(*keys, "__slice")),
    )
    return (
        _with_lookback(df, ts_us, seconds, slice_seconds)
        .withColumn("__step", step)
        .withColumn("__total", F.sum("__step").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("__next", F.lead("__total").over(ordered))
        .withColumn("rate", (F.max("__total").over(_up_to(keys, ts_us, 0)) - first_inside) / F.lit(float(seconds)))
        .where(~F.col("__context"))
        .drop("__slice", "__context", "__step", "__total", "__next")
    )


def degradation(
    df: DataFrame, keys: list[str], order: list[str], value: str, run: int = KEEP_LAST, slice_seconds: int = 3600
) -> DataFrame:
    """Means of consecutive runs of ``run`` samples: stable while the largest mean
    stays below twice the smallest. The last, shorter run counts too."""
    ranked = with_rank(df, keys, order, "__rn", slice_seconds)
    runs = ranked.groupBy(*keys, F.floor((F.col("__rn") - 1) / run).alias("run")).agg(F.avg(value).alias("run_mean"))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min("run_mean").alias("min_mean"),
        F.max("run_mean").alias("max_mean"),
        (F.max("run_mean") < 2 * F.min("run_mean")).alias("stable"),
    )


def gauges(df: DataFrame, keys: list[str], order: list[str], value: str, red_at: float = GAUGE_RED) -> DataFrame:
    """Latest non-null value of every metric and its colour; ``order`` ends with what breaks ties of time."""
    seen = df.where(F.col(value).isNotNull())
    return seen.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("latest")).withColumn(
        "colour", F.when(F.col("latest") >= red_at, "red").otherwise("green")
    )


def resident_mib(value_bytes: Column) -> Column:
    return value_bytes / 1024 / 1024


def open_sessions(
    df: DataFrame, keys: list[str], order: list[str], change: Column, slice_seconds: int = 3600
) -> DataFrame:
    """Open connections after each connect (+1) / close (-1) event."""
    return with_running(df, keys, order, {"open_sessions": change.cast("bigint")}, slice_seconds)


