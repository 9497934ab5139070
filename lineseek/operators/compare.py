"""Run-against-run comparison and requirement checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.operators.stats import REPORT_PERCENTILES, on_groups, outcome_columns, percentiles, summary_columns

# Allowed mean lookup time in ms, snapshot and re-read mode.
SNAPSHOT_LIMIT_MS = 0.5
REREAD_LIMIT_MS = 40.0


def run_metrics(runs: DataFrame, run_col: str, value: str, duration_seconds: DataFrame) -> DataFrame:
    """Long table (run, metric, value): mean, success, throughput, cv, percentiles.

    ``duration_seconds``: (run, seconds) of each run.
    """
    keys = [run_col]
    sums = runs.groupBy(*keys).agg(*summary_columns(value), *outcome_columns())
    wide = on_groups(sums, percentiles(runs, keys, value), keys, how="left").join(duration_seconds, run_col)
    metrics = {
        "avg_response_time": F.col("avg_response_time"),
        "success_rate": F.col("success_rate"),
        "throughput": F.when(F.col("seconds") > 0, F.col("total_requests") / F.col("seconds")).otherwise(0.0),
        "cv": F.when(F.col("avg_response_time") != 0, F.col("std_dev") / F.col("avg_response_time")),
        **{f"p{p}": F.col(f"p{p}") for p in REPORT_PERCENTILES},
    }
    return wide.select(
        run_col,
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
        ).alias("m"),
    ).select(run_col, "m.metric", "m.value")


def compare_runs(metrics: DataFrame, run_col: str, local: str, other: str) -> DataFrame:
    """One row per metric: both values, signed difference and percentage.

    One aggregation pivots the two runs, so nothing is joined.
    """
    a = F.max(F.when(F.col(run_col) == local, F.col("value")))
    b = F.max(F.when(F.col(run_col) == other, F.col("value")))
    return metrics.groupBy("metric").agg(a.alias("local"), b.alias("other")).select(
        "metric",
        "local",
        "other",
        (F.col("local") - F.col("other")).alias("difference"),
        F.when(F.col("other") != 0, (F.col("local") - F.col("other")) / F.col("other") * 100).alias("difference_pct"),
        F.when(F.col("local") < F.col("other"), "faster").otherwise("slower").alias("direction"),
    )


def recommendation(comparison: DataFrame) -> DataFrame:
    """Label from the mean response time: better than the other run or not."""
    return comparison.where(F.col("metric") == "avg_response_time").select(
        "difference",
        "difference_pct",
        F.when(F.col("difference") < 0, "performing well").otherwise("needs improvement").alias("recommendation"),
    )


def full_comparison(left: DataFrame, right: DataFrame, key: str, missing: float = float("inf")) -> DataFrame:
    """Two result sets side by side; a side without the key counts as infinite."""
    a = left.select(key, F.col("value").alias("left_value"))
    b = right.select(key, F.col("value").alias("right_value"))
    return a.join(b, key, "full_outer").select(
        key,
        F.coalesce("left_value", F.lit(missing)).alias("left_value"),
        F.coalesce("right_value", F.lit(missing)).alias("right_value"),
    )


def requirement_check(
    snapshot: DataFrame,
    reread: DataFrame,
    key: str,
    value: str = "response_ms",
    snapshot_limit: float = SNAPSHOT_LIMIT_MS,
    reread_limit: float = REREAD_LIMIT_MS,
) -> DataFrame:
    """Mean time per corpus size in both modes and whether both limits hold.

    Samples without a positive time failed and are left out of the mean.
    """
    def means(df: DataFrame) -> DataFrame:
        return df.where(F.col(value) > 0).groupBy(key).agg(F.avg(value).alias("value"))

    both = full_comparison(means(snapshot), means(reread), key)
    return both.select(
        key,
        F.col("left_value").alias("snapshot_ms"),
        F.col("right_value").alias("reread_ms"),
        ((F.col("left_value") <= snapshot_limit) & (F.col("right_value") <= reread_limit)).alias("meets_requirement"),
    )
