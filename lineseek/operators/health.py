"""Health checks over metric rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.functions.text import number
from lineseek.plans.joins import join_groups

# Default limits.
SYSTEM_LIMITS = {"memory_percent": 80.0, "cpu_percent": 80.0}
SYSTEM_LABELS = {"memory_percent": "high memory usage", "cpu_percent": "high CPU usage"}
METRIC_LIMITS = {
    "cpu_percent": 80.0,
    "memory_percent": 80.0,
    "disk_usage_percent": 80.0,
    "open_files": 1000.0,
    "thread_count": 100.0,
}


def issues(limits: Mapping[str, float] = SYSTEM_LIMITS, labels: Mapping[str, str] = SYSTEM_LABELS) -> Column:
    """Texts of the metrics above their limit, e.g. ``high CPU usage: 85.2%``."""
    texts = [
        F.when(F.col(m) > limit, F.concat(F.lit(f"{labels[m]}: "), number(F.col(m), 1), F.lit("%")))
        for m, limit in limits.items()
    ]
    return F.array_compact(F.array(*texts))


def system_health(samples: DataFrame) -> DataFrame:
    """Unhealthy when a metric is above its limit; at the limit it is healthy."""
    details = F.create_map(*[x for m in SYSTEM_LIMITS for x in (F.lit(m), F.col(m).cast("double"))])
    return (
        samples.withColumn("issues", issues())
        .withColumn("healthy", F.size("issues") == 0)
        .withColumn("details", details)
    )


def limits_with(changes: Mapping[str, float]) -> dict[str, float]:
    """Default limits with changes; an unknown metric is rejected."""
    unknown = set(changes) - set(METRIC_LIMITS)
    if unknown:
        raise ValueError(f"Invalid metric: {sorted(unknown)}")
    return {**METRIC_LIMITS, **changes}


def metric_health(samples: DataFrame, limits: Mapping[str, float] = METRIC_LIMITS) -> DataFrame:
    """Healthy only when every metric is below its limit; at the limit it is not."""
    ok = F.lit(True)
    for metric, limit in limits.items():
        ok = ok & (F.col(metric) < limit)
    return samples.withColumn("healthy", ok)


def component_report(checks: DataFrame) -> DataFrame:
    """Status and issues of each component from (component, healthy, issues)."""
    found = checks.select("component", F.explode("issues").alias("issue")).distinct()
    texts = found.groupBy("component").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    status = checks.groupBy("component").agg(
        F.bool_and("healthy").alias("healthy"), F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("healthy")).alias("failed_checks"),
    )
    return join_groups(status, texts, ["component"], "left").withColumn(
        "issues", F.coalesce("issues", F.array().cast("array<string>"))
    )


def component_counts(checks: DataFrame) -> DataFrame:
    """Like ``component_report`` with issue counts instead of texts, for checks
    whose texts are unbounded in number."""
    return checks.groupBy("component").agg(
        F.bool_and("healthy").alias("healthy"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("healthy")).alias("failed_checks"),
        F.sum(F.size("issues")).alias("n_issues"),
    )


def overall(report: DataFrame) -> DataFrame:
    return report.agg(
        F.when(F.bool_and("healthy"), "healthy").otherwise("unhealthy").alias("overall_status"),
        F.count_if(~F.col("healthy")).alias("unhealthy_components"),
        F.sum("failed_checks").alias("failed_checks"),
    )
