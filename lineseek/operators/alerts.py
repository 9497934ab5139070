"""Alerts: raising, filtering, dedup, resolution, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lineseek.operators.ordered import slice_of
from lineseek.plans.joins import join_groups

# Alert levels; per-source metric, limit, level and detail name.
LEVELS = ("info", "warning", "error", "critical")
SOURCE_RULES = {
    "memory": ("memory_percent", 80.0, "warning", "usage"),
    "cpu": ("cpu_percent", 80.0, "warning", "usage"),
    "disk": ("disk_usage_percent", 80.0, "warning", "usage"),
    "error_rate": ("error_rate", 0.1, "warning", "rate"),
    "connection_pool": ("connection_usage_percent", 90.0, "warning", "usage"),
    "search_latency": ("search_latency_ms", 1000.0, "warning", "latency"),
}


def alert(ts: Column, level: Column, source: Column, message: Column, details: Column | None = None) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.struct(
        ts.alias("ts"), level.alias("level"), source.alias("source"), message.alias("message"),
        (empty if details is None else F.coalesce(details, empty)).alias("details"),
    )


def from_health(health: DataFrame, ts: str = "ts") -> DataFrame:
    """One warning for each failed system check."""
    return (
        health.where(~F.col("healthy"))
        .select(
            alert(
                F.col(ts), F.lit("warning"), F.lit("system"), F.lit("System health check failed"),
                F.transform_values("details", lambda k, v: v.cast("string")),
            ).alias("a")
        )
        .select("a.*")
    )


def from_issues(health: DataFrame, ts: str = "ts") -> DataFrame:
    """One warning for each issue of a failed check."""
    issue = F.explode("issues").alias("issue")
    return health.where(~F.col("healthy")).select(ts, issue).select(
        F.col(ts).alias("ts"),
        F.lit("warning").alias("level"),
        F.lit("health_check").alias("source"),
        F.concat(F.lit("Health check failed: "), F.col("issue")).alias("message"),
        F.create_map().cast("map<string,string>").alias("details"),
    )


def from_error_rate(means: DataFrame, ts: str = "ts") -> DataFrame:
    """Warnings where the trailing error rate is above its limit."""
    return means.where("alarm").select(
        F.col(ts).alias("ts"),
        F.lit("warning").alias("level"),
        F.lit("server").alias("source"),
        F.lit("High error rate detected").alias("message"),
        F.create_map(F.lit("error_rate"), F.col("trailing_mean").cast("string")).alias("details"),
    )


def states(samples: DataFrame, ts: str = "ts", rules: dict | None = None, inclusive: tuple = ("connection_pool",)) -> DataFrame:
    """Long table (ts, source, value, firing): each rule tried on each sample.

    The connection pool fires at its limit, the other sources above it.
    """
    rows = []
    for source, (metric, limit, _, _) in (rules or SOURCE_RULES).items():
        if metric in samples.columns:
            over = F.col(metric) >= limit if source in inclusive else F.col(metric) > limit
            rows.append(
                F.struct(
                    F.lit(source).alias("source"), F.col(metric).cast("double").alias("value"), over.alias("firing")
                )
            )
    return samples.select("*", F.explode(F.array(*rows)).alias("s")).select(
        *samples.columns, "s.source", "s.value", "s.firing"
    )


def filter_alerts(alerts: DataFrame, level: str | None = None, source: str | None = None) -> DataFrame:
    """Alerts of a level and/or source; null means no filter."""
    out = alerts
    if level is not None:
        out = out.where(F.col("level") == level)
    if source is not None:
        out = out.where(F.col("source") == source)
    return out


def dedup(alerts: DataFrame, ts_us: str, cooldown_seconds: int, tie: str | None = None) -> DataFrame:
    """First alert of equal (level, source, message) in each cool-down period.

    Periods are fixed stretches of time, so this is one ``min_by`` with map-side
    combine, however often an alert repeats.
    """
    order = F.struct(ts_us, *([tie] if tie else []))
    first = F.min_by(F.struct(*alerts.columns), order)
    return (
        alerts.withColumn("__period", slice_of(F.col(ts_us), cooldown_seconds))
        .groupBy("level", "source", "message", "__period")
        .agg(first.alias("a"), F.count(F.lit(1)).alias("n_suppressed"))
        .select("a.*", (F.col("n_suppressed") - 1).alias("n_suppressed"))
    )


def transitions(
    states_df: DataFrame, keys: list[str], order: list[str], firing: str = "firing", slice_seconds: int = 3600
) -> DataFrame:
    """Rows at which a state changes; ``change`` is raised or resolved.

    A series starts out quiet, and an unknown (null) state leaves it as it was. The last state of each time slice is found by an
    aggregation and handed to the next slice, so a busy series is many tasks.
    """
    sliced = states_df.withColumn("__slice", slice_of(F.col(order[0]), slice_seconds))
    last = sliced.groupBy(*keys, "__slice").agg(F.max_by(firing, F.when(F.col(firing).isNotNull(), F.struct(*order))).alias("__last"))
    handed = last.select(
        *keys, "__slice",
        F.coalesce(F.last("__last", ignorenulls=True).over(
            W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(False)).alias("__carried"),
    )
    inside = W.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.last(firing, ignorenulls=True).over(inside), F.col("__carried"))
    return (
        join_groups(sliced, handed, [*keys, "__slice"])
        .withColumn("__before", before)
        .where(F.col(firing) != F.col("__before"))
        .withColumn("change", F.when(F.col(firing), "raised").otherwise("resolved"))
        .drop("__slice", "__carried", "__before")
    )


def from_transitions(changes: DataFrame, ts: str = "ts", rules: dict | None = None) -> DataFrame:
    """Alert rows: the rule's level when raised, info when resolved."""
    rules = rules or SOURCE_RULES
    level, detail = F.lit("warning"), F.lit("value")
    for source, (_, _, rule_level, name) in rules.items():
        level = F.when(F.col("source") == source, rule_level).otherwise(level)
        detail = F.when(F.col("source") == source, name).otherwise(detail)
    raised = F.col("change") == "raised"
    return changes.select(
        F.col(ts).alias("ts"),
        F.when(raised, level).otherwise("info").alias("level"),
        "source",
        F.concat("source", F.when(raised, " limit exceeded").otherwise(" alert resolved")).alias("message"),
        F.create_map(detail, F.col("value").cast("string")).alias("details"),
    )


def report(alerts: DataFrame) -> DataFrame:
    """Alert counts by level and source."""
    return alerts.groupBy("level", "source").agg(F.count(F.lit(1)).alias("n_alerts"))


def active(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Series whose last change raised an alert."""
    return (
        changes.groupBy(*keys)
        .agg(F.max_by("change", F.struct(*order)).alias("last_change"), F.max(order[0]).alias("since_us"))
        .where(F.col("last_change") == "raised")
        .drop("last_change")
    )


