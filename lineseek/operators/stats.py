"""Latency and outcome statistics of a request log or load test.

Everything here is an aggregation with map-side combine, or starts from one
(exact quantiles, histogram, box plot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lineseek.operators.quantiles import few_groups, from_value_counts, mixed_quantiles, quantiles, value_counts
from lineseek.plans.joins import join_groups

# Report percentiles and histogram size.
REPORT_PERCENTILES = (50, 75, 90, 95, 99)
HISTOGRAM_BINS = 50


def on_groups(left: DataFrame, right: DataFrame, keys: list[str], small: bool = False, how: str = "inner") -> DataFrame:
    """Join two per-group results; without keys both hold one row."""
    if keys:
        return join_groups(left, right, keys, how, small)
    one = right.withColumn("__one", F.lit(1))  # a single row
    return join_groups(left.withColumn("__one", F.lit(1)), one, ["__one"], how, True).drop("__one")


def summary_columns(value: str) -> list[Column]:
    return [
        F.count(value).alias("total_requests"),
        F.avg(value).alias("avg_response_time"),
        F.min(value).alias("min_response_time"),
        F.max(value).alias("max_response_time"),
        F.stddev_samp(value).alias("std_dev"),
    ]


def outcome_columns() -> list[Column]:
    has_error = F.coalesce(F.col("error"), F.lit("")) != ""
    n = F.count(F.lit(1))
    return [
        F.when(n > 0, F.count_if("success") * 100.0 / n).alias("success_rate"),
        F.count_if(has_error).alias("error_count"),
        F.count_distinct(F.when(has_error, F.col("error"))).alias("unique_errors"),
        F.when(n > 0, F.count_if(has_error) / n).otherwise(1.0).alias("error_rate"),
    ]


def throughput_column(ts_seconds: Column) -> Column:
    span = F.max(ts_seconds) - F.min(ts_seconds)
    return F.when(span > 0, F.count(F.lit(1)) / span).otherwise(0.0).alias("requests_per_second")


def latency_summary(df: DataFrame, keys: list[str], value: str = "response_ms") -> DataFrame:
    """count, mean, min, max, sample standard deviation (null for one sample)."""
    return df.groupBy(*keys).agg(*summary_columns(value))


def median(df: DataFrame, keys: list[str], value: str = "response_ms") -> DataFrame:
    return quantiles(df, keys, value, {"median_response_time": 0.5})


def tail_latency(df: DataFrame, keys: list[str], value: str = "response_ms") -> DataFrame:
    """p95 and p99 by the exclusive method; they may exceed the maximum."""
    ps = {"p95_response_time": 0.95, "p99_response_time": 0.99}
    return quantiles(df, keys, value, ps, "exclusive")


def percentiles(
    df: DataFrame, keys: list[str], value: str = "response_ms", approximate: bool = False
) -> DataFrame:
    """p50/75/90/95/99 by the linear method; the approximate form is one pass."""
    if approximate:
        fractions = [p / 100 for p in REPORT_PERCENTILES]
        sketch = df.groupBy(*keys).agg(F.percentile_approx(value, fractions, 100_000).alias("q"))
        return sketch.select(*keys, *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(REPORT_PERCENTILES)])
    return quantiles(df, keys, value, {f"p{p}": p / 100 for p in REPORT_PERCENTILES})


def variation(df: DataFrame, keys: list[str], value: str = "response_ms") -> DataFrame:
    """Coefficient of variation (volatility): stdev / mean."""
    mean = F.avg(value)
    return df.groupBy(*keys).agg(F.when(mean != 0, F.stddev_samp(value) / mean).alias("cv"))


def outcomes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Success rate in percent, errors, distinct errors, error share."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_requests"), *outcome_columns())


def throughput(df: DataFrame, keys: list[str], ts_seconds: Column) -> DataFrame:
    """Requests per second over the observed span; 0 when the span is 0."""
    return df.groupBy(*keys).agg(throughput_column(ts_seconds))


def throughput_fixed(df: DataFrame, keys: list[str], duration_seconds: float) -> DataFrame:
    """Requests per second of a run whose length is known."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(float(duration_seconds))).alias("requests_per_second"))


def load_test_report(df: DataFrame, keys: list[str], ts_seconds: Column, value: str = "response_ms") -> DataFrame:
    """The full load-test analysis, one row per run: one aggregation and one
    quantile pass. A run without any time (all failed) has null quantiles."""
    sums = df.groupBy(*keys).agg(*summary_columns(value), throughput_column(ts_seconds), *outcome_columns())
    ranks = {
        "median_response_time": (0.5, "linear"),
        "p95_response_time": (0.95, "exclusive"),
        "p99_response_time": (0.99, "exclusive"),
    }
    return on_groups(sums, mixed_quantiles(df, keys, value, ranks), keys, how="left")


def histogram(df: DataFrame, keys: list[str], value: str = "response_ms", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed.

    When all values are equal the range is widened by 0.5 on both sides. Empty
    bins are listed with 0. Values that are not finite are left out.
    """
    counts = value_counts(df.where(F.abs(value) < float("inf")), keys, value)
    group = keys or ["__all"]
    if not keys:
        counts = counts.withColumn("__all", F.lit(1))
    edges = counts.groupBy(*group).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(
        *group,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    small = few_groups(df, keys)
    index = F.least(F.floor((F.col("__v") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    filled = (
        join_groups(counts, edges, group, small=small)
        .groupBy(*group, index.alias("bin"))
        .agg(F.sum("__c").alias("n"))
    )
    slots = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (
        join_groups(slots, filled, [*group, "bin"], "left")
        .select(
            *keys,
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def boxplot(df: DataFrame, keys: list[str], value: str = "response_ms") -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and outlier count."""
    counts = value_counts(df, keys, value)
    small = few_groups(df, keys)
    quartiles = {"q1": (0.25, "linear"), "median": (0.5, "linear"), "q3": (0.75, "linear")}
    iqr = F.col("q3") - F.col("q1")
    box = (
        from_value_counts(counts, keys, quartiles, small)
        .withColumn("low", F.col("q1") - 1.5 * iqr)
        .withColumn("high", F.col("q3") + 1.5 * iqr)
    )
    fenced = on_groups(counts, box, keys, small)
    within = (F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high"))
    # the box columns are the same on every row of a group
    group = [*keys, "q1", "median", "q3"]
    return fenced.groupBy(*group).agg(
        F.least(F.min(F.when(within, F.col("__v"))), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(within, F.col("__v"))), F.col("q3")).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~within, F.col("__c"))), F.lit(0)).alias("n_outliers"),
    )


def by_algorithm(df: DataFrame, keys: list[str], value: str = "response_ms") -> DataFrame:
    """avg / min / max per algorithm (and size, query, query class)."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("avg_time"), F.min(value).alias("min_time"), F.max(value).alias("max_time")
    )


def fastest(summary: DataFrame, name: str = "algorithm", value: str = "avg_time") -> DataFrame:
    return summary.agg(
        F.min_by(name, F.struct(value, name)).alias("fastest"), F.min(value).alias("avg_time")
    )


def found_rate(df: DataFrame, keys: list[str], found: str = "found") -> DataFrame:
    """Share of found queries in percent; 0 for an empty log."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("total_searches"),
        F.when(n > 0, F.count_if(found) * 100.0 / n).otherwise(0.0).alias("found_rate"),
    )


def repeat_rate(df: DataFrame, key_cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Share of requests that repeat an earlier (query, options), in percent.

    n equal requests hold n-1 repeats whatever their order, so two stacked counts
    answer it and a hot query never needs ordering.
    """
    keys = keys or []
    per_query = df.groupBy(*keys, *key_cols).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c")
    return per_query.groupBy(*keys).agg(
        F.coalesce(total, F.lit(0)).alias("total_searches"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeats"),
        F.when(total > 0, F.sum(F.col("c") - 1) * 100.0 / total).otherwise(0.0).alias("repeat_rate"),
    )


def bucket_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile of a cumulative histogram ``(keys, le, n)``, ``le`` up to +Inf.

    Linear inside the bucket; the first bucket starts at 0 (unless its bound is
    not positive); above the last finite bound that bound is the answer.
    """
    w = W.partitionBy(*keys).orderBy("le")
    whole = W.partitionBy(*keys)
    b = buckets.select(
        *keys,
        "le",
        "n",
        F.lag("le").over(w).alias("prev_le"),
        F.coalesce(F.lag("n").over(w), F.lit(0)).alias("prev_n"),
        (F.max("n").over(whole) * F.lit(q)).alias("rank"),
    )
    hit = b.where((F.col("n") >= F.col("rank")) & (F.col("n") > 0)).groupBy(*keys).agg(
        F.min_by(F.struct("le", "n", "prev_le", "prev_n", "rank"), "le").alias("b")
    )
    start = F.coalesce(F.col("b.prev_le"), F.when(F.col("b.le") > 0, F.lit(0.0)).otherwise(F.col("b.le")))
    inside = F.col("b.n") - F.col("b.prev_n")
    value = start + (F.col("b.le") - start) * (F.col("b.rank") - F.col("b.prev_n")) / inside
    return hit.select(
        *keys,
        F.when(F.col("b.le") == float("inf"), F.col("b.prev_le"))
        .when(inside <= 0, F.col("b.le"))
        .otherwise(value)
        .alias("quantile"),
    )


def to_buckets(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram of raw values: one pass, one row per group and bound."""
    sums = df.groupBy(*keys).agg(
        F.array(
            *[
                F.struct(F.lit(float(le)).alias("le"), F.count_if(F.col(value) <= le).alias("n"))
                for le in [*bounds, float("inf")]
            ]
        ).alias("b")
    )
    return sums.select(*keys, F.explode("b").alias("b")).select(*keys, "b.le", "b.n")
