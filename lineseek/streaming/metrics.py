"""Request metrics per time window, as a stream or in batch (same columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILE_ACCURACY = 100_000


def per_window(
    requests: DataFrame,
    ts: str = "ts",
    keys: tuple[str, ...] = (),
    width: str = "60 seconds",
    slide: str | None = None,
    delay: str | None = None,
    value: str = "duration_ms",
) -> DataFrame:
    """Requests, mean, p95/p99, error rate, found rate and bytes per window.

    Tumbling windows, or sliding ones when ``slide`` is given. All aggregates are
    mergeable (quantiles as bounded sketches), so a window with most of the
    traffic is combined on the map side first. ``delay`` sets the watermark.
    """
    rows = requests.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay is not None:
        rows = rows.withWatermark(ts, delay)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    n = F.count(F.lit(1))
    return (
        rows.groupBy(window.alias("w"), *keys)
        .agg(
            n.alias("requests"),
            F.avg(value).alias("mean_ms"),
            F.percentile_approx(value, [0.95, 0.99], QUANTILE_ACCURACY).alias("q"),
            (F.count_if(F.col("is_error")) / n).alias("error_rate"),
            (F.count_if(F.col("found")) * 100.0 / n).alias("found_rate"),
            F.sum(F.col("bytes")).alias("bytes"),
        )
        .select(
            F.unix_micros("w.start").alias("window_start_us"), *keys, "requests", "mean_ms",
            F.col("q")[0].alias("p95_ms"), F.col("q")[1].alias("p99_ms"), "error_rate", "found_rate", "bytes",
        )
    )
