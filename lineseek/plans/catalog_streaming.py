"""Catalogue: streaming forms, each run over the whole table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.operators import alerts as alert_ops

from lineseek.plans.catalog_requests import LOG_LIMIT, LOG_WINDOW_S, BUCKET_BURST, BUCKET_RATE, SQL_BUCKET, SQL_SLIDING
from lineseek.plans.catalog_search import doc_lines
from lineseek.plans.catalog_telemetry import DAY, SQL_ALERTS, SQL_CHANGES, rounded, with_alert_metrics
from lineseek.plans.registry import SQL_LINES, register, rs, sql_strip, table
from lineseek.plans.session import scratch_path
from lineseek.sources import lines as sources
from lineseek.streaming import admission, alerts, lookup, metrics
from lineseek.streaming.run import drain, drain_writer, replay, rocksdb


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, a file or a folder of files, as a file stream."""
    schema = table(spark, sf_dir, name).schema
    # as a pattern, the path may be that of a single file as well, which a file stream else refuses
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


#: Events come in several files and up to an hour out of order; streams wait for them so long.
DELAY = "2 hours"


def arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(table(spark, sf_dir, "events"), "ts", "events")


@register(f"""WITH {SQL_LINES}
SELECT conv_id, turn, line_no, query, found, CASE WHEN found THEN 'STRING EXISTS' ELSE 'STRING NOT FOUND' END AS verdict
FROM (SELECT *, query IN (SELECT line FROM lines) AS found FROM (
  SELECT conv_id, turn, unnest(generate_series(0, len(parts) - 1)) AS line_no, {sql_strip('unnest(parts)')} AS query
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)))""")
def stream_membership(spark, sf_dir):
    """Every line of every turn, looked up as it arrives."""
    turns = stream(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "query")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))
    return drain(lookup.live_lookup(turns, doc_lines(spark, sf_dir)), "membership")


@register(f"WITH {SQL_LINES} SELECT DISTINCT line FROM lines")
def stream_corpus_growth(spark, sf_dir):
    """Lines of arriving documents added to a corpus table."""
    arriving = sources.clean(sources.from_table(stream(spark, sf_dir, "documents"), "doc_id", "text"))
    path = scratch_path(spark, "grown")
    # two streams with checkpoints of their own, the second on the corpus of the first
    for half in (0, 1):
        drain_writer(lookup.grow_corpus(arriving.where(F.col("path") % 2 <= half), path), "growth", spark)
    return spark.read.parquet(path).select("line")


def _request_log(df: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    return df.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("duration_ms"),
        failed.alias("is_error"), (F.col("event_type") == "view").alias("found"),
        F.octet_length("props").cast("bigint").alias("bytes"),
    )


def sql_windows(width: int, slide: int, keys: str = "") -> str:
    """Window metrics in SQL."""
    return f"""WITH e AS (SELECT epoch_us(ts) AS t, * FROM events),
w AS (SELECT *, (t // {slide * 1_000_000} - k) * {slide * 1_000_000} AS ws FROM e, (SELECT unnest(range({width // slide})) AS k) s)
SELECT ws AS window_start_us, {keys} count(*) AS requests, {rs('avg(value)')} AS mean_ms,
  {rs('quantile_disc(value, 0.95)')} AS p95_ms, {rs('quantile_disc(value, 0.99)')} AS p99_ms,
  {rs("count(*) FILTER (event_type = 'error')::DOUBLE / count(*)")} AS error_rate,
  {rs("count(*) FILTER (event_type = 'view') * 100.0::DOUBLE / count(*)")} AS found_rate,
  sum(strlen(props))::BIGINT AS bytes
FROM w WHERE t >= ws AND t < ws + {width * 1_000_000} GROUP BY ALL"""


@register(sql_windows(DAY, DAY // 4, "event_type,"))
def request_metrics_sliding(spark, sf_dir):
    """Batch form: day-long windows every six hours, by event type."""
    log = _request_log(table(spark, sf_dir, "events"))
    return rounded(metrics.per_window(log, "ts", ("event_type",), "1 day", "6 hours"))


@register(sql_windows(60, 60))
def request_metrics_60s(spark, sf_dir):
    return rounded(metrics.per_window(_request_log(table(spark, sf_dir, "events"))))


@register(sql_windows(60, 60))
def stream_metrics_60s(spark, sf_dir):
    """Stream form, events out of order."""
    return rounded(drain(metrics.per_window(_request_log(arriving_events(spark, sf_dir)), delay=DELAY), "metrics"))


@register(sql_windows(DAY, DAY // 4, "event_type,"))
def stream_metrics_sliding(spark, sf_dir):
    """Stream form of the sliding windows; a window's state goes when it has come out."""
    log = _request_log(arriving_events(spark, sf_dir))
    return rounded(drain(metrics.per_window(log, "ts", ("event_type",), "1 day", "6 hours", DELAY), "sliding"))


def _decided(out: DataFrame) -> DataFrame:
    return out.select(
        F.col("client").cast("bigint").alias("user_id"), "ts_us",
        F.col("id").alias("event_id"), "admitted",
    )


@register(SQL_SLIDING)
def stream_rate_limit(spark, sf_dir):
    with rocksdb(spark):
        log = arriving_events(spark, sf_dir)
        return _decided(
            drain(admission.sliding_log(log, "user_id", "ts", "event_id", LOG_LIMIT, LOG_WINDOW_S, DELAY), "sliding")
        )


@register(SQL_BUCKET)
def stream_token_bucket(spark, sf_dir):
    with rocksdb(spark):
        log = arriving_events(spark, sf_dir)
        return _decided(
            drain(admission.token_bucket(log, "user_id", "ts", "event_id", BUCKET_RATE, BUCKET_BURST, DELAY), "bucket")
        )


def _states(events: DataFrame) -> DataFrame:
    """States of all alert sources of each user from an event table or stream."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = events.select(
        "event_id", "user_id", "ts", F.col("value").alias("cpu_percent"), k.alias("memory_percent")
    )
    return alert_ops.states(with_alert_metrics(rows)).select(
        F.concat_ws("/", "user_id", "source").alias("series"), "ts", F.col("event_id").alias("id"), "source", "value", "firing"
    )


@register(f"""WITH {SQL_CHANGES}
SELECT user_id || '/' || source AS series, event_id AS id, CASE WHEN firing THEN 'raised' ELSE 'resolved' END AS change
FROM ch WHERE changed""")
def stream_alert_resolution(spark, sf_dir):
    with rocksdb(spark):
        states = _states(arriving_events(spark, sf_dir))
        return drain(alerts.transitions(states, delay=DELAY), "transitions").select("series", "id", "change")


def _limit_alerts(events: DataFrame, flush: bool = False) -> DataFrame:
    """Alerts of a stream; with ``flush`` the row without an event passes too, as it only moves the watermark."""
    fired = _states(events).where("firing or id is null" if flush else "firing")
    level = F.when((F.col("source") == "cpu") & (F.col("value") > 200), "critical").otherwise("warning")
    return fired.select(
        F.col("ts").cast("timestamp").alias("ts"), level.alias("level"), "source",
        F.concat("source", F.lit(" limit exceeded")).alias("message"), "id",
    )


@register(f"""WITH {SQL_ALERTS} SELECT level, source, message, arg_min(event_id, (ts, event_id)) AS id, count(*) - 1 AS n_suppressed
FROM alerts GROUP BY level, source, message, ts_us // {DAY * 1_000_000}""")
def stream_alert_dedup(spark, sf_dir):
    """First of equal alerts of each day, events out of order."""
    fired = _limit_alerts(arriving_events(spark, sf_dir), flush=True)
    return drain(alerts.dedup(fired, "ts", "1 day", DELAY, "id"), "dedup").select("level", "source", "message", "id", "n_suppressed")


@register(f"""WITH {SQL_ALERTS}
SELECT sink, n FROM (VALUES ('json'), ('parquet')) s(sink), (SELECT count(*) AS n FROM alerts) c
UNION ALL SELECT 'broken: missed', count(*) FROM alerts""")
def stream_alert_routing(spark, sf_dir):
    """Three sinks, one of which fails; the other two get every alert."""
    root = scratch_path(spark, "routing")

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise RuntimeError("sink is down")

    sinks = {
        "broken": broken,
        "json": alerts.file_sink(f"{root}/json", "json"),
        "parquet": alerts.file_sink(f"{root}/parquet", "parquet"),
    }
    fired = _limit_alerts(arriving_events(spark, sf_dir))
    drain_writer(alerts.deliver(fired, sinks, f"{root}/failures"), "routing", spark)

    def counted(df: DataFrame, sink) -> DataFrame:
        return df.groupBy(sink.alias("sink")).agg(F.count(F.lit(1)).alias("n"))

    missed = spark.read.parquet(f"{root}/failures").groupBy(F.concat("sink", F.lit(": missed")).alias("sink")).agg(F.sum("n_alerts").alias("n"))
    return (
        counted(spark.read.schema("id bigint").json(f"{root}/json"), F.lit("json"))
        .unionByName(counted(spark.read.parquet(f"{root}/parquet"), F.lit("parquet")))
        .unionByName(missed)
    )
