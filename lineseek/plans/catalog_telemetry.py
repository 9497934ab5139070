"""Catalogue: statistics, windows, comparison, health and alerts over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.operators import alerts, compare, health, stats, windows
from lineseek.plans.catalog_requests import events
from lineseek.plans.registry import r, register, rs, table

DAY = 86_400
EPOCH_2024_US = 1_704_067_200_000_000


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as load-test samples: an error event is a failed request."""
    failed = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        "event_id", "user_id", "event_type", "ts_us", F.col("value").alias("response_ms"),
        (~failed).alias("success"), F.when(failed, F.col("props")).alias("error"),
        F.when(F.col("event_id") % 2 == 0, "local").otherwise("other").alias("run"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        r(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


def q_exclusive(p: float) -> str:
    """SQL of the exclusive quantile over (g, v, rn, n)."""
    j = f"greatest(1, least(n - 1, floor({p}::DOUBLE * (n + 1))))"
    low, high = f"max(CASE WHEN rn = {j} THEN v END)", f"max(CASE WHEN rn = {j} + 1 THEN v END)"
    return f"CASE WHEN max(n) >= 2 THEN {rs(f'({low} + ({p}::DOUBLE * (max(n) + 1) - max({j})) * ({high} - {low}))')} END"


SQL_SAMPLES = """s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us, value AS response_ms,
  event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN props END AS error,
  CASE WHEN event_id % 2 = 0 THEN 'local' ELSE 'other' END AS run FROM events)"""
SQL_RANKED = """ranked AS (SELECT event_type AS g, value AS v,
  row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)"""

# ---------------------------------------------------------------- statistics


@register(f"""SELECT event_type, count(value) AS total_requests, {rs('avg(value)')} AS avg_response_time,
  {rs('min(value)')} AS min_response_time, {rs('max(value)')} AS max_response_time,
  {rs('stddev_samp(value)')} AS std_dev FROM events GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    return rounded(stats.latency_summary(samples(spark, sf_dir), ["event_type"]))


@register(f"SELECT event_type, {rs('median(value)')} AS median_response_time FROM events GROUP BY event_type")
def latency_median(spark, sf_dir):
    return rounded(stats.median(samples(spark, sf_dir), ["event_type"]))


@register(f"""WITH {SQL_RANKED}
SELECT g AS event_type, {q_exclusive(0.95)} AS p95_response_time, {q_exclusive(0.99)} AS p99_response_time
FROM ranked GROUP BY g""")
def latency_p_exclusive(spark, sf_dir):
    return rounded(stats.tail_latency(samples(spark, sf_dir), ["event_type"]))


SQL_LINEAR = ", ".join(f"{rs(f'quantile_cont(value, {p / 100})')} AS p{p}" for p in stats.REPORT_PERCENTILES)


@register(f"SELECT event_type, {SQL_LINEAR} FROM events GROUP BY event_type")
def latency_p_linear(spark, sf_dir):
    return rounded(stats.percentiles(samples(spark, sf_dir), ["event_type"]))


@register(f"SELECT {SQL_LINEAR} FROM events")
def latency_p_overall(spark, sf_dir):
    return rounded(stats.percentiles(samples(spark, sf_dir), []))


@register(f"SELECT event_type, {rs('stddev_samp(value) / avg(value)')} AS cv FROM events GROUP BY event_type")
def latency_cv(spark, sf_dir):
    return rounded(stats.variation(samples(spark, sf_dir), ["event_type"]))


@register(f"""WITH {SQL_SAMPLES}
SELECT user_id, count(*) AS total_requests, {rs('count(*) FILTER (success) * 100.0::DOUBLE / count(*)')} AS success_rate,
  count(error) AS error_count, count(DISTINCT error) AS unique_errors,
  {rs('count(error)::DOUBLE / count(*)')} AS error_rate FROM s GROUP BY user_id""")
def outcome_rates(spark, sf_dir):
    return rounded(stats.outcomes(samples(spark, sf_dir), ["user_id"]))


SQL_RPS = ("(CASE WHEN max(ts_us) > min(ts_us) THEN count(*)::DOUBLE / (max(ts_us) / 1e6 - min(ts_us) / 1e6)"
           " ELSE 0 END)")


@register(f"""WITH {SQL_SAMPLES}
SELECT user_id, {rs(SQL_RPS, 9)} AS requests_per_second FROM s GROUP BY user_id""")
def throughput(spark, sf_dir):
    return rounded(stats.throughput(samples(spark, sf_dir), ["user_id"], F.col("ts_us") / 1e6), 9)


@register(f"""WITH {SQL_SAMPLES}
SELECT event_type, {rs('count(*) / 3600.0::DOUBLE', 9)} AS requests_per_second FROM s GROUP BY event_type""")
def throughput_fixed(spark, sf_dir):
    return rounded(stats.throughput_fixed(samples(spark, sf_dir), ["event_type"], 3600), 9)


@register(f"""WITH {SQL_SAMPLES},
ranked AS (SELECT run AS g, response_ms AS v, row_number() OVER (PARTITION BY run ORDER BY response_ms) AS rn,
  count(*) OVER (PARTITION BY run) AS n FROM s),
e AS (SELECT g AS run, {q_exclusive(0.95)} AS p95_response_time, {q_exclusive(0.99)} AS p99_response_time
  FROM ranked GROUP BY g)
SELECT run, count(*) AS total_requests, {rs('avg(response_ms)')} AS avg_response_time,
  {rs('min(response_ms)')} AS min_response_time, {rs('max(response_ms)')} AS max_response_time,
  {rs('stddev_samp(response_ms)')} AS std_dev, {rs('median(response_ms)')} AS median_response_time,
  any_value(p95_response_time) AS p95_response_time, any_value(p99_response_time) AS p99_response_time,
  {rs(SQL_RPS)} AS requests_per_second, {rs('count(*) FILTER (success) * 100.0::DOUBLE / count(*)')} AS success_rate,
  count(error) AS error_count, count(DISTINCT error) AS unique_errors,
  {rs('count(error)::DOUBLE / count(*)')} AS error_rate
FROM s JOIN e USING (run) GROUP BY run""")
def load_test_report(spark, sf_dir):
    return rounded(stats.load_test_report(samples(spark, sf_dir), ["run"], F.col("ts_us") / 1e6))


@register(f"""WITH e AS (SELECT event_type, min(value) AS lo, (max(value) - min(value)) / 50 AS width FROM events GROUP BY 1),
b AS (SELECT event_type, least(floor((value - lo) / width), 49)::INTEGER AS bin, count(*) AS n
  FROM events JOIN e USING (event_type) GROUP BY ALL),
slots AS (SELECT event_type, lo, width, unnest(range(50))::INTEGER AS bin FROM e)
SELECT event_type, bin, {rs('lo + bin * width')} AS bin_start, {rs('lo + (bin + 1) * width')} AS bin_end,
  coalesce(n, 0) AS n FROM slots LEFT JOIN b USING (event_type, bin)""")
def latency_histogram50(spark, sf_dir):
    return rounded(stats.histogram(samples(spark, sf_dir), ["event_type"]))


@register(f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
f AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM events JOIN q USING (event_type))
SELECT event_type, {rs('q1')} AS q1, {rs('median')} AS median, {rs('q3')} AS q3,
  {rs('least(min(value) FILTER (ok), q1)')} AS whisker_low, {rs('greatest(max(value) FILTER (ok), q3)')} AS whisker_high,
  count(*) FILTER (NOT ok) AS n_outliers FROM f GROUP BY event_type, q1, median, q3""".replace(
    "{rs('q1')}", "q1"))
def latency_boxplot(spark, sf_dir):
    return rounded(stats.boxplot(samples(spark, sf_dir), ["event_type"]))


@register(f"""SELECT event_type, user_id, {rs('avg(value)')} AS avg_time, {rs('min(value)')} AS min_time,
  {rs('max(value)')} AS max_time FROM events GROUP BY ALL""")
def group_summary(spark, sf_dir):
    return rounded(stats.by_algorithm(samples(spark, sf_dir), ["event_type", "user_id"]))


@register(f"""WITH g AS (SELECT event_type, avg(value) AS a FROM events GROUP BY 1)
SELECT arg_min(event_type, a) AS fastest, {rs('min(a)')} AS avg_time FROM g""")
def fastest_group(spark, sf_dir):
    summary = stats.by_algorithm(samples(spark, sf_dir), ["event_type"])
    return rounded(stats.fastest(summary, "event_type"))


@register(f"""SELECT user_id, count(*) AS total_searches,
  {rs("count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*)")} AS found_rate FROM events GROUP BY user_id""")
def found_rate(spark, sf_dir):
    return rounded(stats.found_rate(samples(spark, sf_dir), ["user_id"], "success"))


@register(f"""WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1
  AS again FROM events)
SELECT user_id, count(*) AS total_searches, count(*) FILTER (again) AS repeats,
  {rs('count(*) FILTER (again) * 100.0::DOUBLE / count(*)')} AS repeat_rate FROM x GROUP BY user_id""")
def repeat_query_rate(spark, sf_dir):
    return rounded(stats.repeat_rate(events(spark, sf_dir), ["event_type", "props"], ["user_id"]))


BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@register(f"""WITH b AS (SELECT event_type, le, (SELECT count(*) FROM events i WHERE i.event_type = e.event_type AND value <= le)
    AS n FROM (SELECT DISTINCT event_type FROM events) e,
    (SELECT unnest([{", ".join(str(b) for b in BOUNDS)}, 'inf'::DOUBLE]) AS le) l),
w AS (SELECT *, lag(le) OVER o AS ple, coalesce(lag(n) OVER o, 0) AS pn, max(n) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS rank
  FROM b WINDOW o AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, {rs("CASE WHEN le = 'inf'::DOUBLE THEN ple ELSE coalesce(ple, 0) + (le - coalesce(ple, 0)) * (rank - pn) / (n - pn) END")}
  AS quantile
FROM w WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1""")
def histogram_quantile(spark, sf_dir):
    buckets = stats.to_buckets(samples(spark, sf_dir), ["event_type"], "response_ms", list(BOUNDS))
    return rounded(stats.bucket_quantile(buckets, ["event_type"], 0.95))


# ------------------------------------------------------------------- windows

@register("""SELECT event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000""")
def metric_retention_1000(spark, sf_dir):
    kept = windows.keep_newest(
        events(spark, sf_dir).select("event_type", "ts_us", "event_id"), ["event_type"], ["ts_us", "event_id"], 1000, DAY
    )
    return kept.select("event_type", "event_id")


@register("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def alert_history_1000(spark, sf_dir):
    return windows.keep_newest(events(spark, sf_dir), [], ["ts_us", "event_id"], 1000).select("event_id")


@register("""SELECT event_id, event_type FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND""")
def metric_trailing_window(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    now = log.agg(F.max("ts").alias("now")).scalar()
    return windows.trailing(log, "ts", now, DAY).select("event_id", "event_type")


@register("""SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND""")
def metric_expiry(spark, sf_dir):
    import datetime as dt

    log = table(spark, sf_dir, "events")
    now = log.agg(F.max("ts").alias("now")).scalar()
    return windows.expire(log, "ts", now, dt.timedelta(seconds=3600)).select("event_id")


@register(f"""SELECT event_id, {rs('''avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
  ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)''')} AS rolling_mean FROM events""")
def rolling_mean_1000(spark, sf_dir):
    out = windows.rolling_mean(
        events(spark, sf_dir).select("event_id", "event_type", "ts_us", "value"),
        ["event_type"], ["ts_us", "event_id"], "value", 1000, DAY, block=1000,
    )
    return rounded(out.select("event_id", "rolling_mean"))


@register(f"""SELECT event_id, row_number() OVER w AS request_count,
  {rs(f'(row_number() OVER w) / ((epoch_us(ts) - {EPOCH_2024_US}) / 1000000)', 12)} AS requests_per_second
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def cumulative_rps(spark, sf_dir):
    out = windows.cumulative_rate(
        events(spark, sf_dir).select("event_id", "event_type", "ts_us"), ["event_type"], ["ts_us", "event_id"],
        F.lit(EPOCH_2024_US), DAY,
    )
    return rounded(out.select("event_id", "request_count", "requests_per_second"), 12)


@register(f"""SELECT event_id, count(*) OVER w AS total_searches,
  {rs("(count(*) FILTER (event_type <> 'error') OVER w) * 100.0::DOUBLE / (count(*) OVER w)")} AS found_rate
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running_found_rate(spark, sf_dir):
    log = samples(spark, sf_dir).select("event_id", "user_id", "ts_us", "success")
    out = windows.running_found_rate(log, ["user_id"], ["ts_us", "event_id"], "success", DAY)
    return rounded(out.select("event_id", "total_searches", "found_rate"))


SQL_TRAIL = """t AS (SELECT event_id, ts, user_id, (sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w)::DOUBLE
  / (count(*) OVER w) AS m FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW))"""


def _error_means(spark, sf_dir):
    log = events(spark, sf_dir).select(
        "event_id", "user_id", "ts", "ts_us", (F.col("event_type") == "error").cast("double").alias("error_rate")
    )
    return windows.trailing_mean_alarm(log, ["user_id"], "ts_us", "error_rate", DAY, 0.4, 4 * DAY)


@register(f"WITH {SQL_TRAIL} SELECT event_id, {rs('m')} AS trailing_mean, m > 0.4::DOUBLE AS alarm FROM t")
def error_rate_alerts(spark, sf_dir):
    return rounded(_error_means(spark, sf_dir).select("event_id", "trailing_mean", "alarm"))


@register(f"""WITH c AS (SELECT event_id, user_id, ts, (props::JSON->>'k')::BIGINT AS k FROM events),
d AS (SELECT *, CASE WHEN lag(k) OVER w IS NULL THEN 0 WHEN k >= lag(k) OVER w THEN k - lag(k) OVER w ELSE k END AS step
  FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, {rs('((sum(step) OVER r)::DOUBLE - first_value(step) OVER r) / 86400', 9)} AS rate FROM d
WINDOW r AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)""")
def counter_rate(spark, sf_dir):
    """``props.k`` read as a counter that restarts now and then."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    log = events(spark, sf_dir).select("event_id", "user_id", "ts_us", k.alias("k"))
    out = windows.counter_rate(log, ["user_id"], ["ts_us", "event_id"], "k", DAY, 4 * DAY)
    return rounded(out.select("event_id", "rate"), 9)


@register(f"""WITH x AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 1000
  AS run FROM events), m AS (SELECT event_type, run, avg(value) AS a FROM x GROUP BY ALL)
SELECT event_type, count(*) AS n_runs, {rs('min(a)')} AS min_mean, {rs('max(a)')} AS max_mean,
  max(a) < 2 * min(a) AS stable FROM m GROUP BY event_type""")
def degradation_check(spark, sf_dir):
    log = events(spark, sf_dir).select("event_type", "event_id", "ts_us", "value")
    return rounded(windows.degradation(log, ["event_type"], ["ts_us", "event_id"], "value", 1000, DAY))


@register("""SELECT user_id, latest, CASE WHEN latest >= 80 THEN 'red' ELSE 'green' END AS colour, latest / 1024 / 1024 AS latest_mib
FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS latest FROM events WHERE value IS NOT NULL GROUP BY user_id)""")
def gauge_latest(spark, sf_dir):
    out = windows.gauges(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return out.withColumn("latest_mib", windows.resident_mib(F.col("latest")))


@register("""SELECT event_id, (sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS open_sessions FROM events""")
def active_sessions(spark, sf_dir):
    """A signup opens a session, an error closes one."""
    kind = F.col("event_type")
    change = F.when(kind == "signup", 1).when(kind == "error", -1).otherwise(0)
    log = events(spark, sf_dir).select("event_id", "user_id", "ts_us", "event_type")
    return windows.open_sessions(log, ["user_id"], ["ts_us", "event_id"], change, DAY).select("event_id", "open_sessions")


# ---------------------------------------------------------------- comparison

SQL_RUNS = f"""{SQL_SAMPLES}, m AS (SELECT run, avg(response_ms) AS avg_response_time,
  count(*) FILTER (success) * 100.0::DOUBLE / count(*) AS success_rate,
  count(*)::DOUBLE / ((max(ts_us) - min(ts_us)) / 1000000) AS throughput,
  stddev_samp(response_ms) / avg(response_ms) AS cv,
  {", ".join(f"quantile_cont(response_ms, {p / 100}) AS p{p}" for p in stats.REPORT_PERCENTILES)}
  FROM s GROUP BY run),
u AS (UNPIVOT m ON COLUMNS(* EXCLUDE run) INTO NAME metric VALUE v),
cmp AS (SELECT metric, max(v) FILTER (run = 'local') AS local, max(v) FILTER (run = 'other') AS other FROM u GROUP BY metric)"""


def _comparison(spark, sf_dir):
    runs = samples(spark, sf_dir)
    seconds = runs.groupBy("run").agg(((F.max("ts_us") - F.min("ts_us")) / 1_000_000).alias("seconds"))
    return compare.compare_runs(compare.run_metrics(runs, "run", "response_ms", seconds), "run", "local", "other")


@register(f"""WITH {SQL_RUNS} SELECT metric, {rs('local')} AS local, {rs('other')} AS other,
  {rs('local - other')} AS difference, {rs('(local - other) / other * 100')} AS difference_pct,
  CASE WHEN local < other THEN 'faster' ELSE 'slower' END AS direction FROM cmp""")
def run_comparison(spark, sf_dir):
    return rounded(_comparison(spark, sf_dir))


@register(f"""WITH {SQL_RUNS} SELECT {rs('local - other')} AS difference, {rs('(local - other) / other * 100')} AS difference_pct,
  CASE WHEN local < other THEN 'performing well' ELSE 'needs improvement' END AS recommendation
FROM cmp WHERE metric = 'avg_response_time'""")
def run_recommendation(spark, sf_dir):
    return rounded(compare.recommendation(_comparison(spark, sf_dir)))


@register(f"""WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_id % 2 = 0 AND value > 0 GROUP BY 1),
b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_id % 2 = 1 AND value > 100 GROUP BY 1),
j AS (SELECT user_id, coalesce(a.v, 'inf'::DOUBLE) AS x, coalesce(b.v, 'inf'::DOUBLE) AS y FROM a FULL JOIN b USING (user_id))
SELECT user_id, CASE WHEN isinf(x) THEN NULL ELSE {rs('x')} END AS snapshot_ms,
  CASE WHEN isinf(y) THEN NULL ELSE {rs('y')} END AS reread_ms, x <= 50 AND y <= 150 AS meets_requirement FROM j""")
def requirement_check(spark, sf_dir):
    """Even events as snapshot samples, slow odd ones as re-read samples, per user.

    A missing side counts as infinite and is shown as null.
    """
    runs = samples(spark, sf_dir)
    out = compare.requirement_check(
        runs.where("run = 'local'"), runs.where("run = 'other' and response_ms > 100"), "user_id",
        snapshot_limit=50.0, reread_limit=150.0,
    )
    inf = float("inf")
    return out.select(
        "user_id",
        *[F.when(F.col(c) != inf, r(F.col(c))).alias(c) for c in ("snapshot_ms", "reread_ms")],
        "meets_requirement",
    )


# ---------------------------------------------------------- health and alerts

def health_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as health samples: value as CPU, props.k as memory and disk."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events(spark, sf_dir).select(
        "event_id", "user_id", "event_type", "ts", "ts_us", F.col("value").alias("cpu_percent"),
        k.alias("memory_percent"), (99 - k).alias("disk_usage_percent"),
        (F.col("event_id") % 1001).alias("open_files"), (F.col("event_id") % 101).alias("thread_count"),
    )


SQL_HEALTH = """h AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS ts_us, value AS cpu,
  (props::JSON->>'k')::DOUBLE AS mem FROM events)"""


@register(f"""WITH {SQL_HEALTH}
SELECT event_id, cpu <= 80 AND mem <= 80 AS healthy, ((cpu > 80)::INT + (mem > 80)::INT) AS n_issues,
  CASE WHEN mem > 80 THEN 'high memory usage: ' || format('{{:.1f}}', mem) || '%' ELSE '' END AS memory_issue FROM h""")
def health_status_strict(spark, sf_dir):
    out = health.system_health(health_samples(spark, sf_dir))
    memory = F.filter("issues", lambda x: F.startswith(x, F.lit("high memory")))
    return out.select(
        "event_id", "healthy", F.size("issues").alias("n_issues"), F.array_join(memory, "").alias("memory_issue")
    )


@register(f"""WITH {SQL_HEALTH}
SELECT event_id, cpu < 80 AND mem < 80 AND 99 - mem < 80 AND event_id % 1001 < 1000 AND event_id % 101 < 100 AS healthy FROM h""")
def health_status_inclusive(spark, sf_dir):
    return health.metric_health(health_samples(spark, sf_dir)).select("event_id", "healthy")


@register(f"""WITH {SQL_HEALTH}, c AS (SELECT user_id, cpu <= 80 AND mem <= 80 AS ok, (cpu > 80)::INT + (mem > 80)::INT AS n FROM h)
SELECT user_id, bool_and(ok) AS healthy, count(*) AS checks, count(*) FILTER (NOT ok) AS failed_checks,
  sum(n)::BIGINT AS n_issues FROM c GROUP BY user_id""")
def component_health(spark, sf_dir):
    checks = health.system_health(health_samples(spark, sf_dir)).withColumnRenamed("user_id", "component")
    return health.component_counts(checks).withColumnRenamed("component", "user_id")


@register(f"""WITH {SQL_HEALTH}, c AS (SELECT user_id, mem <= 80 AS ok, mem FROM h),
t AS (SELECT user_id, string_agg(DISTINCT 'memory ' || mem::INT, ';' ORDER BY 'memory ' || mem::INT) AS issues FROM c
  WHERE NOT ok GROUP BY 1)
SELECT user_id, bool_and(ok) AS healthy, count(*) AS checks, count(*) FILTER (NOT ok) AS failed_checks,
  coalesce(any_value(issues), '') AS issues FROM c LEFT JOIN t USING (user_id) GROUP BY user_id""")
def component_issues(spark, sf_dir):
    """Issue texts per component: at most one per whole memory percentage."""
    over = F.col("memory_percent") > 80
    text = F.concat(F.lit("memory "), F.col("memory_percent").cast("int"))
    checks = health_samples(spark, sf_dir).select(
        F.col("user_id").alias("component"), (~over).alias("healthy"),
        F.array_compact(F.array(F.when(over, text))).alias("issues"),
    )
    return health.component_report(checks).select(
        F.col("component").alias("user_id"), "healthy", "checks", "failed_checks",
        F.array_join("issues", ";").alias("issues"),
    )


@register(f"""WITH {SQL_HEALTH}, c AS (SELECT user_id, bool_and(cpu <= 80 AND mem <= 80) AS ok,
  count(*) FILTER (cpu > 80 OR mem > 80) AS f FROM h GROUP BY 1)
SELECT CASE WHEN bool_and(ok) THEN 'healthy' ELSE 'unhealthy' END AS overall_status,
  count(*) FILTER (NOT ok) AS unhealthy_components, sum(f)::BIGINT AS failed_checks FROM c""")
def overall_health(spark, sf_dir):
    checks = health.system_health(health_samples(spark, sf_dir)).withColumnRenamed("user_id", "component")
    return health.overall(health.component_counts(checks))


def all_alerts(spark, sf_dir):
    """Alerts raised from failed checks, one per issue, with their source rows."""
    return alerts.from_issues(health.system_health(health_samples(spark, sf_dir)))


def with_alert_metrics(df, value: str = "cpu_percent", k: str = "memory_percent"):
    """Adds the metrics of the other alert sources, read from the same two columns."""
    return df.withColumns({
        "disk_usage_percent": 99 - F.col(k), "error_rate": F.col(k) / 400, "connection_usage_percent": F.col(k),
        "search_latency_ms": F.col(value) * 10,
    })


SQL_SOURCES = " UNION ALL ".join(
    f"SELECT user_id, event_id, ts, ts_us, cpu, '{source}' AS source, {test} AS firing FROM h" for source, test in (
        ("memory", "mem > 80"), ("cpu", "cpu > 80"), ("disk", "99 - mem > 80"), ("error_rate", "mem / 400 > 0.1::DOUBLE"),
        ("connection_pool", "mem >= 90"), ("search_latency", "cpu * 10 > 1000"),
    ))
SQL_STATES = f"{SQL_HEALTH}, st AS ({SQL_SOURCES})"
SQL_ALERTS = f"""{SQL_STATES}, alerts AS (
  SELECT ts, ts_us, CASE WHEN source = 'cpu' AND cpu > 200 THEN 'critical' ELSE 'warning' END AS level, source,
    source || ' limit exceeded' AS message, event_id FROM st WHERE firing)"""


def limit_alerts(spark, sf_dir):
    """One alert for each sample and source above its limit."""
    fired = alerts.states(with_alert_metrics(health_samples(spark, sf_dir))).where("firing")
    level = F.when((F.col("source") == "cpu") & (F.col("value") > 200), "critical").otherwise("warning")
    return fired.select(
        "ts", "ts_us", level.alias("level"), "source", F.concat("source", F.lit(" limit exceeded")).alias("message"), "event_id"
    )


@register(f"""WITH {SQL_HEALTH}, a AS (
  SELECT 'Health check failed: high memory usage: ' || format('{{:.1f}}', mem) || '%' AS message FROM h WHERE mem > 80
  UNION ALL SELECT 'Health check failed: high CPU usage' FROM h WHERE cpu > 80)
SELECT 'warning' AS level, 'health_check' AS source, message, count(*) AS n FROM a GROUP BY message""")
def alerts_from_health(spark, sf_dir):
    """Alerts by text. CPU figures are left out, as engines round ties of the printed digit apart; memory is whole numbers."""
    text = F.regexp_replace("message", r"(high CPU usage): [0-9.]+%$", "$1")
    return all_alerts(spark, sf_dir).withColumn("message", text).groupBy("level", "source", "message").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {SQL_HEALTH} SELECT ts_us, 'warning' AS level, 'system' AS source, 'System health check failed' AS message,
  mem AS memory_percent FROM h WHERE mem > 80 OR cpu > 80""")
def alerts_from_system_health(spark, sf_dir):
    raised = alerts.from_health(health.system_health(health_samples(spark, sf_dir)))
    return raised.select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "level", "source", "message",
        F.col("details")["memory_percent"].cast("double").alias("memory_percent"),
    )


@register(f"""WITH {SQL_TRAIL} SELECT epoch_us(ts) AS ts_us, 'warning' AS level, 'server' AS source,
  'High error rate detected' AS message FROM t WHERE m > 0.4::DOUBLE""")
def alerts_from_error_rate(spark, sf_dir):
    raised = alerts.from_error_rate(_error_means(spark, sf_dir))
    return raised.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "level", "source", "message")


@register(f"WITH {SQL_ALERTS} SELECT event_id, source FROM alerts WHERE level = 'critical' AND source = 'cpu'")
def alert_filter(spark, sf_dir):
    return alerts.filter_alerts(limit_alerts(spark, sf_dir), "critical", "cpu").select("event_id", "source")


@register(f"""WITH {SQL_ALERTS}, p AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY level, source, message,
    ts_us // 86400000000) AS n FROM alerts WINDOW w AS (PARTITION BY level, source, message, ts_us // 86400000000 ORDER BY ts_us, event_id))
SELECT event_id, level, source, n - 1 AS n_suppressed FROM p WHERE rn = 1""")
def alert_dedup(spark, sf_dir):
    out = alerts.dedup(limit_alerts(spark, sf_dir), "ts_us", DAY, "event_id")
    return out.select("event_id", "level", "source", "n_suppressed")


SQL_CHANGES = f"""{SQL_STATES},
ch AS (SELECT *, firing <> coalesce(lag(firing) OVER (PARTITION BY user_id, source ORDER BY ts_us, event_id), false) AS changed FROM st)"""


def _changes(spark, sf_dir):
    states = alerts.states(with_alert_metrics(health_samples(spark, sf_dir)))
    return alerts.transitions(
        states.select("user_id", "event_id", "ts", "ts_us", "source", "value", "firing"),
        ["user_id", "source"], ["ts_us", "event_id"], slice_seconds=DAY,
    )


@register(f"""WITH {SQL_CHANGES}
SELECT event_id, source, CASE WHEN firing THEN 'raised' ELSE 'resolved' END AS change FROM ch WHERE changed""")
def alert_resolution(spark, sf_dir):
    return _changes(spark, sf_dir).select("event_id", "source", "change")


@register(f"""WITH {SQL_CHANGES}
SELECT CASE WHEN firing THEN 'warning' ELSE 'info' END AS level, source,
  source || CASE WHEN firing THEN ' limit exceeded' ELSE ' alert resolved' END AS message, count(*) AS n
FROM ch WHERE changed GROUP BY ALL""")
def alert_rows(spark, sf_dir):
    return alerts.from_transitions(_changes(spark, sf_dir)).groupBy("level", "source", "message").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(f"""WITH {SQL_CHANGES}
SELECT user_id, source, max(ts_us) AS since_us FROM ch WHERE changed GROUP BY user_id, source
HAVING arg_max(firing, (ts_us, event_id))""")
def alert_active(spark, sf_dir):
    return alerts.active(_changes(spark, sf_dir), ["user_id", "source"], ["ts_us", "event_id"])


@register(f"WITH {SQL_ALERTS} SELECT level, source, count(*) AS n_alerts FROM alerts GROUP BY level, source")
def alert_report(spark, sf_dir):
    return alerts.report(limit_alerts(spark, sf_dir))
