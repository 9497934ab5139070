"""Catalogue: request parsing, checks, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions import verdicts
from lineseek.functions.hashing import trace_bound, trace_sampled
from lineseek.functions.text import decode_lossy, normalise_query
from lineseek.operators import admission, requests, service
from lineseek.operators.ordered import micros
from lineseek.plans.catalog_search import doc_lines
from lineseek.plans.registry import SQL_FOLDED, register, spread, sql_strip, table
from lineseek.plans.session import scratch_path
from lineseek.sources import index, requests as sources


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a request log: one client per user."""
    return table(spark, sf_dir, "events").withColumn("ts_us", micros(F.col("ts")))


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as raw requests of seven kinds."""
    turns = table(spark, sf_dir, "conversations").withColumn("request_id", F.col("conv_id") * 1000 + F.col("turn"))
    kind = F.pmod("request_id", F.lit(7))

    def js(**fields) -> F.Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    none = F.create_map().cast("map<string,string>")
    bad_or_good = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("["), F.col("role"))).otherwise("a+")
    raw = (
        F.when(kind == 0, js(command=F.lit("search"), query=F.col("text"), options=none))
        .when(
            kind == 1,
            js(
                pattern=F.col("text"),
                options=F.struct(F.lit(True).alias("whole_line"), F.lit(False).alias("regex")),
            ),
        )
        .when(kind == 2, F.col("text"))
        .when(kind == 3, js(command=F.lit("health")))
        .when(kind == 4, js(command=F.col("role")))
        .when(kind == 5, js(options=none))
        .otherwise(
            js(
                command=F.lit("search"),
                query=bad_or_good,
                options=F.struct(F.lit(True).alias("use_regex"), F.col("turn").alias("max_count")),
            )
        )
    )
    return turns.select("request_id", raw.alias("raw"))


SQL_REQUESTS = f"""c AS (SELECT conv_id * 1000 + turn AS request_id, (conv_id * 1000 + turn) % 7 AS kind, * FROM conversations),
req AS (
  SELECT request_id, kind <> 2 AS is_json,
    CASE kind WHEN 3 THEN 'health' WHEN 4 THEN role ELSE 'search' END AS command,
    {sql_strip("trim(CASE WHEN kind <= 2 THEN text WHEN kind = 6 THEN CASE WHEN turn % 2 = 0 THEN '[' || role ELSE 'a+' END ELSE '' END, chr(0))")}
      AS query,
    kind = 1 AS whole_line, kind = 6 AS regex, CASE WHEN kind = 6 THEN turn::INTEGER END AS max_count
  FROM c)"""


@register(f"WITH {SQL_REQUESTS} SELECT * FROM req")
def request_parse(spark, sf_dir):
    parsed = sources.parse(raw_requests(spark, sf_dir))
    return parsed.select(
        "request_id", "is_json", "command", "query", "options.whole_line", "options.regex", "options.max_count"
    )


SQL_VALID = f"""{SQL_REQUESTS}, v AS (
  SELECT request_id, CASE
    WHEN command NOT IN ('search', 'metrics', 'health', 'alerts') THEN 'INVALID_REQUEST'
    WHEN command = 'search' AND query = '' THEN 'INVALID_REQUEST'
    WHEN command = 'search' AND length(query) > 1000 THEN 'INVALID_PATTERN'
    WHEN command = 'search' AND regex AND starts_with(query, '[') THEN 'INVALID_PATTERN' END AS error_code,
    CASE WHEN command NOT IN ('search', 'metrics', 'health', 'alerts') THEN 'Unknown command: ' || command
    WHEN command = 'search' AND query = '' THEN 'Empty query'
    WHEN command = 'search' AND length(query) > 1000 THEN 'Query too long'
    WHEN command = 'search' AND regex AND starts_with(query, '[') THEN 'bad regular expression' END AS error_message,
    command
  FROM req)"""


@register(f"WITH {SQL_VALID} SELECT request_id, error_code, error_message FROM v")
def request_validate(spark, sf_dir):
    checked = requests.validate(sources.parse(raw_requests(spark, sf_dir)))
    return checked.select("request_id", "error_code", "error_message")


@register(f"WITH {SQL_VALID} SELECT command, count(*) AS n FROM v WHERE error_code IS NULL GROUP BY command")
def request_dispatch(spark, sf_dir):
    """Valid requests by command, put together again from the separate parts."""
    parts = requests.dispatch(requests.validate(sources.parse(raw_requests(spark, sf_dir))))
    out = None
    for command, part in parts.items():
        counted = part.groupBy("command").agg(F.count(F.lit(1)).alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


@register(f"""SELECT conv_id, turn, {sql_strip("trim(chr(0) || chr(0) || ' ' || text || chr(9) || chr(0), chr(0))")} AS query
FROM conversations""")
def query_normalise(spark, sf_dir):
    """Turns padded with NULs and white space, as a socket would deliver them."""
    padded = F.concat(F.lit("\0\0 "), F.col("text"), F.lit("\t\0"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalise_query(padded).alias("query"))


@register("SELECT conv_id, turn, text FROM conversations")
def lossy_decode(spark, sf_dir):
    """Turns as bytes with invalid bytes around them; decoding drops just those."""
    payload = F.unhex(F.concat(F.lit("FF"), F.hex(F.encode("text", "UTF-8")), F.lit("C3FE")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", decode_lossy(payload).alias("text"))


@register("""SELECT event_id, CASE event_type WHEN 'error' THEN 'SERVER ERROR' WHEN 'view' THEN 'STRING EXISTS'
  WHEN 'click' THEN 'STRING NOT FOUND' ELSE 'RATE LIMIT EXCEEDED' END AS verdict,
  CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE round(value, 2) END::DOUBLE AS duration_ms FROM events""")
def verdict_parse(spark, sf_dir):
    """Responses written from events, every third one without a time."""
    e = table(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_type") == "error", verdicts.FAILED)
        .when(F.col("event_type") == "view", verdicts.EXISTS)
        .when(F.col("event_type") == "click", verdicts.NOT_FOUND)
        .otherwise(verdicts.RATE_LIMITED)
    )
    response = F.when(F.col("event_id") % 3 == 0, text).otherwise(verdicts.response_text(text, F.col("value")))
    verdict, ms = verdicts.parse_response(F.col("response"))
    return e.select("event_id", response.alias("response")).select(
        "event_id", verdict.alias("verdict"), ms.alias("duration_ms")
    )


@register(f"""SELECT e.event_id, p.query, 'u' || e.user_id AS client_ip,
  CASE WHEN event_type <> 'error' THEN 'STRING EXISTS' ELSE 'STRING NOT FOUND' END AS verdict,
  event_type <> 'error' AS found, round(value, 2) AS duration_ms, 50.5::DOUBLE AS hit_rate
FROM events e, LATERAL (SELECT event_type || ' ''' || props || ''' | IP: x' AS query) p""")
def service_log_parse(spark, sf_dir):
    """Service-log lines written from events; the queries hold quotes and bars."""
    e = spread(table(spark, sf_dir, "events"), "event_id")
    found = F.col("event_type") != "error"
    query = F.concat("event_type", F.lit(" '"), "props", F.lit("' | IP: x"))
    line = sources.service_log_line(
        found, query, F.concat(F.lit("u"), "user_id"), verdicts.verdict(found), F.col("value"), F.lit(50.5)
    )
    return sources.parse_service_log(e.select("event_id", line.alias("value")))


@register("""SELECT doc_id, lang FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def client_allow_deny(spark, sf_dir):
    """Documents as clients: good ones are allowed, toxic ones denied."""
    labels = table(spark, sf_dir, "labels")
    return requests.permitted(
        table(spark, sf_dir, "documents").select("doc_id", "lang"),
        labels.where("quality = 1").select("doc_id"),
        labels.where("toxic = 1").select("doc_id"),
        "doc_id",
    )


@register("""SELECT event_id, CASE event_type WHEN 'error' THEN 'SEARCH_ERROR' WHEN 'click' THEN 'VALIDATION_ERROR'
  WHEN 'signup' THEN 'SECURITY_ERROR' WHEN 'purchase' THEN 'RESOURCE_ERROR' ELSE 'SERVER_ERROR' END AS code FROM events""")
def error_classify(spark, sf_dir):
    kind = F.col("event_type")
    failure = (
        F.when(kind == "error", "search").when(kind == "click", "validation").when(kind == "signup", "security")
        .when(kind == "purchase", "resource").otherwise("unheard of")
    )
    return table(spark, sf_dir, "events").select("event_id", requests.error_code(failure).alias("code"))


@register(f"SELECT event_id FROM events WHERE right(md5(event_id::VARCHAR), 16) < '{trace_bound(0.25):016x}'")
def trace_sampling(spark, sf_dir):
    trace = F.md5(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").where(trace_sampled(trace, 0.25)).select("event_id")


@register("""SELECT event_id, length(event_type) AS search_pattern_length, user_id AS search_result_count,
  CASE WHEN value > 0 THEN 1.0 / value ELSE 0.0 END::DOUBLE AS search_throughput FROM events""")
def request_metrics(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("query"), F.col("user_id").alias("count"), F.col("value").alias("duration")
    )
    return requests.request_metrics(log).select(
        "event_id", F.col("search_pattern_length").cast("bigint").alias("search_pattern_length"),
        "search_result_count", "search_throughput",
    )


SQL_ANSWERS = f"""{SQL_FOLDED}, {SQL_VALID},
asked AS (SELECT req.*, error_code FROM req JOIN v USING (request_id)),
m AS (
  SELECT request_id, max_count AS k, first_pos FROM asked JOIN folded ON
    CASE WHEN regex THEN regexp_matches(line_lower, query) WHEN whole_line THEN line_lower = lower(query)
         ELSE contains(line_lower, lower(query)) END
  WHERE error_code IS NULL AND command = 'search'),
n AS (SELECT request_id, CASE WHEN max(k) > 0 THEN least(count(*), max(k)) ELSE count(*) END AS n FROM m GROUP BY 1)
SELECT asked.request_id, error_code, CASE WHEN error_code IS NULL AND command = 'search' THEN coalesce(n, 0) END AS count
FROM asked LEFT JOIN n USING (request_id)"""


@register(f"WITH {SQL_ANSWERS}")
def request_answers(spark, sf_dir):
    """Every raw request answered against the documents, end to end."""
    snap = index.snapshot(spark, doc_lines(spark, sf_dir), scratch_path(spark, "index"))
    responses, _ = service.answer(raw_requests(spark, sf_dir), snap)
    return responses.select("request_id", "error_code", "count")


# ----------------------------------------------------------------- admission
LOG_LIMIT, LOG_WINDOW_S = 2, 86_400
BUCKET_RATE, BUCKET_BURST = 1 / 40_000, 2

SQL_ORDERED = """ev AS (SELECT user_id, event_id, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""
SQL_SLIDING = f"""WITH RECURSIVE {SQL_ORDERED},
fold AS (
  SELECT user_id, event_id, t, rn, true AS admitted, [t] AS log FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.t, e.rn, len(f.log) < {LOG_LIMIT} OR f.log[1] < e.t - {LOG_WINDOW_S * 1_000_000},
    CASE WHEN len(f.log) < {LOG_LIMIT} THEN list_append(f.log, e.t)
         WHEN f.log[1] < e.t - {LOG_WINDOW_S * 1_000_000} THEN list_append(f.log[2:], e.t) ELSE f.log END
  FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, event_id, t AS ts_us, admitted FROM fold"""
SQL_BUCKET = f"""WITH RECURSIVE {SQL_ORDERED},
fold AS (
  SELECT user_id, event_id, t, rn, true AS admitted, {BUCKET_BURST - 1}.0 * 1000000 AS credit FROM ev WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, t, rn, c >= 1000000, CASE WHEN c >= 1000000 THEN c - 1000000 ELSE c END FROM (
    SELECT e.user_id, e.event_id, e.t, e.rn,
           least({BUCKET_BURST}000000::DOUBLE, f.credit + (e.t - f.t) * {BUCKET_RATE!r}::DOUBLE) AS c
    FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT user_id, event_id, t AS ts_us, admitted FROM fold"""


@register(SQL_SLIDING)
def rate_limit_sliding_log(spark, sf_dir):
    return admission.sliding_log(
        events(spark, sf_dir), "user_id", "ts_us", "event_id", LOG_LIMIT, LOG_WINDOW_S
    )


@register(SQL_BUCKET.replace(".0 * 1000000 AS credit", "000000::DOUBLE AS credit"))
def rate_limit_token_bucket(spark, sf_dir):
    return admission.token_bucket(
        events(spark, sf_dir), "user_id", "ts_us", "event_id", BUCKET_RATE, BUCKET_BURST
    )


@register(f"""WITH fold AS ({SQL_SLIDING})
SELECT e.event_id, event_type, admitted, CASE WHEN NOT admitted THEN 'RATE_LIMIT_EXCEEDED' END AS error_code
FROM events e JOIN fold USING (event_id)""".replace("WITH fold AS (WITH RECURSIVE", "WITH fold AS (WITH RECURSIVE"))
def rate_limit_verdicts(spark, sf_dir):
    log = events(spark, sf_dir)
    keys = ["user_id", "ts_us", "event_id"]
    decided = admission.sliding_log(log, *keys, LOG_LIMIT, LOG_WINDOW_S)
    return admission.with_verdicts(log, decided, keys).select("event_id", "event_type", "admitted", "error_code")
