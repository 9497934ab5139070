"""Request-log sources.

``parse`` turns raw request text into columns, whatever carried it (files, a
table, a stream): a JSON object is read by name, anything else is a plain-text
search. ``parse_service_log`` reads the service's own log lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.functions.text import normalise_query
from lineseek.functions.verdicts import EXISTS
from lineseek.operators.search import OPTION_SPELLINGS

# Fixed value: layout of one service-log line.
SERVICE_LOG_FORMAT = "%s Query: '%s' | IP: %s | Result: %s | Time: %.2fms | Cache Hit Rate: %.1f%%"
SERVICE_LOG_PATTERN = (
    r"(?s)^\S+ Query: '(.*)' \| IP: ([^\x01]*?) \| Result: ([^\x01]*?) \| "
    r"Time: ([0-9.]+)ms \| Cache Hit Rate: ([0-9.]+)%$"
)
_END = "#end-of-request"


def _get(doc: Column, *names: str, to: str = "string") -> Column:
    found = [F.try_variant_get(doc, f"$[0].{name}", to) for name in names]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def stamped(log: DataFrame) -> DataFrame:
    """Requests as they come in, with a ``request_id`` (random UUID) and ``received_at`` (ISO 8601, UTC, microseconds).

    Ids are drawn anew whenever the plan runs: write the rows down, or stream them
    into a table, before using ids twice. All rows of one batch share its time.
    """
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return log.withColumn("request_id", F.uuid()).withColumn("received_at", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def parse(log: DataFrame, raw_col: str = "raw", strict_json: bool = False) -> DataFrame:
    """Add ``is_json, command, query, options, parse_error``.

    The raw text is parsed once, as a variant. It is wrapped together with an
    end mark, so that text after a complete JSON value is not overlooked.
    """
    doc = F.try_parse_json(F.concat(F.lit("["), F.col(raw_col), F.lit(f',"{_END}"]')))
    parsed = log.withColumn("__doc", doc)
    whole = F.coalesce(F.try_variant_get("__doc", "$[1]", "string") == _END, F.lit(False))
    is_object = whole & F.startswith(F.ltrim(F.col(raw_col)), F.lit("{"))
    is_value = whole & ~is_object
    options = F.struct(
        *[
            F.coalesce(
                _get(F.col("__doc"), *[f"options.{a}" for a in aliases], to="boolean"), F.lit(False)
            ).alias(name)
            for name, aliases in OPTION_SPELLINGS.items()
            if name != "max_count"
        ],
        _get(F.col("__doc"), "options.max_count", to="int").alias("max_count"),
    )
    command = F.when(is_object, F.coalesce(_get(F.col("__doc"), "command"), F.lit("search"))).otherwise("search")
    text = F.when(is_object, F.coalesce(_get(F.col("__doc"), "query", "pattern"), F.lit(""))).otherwise(
        F.when(is_value, F.lit(None).cast("string")).otherwise(F.col(raw_col))
    )
    problem = F.when(is_value, "request is not an object")
    if strict_json:
        problem = F.when(~is_object, "request is not a JSON object")
    return (
        parsed.withColumn("is_json", is_object)
        .withColumn("command", command)
        .withColumn("query", normalise_query(text))
        .withColumn("options", options)
        .withColumn("parse_error", problem)
        .drop("__doc")
    )


def service_log_line(
    found: Column, query: Column, client: Column, result: Column, ms: Column, hit_rate: Column
) -> Column:
    icon = F.when(found, "✓").otherwise("✗")
    return F.format_string(SERVICE_LOG_FORMAT, icon, query, client, result, ms, hit_rate)


def parse_service_log(log: DataFrame, line_col: str = "value") -> DataFrame:
    """Columns of a service-log line. The query may itself hold quotes and bars:
    the match is greedy, so it ends at the last place where the layout fits."""
    # one match gives all parts; the query comes last, so it may hold any character
    parts = F.split(F.regexp_replace(line_col, SERVICE_LOG_PATTERN, "$2\x01$3\x01$4\x01$5\x01$1"), "\x01", 5)
    kept = [c for c in log.columns if c != line_col]

    def part(i: int) -> Column:
        return F.col("__parts")[i]

    return log.where(F.col(line_col).rlike(SERVICE_LOG_PATTERN)).select(*kept, parts.alias("__parts")).select(
        *kept,
        part(4).alias("query"),
        part(0).alias("client_ip"),
        part(1).alias("verdict"),
        (part(1) == EXISTS).alias("found"),
        part(2).cast("double").alias("duration_ms"),
        part(3).cast("double").alias("hit_rate"),
    )
