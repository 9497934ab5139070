"""Request checks: validation, command dispatch, error codes, client lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lineseek.functions import regex
from lineseek.plans.session import materialise
from lineseek.plans.sizing import broadcast_if_small

# Default limits and the known commands.
MAX_PATTERN_CHARS = 1000
MAX_REQUEST_BYTES = 1 << 20
COMMANDS = ("search", "metrics", "health", "alerts")

# Error code of each class of failure.
ERROR_CODES = {
    "server": "SERVER_ERROR",
    "config": "CONFIG_ERROR",
    "security": "SECURITY_ERROR",
    "validation": "VALIDATION_ERROR",
    "rate_limit": "RATE_LIMIT_EXCEEDED",
    "resource": "RESOURCE_ERROR",
    "connection": "CONNECTION_ERROR",
    "search": "SEARCH_ERROR",
}


@F.pandas_udf(BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    return patterns.map(regex.is_valid)


def valid_patterns(requests: DataFrame, max_pattern_chars: int = MAX_PATTERN_CHARS) -> DataFrame:
    """Distinct regex patterns of a log, up to the length that is let in, with a flag: each is compiled once."""
    return (
        requests.where(F.col("options.regex") & (F.length("query") <= max_pattern_chars))
        .select("query")
        .distinct()
        .withColumn("pattern_ok", _compiles("query"))
    )


def validate(
    requests: DataFrame,
    raw_col: str = "raw",
    max_pattern_chars: int = MAX_PATTERN_CHARS,
    max_request_bytes: int = MAX_REQUEST_BYTES,
    check_patterns: bool = True,
) -> DataFrame:
    """Add ``error_code`` and ``error_message`` (null = fine) to parsed requests.

    The size test comes first, so an oversized request is not looked at further.
    """
    if check_patterns:
        checked = materialise(valid_patterns(requests, max_pattern_chars), "patterns")
        requests = requests.join(checked, "query", "left").withColumn(
            "pattern_ok", F.coalesce("pattern_ok", F.lit(True))
        )
    else:
        requests = requests.withColumn("pattern_ok", F.lit(True))
    is_search = F.col("command") == "search"
    chain = (
        F.when(
            F.octet_length(raw_col) > max_request_bytes,
            F.struct(F.lit("REQUEST_TOO_LARGE").alias("code"), F.lit("request too large").alias("message")),
        )
        .when(
            F.col("parse_error").isNotNull(),
            F.struct(F.lit("INVALID_REQUEST").alias("code"), F.col("parse_error").alias("message")),
        )
        .when(
            ~F.col("command").isin(*COMMANDS),
            F.struct(
                F.lit("INVALID_REQUEST").alias("code"),
                F.concat(F.lit("Unknown command: "), F.col("command")).alias("message"),
            ),
        )
        .when(
            is_search & (F.coalesce(F.col("query"), F.lit("")) == ""),
            F.struct(F.lit("INVALID_REQUEST").alias("code"), F.lit("Empty query").alias("message")),
        )
        .when(
            is_search & (F.length("query") > max_pattern_chars),
            F.struct(F.lit("INVALID_PATTERN").alias("code"), F.lit("Query too long").alias("message")),
        )
        .when(
            is_search & F.col("options.regex") & ~F.col("pattern_ok"),
            F.struct(F.lit("INVALID_PATTERN").alias("code"), F.lit("bad regular expression").alias("message")),
        )
        .when(
            is_search & (F.col("options.max_count") < 0),
            F.struct(F.lit("INVALID_REQUEST").alias("code"), F.lit("max_count is negative").alias("message")),
        )
    )
    return (
        requests.withColumn("__error", chain)
        .withColumn("error_code", F.col("__error.code"))
        .withColumn("error_message", F.col("__error.message"))
        .drop("__error", "pattern_ok")
    )


def dispatch(requests: DataFrame) -> dict[str, DataFrame]:
    """Valid requests by command; each part is a filter of the same plan."""
    fine = requests.where(F.col("error_code").isNull())
    return {command: fine.where(F.col("command") == command) for command in COMMANDS}


def error_code(kind: Column) -> Column:
    """Error code of a failure class; an unknown class is a server error."""
    code = F.lit(ERROR_CODES["server"])
    for name, value in ERROR_CODES.items():
        code = F.when(kind == name, F.lit(value)).otherwise(code)
    return code


def error_row(code: Column, message: Column, details: Column | None = None) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.struct(
        code.alias("code"),
        message.alias("message"),
        (empty if details is None else F.coalesce(details, empty)).alias("details"),
    )


def permitted(
    requests: DataFrame, allow: DataFrame | None, deny: DataFrame | None, client_col: str = "client_ip"
) -> DataFrame:
    """Requests of permitted clients. Deny wins; an empty allow list allows all."""
    out = requests
    if deny is not None:
        denied = materialise(deny.select(client_col).where(F.col(client_col).isNotNull()).distinct(), "denied")
        out = out.join(broadcast_if_small(denied), client_col, "left_anti")
    if allow is not None:
        allowed = materialise(allow.select(client_col).distinct(), "allowed")
        if allowed.limit(1).count():
            out = out.join(broadcast_if_small(allowed), client_col, "left_semi")
    return out


def request_metrics(results: DataFrame) -> DataFrame:
    """Per request: pattern length, result count, throughput (0 when instant)."""
    return results.select(
        "*",
        F.length("query").alias("search_pattern_length"),
        F.col("count").alias("search_result_count"),
        F.when(F.col("duration") > 0, 1.0 / F.col("duration")).otherwise(0.0).alias("search_throughput"),
    )
