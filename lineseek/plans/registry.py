"""Catalogue of queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions.text import WHITESPACE_CODE_POINTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that checks it."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a table of few file splits to all cores before heavy work per row.

    A table with at least one split for each core is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def r(value: Column, digits: int = 6) -> Column:
    """Round for comparison; the nudge makes exact ties round alike everywhere."""
    return F.round(value + F.lit(0.01 / 10**digits), digits)


def rs(value: str, digits: int = 6) -> str:
    """SQL twin of ``r``."""
    return f"round({value} + {0.01 / 10**digits:.{digits + 2}f}, {digits})"


SQL_WS = "concat(" + ",".join(f"chr({c})" for c in WHITESPACE_CODE_POINTS) + ")"


def sql_strip(value: str) -> str:
    return f"trim({value}, {SQL_WS})"


def sql_lines(source: str = "documents", key: str = "doc_id", text: str = "text", p: str = "") -> str:
    """CTEs ``{p}raw`` and ``{p}lines`` of a text table."""
    return f"""{p}raw AS (
  SELECT path, unnest(generate_series(0, len(parts) - 1)) AS line_no, unnest(parts) AS raw
  FROM (SELECT {key} AS path, string_split({text}, chr(10)) AS parts FROM {source})),
{p}lines AS (
  SELECT path, line_no, path * 4294967296 + line_no AS pos, line, lower(line) AS line_lower
  FROM (SELECT *, {sql_strip('raw')} AS line FROM {p}raw) WHERE line <> '')"""


SQL_LINES = sql_lines()
SQL_EXACT = f"""{SQL_LINES},
exact AS (
  SELECT line, lower(line) AS line_lower, count(*) AS n_occurrences, min(pos) AS first_pos, max(pos) AS last_pos,
         arg_max(line_no, pos) AS last_line_no
  FROM lines GROUP BY line)"""
SQL_FOLDED = f"""{SQL_EXACT},
folded AS (
  SELECT line_lower, arg_max(line, last_pos) AS line, sum(n_occurrences)::BIGINT AS n_occurrences,
         min(first_pos) AS first_pos, max(last_pos) AS last_pos
  FROM exact GROUP BY line_lower)"""
# query batch: distinct lines of benchmark items and conversation turns
SQL_BATCH = f"""batch AS (
  SELECT DISTINCT query FROM (
    SELECT {sql_strip('unnest(string_split(text, chr(10)))')} AS query FROM benchmark
    UNION ALL SELECT {sql_strip('unnest(string_split(text, chr(10)))')} FROM conversations)
  WHERE query <> '')"""
