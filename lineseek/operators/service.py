"""From raw requests to answers: parse, check, admit, search, respond."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.operators.patterns import batch_search
from lineseek.operators.requests import validate
from lineseek.plans.joins import join_groups
from lineseek.plans.session import materialise
from lineseek.sources.requests import parse

OPTIONS = ("case_sensitive", "whole_line", "regex", "invert", "max_count")


def checked_requests(log: DataFrame, raw_col: str = "raw", **limits) -> DataFrame:
    """Parsed and validated requests; ``error_code`` is null where all is well."""
    return validate(parse(log, raw_col), raw_col, **limits)


def distinct_queries(requests: DataFrame) -> DataFrame:
    """Every different (query, options) among the valid searches, once.

    A query that makes up a third of the log is searched a single time.
    """
    return requests.where(is_search()).select("query", *[F.col(f"options.{o}") for o in OPTIONS]).distinct()


def is_search() -> Column:
    return F.col("error_code").isNull() & (F.col("command") == "search")


def answer(log: DataFrame, index: DataFrame, raw_col: str = "raw", **limits) -> tuple[DataFrame, DataFrame]:
    """(responses, matches).

    ``responses``: each request with ``error_code, error_message, query_id`` and
    ``count`` (null for requests that are not searches or were refused).
    ``matches``: (query_id, line, first_pos), one row per match of each distinct
    query. ``index`` is the table of ``sources.index``, best a persisted one.
    """
    # the requests are needed for the queries and again for the responses
    requests = materialise(checked_requests(log, raw_col, **limits), "requests")
    # written down, so that every later use sees the same ids
    numbered = distinct_queries(requests).withColumn("query_id", F.monotonically_increasing_id())
    queries = materialise(numbered, "queries")
    matches = materialise(batch_search(index, queries), "answers")
    found = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    counts = queries.join(found, "query_id", "left").select(
        "query", *OPTIONS, "query_id", F.coalesce("n", F.lit(0)).alias("count")
    )
    asked = requests.select("*", *[F.when(is_search(), F.col(f"options.{o}")).alias(o) for o in OPTIONS])
    responses = join_groups(asked, counts, ["query", *OPTIONS], "left").drop(*OPTIONS)
    return responses, matches
