"""Option search: substring, whole line, regex, inverted, limited.

A search runs over a *view* of the corpus (``operators.corpus``): the exact view
when case matters, the folded view otherwise. Both hold ``line``,
``line_lower`` and ``first_pos``; keeping the lower-cased text as a column lets
the predicate reach the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window as W

from lineseek.functions import regex
from lineseek.plans.session import materialise
from lineseek.plans.sizing import broadcast_if_small

# Option names, with the spellings accepted in requests.
OPTION_SPELLINGS = {
    "case_sensitive": ("case_sensitive",),
    "whole_line": ("whole_line", "whole_line_match"),
    "regex": ("regex", "use_regex"),
    "invert": ("invert", "invert_match"),
    "max_count": ("max_count",),
}


@dataclass(frozen=True)
class SearchOptions:
    case_sensitive: bool = False
    whole_line: bool = False
    regex: bool = False
    invert: bool = False
    max_count: int | None = None

    def __post_init__(self) -> None:
        if self.max_count is not None and self.max_count < 0:
            raise ValueError("max_count must not be negative")

    @classmethod
    def from_request(cls, options: dict) -> "SearchOptions":
        spelling = {alias: name for name, aliases in OPTION_SPELLINGS.items() for alias in aliases}
        unknown = set(options) - set(spelling)
        if unknown:
            raise ValueError(f"unknown search options: {sorted(unknown)}")
        return cls(**{spelling[k]: v for k, v in options.items() if v is not None})

    @property
    def limit(self) -> int | None:
        """0 and null both mean: no limit."""
        return self.max_count or None


def check_query(query: str, options: SearchOptions) -> None:
    if not query:
        raise ValueError("INVALID_REQUEST: empty query")
    if options.regex and not regex.is_valid(query):
        raise ValueError("INVALID_PATTERN: not a regular expression")


def predicate(query: str, options: SearchOptions, text: Column | None = None) -> Column:
    """The test one query puts to one line. Regex wins over whole line.

    ``text`` is the line as the search sees it: lower-cased unless case matters.
    """
    if text is None:
        text = F.col("line" if options.case_sensitive else "line_lower")
    if options.regex:
        test = text.rlike(regex.to_jvm(query, ignore_case=not options.case_sensitive))
    else:
        needle = F.lit(query) if options.case_sensitive else F.lower(F.lit(query))
        test = (text == needle) if options.whole_line else F.contains(text, needle)
    return ~test if options.invert else test


def view_for(options: SearchOptions, exact: DataFrame, folded: DataFrame) -> DataFrame:
    return exact if options.case_sensitive else folded


def search(view: DataFrame, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Matches ``(line, first_pos)``, cut to ``max_count`` in first-seen order."""
    check_query(query, options)
    hits = view.where(predicate(query, options)).select("line", "first_pos")
    return hits.orderBy("first_pos").limit(options.limit) if options.limit else hits


def limit_per_query(matches: DataFrame, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Keep each query's first ``max_count`` matches.

    Unlimited queries skip the ranking altogether, so a query that matches a
    third of the corpus is never gathered in one task; limited ones are cut to
    the largest limit on the map side. A mixed batch writes its matches down
    once, so that the search itself does not run twice.
    """
    limited = F.coalesce(F.col("max_count"), F.lit(0)) > 0
    n_limited, n_free, largest = queries.agg(
        F.count_if(limited), F.count_if(~limited), F.max(F.when(limited, F.col("max_count")))
    ).first()
    if not n_limited:
        return matches
    limits = broadcast_if_small(queries.where(limited).select(query_id, F.col("max_count").alias("k")))
    if n_free:
        matches = materialise(matches, "matches")
    free = matches.join(limits, query_id, "left_anti")
    ranked = matches.join(limits, query_id).withColumn(
        "rn", F.row_number().over(W.partitionBy(query_id).orderBy("first_pos"))
    )
    ranked = ranked.where((F.col("rn") <= largest) & (F.col("rn") <= F.col("k"))).select(*free.columns)
    return free.unionByName(ranked) if n_free else ranked


#: Matches that a task looks at together, and that it holds at most, when it cuts them to the first ones.
CUT_ROWS, HELD_ROWS = 1 << 16, 1 << 20


def first_matches(matches: DataFrame, max_count: int, query_id: str = "query_id") -> DataFrame:
    """Each query's first ``max_count`` matches by ``first_pos`` (nulls first); matches of no query are left out.

    Every task keeps the first ones of the rows it has seen, so that neither a sort
    nor a shuffle meets all matches; the ranking that decides follows on these. Ids and
    positions that are not whole numbers of 64 bits are ranked right away.
    """
    matches = matches.where(F.col(query_id).isNotNull())
    whole = all(isinstance(matches.schema[c].dataType, LongType) for c in (query_id, "first_pos"))

    def firsts(rows: pa.Table) -> pa.Table:
        ids = rows[query_id].to_numpy()
        known = rows["first_pos"].is_valid().to_numpy()
        at = pc.fill_null(rows["first_pos"], 0).to_numpy()
        order = np.lexsort((at, known, ids))
        ids = ids[order]
        rank = np.arange(len(ids)) - np.searchsorted(ids, ids)
        return rows.take(order[rank < max_count])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0
        for batch in batches:
            held.append(batch)
            fresh += len(batch)
            if fresh >= CUT_ROWS:
                held, fresh = firsts(pa.Table.from_batches(held)).combine_chunks().to_batches(), 0
                if sum(map(len, held)) > HELD_ROWS:
                    yield from held
                    held = []
        if held:
            yield from firsts(pa.Table.from_batches(held)).to_batches()

    cut = matches.mapInArrow(run, matches.schema) if whole else matches
    rank = F.row_number().over(W.partitionBy(query_id).orderBy("first_pos"))
    return cut.withColumn("__rn", rank).where(F.col("__rn") <= max_count).drop("__rn")


def result_counts(queries: DataFrame, matches: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row per query with its number of matches; a miss counts 0."""
    counts = matches.groupBy(query_id).agg(F.count(F.lit(1)).alias("count"))
    return queries.join(counts, query_id, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def result_lists(queries: DataFrame, matches: DataFrame, max_count: int, query_id: str = "query_id") -> DataFrame:
    """Matches of each query as one array, at most ``max_count`` long."""
    if max_count <= 0:
        raise ValueError("an array result needs a positive max_count; use the row form otherwise")
    w = W.partitionBy(query_id).orderBy("first_pos")
    top = matches.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_count)
    lists = top.groupBy(query_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda m: m["line"]).alias("matches")
    )
    return (
        queries.join(lists, query_id, "left")
        .withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))
        .withColumn("count", F.size("matches").cast("bigint"))
    )
