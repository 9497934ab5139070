"""Does this exact line exist? One answer per query, for batches of any size.

The corpus is the big side. When the distinct queries fit a checked bound they
are broadcast and the corpus is filtered where it is read: nothing of it is
shuffled. Beyond the bound both sides are joined on the line, and Spark's
runtime filter thins out the corpus before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.functions.hashing import BUCKETS, FILTER_BITS, bit_address, bucket_of
from lineseek.functions.text import WHITESPACE, normalise_query
from lineseek.functions.verdicts import verdict
from lineseek.plans.session import materialise
from lineseek.plans.sizing import broadcast_if_small, fits


def single(lines: DataFrame, needle: str) -> DataFrame:
    """One lookup. The equality reaches the Parquet reader and stops at a hit."""
    query = needle.strip("\0").strip(WHITESPACE)
    return lines.where(F.col("line") == F.lit(query)).select("line").limit(1)


def prepare(queries: DataFrame, query_col: str = "query") -> DataFrame:
    return queries.withColumn(query_col, normalise_query(F.col(query_col)))


def _needles(queries: DataFrame, query_col: str) -> DataFrame:
    """Distinct query texts, written down: they are counted first and used after."""
    texts = queries.select(F.col(query_col).alias("line")).where(F.col("line") != "").distinct()
    return materialise(texts, "needles")


def found_lines(lines: DataFrame, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Distinct query texts that are lines of the corpus."""
    needles = broadcast_if_small(_needles(queries, query_col))
    return lines.select("line").join(needles, "line", "left_semi").distinct()


def lookup_pruned(index: DataFrame, queries: DataFrame, query_col: str = "query", buckets: int = BUCKETS) -> DataFrame:
    """``lookup`` in a table of ``sources.index.save``: only the folders that can hold a query are read.

    The folders come from the broadcast queries themselves while the query runs; a
    batch too large to broadcast joins bucket by bucket, without a shuffle of the index.
    """
    needles = _needles(queries, query_col).where(F.length("line") > 0).withColumn("part", bucket_of("line", buckets))
    if fits(needles):
        hits = index.select("line", "part").join(F.broadcast(needles), ["part", "line"], "left_semi")
    else:
        hits = index.select("line").join(needles.select("line").hint("merge"), "line", "left_semi")
    return _answered(queries, hits.select("line"), query_col)


def lookup(lines: DataFrame, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """queries + ``found`` + ``verdict``. Empty queries are never found."""
    return _answered(queries, found_lines(lines, queries, query_col), query_col)


def _answered(queries: DataFrame, found: DataFrame, query_col: str) -> DataFrame:
    hits = found.select(F.col("line").alias(query_col), F.lit(True).alias("hit"))
    return (
        queries.join(hits, query_col, "left")
        .withColumn("found", F.coalesce("hit", F.lit(False)))
        .drop("hit")
        .withColumn("verdict", verdict(F.col("found")))
    )


def lookup_sorted(lines: DataFrame, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Same answers by ordered search: a sort-merge join on the line.

    Fits a corpus stored sorted and bucketed by line, where its side needs
    neither shuffle nor sort.
    """
    distinct = lines.select(F.col("line").alias(query_col), F.lit(True).alias("hit")).distinct()
    return (
        queries.join(distinct.hint("merge"), query_col, "left")
        .withColumn("found", F.coalesce("hit", F.lit(False)))
        .drop("hit")
        .withColumn("verdict", verdict(F.col("found")))
    )


def lookup_by_hash(lines: DataFrame, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Approximate: two lines with one 64-bit hash count as equal.

    The keys are 8 bytes wide, so far less is shuffled than by ``lookup``.
    """
    hits = lines.select(F.xxhash64("line").alias("h")).distinct().withColumn("maybe", F.lit(True))
    return (
        queries.withColumn("h", F.xxhash64(query_col))
        .join(hits, "h", "left")
        .withColumn("maybe", F.coalesce("maybe", F.lit(False)))
        .drop("h")
    )


def filter_bits(lines: DataFrame, bits: int = FILTER_BITS, digest: str = "xxhash64") -> DataFrame:
    """The set bits of the membership filter: at most ``bits`` rows."""
    return lines.select(bit_address(F.col("line"), bits, digest).alias("bit")).distinct()


def lookup_by_filter(
    lines: DataFrame,
    queries: DataFrame,
    query_col: str = "query",
    bits: int = FILTER_BITS,
    digest: str = "xxhash64",
) -> DataFrame:
    """queries + ``maybe`` (filter answer). False means certainly absent."""
    set_bits = filter_bits(lines, bits, digest).withColumn("maybe", F.lit(True))
    return (
        queries.withColumn("bit", bit_address(F.col(query_col), bits, digest))
        .join(set_bits, "bit", "left")
        .withColumn("maybe", F.coalesce("maybe", F.lit(False)))
        .drop("bit")
    )


def filter_error(lines: DataFrame, queries: DataFrame, query_col: str = "query", **kw) -> DataFrame:
    """Measured false positives of the filter over a query batch."""
    exact = lookup(lines, queries, query_col).select(query_col, "found")
    both = lookup_by_filter(lines, exact, query_col, **kw)
    absent = F.count_if(~F.col("found"))
    wrong = F.count_if(F.col("maybe") & ~F.col("found"))
    return both.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if("found").alias("n_found"),
        F.count_if("maybe").alias("n_maybe"),
        wrong.alias("false_positives"),
        F.count_if(F.col("found") & ~F.col("maybe")).alias("false_negatives"),
        F.when(absent > 0, wrong / absent).alias("false_positive_rate"),
    )


def semi(queries: DataFrame, lines: DataFrame, query_col: str = "query") -> DataFrame:
    """Queries whose text is present."""
    hits = found_lines(lines, queries, query_col).withColumnRenamed("line", query_col)
    return queries.join(hits, query_col, "left_semi")


def anti(queries: DataFrame, lines: DataFrame, query_col: str = "query") -> DataFrame:
    """Queries whose text is missing."""
    hits = found_lines(lines, queries, query_col).withColumnRenamed("line", query_col)
    return queries.join(hits, query_col, "left_anti")


def prefix_exists(lines: DataFrame, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Is some line an extension of the query? One answer per query.

    Lines are cut at the lengths that occur among the queries, which turns a
    range search into an equality semi join.
    """
    lengths = (
        queries.where(F.col(query_col) != "")
        .agg(F.array_sort(F.collect_set(F.length(query_col))).alias("lengths"))
        .scalar()
    )
    heads = lines.select("line", F.explode(lengths).alias("n")).where(F.col("n") <= F.length("line")).select(
        F.substring(F.col("line"), F.lit(1), F.col("n")).alias("line")
    )
    needles = _needles(queries, query_col)
    if fits(needles):
        hits = heads.join(F.broadcast(needles), "line", "left_semi").distinct()
    else:
        # combine equal beginnings before they are shuffled
        hits = heads.distinct().join(needles, "line", "left_semi")
    return (
        queries.join(hits.select(F.col("line").alias(query_col), F.lit(True).alias("hit")), query_col, "left")
        .withColumn("found", F.coalesce("hit", F.lit(False)))
        .drop("hit")
    )


def coverage(required: DataFrame, lines: DataFrame) -> DataFrame:
    """k of n required lines are present."""
    flags = lookup(lines, required.select(F.col("line").alias("query")).distinct())
    return flags.agg(
        F.count_if("found").alias("present"),
        F.count(F.lit(1)).alias("required"),
        (F.count_if("found") == F.count(F.lit(1))).alias("complete"),
    )


def raw_line_exists(raw_lines: DataFrame, needle: str, raw_col: str = "raw") -> DataFrame:
    """Is some unstripped line exactly this text? White space at the ends counts."""
    return raw_lines.agg(F.coalesce(F.bool_or(F.col(raw_col) == F.lit(needle)), F.lit(False)).alias("found"))


def any_line_contains(raw_lines: DataFrame, needle: str, raw_col: str = "raw") -> DataFrame:
    """Does any unstripped line hold the text? Part of a line is enough."""
    return raw_lines.agg(F.coalesce(F.bool_or(F.contains(F.col(raw_col), F.lit(needle))), F.lit(False)).alias("found"))
