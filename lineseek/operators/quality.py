"""Corpus quality: required lines, repair, format, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions.text import strip
from lineseek.operators.corpus import missing, repaired
from lineseek.operators.membership import any_line_contains, lookup
from lineseek.plans.session import materialise
from lineseek.plans.sizing import broadcast_if_small
from lineseek.sources.generators import REQUIRED_LINES


def required_lines(spark: SparkSession, lines: tuple[str, ...] = REQUIRED_LINES) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "line string")


def required_status(required: DataFrame, lines: DataFrame) -> DataFrame:
    """Every required line with ``present``."""
    flags = lookup(lines, required.select(F.col("line").alias("query")).distinct())
    return flags.select(F.col("query").alias("line"), F.col("found").alias("present"))


def append_missing(spark: SparkSession, required: DataFrame, lines: DataFrame, path: str) -> None:
    """Repair by append: adds the missing required lines as a new file of the corpus."""
    missing(required, lines).select("line").write.mode("append").text(path)


def rewrite_repaired(required: DataFrame, lines: DataFrame, new_path: str) -> None:
    """Repair by rewrite into a new folder, required lines first.

    The corpus being read is left alone and serves as the backup. The range
    partitioned sort keeps the order across part files.
    """
    repaired(required, lines).orderBy("part", "pos", "line").select("line").write.text(new_path)


def format_check(raw_lines: DataFrame, required: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Per file: first failing rule of (encoding, CRLF, required lines), or ok.

    ``raw_lines`` come from an LF-only read, where CRLF shows as a line ending in
    CR. Required lines are counted by an equality join against a few rows.
    """
    group = list(keys)
    need = materialise(required.select(strip(F.col("line")).alias("line")).distinct(), "required")
    n_required = need.agg(F.count(F.lit(1)).alias("n")).scalar()
    base = raw_lines.groupBy(*group).agg(
        F.bool_or(~F.is_valid_utf8("raw")).alias("bad_encoding"), F.bool_or(F.endswith("raw", F.lit("\r"))).alias("crlf")
    )
    hits = (
        raw_lines.select(*group, strip(F.col("raw")).alias("line"))
        .join(broadcast_if_small(need), "line", "left_semi")
        .groupBy(*group)
        .agg(F.count_distinct("line").alias("n_present"))
    )
    joined = base.join(hits, group, "left").withColumn("n_present", F.coalesce("n_present", F.lit(0)))
    rule = (
        F.when(F.col("bad_encoding"), "encoding")
        .when(F.col("crlf"), "line endings")
        .when(F.col("n_present") < n_required, "required lines")
    )
    return joined.select(
        *group, rule.alias("failed_rule"), rule.isNull().alias("ok"), "crlf", "n_present"
    )


def profile(raw_lines: DataFrame, needle: str, raw_col: str = "raw") -> DataFrame:
    """Total lines, distinct lines, and both "found" answers for a text.

    ``found_line`` asks for the whole stripped line, ``found_part`` for any part
    of an unstripped one. One pass plus the distinct count.
    """
    line = strip(F.col(raw_col))
    return raw_lines.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_distinct(F.when(line != "", line)).alias("distinct_lines"),
        F.count_if(line == "").alias("blank_lines"),
        F.coalesce(F.bool_or(line == F.lit(needle)), F.lit(False)).alias("found_line"),
        F.coalesce(F.bool_or(F.contains(F.col(raw_col), F.lit(needle))), F.lit(False)).alias("found_part"),
    )


def size_report(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines, distinct lines and bytes of each corpus.

    Counted per (corpus, line) first, so that a corpus holding most rows is
    counted by many tasks.
    """
    per_line = lines.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("c"))
    return per_line.groupBy(*keys).agg(
        F.sum("c").alias("lines"),
        F.count(F.lit(1)).alias("distinct_lines"),
        F.sum(F.octet_length("line") * F.col("c")).alias("bytes"),
    )


__all__ = [
    "any_line_contains", "append_missing", "format_check", "profile", "required_lines", "required_status",
    "rewrite_repaired", "size_report",
]
