"""Line corpora from text files and from text columns.

Every reader returns raw lines ``(path, line_no, pos, raw)``. ``line_no`` is the
0-based number inside one file or document (blank lines count) and ``pos`` is a
number that grows with (path, line_no) over the whole corpus, so that "first"
and "last" need only a min or max of a fixed-width column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lineseek.functions.text import LF, UNIVERSAL_NEWLINE, strip
from lineseek.plans.session import materialise
from lineseek.plans.sizing import broadcast_if_small

LINES_PER_DOCUMENT = 1 << 32
BAD_UTF8_POLICIES = ("fail", "drop", "flag", "keep")


def from_table(df: DataFrame, id_col: str, text_col: str, newline: str = LF, small_ids: bool = False) -> DataFrame:
    """Split a text column into lines. No shuffle: one explode per document.

    ``pos`` is a decimal that holds every 64-bit id. ``small_ids`` says that all
    ids fit 31 bits and makes it a bigint; a larger id is then an error.
    """
    doc = F.col(id_col).cast("bigint")
    kind = "bigint" if small_ids else "decimal(38,0)"
    path = F.col("path").cast("bigint" if small_ids else "decimal(20,0)")
    return df.select(
        doc.alias("path"), F.posexplode(F.split(F.col(text_col), newline)).alias("line_no", "raw")
    ).select(
        "path",
        F.col("line_no").cast("bigint").alias("line_no"),
        (path * F.lit(LINES_PER_DOCUMENT).cast("bigint" if small_ids else "decimal(10,0)") + F.col("line_no")).cast(kind).alias("pos"),
        "raw",
    )


def clean(raw_lines: DataFrame) -> DataFrame:
    """Strip, drop blank lines, add the lower-cased form."""
    line = strip(F.col("raw"))
    return (
        raw_lines.withColumn("line", line)
        .where(F.col("line") != "")
        .drop("raw")
        .withColumn("line_lower", F.lower("line"))
    )


def _pin_splits(spark: SparkSession) -> None:
    # Split planning follows the number of live cores unless this is set; the two
    # passes over the same files must see the same splits.
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def _utf8(df: DataFrame, policy: str) -> DataFrame:
    if policy not in BAD_UTF8_POLICIES:
        raise ValueError(f"on_bad_utf8 must be one of {BAD_UTF8_POLICIES}")
    if policy == "fail":
        return df.withColumn("raw", F.validate_utf8("raw"))
    if policy == "drop":
        return df.where(F.is_valid_utf8("raw"))
    if policy == "flag":
        return df.withColumn("bad_utf8", ~F.is_valid_utf8("raw"))
    return df


def scan(spark: SparkSession, paths: str | list[str], universal_newlines: bool = True) -> DataFrame:
    """Plain scan ``(path, raw)``: one pass, no line numbers."""
    reader = spark.read if universal_newlines else spark.read.option("lineSep", LF)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def read(
    spark: SparkSession,
    paths: str | list[str],
    universal_newlines: bool = True,
    on_bad_utf8: str = "fail",
) -> DataFrame:
    """Numbered raw lines of text files.

    Pass 1 counts the lines of every file split; a running sum over that small
    table gives each split its first line number. Pass 2 adds the row's place in
    its split. No row of text is ever shuffled.
    """
    _pin_splits(spark)
    reader = spark.read if universal_newlines else spark.read.option("lineSep", LF)
    rows = reader.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("raw"),
    )
    counts = materialise(
        rows.groupBy("path", "block").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n_lines")),
        "splits",
    )
    before = W.rowsBetween(W.unboundedPreceding, -1)
    # one row per file split: a table of the size of the file listing
    offsets = counts.select(
        "path",
        "block",
        "first_id",
        "n_lines",
        F.coalesce(F.sum("n_lines").over(before.partitionBy("path").orderBy("block")), F.lit(0)).alias("line_base"),
        F.coalesce(F.sum("n_lines").over(before.orderBy("path", "block")), F.lit(0)).alias("pos_base"),
    )
    rank = F.col("row_id") - F.col("first_id")
    checked = F.when(rank.between(F.lit(0), F.col("n_lines") - 1), rank).otherwise(
        F.raise_error(F.lit("file splits changed between the two passes; read the files again"))
    )
    numbered = (
        rows.join(broadcast_if_small(offsets), ["path", "block"], "left")
        .withColumn("rank", checked)
        .select(
            "path",
            (F.col("line_base") + F.col("rank")).alias("line_no"),
            (F.col("pos_base") + F.col("rank")).alias("pos"),
            "raw",
        )
    )
    return _utf8(numbered, on_bad_utf8)


def read_lf(spark: SparkSession, paths: str | list[str], on_bad_utf8: str = "fail") -> DataFrame:
    """Corpus split at LF only; a CR inside a line stays."""
    return clean(read(spark, paths, universal_newlines=False, on_bad_utf8=on_bad_utf8))


def read_universal(spark: SparkSession, paths: str | list[str], on_bad_utf8: str = "fail") -> DataFrame:
    """Corpus split at LF, CR and CRLF."""
    return clean(read(spark, paths, universal_newlines=True, on_bad_utf8=on_bad_utf8))


def total_lines(raw_lines: DataFrame) -> DataFrame:
    """Raw line count: blanks and duplicates included."""
    return raw_lines.agg(F.count(F.lit(1)).alias("total_lines"))


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file; for many small files only, since a file fills one task."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")


def refreshed(spark: SparkSession, path: str, on_bad_utf8: str = "fail") -> DataFrame:
    """Corpus as it is on disk now (lookup after a change sees the change)."""
    spark.catalog.refreshByPath(path)
    return read_universal(spark, path, on_bad_utf8)


def universal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return from_table(df, id_col, text_col, UNIVERSAL_NEWLINE)


def head(raw_lines: DataFrame, n: int) -> DataFrame:
    """First n lines of every file or document, with their numbers."""
    return raw_lines.where(F.col("line_no") < n)


def line_bytes(line: Column) -> Column:
    return F.octet_length(line)
