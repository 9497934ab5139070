"""Set views of a corpus.

``exact_view``   one row per distinct line
``folded_view``  one row per lower-cased line, carrying its last original

The exact view is a hash aggregation over fixed-width positions, so a line that
makes up a third of the corpus shrinks to one row per map task before the
shuffle. The folded view starts from the exact one and meets each line once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lineseek.functions.text import strip
from lineseek.operators.membership import anti, semi


def exact_view(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy("line")
        .agg(
            F.count(F.lit(1)).alias("n_occurrences"),
            F.min("pos").alias("first_pos"),
            F.max("pos").alias("last_pos"),
            F.max_by("line_no", "pos").alias("last_line_no"),
        )
        .withColumn("line_lower", F.lower("line"))
    )


def with_fold(exact: DataFrame) -> DataFrame:
    """Exact view with the figures of each line's lower-cased group.

    The group holds the distinct spellings of one line, so a window over it is
    small; unlike an aggregation that carries text it sorts once. The rows come to
    it by their lower-cased form, which is made again there and not shuffled.
    """
    spellings = W.partitionBy("line_lower")
    exact = exact.drop("line_lower").repartition(F.lower("line")).withColumn("line_lower", F.lower("line")).select(*exact.columns)
    return (
        exact.withColumn("is_fold", F.col("last_pos") == F.max("last_pos").over(spellings))
        .withColumn("fold_first_pos", F.min("first_pos").over(spellings))
        .withColumn("fold_occurrences", F.sum("n_occurrences").over(spellings))
    )


def folded_view(exact: DataFrame) -> DataFrame:
    return with_fold(exact).where("is_fold").select(
        "line_lower",
        "line",
        F.col("fold_occurrences").alias("n_occurrences"),
        F.col("fold_first_pos").alias("first_pos"),
        "last_pos",
    )


def line_index(lines: DataFrame) -> DataFrame:
    """Last 0-based line number of every distinct line."""
    return exact_view(lines).select("line", "last_line_no")


def distinct_lines(lines: DataFrame) -> DataFrame:
    return lines.select("line").distinct()


def distinct_count(lines: DataFrame, approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return lines.agg(counter("line").alias("distinct_lines"))


def sorted_lines(lines: DataFrame) -> DataFrame:
    """Code-point order (UTF-8 byte order is the same order)."""
    return distinct_lines(lines).orderBy("line")


def missing(required: DataFrame, lines: DataFrame) -> DataFrame:
    """Required lines the corpus lacks (set difference)."""
    return anti(required.select("line").distinct(), lines, "line")


def present(required: DataFrame, lines: DataFrame) -> DataFrame:
    return semi(required.select("line").distinct(), lines, "line")


def sample_entries(lines: DataFrame, n: int = 5, digest: str = "xxhash64") -> DataFrame:
    """n lines picked by hash order: arbitrary, yet the same on every run."""
    key = F.xxhash64("line") if digest == "xxhash64" else F.md5("line")
    return distinct_lines(lines).orderBy(key, "line").limit(n)


def query_sample(lines: DataFrame, cap: int = 1000, fraction: int = 10, digest: str = "xxhash64") -> DataFrame:
    """min(cap, n / fraction) distinct lines, as a query set drawn from the corpus."""
    found = distinct_lines(lines)
    size = found.agg(F.least(F.lit(cap), F.floor(F.count(F.lit(1)) / fraction)).alias("k"))
    key = F.xxhash64("line") if digest == "xxhash64" else F.md5("line")
    top = found.select("line", key.alias("key")).orderBy("key", "line").limit(cap)
    ranked = top.select("line", "key", F.struct("key", "line").alias("order_key"))
    # `top` holds at most `cap` rows, so one task may rank it
    return (
        ranked.withColumn("rn", F.row_number().over(W.orderBy("order_key")))
        .where(F.col("rn") <= size.scalar())
        .select("line")
    )


def repaired(required: DataFrame, lines: DataFrame) -> DataFrame:
    """Required lines first, then every other original line, duplicates kept."""
    needed = required.select(strip(F.col("line")).alias("line")).distinct()
    rest = lines.join(needed, "line", "left_anti").select(F.lit(1).alias("part"), "pos", "line")
    first = needed.select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos"), "line")
    return first.unionByName(rest)
