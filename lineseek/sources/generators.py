"""Line generators: distributed, seeded, any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The lines every corpus must hold.
REQUIRED_LINES = (
    "7;0;6;28;0;23;5;0;",
    "1;0;6;16;0;19;3;0;",
    "18;0;21;26;0;17;3;0;",
    "20;0;1;11;0;12;5;0;",
)


def semicolon_lines(spark: SparkSession, n: int) -> DataFrame:
    """``{i};0;{i+1};{i+2};0;{i+3};{i%5};0;`` for i < n."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat_ws(";", i, F.lit(0), i + 1, i + 2, F.lit(0), i + 3, i % 5, F.lit(0), F.lit("")).alias("line")
    )


def numbered_lines(spark: SparkSession, n: int, prefix: str = "test_line_") -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id")).alias("line"))


def mixed_lines(spark: SparkSession, n: int) -> DataFrame:
    """Four interleaved families of lines."""
    family = F.element_at(
        F.array(*[F.lit(x) for x in ("common_pattern_", "rare_pattern_", "unique_pattern_", "random_text_")]),
        (F.col("id") % 4 + 1).cast("int"),
    )
    return spark.range(n).select(F.concat(family, F.col("id")).alias("line"))


def random_triples(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``a;b;c`` with 0..20, 0..1, 1..30: at most 1260 distinct lines."""
    def pick(low: int, high: int, k: int):
        return (F.floor(F.rand(seed + k) * (high - low + 1)) + low).cast("int")

    return spark.range(n).select(F.concat_ws(";", pick(0, 20, 0), pick(0, 1, 1), pick(1, 30, 2)).alias("line"))


def random_text(spark: SparkSession, n: int, width: int, seed: int) -> DataFrame:
    return spark.range(n).select(F.randstr(width, seed).alias("line"))
