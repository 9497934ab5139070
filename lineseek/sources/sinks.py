"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("json", "parquet", "csv", "orc")


def write_result(result: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = result.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", "true").option("escape", '"').option("quoteAll", "true")
    writer.format(kind).save(path)


def read_result(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet") -> DataFrame:
    """A written result with the schema it was written with. Empty texts of CSV come back as such, not as null."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", "true").option("emptyValue", "").option("multiLine", "true").option("escape", '"')
    return reader.format(kind).load(path)


def write_report(result: DataFrame, path: str, title: str, label: str, value: str, unit: str = "") -> None:
    """Text report of a small result: a title and one ``label: value`` line each."""
    lines = result.select(
        F.lit(1).alias("part"), F.col(label).cast("string").alias("key"),
        F.format_string(f"%s: %.2f{unit}", F.col(label).cast("string"), F.col(value).cast("double")).alias("value"),
    )
    head = result.sparkSession.createDataFrame(
        [(0, "", title), (0, " ", "=" * len(title))], "part int, key string, value string"
    )
    head.unionByName(lines).orderBy("part", "key").select("value").write.text(path)


def response_json(matches, count, duration):
    """Response of a search as JSON text."""
    return F.to_json(
        F.struct(
            F.lit(True).alias("success"), matches.alias("matches"), count.alias("count"), duration.alias("duration")
        )
    )
