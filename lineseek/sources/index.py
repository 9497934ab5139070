"""The persisted search index: a sorted Parquet table of distinct lines.

One row per distinct line with both search views in it (``is_fold`` marks the
line that stands for its lower-cased form). Range-partitioned and sorted by
line, so a lookup reads only the row groups whose min/max can hold it; the
Parquet bloom filter rejects most absent lines without reading any data.

``save`` lays the same table out by the hash of the line instead: a folder and a
bucket for each hash value, sorted by line. Batches of look-ups then read only the
folders of their own lines (dynamic partition pruning), and joins on the line
need no shuffle of the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions.hashing import BUCKETS, bucket_of
from lineseek.operators.corpus import exact_view, with_fold

COLUMNS = ("line", "line_lower", "n_occurrences", "first_pos", "last_pos", "last_line_no", "is_fold", "fold_first_pos")
#: A saved index holds every line twice and is read often, so it is packed well.
CODEC = "zstd"


def build(lines: DataFrame) -> DataFrame:
    return with_fold(exact_view(lines)).select(*COLUMNS)


def write(lines: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    table = build(lines)
    ranged = table.repartitionByRange(partitions, "line") if partitions else table.repartitionByRange("line")
    (
        ranged.sortWithinPartitions("line")
        .write.mode(mode)
        .option("parquet.bloom.filter.enabled#line", "true")
        .parquet(path)
    )


def save(lines: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The index as table ``name`` at ``path``, with the column ``part`` (the bucket of the line) as folders."""
    # the lower-cased form is made again where it is written, not shuffled beside the line
    table = build(lines).drop("line_lower").repartition(buckets, "line")
    table = table.withColumn("line_lower", F.lower("line")).select(*COLUMNS, bucket_of("line", buckets).alias("part"))
    (
        table.write.partitionBy("part")
        .bucketBy(buckets, "line")
        .sortBy("line")
        .option("path", path)
        .option("compression", CODEC)
        .option("parquet.bloom.filter.enabled#line", "true")
        .saveAsTable(name)
    )
    return lines.sparkSession.table(name)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exact(index: DataFrame) -> DataFrame:
    """Exact view: no aggregation needed, the index holds it."""
    return index.select("line", "line_lower", "n_occurrences", "first_pos", "last_pos", "last_line_no")


def folded(index: DataFrame) -> DataFrame:
    """Folded view, ordered by the first sighting of any of its spellings."""
    return index.where("is_fold").select("line", "line_lower", F.col("fold_first_pos").alias("first_pos"))


def snapshot(spark: SparkSession, lines: DataFrame, path: str) -> DataFrame:
    """Write an index once and use that state from then on."""
    write(lines, path)
    return read(spark, path)
