"""Running a stream to the end of its present input."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.plans.session import STATE_STORE, scratch_path


@contextmanager
def rocksdb(spark: SparkSession):
    """Use the RocksDB state store for the streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drain(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Process all input there is now into a Parquet table and read it back.

    Checkpoint and table lie in the cluster's shared folder, so a lost executor
    or driver can pick up where it stopped.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    out = f"{root}/table"
    query = (
        stream.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_writer(writer, label: str, spark: SparkSession) -> None:
    """Run a ``foreachBatch`` writer over all input there is now."""
    query = (
        writer.option("checkpointLocation", f"{scratch_path(spark, label)}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


#: Rows of one file of a replayed part.
ROWS_PER_FILE = 250_000


def replay(table: DataFrame, ts: str, label: str, parts: int = 4, disorder_seconds: int = 3600) -> DataFrame:
    """A table as a stream that comes part by part, each row up to ``disorder_seconds`` out of order.

    A part is one micro-batch: all parts are the same number of files, which are
    empty where rows do not suffice. The last part holds one row far behind all
    others and null but for its time: it lets the watermark pass the rest, so that
    every real row is answered.
    """
    spark = table.sparkSession
    folder = f"{scratch_path(spark, label)}/arrivals"
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high, n_rows = table.agg(F.min(micros), F.max(micros), F.count(F.lit(1))).first()
    n_files = -(-n_rows // (parts * ROWS_PER_FILE)) or 1
    if low is not None:
        width = (high - low) // parts + 1
        moved = micros - low + F.pmod(F.xxhash64(*(c for c, kind in table.dtypes if "map<" not in kind)), F.lit(disorder_seconds * 1_000_000))
        part = F.least(F.floor(moved / width), F.lit(parts - 1))
        for i in range(parts):
            table.where(part == i).repartition(n_files).write.mode("append").parquet(folder)
            written = len(spark.read.schema(table.schema).parquet(folder).inputFiles())
            for _ in range(written, (i + 1) * n_files):
                table.limit(0).coalesce(1).write.mode("append").parquet(folder)
    last = table.agg((F.max(ts) + F.expr("interval 400 days")).alias(ts))
    last = last.select(*(F.col(c) if c == ts else F.lit(None).cast(kind).alias(c) for c, kind in table.dtypes))
    last.write.mode("append").parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", n_files).parquet(folder)
