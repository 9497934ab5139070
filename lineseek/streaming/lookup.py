"""Live lookup and corpus growth."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions.text import normalise_query
from lineseek.functions.verdicts import verdict
from lineseek.operators.membership import anti, lookup


def live_lookup(requests: DataFrame, corpus: DataFrame, query_col: str = "query") -> DataFrame:
    """Stream of requests against a corpus table: a stateless left join.

    With a corpus read from files and not cached, every micro-batch reads the
    files as they are then; a written table is a snapshot. The corpus may grow,
    so no broadcast is asked for. ``lookup_batches`` is the form for a corpus
    much larger than a micro-batch.
    """
    lines = corpus.select(F.col("line").alias(query_col)).distinct().withColumn("hit", F.lit(True))
    return (
        requests.withColumn(query_col, normalise_query(F.col(query_col)))
        .join(lines, query_col, "left")
        .withColumn("found", F.coalesce("hit", F.lit(False)))
        .drop("hit")
        .withColumn("verdict", verdict(F.col("found")))
    )


def lookup_batches(requests: DataFrame, corpus_path: str, out_path: str, query_col: str = "query"):
    """Writer that looks each micro-batch up in the corpus as it is at that time,
    filtering the corpus by the batch's queries where it is read."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.catalog.refreshByPath(corpus_path)
        answers = lookup(spark.read.parquet(corpus_path), batch, query_col)
        # the batch number names the folder, so a retried batch replaces itself
        answers.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return requests.writeStream.foreachBatch(one_batch)


def grow_corpus(lines: DataFrame, index_path: str):
    """Writer that adds the new lines of each micro-batch to the corpus table.

    Known lines are left out by looking the batch up in everything that lies under
    ``index_path``, whoever wrote it: a new stream with a new checkpoint goes on
    with the corpus it finds. Folders bear the name of this writer and the batch,
    so nothing of another run is replaced. A batch retried by this writer replaces
    its own folder, which the lookup leaves out; one retried after a restart finds
    the lines it had written as known.
    """
    run = uuid.uuid4().hex

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"run={run}/batch={batch_id}"
        fresh = batch.select("line").distinct()
        known = _corpus(spark, index_path, own)
        if known is not None:
            fresh = anti(fresh, known, "line")
        fresh.write.mode("overwrite").parquet(f"{index_path}/{own}")

    return lines.writeStream.foreachBatch(one_batch)


def _corpus(spark: SparkSession, path: str, own: str) -> DataFrame | None:
    """All lines under the path but those of the own folder; None where there is nothing yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema("line string").option("recursiveFileLookup", "true").parquet(path)
    return rows.where(~F.contains(F.col("_metadata.file_path"), F.lit(f"/{own}/"))).select("line")
