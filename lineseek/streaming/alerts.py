"""Alert streams: dedup, resolution, delivery to several sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.streaming.ordered import event_rows, fold_in_order

Sink = Callable[[DataFrame, int], None]


def dedup(alerts: DataFrame, ts: str = "ts", period: str = "5 minutes", delay: str = "10 minutes", tie: str | None = None) -> DataFrame:
    """First of equal (level, source, message) alerts in each cool-down period of event time.

    The stream form of ``operators.alerts.dedup``: periods are fixed stretches of
    time, so the answer does not depend on how rows come in batches, as long as no
    row is later than ``delay``. A period's alert comes out when the watermark has
    passed its end, and its state goes then.
    """
    order = F.struct(ts, *([tie] if tie else []))
    first = F.min_by(F.struct(*alerts.columns), order)
    return (
        alerts.withWatermark(ts, delay)
        .groupBy(F.window(ts, period), "level", "source", "message")
        .agg(first.alias("a"), F.count(F.lit(1)).alias("n"))
        .select("a.*", (F.col("n") - 1).alias("n_suppressed"))
    )


def deliver(alerts: DataFrame, sinks: Mapping[str, Sink], failures_path: str):
    """Writer that gives every micro-batch to each sink.

    A failing sink is recorded under ``failures_path`` with its problem and the
    number of alerts it missed, and does not keep the others from getting the batch. Sinks get the batch number to be idempotent.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        failures, n = [], batch.count()
        for name, sink in sinks.items():
            try:
                sink(batch, batch_id)
            except Exception as problem:  # any sink error is data here
                failures.append((batch_id, name, str(problem), n))
        batch.unpersist()
        if failures:
            spark.createDataFrame(failures, "batch bigint, sink string, problem string, n_alerts bigint").write.mode(
                "overwrite"
            ).parquet(f"{failures_path}/failed={batch_id}")

    return alerts.writeStream.foreachBatch(one_batch)


def file_sink(path: str, kind: str = "parquet") -> Sink:
    """Sink writing each batch to its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("details", F.to_json("details")) if kind == "csv" else batch
        out.write.mode("overwrite").format(kind).save(f"{path}/batch={batch_id}")

    return write


def transitions(states: DataFrame, series: str = "series", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Stream form of ``operators.alerts.transitions`` over (series, ts, id, value,
    firing). A series is one source of one server, so state is spread by both; it
    is one boolean per series."""

    def fold(rows: pd.DataFrame, starts: np.ndarray, memories: list[tuple | None]):
        owner = np.repeat(np.arange(len(memories)), np.diff(starts))
        told = np.flatnonzero(rows["state"].to_numpy() >= 0)  # an unknown state changes nothing
        owner, firing = owner[told], rows["state"].to_numpy()[told] == 1
        first = np.searchsorted(owner, np.arange(len(memories) + 1))
        last = np.array([bool(memory[0]) if memory else False for memory in memories], dtype=bool)
        before = np.roll(firing, 1)
        some = first[:-1] < first[1:]
        before[first[:-1][some]] = last[some]
        last[some] = firing[first[1:][some] - 1]
        changed = firing != before
        out = rows.iloc[told[changed]]
        out = pd.DataFrame(
            {
                "series": out["key"], "ts_us": out["ts_us"], "id": out["id"], "value": out["value"],
                "change": np.where(firing[changed], "raised", "resolved"),
            }
        )
        return out, [(bool(state),) for state in last], [None] * len(memories)

    state = F.coalesce(F.col("firing").cast("tinyint"), F.lit(-1).cast("tinyint")).alias("state")
    rows = event_rows(states, series, ts, "id", delay, "value", state)
    return fold_in_order(
        rows, "key", ("value", "state"), {"firing": pa.bool_()}, fold,
        "series string, ts_us bigint, id bigint, value double, change string",
    )
