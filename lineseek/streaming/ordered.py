"""Per-key folds over a stream in event-time order.

Rows of one micro-batch come in any order, and a row may still be overtaken by an
earlier one until the watermark has passed it. Rows therefore wait in state until
then, and are handed to the fold sorted by (time, id). Stream and batch agree on
all rows that are not later than the watermark.

State is kept by bucket of keys, not by key: Python is called once a bucket and
micro-batch, and many quiet keys cost no more than a few busy ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Buckets of keys. A bucket's rows of one micro-batch, and those that wait, are one task's work.
BUCKETS = 1024

# fold(rows sorted by key, ts_us and id; where each key starts, and the end; memory of each key or None)
#   -> (output rows, new memory of each key,
#       event time in microseconds after which the memory of a key says nothing; None = never)
Fold = Callable[
    [pd.DataFrame, np.ndarray, list[tuple | None]], tuple[pd.DataFrame, list[tuple], list[int | None]]
]


def _packed(columns: dict) -> bytes:
    """Columns as an Arrow stream."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(packed))).read_all()


def _memories(packed: bytes | None) -> dict[str | None, tuple[tuple, int | None]]:
    if packed is None:
        return {}
    keys, forget, *memory = (c.to_pylist() for c in _unpacked(packed).columns)
    return {k: (tuple(m), f) for k, f, *m in zip(keys, forget, *memory, strict=True)}


def fold_in_order(
    rows: DataFrame, key: str, columns: tuple[str, ...], memory: dict[str, pa.DataType], fold: Fold, output: str,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``rows`` has a watermark on ``ts`` and the columns ``key, ts_us, id`` plus
    ``columns``, numbers without nulls (a null of a double comes as NaN). State of a
    bucket: the waiting rows of its keys, and the memory of each key with the time it
    may be dropped, each as one Arrow stream. A null key is a key like any other; rows
    without a time are never passed by the watermark and are left out."""
    names = ["key", "ts_us", "id", "known", *columns]
    kinds = {"forget": pa.int64(), **memory}

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [] if state.hasTimedOut else [f[names] for f in frames]
        held: dict[str | None, tuple[tuple, int | None]] = {}
        if state.exists:
            packed, kept = state.get
            held = _memories(kept)
            if packed is not None:
                parts.append(_unpacked(packed).to_pandas())
        passed = state.getCurrentWatermarkMs() * 1000
        left = None
        if parts:
            waiting = pd.concat(parts, ignore_index=True)
            is_ready = (waiting["ts_us"] < passed).to_numpy()
            ready, left = waiting[is_ready], waiting[~is_ready]
            if len(ready):
                codes, found = pd.factorize(ready["key"], use_na_sentinel=False)
                order = np.lexsort((ready["id"].to_numpy(), ~ready["known"].to_numpy(bool), ready["ts_us"].to_numpy(), codes))
                ready = ready.iloc[order].reset_index(drop=True)
                # an unknown id stays unknown
                ready["id"] = pd.arrays.IntegerArray(ready["id"].to_numpy("int64"), ~ready["known"].to_numpy(bool))
                starts = np.searchsorted(codes[order], np.arange(len(found) + 1))
                keys = [None if pd.isna(k) else k for k in found]
                out, after, forget = fold(ready, starts, [held[k][0] if k in held else None for k in keys])
                held.update(zip(keys, zip(after, forget, strict=True), strict=True))
                if len(out):
                    yield out
        held = {k: m for k, m in held.items() if m[1] is None or m[1] >= passed}
        if (left is None or left.empty) and not held:
            state.remove()
            return
        packed = kept = None
        wake = [f for _, f in held.values() if f is not None]
        if left is not None and len(left):
            wake.append(int(left["ts_us"].min()))
            packed = _packed({n: pa.array(left[n], from_pandas=True) for n in names})
        if held:
            parts_of = zip(*((f, *m) for m, f in held.values()), strict=True)
            kept = _packed({
                "key": pa.array(list(held), pa.string()),
                **{n: pa.array(v, kinds[n]) for n, v in zip(kinds, parts_of, strict=True)},
            })
        state.update((packed, kept))
        if wake:
            state.setTimeoutTimestamp(max(min(wake), passed) // 1000 + 1)

    known = F.col("id").isNotNull()
    bucketed = rows.where(F.col("ts_us").isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).alias("key"), "ts", "ts_us",
        F.coalesce("id", F.lit(0).cast("bigint")).alias("id"), known.alias("known"), *columns,
    )
    return bucketed.groupBy("bucket").applyInPandasWithState(
        run, output, "waiting binary, memory binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def event_rows(df: DataFrame, key: str, ts: str, tie: str, delay: str, *extra: str | Column) -> DataFrame:
    """Key, event time, its microseconds and the tie breaker, under a watermark."""
    return (
        df.select(
            F.col(key).cast("string").alias("key"),
            F.col(ts).cast("timestamp").alias("ts"),
            F.col(tie).cast("bigint").alias("id"),
            *extra,
        )
        .withWatermark("ts", delay)
        .withColumn("ts_us", F.unix_micros("ts"))
    )
