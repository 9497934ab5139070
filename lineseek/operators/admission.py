"""Per-client admission: sliding log and token bucket.

Both decide in order, because what was admitted before decides what is admitted
next; a window count cannot express that. The work is still spread out:

* a client's history is cut wherever a pause leaves no memory (longer than the
  window, or long enough to refill the bucket), so each stretch is decided on
  its own;
* only (client, stretch, time, id) reach Python, in Arrow batches of a sorted
  partition, with O(limit) state carried from batch to batch. No group is
  collected, and stretches of refused requests are skipped by binary search.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lineseek.operators.ordered import MICROS

# Default limits.
REQUESTS_PER_WINDOW = 1000
WINDOW_SECONDS = 60
NO_CLIENT = "\0"


class SlidingLog:
    """Admission times still inside the window. Refused requests leave no trace;
    a request exactly ``window_us`` old still counts."""

    def __init__(self, limit: int, window_us: int, admitted: tuple = ()) -> None:
        self.limit, self.window = limit, window_us
        self.log = deque(admitted, maxlen=max(limit, 1))

    def decide(self, times: np.ndarray) -> np.ndarray:
        out = np.zeros(len(times), dtype=bool)
        if self.limit <= 0:
            return out
        i = 0
        while i < len(times):
            if len(self.log) == self.limit and self.log[0] >= times[i] - self.window:
                # full: nothing is admitted until the oldest entry has expired
                i += max(1, int(np.searchsorted(times[i:], self.log[0] + self.window, side="right")))
                continue
            self.log.append(int(times[i]))
            out[i] = True
            i += 1
        return out


class TokenBucket:
    """``burst`` tokens at first, ``rate`` more each second. Counted in
    micro-tokens, so whole rates are exact."""

    def __init__(self, rate: float, burst: float, credit: float | None = None, last: int | None = None) -> None:
        self.rate, self.full = rate, burst * MICROS
        self.credit, self.last = (self.full if credit is None else credit), last

    def decide(self, times: np.ndarray) -> np.ndarray:
        out = np.zeros(len(times), dtype=bool)
        for i, now in enumerate(times.tolist()):
            if self.last is not None:
                self.credit = min(self.full, self.credit + (now - self.last) * self.rate)
            self.last = now
            if self.credit >= MICROS:
                self.credit -= MICROS
                out[i] = True
        return out


def _stretches(df: DataFrame, client: str, pause_us: int) -> DataFrame:
    """Number the stretches of each client that pauses of more than ``pause_us``
    separate.

    Such a pause always ends at the first request of a time bucket of that
    length, so comparing neighbouring buckets (their first and last time) finds
    every pause without ordering the requests themselves.
    """
    bucketed = df.withColumn("__b", F.floor(F.col("__t") / pause_us).cast("bigint"))
    spans = bucketed.groupBy(client, "__b").agg(F.min("__t").alias("lo"), F.max("__t").alias("hi"))
    w = W.partitionBy(client).orderBy("__b")
    starts = F.when(F.col("lo") - F.lag("hi").over(w) > pause_us, 1).otherwise(0)
    numbered = spans.withColumn("starts", starts).select(client, "__b", F.sum("starts").over(w).alias("__stretch"))
    return bucketed.join(numbered, [client, "__b"]).drop("__b")


def _fold(
    df: DataFrame, client: str, ts_us: str, tie: str, pause_us: int, new_state: Callable[[], SlidingLog | TokenBucket]
) -> DataFrame:
    """(client, ts_us, tie, admitted)."""
    # clients travel as text: any type, and requests without a client are one client
    name = F.coalesce(F.col(client).cast("string"), F.lit(NO_CLIENT))
    narrow = df.select(name.alias("__k"), F.col(ts_us).alias("__t"), F.col(tie).alias("__id"))
    ordered = (
        _stretches(narrow, "__k", pause_us)
        .repartition("__k", "__stretch")
        .sortWithinPartitions("__k", "__stretch", "__t", "__id")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            clients, stretches, times = batch["__k"].to_numpy(), batch["__stretch"].to_numpy(), batch["__t"].to_numpy()
            changed = (clients[1:] != clients[:-1]) | (stretches[1:] != stretches[:-1])
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
            admitted = np.zeros(len(batch), dtype=bool)
            for a, b in zip(cuts[:-1], cuts[1:]):
                here = (clients[a], stretches[a])
                if key != here:
                    key, state = here, new_state()
                admitted[a:b] = state.decide(times[a:b])
            yield pd.DataFrame({"__k": batch["__k"], "__t": times, "__id": batch["__id"], "admitted": admitted})

    kind = {f.name: f.dataType for f in df.schema.fields}
    decided = ordered.mapInPandas(run, f"__k string, __t bigint, __id {kind[tie].simpleString()}, admitted boolean")
    return decided.select(
        F.when(F.col("__k") != NO_CLIENT, F.col("__k")).cast(kind[client]).alias(client),
        F.col("__t").alias(ts_us), F.col("__id").alias(tie), "admitted",
    )


def sliding_log(
    df: DataFrame,
    client: str = "client_ip",
    ts_us: str = "ts_us",
    tie: str = "id",
    limit: int = REQUESTS_PER_WINDOW,
    window_seconds: float = WINDOW_SECONDS,
) -> DataFrame:
    """(client, ts_us, tie, admitted): at most ``limit`` admitted per window.

    ``(ts_us, tie)`` orders the requests of a client; join the answer back on
    these columns when more of the request is needed.
    """
    window_us = int(window_seconds * MICROS)
    return _fold(df, client, ts_us, tie, window_us, lambda: SlidingLog(limit, window_us))


def token_bucket(
    df: DataFrame,
    client: str = "client_ip",
    ts_us: str = "ts_us",
    tie: str = "id",
    rate: float = 10,
    burst: float = 20,
) -> DataFrame:
    """(client, ts_us, tie, admitted): admit while a whole token is left."""
    return _fold(df, client, ts_us, tie, refill_us(rate, burst), lambda: TokenBucket(rate, burst))


def refill_us(rate: float, burst: float) -> int:
    """Time after which any bucket is full again."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    return max(1, int(np.ceil(burst * MICROS / rate)))


def with_verdicts(requests: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with their admission; refused ones carry the error code."""
    return requests.join(decisions, keys).withColumn(
        "error_code", F.when(~F.col("admitted"), F.lit("RATE_LIMIT_EXCEEDED"))
    )
