"""Rate limits on a stream of requests, decided by the same code as in batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lineseek.operators.admission import SlidingLog, TokenBucket, refill_us
from lineseek.operators.ordered import MICROS
from lineseek.streaming.ordered import Fold, event_rows, fold_in_order

OUTPUT = "client string, ts_us bigint, id bigint, admitted boolean"


def _limited(decide: Callable[[np.ndarray, tuple | None], tuple[np.ndarray, tuple, int]]) -> Fold:
    """The fold of a limiter: ``decide`` gives the answers of one client, its memory and when this may go."""

    def fold(rows: pd.DataFrame, starts: np.ndarray, memories: list[tuple | None]):
        times = rows["ts_us"].to_numpy("int64")
        admitted = np.zeros(len(rows), dtype=bool)
        after, forget = [], []
        for memory, first, end in zip(memories, starts[:-1], starts[1:], strict=True):
            admitted[first:end], kept, until = decide(times[first:end], memory)
            after.append(kept)
            forget.append(until)
        return pd.DataFrame({"client": rows["key"], "ts_us": times, "id": rows["id"], "admitted": admitted}), after, forget

    return fold


def sliding_log(
    requests: DataFrame, client: str, ts: str, tie: str, limit: int, window_seconds: float, delay: str = "10 minutes"
) -> DataFrame:
    """Stream form of ``operators.admission.sliding_log``. The state of a client
    that has been quiet for a window is dropped."""
    window_us = int(window_seconds * MICROS)

    def decide(times: np.ndarray, memory: tuple | None):
        limiter = SlidingLog(limit, window_us, tuple(memory[0]) if memory else ())
        admitted = limiter.decide(times)
        log = list(limiter.log)
        return admitted, (log,), (log[-1] + window_us if log else 0)

    rows = event_rows(requests, client, ts, tie, delay)
    return fold_in_order(rows, "key", (), {"admitted": pa.list_(pa.int64())}, _limited(decide), OUTPUT)


def token_bucket(
    requests: DataFrame, client: str, ts: str, tie: str, rate: float, burst: float, delay: str = "10 minutes"
) -> DataFrame:
    """Stream form of ``operators.admission.token_bucket``. The state of a client
    whose bucket has filled up again is dropped."""
    full_after = refill_us(rate, burst)

    def decide(times: np.ndarray, memory: tuple | None):
        limiter = TokenBucket(rate, burst, *(memory or ()))
        admitted = limiter.decide(times)
        return admitted, (float(limiter.credit), limiter.last), limiter.last + full_after

    rows = event_rows(requests, client, ts, tie, delay)
    return fold_in_order(rows, "key", (), {"credit": pa.float64(), "last": pa.int64()}, _limited(decide), OUTPUT)
