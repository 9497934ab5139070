"""Hash addresses used for approximate membership and trace sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: number of bits of the membership filter (2 MiB of bits).
FILTER_BITS = 1 << 24


def bit_address(value: Column, bits: int = FILTER_BITS, digest: str = "xxhash64") -> Column:
    """Position of a value in a one-hash bit filter.

    ``xxhash64`` is the fast default; ``md5`` gives addresses that any other
    engine can recompute.
    """
    if digest == "xxhash64":
        return F.pmod(F.xxhash64(value), F.lit(bits))
    if digest == "md5":
        return F.pmod(F.conv(F.substring(F.md5(value), 1, 12), 16, 10).cast("bigint"), F.lit(bits))
    raise ValueError(f"unknown digest: {digest}")


def trace_bound(ratio: float) -> int:
    """Upper bound (exclusive) on the low 64 bits of a sampled trace id."""
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must lie in [0, 1]")
    return round(ratio * (1 << 64))


def trace_sampled(trace_id: Column, ratio: float, parent_sampled: Column | None = None) -> Column:
    """Keep a trace when its id falls below the ratio; children follow the parent.

    The ids are lower-case hex, so the comparison is one on fixed-width text and
    every span of a trace gets the same answer on every executor.
    """
    bound = trace_bound(ratio)
    if bound >= 1 << 64:
        own = F.lit(True)
    else:
        own = F.lower(F.right(F.lpad(trace_id, 32, "0"), F.lit(16))) < F.lit(f"{bound:016x}")
    return own if parent_sampled is None else F.coalesce(parent_sampled, own)


#: Buckets of a saved index; one should fit a task.
BUCKETS = 32


def bucket_of(line: Column | str, buckets: int) -> Column:
    """The bucket that Spark's own bucketing gives a line."""
    return F.pmod(F.hash(line), F.lit(buckets))
