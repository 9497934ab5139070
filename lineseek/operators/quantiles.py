"""Exact quantiles by group, without gathering a group.

1. collapse to (group, value, count) with map-side combine;
2. count per (group, bin), where bins grow with the value's magnitude, so that a
   bin holds values within about 1 % of each other; running counts over the
   (few hundred) bins of a group tell which bin holds which rank;
3. rank values only inside the bins that hold a wanted rank.

No step needs more of a group in one task than one bin of distinct values.
Two definitions are offered and never mixed:
``linear``     between closest ranks, p=0 is the minimum and p=1 the maximum
``exclusive``  rank (n+1)p, extrapolating at the ends; needs two values
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lineseek.plans.joins import join_groups
from lineseek.plans.sizing import fits

BINS_PER_DOUBLING = 64
METHODS = ("linear", "exclusive")
MAX_BROADCAST_GROUPS = 100_000


def value_counts(df: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    return (
        df.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
        .groupBy(*keys, F.col(value_col).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )


def _bin(value: Column) -> Column:
    """Order-preserving bin number of a double."""
    size = F.abs(value)
    # 1200 doublings lie below the smallest positive double, so sizes stay >= 1
    step = F.floor((F.log2(size) + 1200) * BINS_PER_DOUBLING).cast("bigint") + 1
    step = F.when(size == float("inf"), F.lit(1 << 40).cast("bigint")).otherwise(step)
    return F.when(size == 0, F.lit(0).cast("bigint")).when(value < 0, -step).otherwise(step)


def _position(p: float, n: Column, method: str) -> tuple[Column, Column]:
    """(1-based lower rank, fraction towards the next rank)."""
    if method == "linear":
        at = F.lit(p) * (n - 1)
        low = F.least(F.floor(at), n - 1)
        return low + 1, at - low
    at = F.lit(p) * (n + 1)
    low = F.greatest(F.lit(1), F.least(n - 1, F.floor(at)))
    return low, at - low


def quantiles(
    df: DataFrame, keys: list[str], value_col: str, ps: dict[str, float], method: str = "linear"
) -> DataFrame:
    """One row per group: the group columns and one double per entry of ``ps``."""
    wanted = {name: (p, method) for name, p in ps.items()}
    return mixed_quantiles(df, keys, value_col, wanted)


def mixed_quantiles(df: DataFrame, keys: list[str], value_col: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Like ``quantiles`` with a method for each entry, from one set of counts."""
    return from_value_counts(value_counts(df, keys, value_col), keys, wanted, few_groups(df, keys))


def few_groups(df: DataFrame, keys: list[str]) -> bool:
    """Are per-group results small enough to broadcast? Reads the keys only."""
    return not keys or fits(df.select(*keys).distinct(), max_rows=MAX_BROADCAST_GROUPS)


def from_value_counts(
    counts: DataFrame, keys: list[str], ps: dict[str, tuple[float, str]], small: bool
) -> DataFrame:
    """``small``: see ``few_groups``; the wanted bins are then broadcast, and only
    values of those bins are shuffled a second time."""
    for _, method in ps.values():
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
    group = keys or ["__all"]
    if not keys:
        counts = counts.withColumn("__all", F.lit(1))
    binned = counts.withColumn("__bin", _bin(F.col("__v")))
    per_bin = binned.groupBy(*group, "__bin").agg(F.sum("__c").alias("__n"))
    whole = W.partitionBy(*group)
    edges = per_bin.select(
        *group,
        "__bin",
        "__n",
        (F.sum("__n").over(whole.orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__lo"),
        F.sum("__n").over(whole).alias("__total"),
    )
    wanted = []
    for name, (p, method) in ps.items():
        low, fraction = _position(p, F.col("__total"), method)
        for end in (0, 1):
            rank = F.least(low + end, F.col("__total")).cast("bigint")
            wanted.append(
                F.struct(
                    F.lit(name).alias("__name"), F.lit(end).alias("__end"), rank.alias("__rank"),
                    fraction.cast("double").alias("__fraction"),
                )
            )
    targets = (
        edges.withColumn("__t", F.explode(F.array(*wanted)))
        .where((F.col("__t.__rank") > F.col("__lo")) & (F.col("__t.__rank") <= F.col("__lo") + F.col("__n")))
        .select(*group, "__bin", "__lo", "__total", "__t.*")
    )
    needed = targets.groupBy(*group, "__bin").agg(
        F.first("__lo").alias("__lo"), F.first("__total").alias("__total"),
        F.collect_list(F.struct("__name", "__end", "__rank", "__fraction")).alias("__ts"),
    )
    inside = W.partitionBy(*group, "__bin").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        join_groups(binned, needed, [*group, "__bin"], small=small)
        .withColumn("__hi", F.col("__lo") + F.sum("__c").over(inside))
        .withColumn("__t", F.explode("__ts"))
        .where((F.col("__t.__rank") <= F.col("__hi")) & (F.col("__t.__rank") > F.col("__hi") - F.col("__c")))
    )
    picked = ranked.groupBy(*group).agg(
        *[
            F.max(F.when((F.col("__t.__name") == name) & (F.col("__t.__end") == end), F.col("__v"))).alias(f"__{name}_{end}")
            for name in ps
            for end in (0, 1)
        ],
        *[F.max(F.when(F.col("__t.__name") == name, F.col("__t.__fraction"))).alias(f"__{name}_f") for name in ps],
        F.max("__total").alias("__total"),
    )
    out = []
    for name, (_, method) in ps.items():
        low, high, fraction = (F.col(f"__{name}_{x}") for x in (0, 1, "f"))
        value = low + fraction * (high - low)
        if method == "exclusive":
            value = F.when(F.col("__total") >= 2, value)
        out.append(value.alias(name))
    return picked.select(*keys, *out)
