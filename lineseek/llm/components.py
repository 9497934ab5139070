"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``links`` holds long columns a and b; order, repetition and loops do not
    matter. Each round joins links with the least neighbour of their ends: first
    from larger neighbours, then to smaller ones. Both are aggregated before the
    shuffle and joined from written tables, so a hub's links are split among
    tasks. A chain of n nodes takes about log n rounds.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    step, before = 0, None
    current = scratch.keep(f"{label}-0", pairs)
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(f"{label}-large", both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        larger = scratch.keep(f"{label}-mid", larger)
        scratch.drop(f"{label}-large", f"{label}-{step}")
        least = scratch.keep(f"{label}-small", larger.groupBy("a").agg(F.min("b").alias("m")))
        smaller = larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        smaller = smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        current = scratch.keep(f"{label}-{step}", smaller.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        scratch.drop(f"{label}-mid", f"{label}-small")
