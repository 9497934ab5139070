"""Near-duplicate embeddings by a pigeonhole join over blocks of rotated coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import Scratch
from lineseek.llm.components import components

BLOCKS = 4
#: Vectors of one side of a comparison that a task holds, about.
SIDE = 1000
#: Squared distances this close to a bound are worked out again term by term.
DOUBT = 1e-9


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation, so that no block holds more of the spread than another."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, threshold: float) -> list[tuple[int, int, float]]:
    """First and last coordinate of each block and its share of the squared distance that the threshold allows."""
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return [(int(a), int(b), 2 * (1 - threshold) * (b - a) / dim + DOUBT) for a, b in zip(edges, edges[1:], strict=False)]


def _usable(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finite vectors other than zero, with their cell along the first coordinate of each block."""
        for batch in batches:
            keep, cells = [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                if not v or None in v:
                    continue
                x = np.array(v, np.float64)
                norm = np.sqrt((x * x).sum())
                if not np.isfinite(norm):
                    x, norm = (x / np.abs(x).max(), 0.0) if np.isfinite(x).all() else (x, np.nan)
                    norm = np.sqrt((x * x).sum()) if norm == 0.0 else norm
                if not np.isfinite(norm) or norm == 0:
                    continue
                y = (x / norm) @ rotation(len(x))
                keep.append(i)
                cells.append([int(np.floor(y[a] / (np.sqrt(bound) + 1e-6))) for a, _, bound in blocks(len(x), threshold)])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int64())) for c in batch.columns), pa.array(cells, pa.list_(pa.int32()))],
                                             ["vec_id", "label", "v", "cells"])

    return run


def _near(x: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    """Which pairs of rows have a squared distance of at most ``bound``; the same answer in whatever task it is asked."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    out = d <= bound
    for i, j in zip(*np.nonzero(np.abs(d - bound) < DOUBT / 10), strict=True):
        out[i, j] = ((x[i] - y[j]) ** 2).sum() <= bound
    return out


def _tile(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Links between two chunks of a cell: each vector's count, and edges that connect what the links connect."""
        block, first, second = (key[k].as_py() for k in (2, 4, 5))
        rows = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        ids, weight, part = (table[c].to_numpy() for c in ("vec_id", "n", "part"))
        left = np.flatnonzero(part == first)
        right = left if first == second else np.flatnonzero(part == second)
        scale = np.abs(rows).max(1, keepdims=True)
        unit = rows / scale
        norms = np.sqrt((unit * unit).sum(1))
        cosine = (unit[left] @ unit[right].T) / norms[left][:, None] / norms[right][None, :]
        linked = cosine >= threshold
        for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):
            linked[i, j] = np.dot(unit[left[i]], unit[right[j]]) / (norms[left[i]] * norms[right[j]]) >= threshold
        turned = (unit / norms[:, None]) @ rotation(rows.shape[1])
        for b, (lo, hi, bound) in enumerate(blocks(rows.shape[1], threshold)[: block + 1]):
            near = _near(turned[left, lo:hi], turned[right, lo:hi], bound)
            linked &= near if b == block else ~near  # a pair counts in the first block that it is near in
        if first == second:
            np.fill_diagonal(linked, False)
        counts = np.zeros(len(ids), np.int64)
        counts[left] += linked @ weight[right]
        if first != second:
            counts[right] += weight[left] @ linked
        root = np.where(counts > 0, ids, np.iinfo(np.int64).max)
        while True:  # smallest id along links
            before = root.copy()
            for i in np.flatnonzero(linked.any(1)):
                own = right[linked[i]]
                low = min(root[left[i]], root[own].min())
                root[left[i]] = low
                root[own] = np.minimum(root[own], low)
            if (root == before).all():
                break
        some = counts > 0
        return pa.table({"vec_id": pa.array(ids[some]), "links": pa.array(counts[some]), "root": pa.array(root[some])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with equal, non-null labels and a cosine of at least ``threshold`` (in
    double precision) are linked; n_links counts the linked vectors, and a
    component bears its smallest id. Null or empty vectors, zero vectors and
    vectors with null or non-finite components link with nothing, nor do vectors
    of different lengths. A null id gets no component and is kept. Rows that
    repeat an id are vectors of their own for the links and share its row's count
    (the largest). An empty table gives no rows. Other columns are ignored.

    A cosine of t allows unit vectors a squared distance of 2 - 2t. Coordinates are
    rotated and split into blocks; a pair within the distance is within the
    block's proportional share in one block at least. Each block is range-joined
    on a grid along its first coordinate, whose cells are as wide as that share
    allows. Equal vectors are folded before. Cells of more than ``SIDE`` vectors
    are cut into chunks that meet chunk by chunk, each pair of chunks in a task of
    its own. Tasks give back counts and a spanning forest, never pairs.
    """
    scratch = Scratch(vectors.sparkSession, "embed")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = rows.where("label is not null and vec_id is not null").mapInArrow(
        _usable(threshold), "vec_id long, label string, v array<double>, cells array<int>")
    usable = scratch.keep("usable", usable.withColumn("same", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)))
    folded = scratch.keep("folded", usable.groupBy("label", "same").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n")))
    classes = usable.join(folded, ["label", "same", "vec_id"]).dropDuplicates(["label", "same"])
    placed = classes.select("vec_id", "label", "n", "v", F.size("v").alias("dim"), F.posexplode("cells").alias("block", "home"))
    placed = placed.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("own")).withColumn(
        "cell", F.col("home") + F.when(F.col("own"), 0).otherwise(1)).drop("home")
    placed = scratch.keep("placed", placed)
    cell = ["label", "dim", "block", "cell"]
    sides = placed.groupBy(cell).agg(F.count(F.when(F.col("own"), 1)).alias("homes"), F.count(F.when(~F.col("own"), 1)).alias("guests"))
    sides = scratch.keep("sides", sides.where("homes > 0 and homes + guests > 1").select(
        *cell, F.ceil(F.col("homes") / SIDE).cast("int").alias("h"), F.ceil(F.col("guests") / SIDE).cast("int").alias("g")))
    tiled = placed.join(sides, cell).withColumn("part", F.expr("cast(pmod(xxhash64(vec_id), if(own, h, g)) + if(own, 0, h) as int)"))
    tiled = tiled.withColumn("tile", F.explode(F.expr("""
        if(own, transform(sequence(0, h + g - 1), j -> struct(least(part, j) as i, greatest(part, j) as j)),
                transform(sequence(0, h - 1), i -> struct(i as i, part as j)))""")))
    found = tiled.select("label", "dim", "block", "cell", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "vec_id", "n", "v", "part")
    found = found.groupBy("label", "dim", "block", "cell", "i", "j").applyInArrow(_tile(threshold), "vec_id long, links long, root long")
    found = scratch.keep("found", found)
    scratch.drop("placed", "sides")
    copies = usable.join(folded.withColumnRenamed("vec_id", "root"), ["label", "same"])
    links = folded.select("vec_id", F.col("n").alias("copies")).join(found.groupBy("vec_id").agg(F.sum("links").alias("links")), "vec_id", "left")
    links = links.select(F.col("vec_id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    links = copies.select("vec_id", "root").join(links, "root").groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    edges = found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(copies.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    labels = components(edges, scratch)
    out = rows.select("vec_id").join(links, "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
