"""Near duplicates by min-max hashing: both ends of every permutation make the signature.

One random permutation of the shingle space gives two signature values, the
least and the greatest image of a document's set. Each agrees between two sets
with probability equal to their Jaccard similarity, and the two are less than
independent in the good direction, so half the hash evaluations give a
signature of the same length and no more variance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.common import Scratch, chunks, lists, mix, numbers, packed, shingles, texts, unpacked, words
from lineseek.llm.components import components

#: 48 bands of 6 values (3 permutations, least and greatest). Two sets at similarity 0.8 share no band with
#: probability (1 - 0.8^6)^48 = 5e-7, less above it.
BANDS, ROWS = 48, 6
#: Members of a bucket that a task compares with as many others.
SIDE = 1000
#: One bit of each signature value. At similarity 0.8 a bit agrees with probability 0.9; fewer than 430 agreeing
#: bits lie 4.5 standard deviations below (once in 200,000 pairs at 0.8, less above). The bands use the first values.
BITS, AGREE = 512, 430
PERMUTATIONS = BITS // 2
FACTOR = (numbers(PERMUTATIONS, 31) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
SHIFT = (numbers(PERMUTATIONS, 37) >> np.uint64(16)).astype(np.uint32)


def signature(codes: np.ndarray) -> np.ndarray:
    """Least and greatest image of the set under each permutation, side by side."""
    x = (codes >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 2048):
        image = FACTOR[:, None] * x[None, i : i + 2048] + SHIFT[:, None]
        np.minimum(low, image.min(axis=1), out=low)
        np.maximum(high, image.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def _digest(size: int):
    factors = numbers(ROWS, 41)
    seeds = numbers(BANDS, 43)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, bands, bits = [], [], [], []
            for first, end, data, offsets in chunks(batch.column(1)):
                hashes, _, _, bounds = words(data, offsets)
                codes, begin = shingles(hashes, bounds, size)
                for i in range(end - first):
                    found = np.unique(codes[begin[i] : begin[i + 1]])
                    counts.append(len(found))
                    if not len(found):
                        keys.append(None)
                        continue
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    values = signature(found)
                    bits.append(np.packbits((values * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)).view(np.int64))
                    bands.append(mix((values[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * factors).sum(axis=1) + seeds).view(np.int64))
            filled = np.concatenate([[0], np.cumsum([k is not None for k in keys])])
            flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                lists(flat(bands), filled * BANDS, pa.int64()), lists(flat(bits), filled * (BITS // 64), pa.int64()),
            ], ["doc_id", "n_shingles", "set_key", "bands", "bits"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, end, data, offsets in chunks(batch.column(1)):
                hashes, _, _, bounds = words(data, offsets)
                codes, begin = shingles(hashes, bounds, size)
                out += [np.unique(codes[begin[i] : begin[i + 1]]).tobytes() for i in range(end - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "members"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tile(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Links between two chunks of a bucket, as many as connect what they connect.

        A pair belongs to the first band it shares. Pairs in one component already,
        by now or through a link found here, need no comparison.
        """
        first, second = key[1].as_py(), key[2].as_py()
        part, node, component, size = (table[c].to_numpy() for c in ("part", "node", "component", "n_set"))
        wide = lambda name: table[name].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        bits, bands = wide("bits").view(np.uint64), wide("bands")
        number = int(np.flatnonzero(bands[0] == key[0].as_py())[0])
        left = np.flatnonzero(part == first)
        right = left if first == second else np.flatnonzero(part == second)
        members = table["members"]
        parent = {c: c for c in np.unique(component).tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out: list[tuple[int, int]] = []
        codes: dict[int, np.ndarray] = {}
        for at in left.tolist():
            other = right[right > at] if first == second else right
            other = other[component[other] != component[at]]
            other = other[100 * np.minimum(size[other], size[at]) >= percent * np.maximum(size[other], size[at])]
            other = other[np.bitwise_count(bits[other] ^ bits[at]).sum(1) <= BITS - AGREE]
            other = other[~(bands[other, :number] == bands[at, :number]).any(1)]
            for to in other.tolist():
                x, y = root(int(component[at])), root(int(component[to]))
                if x == y:
                    continue
                for k in (at, to):
                    if k not in codes:
                        codes[k] = np.frombuffer(members[k].as_buffer(), np.uint64)
                small, large = sorted((codes[at], codes[to]), key=len)
                found = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[found] == small).sum())
                if 100 * both >= percent * (len(small) + len(large) - both):
                    out.append((int(node[at]), int(node[to])))
                    parent[max(x, y)] = min(x, y)
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough.

    The sets are merged with the pairs at every size: a plan that broadcasts short
    lists of pairs would only behave differently once they have grown.
    """
    pairs = scratch.keep(f"{label}-pairs", pairs)
    both = pairs.hint("merge").join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").hint("merge").join(
        sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    links = scratch.keep(f"{label}-links", both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"))
    scratch.drop(f"{label}-pairs")
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct runs of ``size`` lower-cased words (fewer
    words: the whole sequence). Documents whose sets meet 100 * intersection >=
    percent * union are linked, links are closed transitively, and a component
    bears its smallest id. Null or empty text: empty set, linked with nothing.
    Rows that repeat a doc_id are one document. A null doc_id gets no component
    and is kept. Other columns are ignored.

    Equal sets are folded to their smallest id by a pre-aggregated ``groupBy``.
    The rest meets in bands. In each bucket every member is first compared with
    the bucket's smallest id only; members that this leaves in different
    components are then compared with one another, chunk by chunk of the bucket,
    each pair in the first band it shares. Pairs pass an exact bound on the set
    sizes and one on the agreement of 512 signature bits before that. A group of
    true copies thus costs one comparison a member, no bucket is capped, and pairs
    are not written. Every link is confirmed on full sets. ``scratch``: where the
    tables are written that the rows are read from.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minmax", by_bytes=True)
    docs = texts(docs, key, text)
    digest = scratch.keep("digest", docs.mapInArrow(
        _digest(size), "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>"))
    filled = digest.where("set_key is not null and doc_id is not null")
    firsts = filled.groupBy("set_key").agg(F.min("doc_id").alias("first"))
    firsts = scratch.keep("firsts", firsts)
    copies = scratch.keep("copies", filled.join(firsts, "set_key").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    nodes = scratch.keep("nodes", filled.join(firsts.select("set_key", F.col("first").alias("doc_id")), ["set_key", "doc_id"])
                         .dropDuplicates(["set_key"]).select(F.col("doc_id").alias("node"), "n_shingles", "bands", "bits"))
    rows = nodes.select("node", F.explode("bands").alias("band"))
    hubs = scratch.keep("hubs", rows.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = scratch.keep("members", rows.join(hubs, "band").select("band", "node", "hub", "n"))
    traits = nodes.select("node", "n_shingles", "bits", "bands").join(members.select("node").distinct(), "node")
    traits = scratch.keep("traits", traits.select("node", F.col("n_shingles").alias("n_set"), "bits", "bands"))
    scratch.drop("firsts", "nodes")
    alike = " and ".join([
        f"100 * least(s.n_set, t.n_set) >= {percent} * greatest(s.n_set, t.n_set)",
        f"{' + '.join(f'bit_count(s.bits[{i}] ^ t.bits[{i}])' for i in range(BITS // 64))} <= {BITS - AGREE}",
    ])
    star = members.where("node <> hub").select("node", "hub").distinct()
    marks = traits.drop("bands")
    star = star.join(marks.alias("s"), "node").join(marks.withColumnRenamed("node", "hub").alias("t"), "hub").where(alike)
    involved = docs.join(traits.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id")
    sets = scratch.keep("sets", involved.mapInArrow(_sets(size), "doc_id long, members binary"))
    links = _verified(star.select(F.col("node").alias("a"), F.col("hub").alias("b")), sets, percent, scratch, "star")
    labels = scratch.keep("labels", components(links, scratch, "first"))
    # what a bucket's smallest id does not settle: members in different components
    open_rows = members.where("n > 2 and node <> hub").join(labels, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("component"))
    open_rows = scratch.keep("open", open_rows)
    mixed = open_rows.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("chunks"))
    mixed = scratch.keep("mixed", mixed.where("x <> y").select("band", "chunks"))
    rest = open_rows.join(mixed, "band").withColumn("part", F.expr("cast(pmod(xxhash64(node), chunks) as int)"))
    rest = rest.withColumn("with", F.explode(F.expr("sequence(0, chunks - 1)"))).select(
        "band", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "node", "component")
    rest = scratch.keep("rest", rest)
    rest = rest.hint("merge").join(traits, "node").hint("merge").join(sets.withColumnRenamed("doc_id", "node"), "node")
    more = rest.groupBy("band", "i", "j").applyInArrow(_tile(percent), "a long, b long")
    more = scratch.keep("more", more.distinct())
    scratch.drop("hubs", "members", "open", "mixed", "rest", "traits", "sets")
    labels = components(links.unionByName(more).unionByName(copies), scratch, "last")
    out = digest.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one of smallest id.

    Rows with a null id stay; of rows that repeat an id one stays. Null, empty and
    word-free texts are near nothing and stay; very long texts are compared whole.
    All columns stay as they are, whatever their names. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "minmax", by_bytes=True)
    kept = near_duplicates(docs, size, percent, scratch=scratch).where("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    kept = scratch.only("kept", kept)
    rows = packed(docs, F.col("doc_id").cast("long").alias("id"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    named = rows.where("id is not null").join(kept.hint("merge"), "id", "left_semi").withColumn("turn", first).where("turn = 1")
    return unpacked(named.select("row").unionByName(rows.where("id is null").select("row")), docs.columns)
