"""Repeated passages across documents by compact windows of min-hashes.

A text is its sequence of five-word runs. Under one hash function, the Cartesian
tree over the hashes groups all subsequences by their minimum: a node at c that
spans [l, r] stands for every subsequence in [l, r] that contains c. The nodes
that span a passage of the least length at all are exactly the minima of the
windows of that length, so sliding minima list them. A window carries its
minimum as signature; passages of similarity s share one under each function
with probability s. Windows of all functions that tie two texts at one distance
are joined to one interval, and these intervals are compared run by run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lineseek.llm.common import Scratch, chunks, mix, numbers, packed, shingles, texts, unpacked, words
from lineseek.plans.sizing import fits

RUN, LEAST = 5, 50
FUNCTIONS = 5
#: Text bytes whose signatures are sorted together before the shuffle.
STRETCH_TEXT = 8 << 20
#: Words of a text whose asked ranges are cut out together.
SECTION = 4096
SEEDS = numbers(FUNCTIONS, 71)
PAIR = numbers(2, 73)
FACTORS = numbers(RUN, 23)
ROWS = "key long, doc long, pos int, other long, other_pos int, span int"


def minima(values: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` values inside one text: its start and the place of its minimum (leftmost)."""
    n = len(values)
    sizes = np.maximum(np.diff(begin) - width + 1, 0)
    starts = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin[:-1], sizes)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:]) if len(low) > reach else low[:0]
        reach *= 2
    low = np.minimum(low[starts], low[starts + width - reach]) if len(starts) else low[:0]
    return starts, (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def signatures(codes: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of the texts under each function: signature, text, and place (in the text) of the minimum."""
    keys, owners, anchors = [], [], []
    for number, seed in enumerate(SEEDS):
        values = mix(codes ^ seed)
        starts, at = minima(values, begin, width)
        text = np.searchsorted(begin, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        keys.append(mix(values[at[new]] + np.uint64(number)))
        owners.append(text[new])
        anchors.append(at[new] - begin[text[new]])
    keys, owners, anchors = np.concatenate(keys), np.concatenate(owners), np.concatenate(anchors)
    some = ends_of_runs(keys, owners, anchors, width)
    return keys[some], owners[some], anchors[some]


def ends_of_runs(keys: np.ndarray, owners: np.ndarray, anchors: np.ndarray, width: int) -> np.ndarray:
    """True for windows that the texts are compared by: the first and last two of a run of one signature.

    Where a text repeats itself at a distance of at most ``width``, the same window
    comes again and again; what lies around it changes at the ends of the run only.
    """
    order = np.argsort(mix(keys + owners.astype(np.uint64) * PAIR[0]), kind="stable")
    key, text, at = keys[order], owners[order], anchors[order]
    linked = (key[1:] == key[:-1]) & (text[1:] == text[:-1]) & (at[1:] - at[:-1] <= width)
    some = np.ones(len(keys), bool)
    inner = linked[1:-2] & linked[2:-1]
    some[order[2:-2][inner & linked[:-3] & linked[3:]]] = False
    return some


def _table(key, doc, pos, other, other_pos, span) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(key.view(np.int64)), pa.array(doc), pa.array(pos.astype(np.int32)), other, other_pos, span,
    ], ["key", "doc", "pos", "other", "other_pos", "span"])


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures of a stretch of a batch, one row each for its first window; the others are tied to that one here."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts, size = [], 0
            for first, end, data, offsets in chunks(batch.column(1)):
                hashes, _, _, bounds = words(data, offsets)
                key, text, pos = signatures(*shingles(hashes, bounds, RUN, whole=False), least - RUN + 1)
                parts.append((key, ids[first + text], pos))
                size += len(data)
                if size >= STRETCH_TEXT or end == batch.num_rows:
                    yield from _tied(parts)
                    parts, size = [], 0

    return run


def _tied(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    key, doc, pos = (np.concatenate(p) for p in zip(*parts, strict=True))
    if not len(key):
        return
    turn = np.lexsort((pos, doc, key))
    key, doc, pos = key[turn], doc[turn], pos[turn]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    hub = np.flatnonzero(head)[np.cumsum(head) - 1]
    tied = np.flatnonzero((doc != doc[hub]) | (pos != pos[hub]))
    none = pa.nulls(int(head.sum()), pa.int64()), pa.nulls(int(head.sum()), pa.int32()), pa.nulls(int(head.sum()), pa.int32())
    yield _table(key[head], doc[head], pos[head], *none)
    if len(tied):
        a, b, x, y = doc[tied], doc[hub[tied]], pos[tied], pos[hub[tied]]
        turn = np.lexsort((x, x - y, b, a))
        a, b, x, y = a[turn], b[turn], x[turn], y[turn]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | ((x - y)[1:] != (x - y)[:-1])])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(a)) - 1
        yield _table(mix(a[at].astype(np.uint64) * PAIR[0] + x[at].astype(np.uint64)), a[at], x[at],
                     pa.array(b[at]), pa.array(y[at].astype(np.int32)), pa.array((x[end] - x[at]).astype(np.int32)))


def _ties(rows: DataFrame) -> DataFrame:
    """a, b, shift, first, last, ranges: places of a that share a key with the place ``shift`` before in the earlier text b.

    b may be a itself: a text's later places take part in the regrouping. ``ranges``
    are the (first, last) of the rows, where a row has a span.
    """
    w = Window.partitionBy("key").orderBy("doc", "pos")
    tied = rows.select("*", F.first("doc").over(w).alias("hub"), F.first("pos").over(w).alias("hub_pos"))
    tied = tied.where("other is not null or doc <> hub or pos <> hub_pos").select(
        F.col("doc").alias("a"), F.coalesce("other", "hub").alias("b"), (F.col("pos") - F.coalesce("other_pos", "hub_pos")).alias("shift"),
        "pos", (F.col("pos") + F.coalesce("span", F.lit(0))).alias("end"), F.when(F.col("other").isNull() & F.col("span").isNotNull(), F.lit(True)).alias("ranged"))
    ranges = F.collect_set(F.when(F.col("ranged"), F.struct("pos", "end")))
    return tied.groupBy("a", "b", "shift").agg(F.min("pos").alias("first"), F.max("end").alias("last"), ranges.alias("ranges"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the ranges that are asked of each text."""
    for batch in batches:
        docs, first, last, base, out, ends, size = [], [], [], [], [], [], 0
        for doc, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            hashes = words(data, np.array([0, len(data)]))[0]
            for r in ranges:
                docs.append(doc)
                first.append(r["from"])
                last.append(r["to"])
                base.append(max(r["from"], 0))
                out.append(hashes[base[-1] : max(r["to"], 0)].tobytes())
                ends.append((r["is_a"], r["is_b"]))
                size += len(out[-1])
            if size >= STRETCH_TEXT:
                yield _cut_batch(docs, first, last, base, out, ends)
                docs, first, last, base, out, ends, size = [], [], [], [], [], [], 0
        yield _cut_batch(docs, first, last, base, out, ends)


def _cut_batch(docs: list, first: list, last: list, base: list, out: list, ends: list[tuple[bool, bool]]) -> pa.RecordBatch:
    columns = [pa.array(docs, pa.int64()), *(pa.array(c, pa.int32()) for c in (first, last, base)), pa.array(out, pa.binary())]
    columns += [pa.array([e[i] for e in ends], pa.bool_()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["doc", "from", "to", "base", "codes", "is_a", "is_b"])


def _spans(x: np.ndarray, y: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Stretches of runs x that recur in y: first and last run in x, in y, and similarity of the two stretches."""
    if len(x) < width or len(y) < width:
        return []
    order = np.argsort(y, kind="stable")
    at = np.minimum(np.searchsorted(y[order], x), len(y) - 1)
    match = y[order][at] == x
    # of two equal-sized sets of runs at this similarity, as many are shared at least
    need = int(np.ceil(2 * width * percent / (100 + percent) - 1e-9))
    total = np.concatenate([[0], np.cumsum(match)])
    good = np.flatnonzero(total[width:] - total[:-width] >= need)
    out = []
    for part in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
        inside = np.flatnonzero(match[part[0] : part[-1] + width]) + part[0]
        lo, hi = int(inside[0]), int(inside[-1])
        places = order[at[inside]]
        ylo, yhi = int(places.min()), int(places.max())
        s, t = np.unique(x[lo : hi + 1]), np.unique(y[ylo : yhi + 1])
        both = len(np.intersect1d(s, t, assume_unique=True))
        union = len(s) + len(t) - both
        if 100 * both >= percent * union:
            out.append((lo, hi, ylo, yhi, both / union))
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Codes of the runs of one stretch of words, to be compared with those of another one only."""
    n = max(len(x) - RUN + 1, 0)
    total = x[:n] * FACTORS[0]
    for j in range(1, RUN):
        total += x[j : j + n] * FACTORS[j]
    return total


def _equal(x: np.ndarray, y: np.ndarray, offset: int) -> list[tuple[int, int]]:
    """Stretches of at least ``RUN`` words of x that stand ``offset`` further on in y."""
    lo, hi = max(0, -offset), min(len(x), len(y) - offset)
    if hi - lo < RUN:
        return []
    same = np.concatenate([[False], x[lo:hi] == y[lo + offset : hi + offset], [False]])
    turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2) + lo
    return [(a, b) for a, b in turns.tolist() if b - a >= RUN]


def _wider(x: np.ndarray, equal: list[tuple[int, int]], first: int, last: int, ranges: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Ranges of x, each widened by the words up to the first one (inclusive) beyond the ``equal`` stretch it is in, to the right and to the left.

    Without ranges, they are the first and the last run of each equal stretch that
    touches the places from ``first`` to ``last``. Ranges beyond ``least`` words are left out.
    """
    stretches = [(s, e) for s, e in equal if s <= last and e > first]
    if ranges:
        pairs = [(r, r, s, e) for r in ranges for s, e in stretches if s <= r[0] and r[1] <= e]
    else:
        pairs = [((e - RUN, e), (s, s + RUN), s, e) for s, e in stretches]
    out = {(lo, e + 1) for (lo, _), _, _, e in pairs if e < len(x)} | {(s - 1, hi) for _, (_, hi), s, _ in pairs if s > 0}
    out = {w for r in out if r[1] - r[0] <= least for w in _beyond_run(x, *r, least)}
    return sorted(r for r in out if r[1] - r[0] <= least)


def _beyond_run(x: np.ndarray, lo: int, hi: int, least: int) -> list[tuple[int, int]]:
    """The range itself or, where its words only repeat one another, ranges over the ends of this run.

    A passage around such a range holds an end of the run, or ``least`` words of the
    run alone, so the range need not grow through the run word by word.
    """
    for period in range(1, RUN // 2 + 2):
        if 2 * period <= hi - lo and (x[lo + period : hi] == x[lo : hi - period]).all():
            same = x[period:] == x[:-period]
            before, after = np.flatnonzero(~same[:lo]), np.flatnonzero(~same[lo:])
            begin = int(before[-1]) + 1 if len(before) else 0
            end = (int(after[0]) + lo if len(after) else len(same)) + period
            out = [(begin + k, begin + k + least) for k in range(period) if begin + k + least <= end]
            out += [(begin - 1, begin + RUN)] if begin > 0 else []
            return out + ([(end - RUN, end + 1)] if end < len(x) else [])
    return [(lo, hi)]


def _compare(least: int, percent: int):
    width, factors = least - RUN + 1, numbers(least, 79)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated passages, and (kind 1) ranges that leave the earlier text, by which texts are regrouped."""
        for batch in batches:
            out: list[tuple] = []
            sums: list[int] = []
            rows = batch.select(["a", "b", "shift", "first", "last", "ranges", "x_base", "y_base"]).to_pylist()
            for r, x, y in zip(rows, batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                # along the tie itself, where repeats inside a text or partial copies around it blur the stretches
                offset = r["x_base"] - r["shift"] - r["y_base"]
                equal = _equal(x, y, offset)
                if r["a"] != r["b"]:
                    found = _spans(_runs(x), _runs(y), width, percent)
                    found += [(lo, hi - RUN, lo + offset, hi + offset - RUN, 1.0) for lo, hi in equal
                              if hi - lo >= least and not any(f[0] <= lo and hi - RUN <= f[1] for f in found)]
                    for lo, hi, ylo, yhi, same in found:
                        out.append((0, r["a"], lo + r["x_base"], hi + RUN + r["x_base"], r["b"], ylo + r["y_base"], yhi + RUN + r["y_base"], same))
                        sums.append(0)
                base = r["x_base"]
                ranges = [(v["pos"] - base, v["end"] - base) for v in r["ranges"]]
                for lo, hi in _wider(x, equal, r["first"] - base, r["last"] - base, ranges, least):
                    out.append((1, r["a"], lo + base, hi + base, None, None, None, None))
                    sums.append((int(x[lo:hi] @ factors[: hi - lo]) + hi - lo) % (1 << 64))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
            names = ["kind", "doc_id", "start_word", "end_word", "source_id", "source_start", "source_end", "similarity", "key"]
            columns = list(zip(*out, strict=True)) or [()] * (len(kinds) - 1)
            columns.append(mix(np.array(sums, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


FOUND = "kind int, doc_id long, start_word int, end_word int, source_id long, source_start int, source_end int, similarity double, key long"


def repeated(docs: DataFrame, least: int = LEAST, percent: int = 80, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Passages that repeat across documents, each with an earlier document that holds it.

    Columns: doc_id, start_word, end_word (exclusive), source_id, source_start,
    source_end, similarity. source_id < doc_id. Passages have ``least`` words or
    more, and their sets of five-word runs (A-Z lower-cased) a similarity of
    ``percent`` of 100 or more. Every document that repeats a passage of an earlier
    one has a row, the first one holding it only as a source; long passages may be
    reported in overlapping rows. Null, empty and shorter texts have no passages.
    Rows that repeat a doc_id are one document and are not compared with one
    another, nor is a text with itself; null ids are left out. An empty table gives
    no rows. Other columns are ignored.

    A signature's windows are tied to its first one, in each batch before the
    shuffle and among the batches' first ones after it, so a passage shared by all
    documents costs one tie a document. Where a text leaves the one it is tied to,
    the words from the common stretch to the first differing one make a new group,
    which that other text is not in; its members are tied to its first one again,
    and so on until no group is left. A group shares at least one word more than
    the one it comes from, so after at most ``least`` rounds it shares a passage.
    Equal passages are found always; near ones at similarity 0.8 share a signature in
    0.9997 of cases for each stretch of ``least`` words they have. ``scratch``: where
    the tables are written that the rows are read from.
    """
    scratch = scratch or Scratch(docs.sparkSession, "passages", by_bytes=True)
    docs = texts(docs, key, text).where("doc_id is not null")
    edge = least + RUN

    def check(ties: DataFrame, name: str) -> DataFrame:
        ends = {"a": F.lit(0), "b": F.col("shift")}
        ties = ties.select("*", *((F.col(at) - shift + side * edge).cast("int").alias(f"{end}_{name_of}")
                                  for end, shift in ends.items() for at, side, name_of in (("first", -1, "from"), ("last", 1, "to"))))
        asked = reduce(DataFrame.unionByName, (ties.select(
            F.col(e).alias("doc"), F.col(f"{e}_from").alias("from"), F.col(f"{e}_to").alias("to"), *(F.lit(e == end).alias(f"is_{end}") for end in ends)) for e in ends))
        # each range once, however many texts are tied to it, and the ranges of a section of a text beside one copy of it
        asked = scratch.keep(f"{name}-asked", asked.groupBy("doc", "from", "to").agg(*(F.max(f"is_{e}").alias(f"is_{e}") for e in ends)))
        # later rounds ask few texts: the others are left out before texts are shuffled
        own = asked.select(F.col("doc").alias("doc_id")).distinct()
        some = docs.join(F.broadcast(own), "doc_id", "left_semi") if fits(own) else docs
        asked = asked.groupBy("doc", F.floor(F.col("from") / SECTION).alias("section")).agg(F.collect_list(F.struct("from", "to", *(f"is_{e}" for e in ends))).alias("ranges"))
        cut = asked.hint("merge").join(some.withColumnRenamed("doc_id", "doc"), "doc").select("doc", "text", "ranges")
        cut = scratch.keep(f"{name}-cuts", cut.mapInArrow(_slices, "doc long, from int, to int, base int, codes binary, is_a boolean, is_b boolean"))
        for end, value in (("a", "x"), ("b", "y")):
            # of the cut ranges, only those of this end are shuffled
            own = cut.where(f"is_{end}").select(F.col("doc").alias(end), F.col("from").alias(f"{end}_from"), F.col("to").alias(f"{end}_to"), F.col("base").alias(f"{value}_base"), F.col("codes").alias(value))
            ties = ties.hint("merge").join(own, [end, f"{end}_from", f"{end}_to"])
        found = scratch.keep(f"{name}-found", ties.mapInArrow(_compare(least, percent), FOUND))
        scratch.drop(f"{name}-asked", f"{name}-cuts")
        return found

    ties = scratch.keep("0-ties", _ties(docs.mapInArrow(_windows(least), ROWS)))
    found = []
    while not ties.isEmpty():
        step = len(found)
        found.append(check(ties, str(step)))
        scratch.drop(f"{step}-ties")
        loose = found[-1].where("kind = 1").select("key", F.col("doc_id").alias("doc"), F.col("start_word").alias("pos"), (F.col("end_word") - F.col("start_word")).alias("span"))
        loose = loose.distinct().withColumns({"other": F.lit(None).cast("long"), "other_pos": F.lit(None).cast("int")})
        ties = scratch.keep(f"{step + 1}-ties", _ties(loose))
    if not found:
        return docs.sparkSession.createDataFrame([], FOUND).drop("kind", "key")
    out = reduce(DataFrame.unionByName, found).where("kind = 0").drop("kind", "key")
    return out.dropDuplicates(["doc_id", "start_word", "end_word", "source_id", "source_start", "source_end"])


@F.arrow_udf(StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of their spans (if any), from the first sign of the first to the last sign of the last."""
    out = []
    for value, own in zip(texts, spans.to_pylist(), strict=True):
        if own is None or not value.is_valid:
            out.append(value.as_py())
            continue
        raw = value.as_buffer().to_pybytes()
        _, starts, ends, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        keep, at = [], 0
        for s in sorted(own, key=lambda s: (s["start_word"], s["end_word"])):
            lo, hi = int(starts[s["start_word"]]), int(ends[s["end_word"] - 1])
            if lo > at:
                keep.append(raw[at:lo])
            at = max(at, hi)
        out.append(b"".join([*keep, raw[at:]]).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, least: int = LEAST, percent: int = 80) -> DataFrame:
    """``docs`` (with doc_id and text) without passages that an earlier document holds.

    A passage goes from the first to the last sign of its words; the rest of the
    text stays as it is. Documents of which no word is left are dropped.
    Documents without repeated passages are unchanged, as are those with a null id,
    a null or an empty text, and all other columns, whatever their names. Rows that
    repeat a doc_id with one text lose the same passages; where their texts differ,
    both count as one document and keep theirs. Very long texts are handled whole.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "passages", by_bytes=True)
    found = repeated(docs, least, percent, scratch=scratch)
    found = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    found = scratch.only("spans", found)
    mixed = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("x <> y")
    found = found.join(mixed.select("id"), "id", "left_anti")
    # merged at every size: spans that are broadcast while they are few would only behave differently once they have grown
    both = packed(docs, F.col("doc_id").cast("long").alias("id")).hint("merge").join(found, "id", "left")
    text = F.col("row").getField("text")
    both = both.withColumn("cut", _without(text, F.col("spans")))
    both = both.where(F.col("spans").isNull() | (F.regexp_instr("cut", F.lit(r"[^\x20\x09-\x0D]")) > 0))
    return unpacked(both, docs.columns, text=F.col("cut"))
