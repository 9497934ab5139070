"""Collocations by SETM: occurrence relations, counted, thinned to frequent groups and extended word by word.

The relation of length k holds where in the texts each phrase of k words stands,
sorted by piece and position. It is kept stretch by stretch in packed columns,
beside the distinct phrases of the stretch and their counts. Spark counts the
phrases of all stretches, keeps the frequent ones, and joins these back to the
stretches that hold them; there the sorted relation is merged with itself at
adjacent positions, which gives the relation of length k + 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.common import LOWER, Scratch
from lineseek.plans.sizing import broadcast_if_small

LONGEST, LEAST, TOP, COVER = 5, 100, 2000, 100
BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]")
#: Bytes of text whose phrases are numbered together.
STRETCH = 32 << 20
#: Parts in which the phrases of a language are ranked before the last ranking.
SALTS = 64
FOLD = LOWER.tobytes()
WORDS = "stretch long, lang string, word string, number long, count long, gaps binary, codes binary"
PHRASES = "stretch long, left long, right long, count long, ids binary, gaps binary, codes binary"


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


class Occurrences:
    """The words of the texts of one language in a stretch: a number for each, and gaps where a piece ends."""

    def __init__(self) -> None:
        self.number, self.codes, self.gaps, self.gap = Numbers(), [], [], 1

    def add(self, text: bytes) -> None:
        codes: list[int] = []
        begin: list[int] = []
        ask = self.number.__getitem__
        for piece in BREAKS.split(text.translate(FOLD)):
            if found := piece.split():
                begin.append(len(codes))
                codes += map(ask, found)
        if codes:
            gaps = np.ones(len(codes), np.uint8)
            gaps[begin] = 2
            self.codes.append(np.array(codes, np.int32))
            self.gaps.append(gaps)


def _pack(values: np.ndarray) -> bytes:
    """Compressed, all first bytes of the values before all second ones."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _unpack(value: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(value, max_output_size=1 << 40), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _batch(schema: list[str], rows: int, **columns) -> pa.RecordBatch:
    """Columns by name; the others are null."""
    kinds = {"lang": pa.string(), "word": pa.string(), "ids": pa.binary(), "gaps": pa.binary(), "codes": pa.binary()}
    arrays = []
    for name in schema:
        kind = kinds.get(name, pa.int64())
        value = columns.get(name)
        if value is None:
            arrays.append(pa.nulls(rows, kind))
        elif isinstance(value, (np.ndarray, list)):
            arrays.append(pa.array(value, kind))
        else:
            arrays.append(pa.array([value], kind).take(pa.array(np.zeros(rows, np.int64))))
    return pa.RecordBatch.from_arrays(arrays, schema)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First relation: for each stretch and language a row of packed occurrences, and a row for each distinct word."""
    names, step = _names(WORDS), (TaskContext.get().partitionId() << 32)
    langs: dict[str, Occurrences] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal step
        for lang, own in langs.items():
            if not own.codes:
                continue
            codes, gaps = np.concatenate(own.codes), np.concatenate(own.gaps)
            yield _batch(names, 1, stretch=step, lang=lang, gaps=[_pack(gaps)], codes=[_pack(codes)])
            spelled = [w.decode("utf-8", "replace") for w in own.number]
            yield _batch(names, len(spelled), stretch=step, lang=lang, word=spelled, number=np.arange(len(spelled)),
                         count=np.bincount(codes, minlength=len(spelled)))
            step += 1

    for batch in batches:
        for lang, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = value.as_buffer().to_pybytes()
            if langs and size + len(text) > STRETCH:
                yield from flush()
                langs, size = {}, 0
            langs.setdefault(lang, Occurrences()).add(text)
            size += len(text)
    yield from flush()


def _follow(stretch: int, at: np.ndarray, codes: np.ndarray, ids: np.ndarray, keep: bool) -> pa.Table:
    """The relation (``codes`` number the ``ids``), and the distinct pairs that it has at adjacent positions."""
    names = _names(PHRASES)
    # frequent ones get small numbers, which pack well
    order = np.argsort(-np.bincount(codes, minlength=len(ids)), kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    codes, ids = rank[codes], ids[order]
    meet = np.flatnonzero(at[1:] == at[:-1] + 1)
    pairs, counts = np.unique(codes[meet] * len(ids) + codes[meet + 1], return_counts=True)
    out = [_batch(names, len(pairs), stretch=stretch, left=ids[pairs // max(len(ids), 1)], right=ids[pairs % max(len(ids), 1)], count=counts)]
    if keep and len(pairs):
        out.append(_batch(names, 1, stretch=stretch, ids=[_pack(ids)], gaps=[_pack(np.diff(at, prepend=0))], codes=[_pack(codes.astype(np.int32))]))
    return pa.Table.from_batches(out)


def _begin(occurrences: pa.Table, frequent: pa.Table) -> pa.Table:
    """From the words of a stretch and their numbers and ids (null if not frequent): the first relation and its pairs."""
    frequent = frequent.filter(frequent["id"].is_valid())
    if not occurrences.num_rows or not frequent.num_rows:
        return pa.Table.from_batches([_batch(_names(PHRASES), 0)])
    codes = _unpack(occurrences["codes"][0].as_py(), np.int32)
    at = np.cumsum(_unpack(occurrences["gaps"][0].as_py(), np.uint8), dtype=np.int64)
    number, ids = frequent["number"].to_numpy(), frequent["id"].to_numpy()
    known = np.full(int(codes.max()) + 1, -1, np.int64)
    known[number] = np.arange(len(ids))
    codes = known[codes]
    return _follow(occurrences["stretch"][0].as_py(), at[codes >= 0], codes[codes >= 0], ids, True)


def _extend(keep: bool):
    def run(occurrences: pa.Table, frequent: pa.Table) -> pa.Table:
        """From a relation and the ids of its frequent adjacent pairs: the relation of these pairs, and its pairs."""
        if not occurrences.num_rows or not frequent.num_rows:
            return pa.Table.from_batches([_batch(_names(PHRASES), 0)])
        ids = _unpack(occurrences["ids"][0].as_py(), np.int64)
        codes = _unpack(occurrences["codes"][0].as_py(), np.int32).astype(np.int64)
        at = np.cumsum(_unpack(occurrences["gaps"][0].as_py(), np.int64))
        left, right, new = (frequent[c].to_numpy() for c in ("left", "right", "id"))
        order = np.argsort(ids)
        left, right = (order[np.searchsorted(ids[order], x)] for x in (left, right))
        wanted = left * len(ids) + right
        turn = np.argsort(wanted)
        meet = np.flatnonzero(at[1:] == at[:-1] + 1)
        pairs = codes[meet] * len(ids) + codes[meet + 1]
        place = np.minimum(np.searchsorted(wanted[turn], pairs), len(turn) - 1)
        hit = wanted[turn][place] == pairs
        return _follow(occurrences["stretch"][0].as_py(), at[meet][hit], turn[place[hit]], new, keep)

    return run


def _ranked(found: DataFrame, top: int | None) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        part = F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))
        found = found.withColumn("rank", part).where(F.col("rank") <= top).drop("rank")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return found if top is None else found.where(F.col("rank") <= top)


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact."""
    wide = [c.cast("decimal(20,0)") for c in (a, n, left, right)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1], wide[2] * wide[3])


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, cover: int = COVER,
         text: str = "text", lang: str = "lang") -> DataFrame:
    """Phrases of 2 to ``longest`` words that stand together more often than their parts would by chance, ranked per language.

    Columns: lang, rank, phrase, words (array), a (occurrences of the phrase), l, r
    (of its first part and of the rest), n (of all words of the language), score =
    floor(1000 * a * n / (l * r)). A phrase has ``least`` occurrences or more,
    overlapping ones included, none across a sign of ``.,;:!?`` or a line end. Of
    the cuts into two parts the lowest-scoring one counts, the shortest first part
    among equals. Phrases inside a longer one (up to ``longest``) that has ``cover``
    of 100 of their occurrences are dropped. The first ``top`` of each language by
    score, a and phrase (bytes) stay; None keeps all.

    Words are lower-cased in A-Z only. Null texts are empty, a null language is
    ``und``; empty texts and empty tables give no rows. Repeated rows are texts of
    their own and count each. A very long text is a stretch of its own, held packed
    by one task. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    given = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    relation = scratch.keep("1", given.mapInArrow(_read, WORDS))
    spread = relation.where("word is not null")
    sizes = scratch.keep("sizes", spread.groupBy("lang").agg(F.sum("count").alias("n")))
    counted = spread.groupBy("lang", "word").agg(F.sum("count").alias("a")).where(F.col("a") >= least)
    frequent = [scratch.keep("frequent-1", counted.select(
        F.monotonically_increasing_id().alias("id"), "lang", "a", F.array("word").alias("words"), F.array("a").alias("heads"), F.array("a").alias("tails")))]
    words = frequent[0].select("lang", F.col("words")[0].alias("word"), "id")
    # marks every word, so that its rows grow with the words of the stretches alone
    back = spread.join(broadcast_if_small(words), ["lang", "word"], "left").select(F.col("stretch").alias("owner"), "number", "id")
    follow = _begin
    for size in range(2, longest + 1):
        held = relation.where("codes is not null").drop("word", "lang", "number", "left", "right", "count")
        relation = scratch.keep(str(size), held.groupBy("stretch").cogroup(back.groupBy("owner")).applyInArrow(follow, PHRASES))
        scratch.drop(str(size - 1))
        spread = relation.where("left is not null")
        counted = spread.groupBy("left", "right").agg(F.sum("count").alias("a")).where(F.col("a") >= least)
        found = scratch.keep(f"found-{size}", counted.select(F.monotonically_increasing_id().alias("id"), "left", "right", "a"))
        first = frequent[-1].select(F.col("id").alias("left"), "lang", F.col("words").alias("start"), F.col("heads").alias("before"), F.col("a").alias("left_a"))
        last = frequent[-1].select(F.col("id").alias("right"), F.col("words").alias("end"), F.col("tails").alias("after"), F.col("a").alias("right_a"))
        frequent.append(scratch.keep(f"frequent-{size}", found.join(first, "left").join(last, "right").select(
            "id", "lang", "a", F.concat("start", F.slice("end", -1, 1)).alias("words"), F.concat("before", F.array("a")).alias("heads"),
            F.concat("after", F.array("a")).alias("tails"), "left", "right", "left_a", "right_a")))
        if frequent[-1].isEmpty():
            break
        back = spread.join(broadcast_if_small(found.drop("a")), ["left", "right"]).select(F.col("stretch").alias("owner"), "left", "right", "id")
        follow = _extend(size + 1 < longest)
    kept = []
    for shorter, longer in zip(frequent[1:], [*frequent[2:], None], strict=True):
        # a longer phrase reaches the share only if the one between them, a word longer than this, does
        if longer is not None:
            covers = [F.when(100 * F.col("a") >= cover * F.col(f"{side}_a"), F.col(side)) for side in ("left", "right")]
            inside = longer.select(F.explode(F.array(*covers)).alias("id")).where("id is not null")
            shorter = shorter.join(inside, "id", "left_anti")
        kept.append(shorter.select("lang", "a", "words", "heads", "tails"))
    found = reduce(DataFrame.unionByName, kept).join(broadcast_if_small(sizes), "lang")

    def cut(k: Column) -> Column:
        left, right = F.element_at("heads", k), F.element_at("tails", F.size("words") - k)
        return F.struct(_score(F.col("a"), F.col("n"), left, right).alias("score"), k.alias("cut"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))
    found = found.withColumn("best", best).select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", "best.l", "best.r", "n", "best.score")
    return _ranked(found, top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score")
