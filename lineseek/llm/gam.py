"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned. Cyclic boosting visits them in turn and adds a shallow tree
fitted to one feature's gradient histogram to that feature's lookup table; then
the strongest pairs get two-dimensional tables in the same way. A score is the
logistic of a sum of table entries, one vectorised lookup a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import Scratch, chunks, lists, packed, shingles, texts, unpacked, words

FEATURES = (
    "log_words", "word_length", "capitals", "signs", "digits", "foreign", "bars", "stops", "distinct_words", "repeated_next",
    "repeated_runs", "repeated_lines", "words_per_line", "sign_ends", "single_letters",
)
#: Labelled rows that the driver fits on at most (the ones of least hash): about 15 MB.
SAMPLE = 60_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8

# classes of bytes: 0 other, 1 capital, 2 small, 3 digit, 4 sign, 5 beyond ASCII, 6 space, 7 line end, 8 bar, 9 stop
KIND = np.zeros(256, np.int64)
KIND[33:127] = 4
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 1, 2, 3, 5
KIND[[32, 9, 11, 12, 13]], KIND[10], KIND[ord("|")] = 6, 7, 8
KIND[[ord(c) for c in ".,;:'\"?"]] = 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    kind = KIND[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * 10 + kind, minlength=10 * n).reshape(n, 10).astype(float)
    hashes, starts, ends, bounds = words(data, offsets)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(n), count)
    some, size = np.maximum(count, 1), ends - starts
    mean = lambda x: np.bincount(owner, weights=x, minlength=n) / some
    solid = np.maximum(kinds[:, [0, 1, 2, 3, 4, 5, 8, 9]].sum(1), 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    runs, begin = shingles(hashes, bounds, 5, whole=False)
    distinct, repeats, lines = np.ones(n), np.zeros(n), np.zeros(n)
    line_of = np.searchsorted(np.flatnonzero(kind == 7), starts)
    new_line = np.flatnonzero(np.concatenate([[True], (line_of[1:] != line_of[:-1]) | (owner[1:] != owner[:-1])])) if len(starts) else np.zeros(0, np.int64)
    if len(new_line):
        place = (np.arange(len(hashes)) - np.repeat(new_line, np.diff(new_line, append=len(hashes)))).astype(np.uint64)
        line_hash = np.add.reduceat(hashes * (place * np.uint64(2) + np.uint64(1)), new_line)
        line_first = np.searchsorted(new_line, bounds)
    for i in range(n):
        if count[i]:
            distinct[i] = len(np.unique(hashes[bounds[i] : bounds[i + 1]])) / count[i]
            own = runs[begin[i] : begin[i + 1]]
            repeats[i] = 1 - len(np.unique(own)) / len(own) if len(own) else 0
            own = line_hash[line_first[i] : line_first[i + 1]]
            lines[i] = 1 - len(np.unique(own)) / len(own)
    line_count = np.diff(line_first) if len(new_line) else np.zeros(n)
    return np.stack([
        np.log1p(count), mean(size), kinds[:, 1] / letters, kinds[:, 4] / solid, kinds[:, 3] / solid, kinds[:, 5] / solid,
        kinds[:, 8] / some, kinds[:, 9] / some, distinct, mean(again), repeats, lines, count / np.maximum(line_count, 1),
        mean(np.isin(KIND[data[ends - 1]], (4, 8)).astype(float)), mean((size == 1).astype(float)),
    ], axis=1)


@dataclass
class Additive:
    """Tables of an additive model over binned features."""

    cuts: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        fine = self.bins(x, self.cuts)
        for k, t in enumerate(self.tables):
            total += t[fine[:, k]]
        if self.pairs:
            coarse = self.bins(x, self.pair_cuts)
            for (i, j), t in self.pairs.items():
                total += t[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best cut of a histogram: gain, and the first bin on its right."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(left_h < least) | (right_h < least)] = 0
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Leaf values, one for each bin, of a tree of this depth."""
    gain, at = _split(g, h, least) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([tree(g[:at], h[:at], depth - 1, least), tree(g[at:], h[at:], depth - 1, least)])


def pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Best tree that cuts one axis and then the other in both halves: gain and leaf values."""
    best, out = 0.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(gg)):
            halves, gain = [], -(gg.sum() ** 2) / (hh.sum() + 1)
            for part in (slice(0, at), slice(at, None)):
                pg, ph = gg[part].sum(0), hh[part].sum(0)
                leaf = tree(pg, ph, 1, least)
                gain += float((leaf * pg).sum())
                halves.append(np.broadcast_to(leaf, gg[part].shape))
            if gain > best:
                best, value = gain, np.concatenate(halves)
                out = value.T if turn else value
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = BINS, pairs: int = PAIRS, least: float = 2.0) -> Additive:
    """Fit by cyclic boosting on log loss; rows in any order, repeated rows count as often as they stand."""
    grid = lambda n: [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = Additive(grid(bins), pair_cuts=grid(PAIR_BINS))
    rate_one = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model.intercept = float(np.log(rate_one / (1 - rate_one)))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not len(y) or y.min() == y.max():
        return model
    fine, coarse = model.bins(x, model.cuts), model.bins(x, model.pair_cuts)
    total = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            g, h = gradients()
            step = rate * tree(np.bincount(fine[:, k], g, len(t)), np.bincount(fine[:, k], h, len(t)), 2, least)
            t += step
            total += step[fine[:, k]]

    shape = [len(c) + 1 for c in model.pair_cuts]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, i] * shape[j] + coarse[:, j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = gradients()
    gains = {(i, j): pair_tree(sums(i, j, g), sums(i, j, h), least)[0] for i, j in combinations(range(x.shape[1]), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pairs = {p: np.zeros((shape[p[0]], shape[p[1]])) for p in chosen if gains[p] > 0}
    for _ in range(max(1, rounds // 10)):
        for (i, j), t in model.pairs.items():
            g, h = gradients()
            step = rate * pair_tree(sums(i, j, g), sums(i, j, h), least)[1]
            t += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(FEATURES)
    for batch in batches:
        rows = [features(data, offsets) for _, _, data, offsets in chunks(batch.column(1))]
        x = np.concatenate(rows).ravel() if rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(x, np.arange(batch.num_rows + 1) * width, pa.float64())], ["doc_id", "x"])


def _scores(model: Additive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> tuple[Additive, DataFrame]:
    """The model fitted on labelled rows for which ``training`` holds, and the written feature table of all documents."""
    scratch = Scratch(docs.sparkSession, "gam", by_bytes=True)
    table = scratch.keep("features", texts(docs, key, text).mapInArrow(_features, "doc_id long, x array<double>"))
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(training)
    rows = table.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).select("x", "y").toArrow()
    y = rows["y"].to_numpy().astype(float)
    x = rows["x"].combine_chunks().flatten().to_numpy() if len(y) else np.zeros(0)
    return fit(x.reshape(-1, len(FEATURES)), y), table


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, key: str = "doc_id", text: str = "text",
             label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every whole text.

    Only the text enters a score. Labels of rows for which ``held_out`` (over
    doc_id) is not true are learned from, ``sample`` of them at most, chosen by
    hash. Labels other than 0 and 1 are ignored; repeated ones count as often as
    they stand. Without labels of both kinds every text gets the share of ones
    (0.5 without any), so nothing is rejected on no evidence. Null and empty texts
    have all shares 0. A null doc_id is not held out. Repeated rows are scored
    alike; an empty table gives no rows. Other columns are ignored.
    """
    held = F.coalesce(held_out, F.lit(False))
    model, table = learn(docs, labels, ~held, sample, key, text, label)
    scored = table.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _select(model: Additive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(features(data, offsets)) >= 0.5 for _, _, data, offsets in chunks(batch.column(0))]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return run


def accepted(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, with all their columns, unchanged.

    Labels are learned from as in ``classify``. Null and empty texts are scored as
    empty ones, null ids are never learned from; very long texts are scored whole.
    Rows that repeat are judged alike, each for itself; scores of 0.5 count as good.
    Columns may have any names. An empty table gives no rows.
    """
    model, _ = learn(docs, labels, ~F.coalesce(held_out, F.lit(False)))
    rows = packed(docs, F.coalesce("text", F.lit("")).alias("text"))
    return unpacked(rows.mapInArrow(_select(model), rows.schema), docs.columns)
