"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import Scratch, chunks, mix, numbers, texts, words

START, END = (np.uint64(x) for x in numbers(2, 59))
PAIR = numbers(2, 61)
PROBE = 0x9E3779B97F4A7C15
#: Counts are stored as 1 + floor(log_STEP(count)).
STEP = 1.5
#: Bit positions a stored (n-gram, level) sets.
HASHES = 3
#: Bits of filter for each stored (n-gram, level): an absent one passes in about one of a hundred probes, at any size.
RATE = 12
#: Text bytes whose n-grams meet in one block, and whose distinct n-grams are sent to the blocks together.
BLOCK_TEXT, STRETCH_TEXT = 2 << 20, 8 << 20
#: Weight of the word frequencies beside the counts of pairs, in tokens.
PRIOR = 200.0


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(STEP) + 1e-9).astype(np.int64)


def typical() -> np.ndarray:
    """Count that each level stands for: the mean of the whole numbers it covers."""
    out = [0.0]
    for level in range(1, 120):
        low, high = int(np.ceil(STEP ** (level - 1) - 1e-9)), int(np.ceil(STEP**level - 1e-9)) - 1
        out.append((low + high) / 2 if high >= low else STEP ** (level - 0.5))
    return np.array(out)


def grams(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts (words and one end each), the pair that ends at each, and the first token of each text."""
    tokens = np.insert(hashes, bounds[1:], END)
    begin = bounds + np.arange(len(bounds))
    last = np.empty_like(tokens)
    last[1:] = tokens[:-1]
    last[begin[:-1]] = START
    return tokens, mix(last * PAIR[0] + tokens * PAIR[1]), begin


def positions(keys: np.ndarray, level: int, bits: int | np.ndarray) -> list[np.ndarray]:
    """Places inside a block of the bits of (key, level); ``bits`` is the block's size, or one size a key."""
    x = mix(keys + np.uint64(PROBE * level % 2**64))
    half, low = np.uint64(32), np.uint64(2**32 - 1)
    step = (x & low) | np.uint64(1)
    bits = np.asarray(bits, np.uint64)
    return [(((x >> half) + np.uint64(i) * step & low) * bits) >> half for i in range(HASHES)]


def block_of(keys: np.ndarray, log_blocks: int) -> np.ndarray:
    return (keys >> np.uint64(64 - log_blocks)) if log_blocks else np.zeros(len(keys), np.uint64)


class Filter:
    """Log-frequency Bloom filter in blocks of ``bits`` bits each (or one size a block); the n-gram's hash names its block."""

    def __init__(self, data: np.ndarray, log_blocks: int, bits: int | np.ndarray) -> None:
        self.data, self.log_blocks, self.typical = data, log_blocks, typical()
        self.bits = np.broadcast_to(np.asarray(bits, np.uint64), 1 << log_blocks)
        self.base = np.cumsum(self.bits) - self.bits

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Estimated levels: they are probed upwards until one is not a member."""
        found = np.zeros(len(keys), np.uint8)
        block = block_of(keys, self.log_blocks).astype(np.int64)
        alive = np.flatnonzero(self.bits[block])
        for level in range(1, len(self.typical)):
            own, base, bits = keys[alive], self.base[block[alive]], self.bits[block[alive]]
            member = np.ones(len(own), bool)
            for place in positions(own, level, bits):
                at = base + place
                member &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
            alive = alive[member]
            if not len(alive):
                break
            found[alive] = level
        return found

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Estimated counts, by the levels."""
        return self.typical[self.levels(keys)]


def exact(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of the keys by the sorted table of known ones; 0 for others."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of about ``STRETCH_TEXT`` bytes: their texts' ids, first tokens, distinct words (sorted) and the one at each token."""
    for batch in batches:
        parts, first, size = [], 0, 0
        for _, last, data, offsets in chunks(batch.column(2)):
            parts.append(grams(*words(data, offsets)[::3])[::2])
            size += len(data)
            if size < STRETCH_TEXT and last < batch.num_rows:
                continue
            begin = np.cumsum(np.concatenate([[0], *(np.diff(p[1]) for p in parts)]))
            unique, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            whole = pa.array([0, last - first], pa.int32())
            blobs = begin.astype(np.int64), unique, at.astype(np.uint16 if len(unique) <= 1 << 16 else np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([size], pa.int64()), *(pa.ListArray.from_arrays(whole, batch.column(i).slice(first, last - first)) for i in (0, 1)),
                *(pa.array([x.tobytes()], pa.binary()) for x in blobs),
            ], ["bytes", "doc_ids", "held", "begin", "words", "at"])
            parts, first, size = [], last, 0


def _tokens(begin: bytes, unique: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First token of each text of a stretch, distinct words, the one at each token, and the pair that ends at each token."""
    begin, unique = np.frombuffer(begin, np.int64), np.frombuffer(unique, np.uint64)
    at = np.frombuffer(at, np.uint16 if len(unique) <= 1 << 16 else np.int32)
    tokens = unique[at]
    last = np.empty_like(tokens)
    last[1:] = tokens[:-1]
    last[begin[:-1]] = START
    return begin, unique, at, mix(last * PAIR[0] + tokens * PAIR[1])


def _count(log_blocks: int):
    edges = np.arange(1, 1 << log_blocks, dtype=np.uint64) << np.uint64(64 - log_blocks) if log_blocks else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct n-grams of each stretch with their counts in training texts, one row for each block."""
        for batch in batches:
            for stretch, held, *blobs in zip(*(batch.column(i) for i in range(5)), strict=True):
                begin, unique, at, pairs = _tokens(*(b.as_buffer() for b in blobs))
                learn = np.repeat(~np.array(held.as_py(), bool), np.diff(begin))
                both, pair_at = np.unique(pairs, return_inverse=True)
                columns = []
                for keys, where in ((unique, at), (both, pair_at)):
                    counts = np.bincount(where[learn], minlength=len(keys)).astype(np.int64)
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    columns += [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (keys, counts)]
                n = 1 << log_blocks
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stretch.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), *columns],
                    ["stretch", "block", "words", "word_counts", "pairs", "pair_counts"])

    return run


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams and their counts in all, without those that no training text has."""
    turn = np.argsort(keys, kind="stable")
    keys, counts = keys[turn], counts[turn]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    return keys[counts > 0], counts[counts > 0]


def stored(keys: np.ndarray, counts: np.ndarray) -> Filter:
    """A filter of one block with the levels of the counts, of ``RATE`` bits for each (key, level)."""
    level = levels(counts) if len(counts) else counts
    bits = -(-int(level.sum()) * RATE // 64) * 64
    marks = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for place in positions(keys[level >= j], j, bits):
            marks[place] = True
    return Filter(np.packbits(marks, bitorder="little"), 0, bits)


def _blocks(table: pa.Table) -> pa.Table:
    """What one block answers each stretch: exact counts of its words and levels of its pairs; in its first row, the block's sums."""
    rows = {n: table[n].to_pylist() for n in ("words", "word_counts", "pairs", "pair_counts")}
    blob = {n: np.frombuffer(b"".join(v), np.int64 if n.endswith("counts") else np.uint64) for n, v in rows.items()}
    known, counts = _merged(blob["words"], blob["word_counts"])
    filled = stored(*_merged(blob["pairs"], blob["pair_counts"]))
    out = []
    for name, values in (("words", exact(blob["words"], known, counts)), ("pairs", filled.levels(blob["pairs"]))):
        ends = np.cumsum([0, *(len(x) // 8 for x in rows[name])])
        out.append(pa.array([values[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()))
    sums = [pa.array([int(x), *[0] * (len(table) - 1)], pa.int64()) for x in (counts.sum(), len(known))]
    return pa.table([table["stretch"], table["block"], *out, *sums], ["stretch", "block", "counts", "levels", "total", "distinct"])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _sums(begin: np.ndarray, count: np.ndarray, pair: np.ndarray, end: int, space: int, prior: float) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of the texts by their tokens' word and pair counts and the count of ends."""
    chance = (count + 1) / space
    last = np.empty(len(count))  # count of the token before
    last[1:] = count[:-1]
    last[begin[:-1]] = end  # as many starts as ends
    model = np.log10((np.minimum(pair, last) + prior * chance) / (last + prior))
    return [np.diff(begin), *(np.add.reduceat(x, begin[:-1]) for x in ((count > 0).astype(np.int64), np.log10(chance), model))]


def _assemble(space: int, prior: float, end: int):
    def run(stretch: pa.Table, answers: pa.Table) -> pa.Table:
        """Scores of a stretch's texts; its distinct words and pairs are sorted, so blocks in order answer them in order."""
        answers = answers.sort_by("block")
        count = np.frombuffer(b"".join(answers["counts"].to_pylist()), np.int64)
        level = np.frombuffer(b"".join(answers["levels"].to_pylist()), np.uint8)
        begin, _, at, pairs = _tokens(*(stretch[n][0].as_buffer() for n in ("begin", "words", "at")))
        pair_at = np.unique(pairs, return_inverse=True)[1]
        sums = _sums(begin, count[at], typical()[level][pair_at], end, space, prior)
        return pa.table([*(stretch[n].combine_chunks().flatten() for n in ("doc_ids", "held")), *(pa.array(x) for x in sums)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, held_out: Column, filter_bytes: int | None = None, head: int | None = None, prior: float = PRIOR,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean expression over doc_id; the model learns from the
    rest. Tokens are words with A-Z lower-cased, then one end. base_score is the
    add-one unigram log10 probability from exact counts. score is the log10
    probability under the pair model: pair counts come from a log-frequency Bloom
    filter and are smoothed with exact word frequencies of weight ``prior``.

    Null texts are empty: one end token. Rows that repeat are scored (and counted)
    as often as they stand. A null doc_id is not held out. An empty table gives no
    rows; without training rows, N and V are 0. Other columns are ignored.

    Each stretch of texts sends its distinct n-grams, with their counts in training
    texts, to the hash blocks that hold them. A block adds the counts up, fills its
    part of the filter and answers every stretch that asked: exact counts of words,
    levels of pairs. Blocks follow the corpus in number, not in size, and a part has
    ``RATE`` bits for each (pair, level) it holds, so unseen pairs pass equally
    seldom at any size. Nothing is broadcast: ``filter_bytes`` and ``head``, once
    the bounds of that, are taken and have no effect. N-grams are told apart by
    64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    docs = texts(docs, key, text).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    stretches = docs.mapInArrow(_stretches, "bytes long, doc_ids array<long>, held array<boolean>, begin binary, words binary, at binary")
    stretches = scratch.keep("stretches", stretches.withColumn("stretch", F.monotonically_increasing_id()))
    # every training text has one end
    size, end = stretches.agg(F.sum("bytes"), F.sum(F.size(F.filter("held", lambda h: ~h)))).first()
    log_blocks = max(0, int(np.ceil(np.log2(max(size or 0, 1) / BLOCK_TEXT))))
    counted = stretches.select("stretch", "held", "begin", "words", "at").mapInArrow(
        _count(log_blocks), "stretch long, block int, words binary, word_counts binary, pairs binary, pair_counts binary")
    answers = scratch.keep("answers", counted.groupBy("block").applyInArrow(
        _blocks, "stretch long, block int, counts binary, levels binary, total long, distinct long"))
    total, distinct = (x or 0 for x in answers.agg(F.sum("total"), F.sum("distinct")).first())
    asked = answers.select("stretch", "block", "counts", "levels")
    scored = stretches.drop("bytes").groupBy("stretch").cogroup(asked.groupBy("stretch")).applyInArrow(
        _assemble(total + distinct + 1, prior, end or 0), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
