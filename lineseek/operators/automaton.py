"""Many short patterns in one walk over the text.

The patterns are a trie in one table: ``goto[state, class of the next character]``.
All places of a batch of lines are walked together, one character deeper a step,
and places whose state is dead drop out; as no pattern is longer than ``LONGEST``
characters, that many array steps answer every pattern on every line. Work grows
with the text and the matches, not with patterns x lines, and no row is made for a
place where nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from lineseek.plans.sizing import fits

#: Characters of the longest pattern that is walked, and of those that are walked where longer ones do not fit the table.
LONGEST, SHORT = 64, 5
#: Patterns, and entries of the table (4 bytes each), beyond which there is no table.
MAX_PATTERNS = 100_000
MAX_ENTRIES = 8 << 20
#: Characters that are walked at once, and matches, and characters of their lines, that are sent on at once.
CHUNK = 1 << 20
SENT = 1 << 16
SENT_CHARS = 16 << 20


class Trie:
    """``goto`` table of distinct patterns; ``ends[state]`` is the place of the pattern that ends there, or -1."""

    def __init__(self, patterns: list[str]) -> None:
        letters = sorted({ord(c) for p in patterns for c in p})
        self.classes = np.zeros((letters[-1] if letters else 0) + 2, dtype=np.int32)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        place = {chr(c): i for i, c in enumerate(letters, 1)}
        steps: dict[tuple[int, int], int] = {}
        ends = [-1, -1]  # state 0 is dead, 1 the root
        for i, p in enumerate(patterns):
            at = 1
            for c in p:
                key = (at, place[c])
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                at = steps[key]
            ends[at] = i
        self.ends = np.array(ends, dtype=np.int64)
        self.goto = np.zeros((len(ends), len(letters) + 1), dtype=np.int32)
        for (state, letter), to in steps.items():
            self.goto[state, letter] = to

    @staticmethod
    def entries(patterns: list[str]) -> int:
        """Upper bound of the table's size, known before it is built."""
        return (2 + sum(map(len, patterns))) * (1 + len({c for p in patterns for c in p}))

    def found(self, texts: list[str], every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, offset) by place, in order: every occurrence, or each pair once with offset 0."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = self.classes[np.minimum(codes, len(self.classes) - 1)]
        owner = np.repeat(np.arange(len(texts)), sizes)
        stop = np.cumsum(sizes)
        begin = stop - sizes
        pairs = [np.zeros(0, dtype=np.int64)]
        places = [np.zeros(0, dtype=np.int64)]
        n = len(self.ends)
        at = np.arange(len(letters))
        state = np.ones(len(letters), dtype=np.int32)
        for depth in range(LONGEST):
            if not len(at):
                break
            state = self.goto[state, letters[at]]
            alive = state > 0
            at, state, owner = at[alive], state[alive], owner[alive]
            hit = self.ends[state]
            ended = hit >= 0
            key = owner[ended] * n + hit[ended]
            pairs.append(key if every else np.unique(key))
            if every:
                places.append(at[ended] - depth - begin[owner[ended]])
            at = at + 1
            inside = at < stop[owner]
            at, state, owner = at[inside], state[inside], owner[inside]
        both, offset = np.concatenate(pairs), np.concatenate(places)
        if every:
            order = np.lexsort((offset, both))
            both, offset = both[order], offset[order]
        else:
            both = np.unique(both)
            offset = np.zeros(len(both), dtype=np.int64)
        return both // n, both % n, offset


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``CHUNK`` characters: (place of the first, texts)."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= CHUNK:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


def _walked(trie: Trie, texts: list[str], every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``found``; a text of many chunks is walked chunk by chunk, overlapping by a pattern's length."""
    if len(texts[-1]) <= 2 * CHUNK:
        return trie.found(texts, every)
    long, parts = texts[-1], [trie.found(texts[:-1], every)] if len(texts) > 1 else []
    for k in range(0, len(long), CHUNK):
        _, pattern, offset = trie.found([long[k : k + CHUNK + LONGEST - 1]], every)
        mine = offset < CHUNK  # what starts later is found by the next chunk
        parts.append((np.full(mine.sum(), len(texts) - 1), pattern[mine], offset[mine] + k if every else offset[mine]))
    rows = np.unique(np.stack([np.concatenate(column) for column in zip(*parts, strict=True)], axis=1), axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _runs(weights: np.ndarray) -> Iterator[slice]:
    """Runs of rows, at most ``SENT`` and, beyond the first row, about ``SENT_CHARS`` characters."""
    total, k = np.cumsum(weights), 0
    while k < len(weights):
        sent = total[k - 1] if k else 0
        end = min(k + SENT, max(k + 1, int(np.searchsorted(total, sent + SENT_CHARS, side="right"))))
        yield slice(k, end)
        k = end


def short_matches(
    lines: DataFrame, patterns: DataFrame, text_col: str, within: tuple[str, ...] = (), every: bool = False, kept: list[str] | None = None,
) -> DataFrame | None:
    """(pattern_id, <line columns>) for every line that holds a pattern of 1 to ``LONGEST`` characters, once each.

    A task sends each line once, beside the ids of all its patterns, however many they are.
    ``every``: one row for each occurrence, overlapping ones included, with its
    0-based ``offset`` behind the line's columns, and ``is_first``: no earlier one of
    this pattern is in the line. ``kept``: the columns of a line that are put out, all
    by default; a text that nobody reads is best left out, as each match repeats it.

    None if the patterns do not fit a table of bounded size. ``within``: columns of
    both tables that must be equal as well (null equals nothing). Null texts hold
    nothing; equal patterns under several ids are all reported; texts of any length
    are read whole. ``patterns`` holds ``pattern_id, pattern`` and these columns.
    """
    if not fits(patterns, max_rows=MAX_PATTERNS):
        return None
    rows = patterns.collect()
    texts = sorted({r["pattern"] for r in rows})
    if any(not 0 < len(t) <= LONGEST for t in texts) or Trie.entries(texts) > MAX_ENTRIES:
        return None
    place = {t: i for i, t in enumerate(texts)}
    kinds: dict[tuple, int] = {}
    asked = sorted(
        (place[r["pattern"]], kinds.setdefault(tuple(r[c] for c in within), len(kinds)), r["pattern_id"])
        for r in rows if all(r[c] is not None for c in within)
    )
    kept = lines.columns if kept is None else kept
    place_columns = [StructField("offset", LongType()), StructField("is_first", BooleanType())] if every else []
    id_kind = LongType() if every else ArrayType(LongType(), False)
    schema = StructType([StructField("pattern_id", id_kind), *(lines.schema[c] for c in kept), *place_columns])
    with_text = text_col in kept or not every and bool(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(texts)
        ids = np.array([i for *_, i in asked], dtype=np.int64)
        kind_of = np.array([k for _, k, _ in asked], dtype=np.int64)
        start = np.searchsorted(np.array([p for p, *_ in asked], dtype=np.int64), np.arange(len(texts) + 1))
        for batch in batches:
            sent = batch.select(kept)
            lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in within]
            kinds_here = np.array([kinds.get(t, -1) for t in zip(*lists, strict=True)] if within else [0] * len(batch), dtype=np.int64)
            for first, run_of in _pieces(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                line, pattern, offset = _walked(trie, run_of, every)
                n = start[pattern + 1] - start[pattern]
                # places come in order, so the first of a line and pattern leads its run
                leads = np.append(True, (line[1:] != line[:-1]) | (pattern[1:] != pattern[:-1]))[: len(line)]
                first_of = np.repeat(leads, n)
                line, offset = np.repeat(line, n) + first, np.repeat(offset, n)
                which = np.repeat(start[pattern], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                same = kind_of[which] == kinds_here[line]
                line, which, offset, first_of = line[same], which[same], offset[same], first_of[same]
                sizes = np.fromiter(map(len, run_of), dtype=np.int64, count=len(run_of)) * with_text
                if every:
                    for k in _runs(sizes[line - first]):
                        taken = sent.take(pa.array(line[k])).columns if kept else []
                        columns = [pa.array(ids[which[k]]), *taken, pa.array(offset[k]), pa.array(first_of[k])]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
                    continue
                # pairs come by line, so those of a line are one list
                own, begin = np.unique(line, return_index=True)
                stop = np.append(begin[1:], len(line))
                for k in _runs(sizes[own - first] + 8 * (stop - begin)):
                    lo, hi = begin[k][0], stop[k][-1]
                    found = pa.ListArray.from_arrays(pa.array(np.append(begin[k] - lo, hi - lo), pa.int32()), pa.array(ids[which[lo:hi]]))
                    taken = sent.take(pa.array(own[k])).columns if kept else []
                    yield pa.RecordBatch.from_arrays([found, *taken], names=schema.fieldNames())

    found = lines.select(*dict.fromkeys([*kept, text_col, *within])).mapInArrow(run, schema)
    return found if every else found.select(F.explode("pattern_id").alias("pattern_id"), *kept)
