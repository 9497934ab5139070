"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.bpe import byte_names
from lineseek.llm.common import Scratch, texts

#: Distinct white-space-delimited strings whose ids a worker remembers before it starts anew (about 250 MB).
REMEMBERED = 1_000_000
#: Pieces of one length that are ranked in one task's window.
RANKED = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Signs that end a word's piece and never compose with it.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"
LETTERS_END = "\u0250"


class Encoder(dict):
    """Ids of whole texts by the tokenizers library, each distinct string between white space encoded once.

    The tokenizer's pieces never hold white space and its normaliser composes
    nothing across an ASCII space, tab or line break, so the ids of a text are
    those of its strings in order. Words of letters below U+0250 are one piece
    each, which goes to the library's model directly; signs behind them are a
    piece of their own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names = byte_names()

    def __missing__(self, text: str) -> bytes:
        word = text.rstrip(SIGNS)
        low = "".join([c.lower() for c in word])
        if not (word.isalpha() and low.isalpha() and max(word) < LETTERS_END) or "<|" in text:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        elif word != text:
            ids = self[word] + self[text[len(word) :]]
        elif low != text:
            ids = self[low]
        else:
            piece = low if low.isascii() else "".join([self.names[b] for b in low.encode()])
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
        self[text] = ids
        return ids

    def encode(self, rows: Iterable[str]) -> Iterator[bytes]:
        """32-bit ids of each text, little-endian."""
        for text in rows:
            if len(self) > REMEMBERED:
                self.clear()
            yield b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def _pieces(path: str, window: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            decoded = (v.as_buffer().to_pybytes().decode("utf-8", "replace") for v in batch.column(1).cast(pa.binary()))
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(decoded), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * window)):
                    part = ids[at : at + 4 * window]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    return run


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, first rank, last rank, pieces a sequence, first sequence, place):
    the pieces of this length with these ranks go, so many to each, to sequences
    numbered from the first one, at this place and behind it. Sequences that hold
    the same lengths are one group, so the work depends on the window and not on
    the number of pieces. A group is touched again only after its room at least
    halved, and each length splits at most one group, which bounds the rows by
    about 3 * window * log2(window).
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, sequences)
    free: list[int] = []  # its keys in order
    out, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                bisect.insort(free, left)
                room[left] = []
            room[left].append((first, n))

    def fill(length: int, rank: int, todo: int, left: int, first: int, n: int) -> int:
        """Give pieces to n like sequences; pieces placed."""
        each = left // length
        full = min(n, todo // each)
        if full:
            out.append((length, rank, rank + full * each - 1, each, first, window - left))
            put(left - each * length, first, full)
        placed, rest = full * each, min(todo - full * each, each)
        if full < n and rest:
            out.append((length, rank + placed, rank + placed + rest - 1, rest, first + full, window - left))
            put(left - rest * length, first + full, 1)
            placed, full = placed + rest, full + 1
        put(left, first + full, n - full)
        return placed

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        at = bisect.bisect_left(free, length)
        tight = free[at:]
        for left in tight:
            if not todo:
                break
            groups = room.pop(left)
            free.remove(left)
            for first, n in groups:
                placed = fill(length, rank, todo, left, first, n) if todo else 0
                if not placed:
                    put(left, first, n)
                rank, todo = rank + placed, todo - placed
        if todo:
            each = window // length
            n = -(-todo // each)
            fill(length, rank, todo, window, sequences, n)
            sequences += n
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 1, with_ids: bool = False,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``window`` tokens.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``with_ids`` ids (binary, little-endian 32 bits). A document is its ids and
    ``end_id``; only longer ones are cut, at multiples of the window. Null and
    empty texts are the single end id. Rows that repeat an id or a text are packed
    like any other; equal pieces share their length's ranks in any order. An empty
    table gives no rows. Other columns are ignored. ``tokenizer`` is a path that
    every worker can read.

    Only the histogram (at most ``window`` rows) reaches the driver, and only the
    plan (bounded by the window, see ``plan``) is broadcast. Ranks within a length
    are counted in salted groups of about ``RANKED`` pieces.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    spark = docs.sparkSession
    schema = PIECES + (", ids binary" if with_ids else "")
    pieces = scratch.keep("pieces", texts(docs, key, text).mapInArrow(_pieces(tokenizer, window, end_id, with_ids), schema))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, window), "length long, first long, last long, each long, sequence long, place long")
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    s = F.broadcast(slots).alias("s")
    placed = ranked.alias("r").join(s, F.expr("r.length = s.length and r.rank between s.first and s.last"))
    nth = F.expr("r.rank - s.first")
    return placed.select(
        "doc_id", "piece", "start", "r.length", "ids_crc32",
        F.expr("s.sequence + (r.rank - s.first) div s.each").alias("sequence_id"),
        (F.col("s.place") + nth % F.col("s.each") * F.col("r.length")).alias("offset"),
        *(["ids"] if with_ids else []))


def sequences(placed: DataFrame) -> DataFrame:
    """Token ids of each sequence (at most one window of them), from ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("transform(parts, p -> p.doc_id)").alias("doc_ids"),
        F.expr("aggregate(parts, x'', (a, p) -> concat(a, p.ids))").alias("ids"))
