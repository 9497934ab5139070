"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of a model crosses a whitespace marker, a text falls apart before
each run of markers, and its parts are segmented independently of one another.
Texts of a stretch become numbers of its distinct parts, each part is segmented
once, and ids come back to their places by a join on the numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lineseek.llm.common import lists, texts

MARK = "▁"
#: A run of spaces with the word behind it, or the spaces that end a text.
PARTS = re.compile(" *[^ ]+| +")
#: Characters of text whose parts share a table, and those above which a text is cut without a list of its words.
STRETCH, LARGE = 1 << 24, 1 << 22
#: Parts that are segmented together.
TOGETHER = 1 << 14


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class PartTable:
    """Segments parts of texts with a model. A part is named by its text without the first marker."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size) if not self.model.is_control(i) and not self.model.is_byte(i)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        if "".join(self.model.encode_as_pieces("a  a ")) != f"{MARK}a{MARK}{MARK}a{MARK}":
            raise ValueError("this model does not keep all spaces, or begins texts without a marker")
        self.lone = [self.model.piece_to_id(MARK)]

    def segment(self, parts: list[str]) -> list[list[int]]:
        found = self.model.encode(parts, num_threads=1) if parts else []
        return [ids if part else self.lone for part, ids in zip(parts, found, strict=True)]

    def spell(self, ids: list[list[int]]) -> list[str]:
        """Texts of parts, without the space that their first marker stands for."""
        return self.model.decode(ids, num_threads=1) if ids else []


def cut(text: str, number: Numbers) -> np.ndarray:
    """Numbers of the parts of a text, in order."""
    text = text.replace(MARK, " ")
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) > LARGE or text[0] == " " or text[-1] == " " or "  " in text:
        found: Iterable[str] = (m.group()[1:] for m in PARTS.finditer(" " + text))
    else:
        found = text.split(" ")
    return np.fromiter(map(number.__getitem__, found), np.uint32)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], list[str]]]:
    """Ids of documents, numbers of their parts, and the distinct parts, for runs of about ``STRETCH`` characters."""
    keys, codes, number, size = [], [], Numbers(), 0
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = value.as_buffer().to_pybytes().decode("utf-8", "replace")
            if keys and size + len(text) > STRETCH:
                yield keys, codes, list(number)
                keys, codes, number, size = [], [], Numbers(), 0
            keys.append(key)
            codes.append(cut(text, number))
            size += len(text)
    if keys:
        yield keys, codes, list(number)


def _full(table: PartTable, codes: list[np.ndarray], parts: list[str]) -> list[pa.Array]:
    flat, sizes, spelled = [], [], []
    for k in range(0, len(parts), TOGETHER):
        ids = table.segment(parts[k : k + TOGETHER])
        flat.append(np.fromiter((i for own in ids for i in own), np.int32))
        sizes.append(np.fromiter(map(len, ids), np.int64))
        spelled += table.spell(ids)
    flat, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (flat, sizes))
    begin = np.cumsum(sizes) - sizes
    joined, counts, back = [], [], []
    for own in codes:
        n = sizes[own]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
        joined.append(flat[at])
        counts.append(len(at))
        back.append(" ".join([spelled[c] for c in own]))
    ids = lists(np.concatenate(joined).astype(np.int32), np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return [pa.array(counts, pa.int64()), ids, pa.array(back, pa.string())]


def _digests(table: PartTable, codes: list[np.ndarray], parts: list[str]) -> list[pa.Array]:
    decimal, sizes, spelled = [], [], []
    for k in range(0, len(parts), TOGETHER):
        ids = table.segment(parts[k : k + TOGETHER])
        decimal += [",".join(map(str, own)) for own in ids]
        sizes.append(np.fromiter(map(len, ids), np.int64))
        spelled += table.spell(ids)
    count = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    counts, first, second = [], [], []
    for own in codes:
        counts.append(int(count[own].sum()))
        own = own.tolist()
        first.append(hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest())
        second.append(hashlib.sha256(" ".join(map(spelled.__getitem__, own)).encode()).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]


def _rows(path: str, answer, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PartTable(path)
        for keys, codes, parts in _stretches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *answer(table, codes, parts)], names)

    return run


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array) and decoded text of every whole text, one row each.

    ``model`` is the path of a model whose pieces do not cross whitespace markers
    (others are an error); no begin or end ids, no sampling. The marker itself in a
    text counts as a space. Null and empty texts have no ids and decode to an empty
    text; null ids stay. A very long text is a stretch of its own and is held whole
    by one task. Rows are independent, so ties and repeated rows need no rule,
    nothing is shuffled, and an empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    names = ["doc_id", "n_tokens", "ids", "decoded"]
    return texts(docs, key, text).mapInArrow(_rows(model, _full, names), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` with SHA-256 of the ids (decimal, comma-joined) and of the decoded text in place of both."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return texts(docs, key, text).mapInArrow(_rows(model, _digests, names), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
