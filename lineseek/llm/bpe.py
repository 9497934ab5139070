"""Byte-level BPE encoding and decoding; merges are chosen by a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lineseek.llm.common import texts

#: Words of the byte-level scheme: contractions, letters, digits, other signs (each with one leading space), space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct cuts and words that a worker remembers before it starts anew; characters of text taken together.
REMEMBERED, GROUP = 1_200_000, 1 << 20
#: Words longer than this have a tree of their own; shorter ones share arrays of about so many leaves.
LONG, TOGETHER = 256, 1 << 18
NONE = 1 << 62
SPACES = re.compile(r"\s\s")


def byte_names() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(plain))
    return [names[b] for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge adjacent pairs, lowest rank first and leftmost among equals, until none is left.

    ``ranks`` has pairs as left << 32 | right, ``merged`` the symbol of each rank.
    Leaf i of the tree holds (rank, i) of the pair that starts at i, or nothing;
    an inner node the smaller of its two. The root is the next merge, and a merge
    changes three leaves: its own, its left neighbour's and the one it swallows.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    rank = ranks.get
    tree = [NONE] * (2 * size)
    for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)):
        found = rank(x << 32 | y)
        if found is not None:
            tree[size + i] = found << 32 | i
    for k in range(size - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        symbols[i] = merged[top >> 32]
        after[i] = last = after[j]
        if last < n:
            before[last] = i
            found = rank(symbols[i] << 32 | symbols[last])
            own = NONE if found is None else found << 32 | i
        else:
            own = NONE
        changes = [(j, NONE), (i, own)]
        h = before[i]
        if h >= 0:
            found = rank(symbols[h] << 32 | symbols[i])
            changes.append((h, NONE if found is None else found << 32 | h))
        for leaf, value in changes:
            k = size + leaf
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:  # up, as long as something changes
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class ByteBPE:
    """A byte-level BPE tokenizer read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab: dict[str, int] = data["model"]["vocab"]
        names = byte_names()
        code = {c: b for b, c in enumerate(names)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.byte_ids = [vocab[c] for c in names]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        pairs = np.array(list(self.ranks), np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks, self.results = pairs[order], order, np.array(self.merged, np.int64)
        self.pieces = {str(i): bytes(code[c] for c in t) for t, i in vocab.items()}
        self.pieces |= {str(i): t.encode() for t, i in self.special.items()}
        self.split = regex.compile(WORDS)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # ids, decimal and joined by commas, of cuts that begin a text, of others (behind a space), and of words
        self.first: dict[str, str] = {}
        self.inner: dict[str, str] = {}
        self.words: dict[str, str] = {}

    def cuts(self, text: str) -> list[str]:
        """A text without special tokens in cuts that are encoded on their own; all but the first follow a space.

        A space between two other signs begins a new word in any case, so texts are
        cut there. Cuts that touch other white space are put together again.
        """
        cuts = text.split(" ")
        if text[0].isspace() or text[-1].isspace() or SPACES.search(text):
            begin, joined = 0, []
            for k in range(1, len(cuts)):
                left, right = cuts[k - 1], cuts[k]
                if left and right and not left[-1].isspace() and not right[0].isspace():
                    joined.append(" ".join(cuts[begin:k]))
                    begin = k
            cuts = [*joined, " ".join(cuts[begin:])]
        return cuts

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` for those that do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE)

    def merge_many(self, words: list[bytes], size: int) -> list[list[int]]:
        """``merge`` for words of at most ``size`` bytes (a power of two), one tree each, in step."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        symbols = np.zeros((n, size + 1), np.int64)
        ids = np.array(self.byte_ids)
        inside = np.arange(size)[None, :] < lengths[:, None]
        symbols[:, :size][inside] = ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        ranks = self.rank_of(symbols[:, :size], symbols[:, 1:])
        some = (ranks != NONE) & (np.arange(1, size + 1)[None, :] < lengths[:, None])
        tree[:, size:] = np.where(some, ranks << 32 | np.arange(size)[None, :], NONE)
        k = size
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        rows = np.arange(n)
        while True:
            top = tree[rows, 1]
            rows = rows[top != NONE]
            if not len(rows):
                break
            top = top[top != NONE]
            i = top & 0xFFFFFFFF
            j = after[rows, i]
            last, new = after[rows, j], self.results[top >> 32]
            symbols[rows, i], after[rows, i], before[rows, last] = new, last, i
            h = before[rows, i]
            own, left = self.rank_of(new, symbols[rows, last]), self.rank_of(symbols[rows, h], new)
            own = np.where((last < lengths[rows]) & (own != NONE), own << 32 | i, NONE)
            left = np.where((h >= 0) & (left != NONE), left << 32 | h, NONE)
            leaves = [size + i, size + j, size + np.maximum(h, 0)]
            tree[rows, leaves[1]] = NONE
            tree[rows, leaves[2]] = np.where(h >= 0, left, tree[rows, leaves[2]])
            tree[rows, leaves[0]] = own
            while leaves[0][0] > 1:
                leaves = [x >> 1 for x in leaves]
                for x in leaves:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
        kept = np.zeros((n, size + 2), bool)
        at, all_rows = np.zeros(n, np.int64), np.arange(n)
        while len(all_rows):
            kept[all_rows, at] = True
            at = after[all_rows, at]
            all_rows, at = all_rows[at < lengths[all_rows]], at[at < lengths[all_rows]]
        flat = symbols[kept[:, : size + 1]].tolist()
        ends = np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: list[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(1 << max(0, (len(w.encode()) - 1)).bit_length(), []).append(w)
        for size, own in by_size.items():
            step = max(1, TOGETHER // size)
            for k in range(0, len(own), step):
                raw = [w.encode() for w in own[k : k + step]]
                if size == 1 or size > LONG:
                    found = [merge([self.byte_ids[b] for b in w], self.ranks, self.merged) for w in raw]
                else:
                    found = self.merge_many(raw, size)
                for w, ids in zip(own[k : k + step], found, strict=True):
                    self.words[w] = ",".join(map(str, ids))

    def encode_many(self, texts: list[str]) -> list[str]:
        """Ids of each text, decimal, joined by commas; each new cut and each new word is worked out once."""
        if len(self.first) + len(self.inner) + len(self.words) > REMEMBERED:
            for known in (self.first, self.inner, self.words):
                known.clear()
        plans: list[list] = []
        first: set[str] = set()
        inner: set[str] = set()
        for text in texts:
            parts = [text]
            if self.special_split is not None and any(s in text for s in self.special):
                parts = self.special_split.split(text)
            plan: list = []
            for k, part in enumerate(parts):
                if k % 2:
                    plan.append(str(self.special[part]))
                elif part:
                    cuts = self.cuts(part)
                    first.add(cuts[0])
                    inner.update(cuts[1:])
                    plan.append(cuts)
            plans.append(plan)
        units = [(self.first, c, self.split.findall(c)) for c in first if c not in self.first]
        units += [(self.inner, c, self.split.findall(" " + c)) for c in inner if c not in self.inner]
        self.learn(list({w for *_, found in units for w in found if w not in self.words}))
        for known, c, found in units:
            known[c] = ",".join([self.words[w] for w in found])
        out = []
        for plan in plans:
            ids: list[str] = []
            for part in plan:
                if isinstance(part, str):
                    ids.append(part)
                    continue
                if part[0]:
                    ids.append(self.first[part[0]])
                ids += map(self.inner.__getitem__, part[1:])
            out.append(",".join(ids))
        return out

    def encode(self, text: str) -> str:
        return self.encode_many([text])[0]

    def decode(self, ids: str) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``GROUP`` characters; a longer text is taken alone."""
    own, size = [], 0
    for text in texts:
        if own and size + len(text) > GROUP:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


def _rows(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path)
        for batch in batches:
            counts, first, second = [], [], []
            decoded = (v.as_buffer().to_pybytes().decode("utf-8", "replace") for v in batch.column(1).cast(pa.binary()))
            for group in groups(decoded):
                for ids in bpe.encode_many(group):
                    counts.append(ids.count(",") + 1 if ids else 0)
                    back = bpe.decode(ids)
                    if full:
                        first.append([int(i) for i in ids.split(",")] if ids else [])
                        second.append(back)
                    else:
                        first.append(hashlib.sha256(ids.encode()).hexdigest())
                        second.append(hashlib.sha256(back.encode()).hexdigest())
            kind = pa.list_(pa.int32()) if full else pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())],
                                             ["doc_id", "n_tokens", *(("ids", "decoded") if full else ("ids_sha256", "decoded_sha256"))])

    return run


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array) and decoded text of every whole text, one row each.

    Null texts are empty: no ids. Strings of special tokens in a text become their
    ids. Rows are independent, so ties and repeated rows need no rule, nothing is
    shuffled, and an empty table gives no rows. Other columns are ignored.
    """
    return texts(docs, key, text).mapInArrow(_rows(tokenizer, True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` with SHA-256 of the ids (decimal, comma-joined) and of the decoded text in place of both."""
    return texts(docs, key, text).mapInArrow(_rows(tokenizer, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
