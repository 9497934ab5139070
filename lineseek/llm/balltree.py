"""Ranked lexical search: exact largest inner products by sparse ball trees.

A document is a sparse vector of saturated term counts over the terms of the
queries, a query one of term weights; both are whole numbers, and a score is
their inner product. Trees over runs of documents are searched best-first for
each query. No score of a node's documents exceeds the query's product with the
centroid plus its length times the radius. As sparse vectors are far apart
whatever the tree, a node also keeps its reach in each coordinate beyond the
centroid, of which a query only meets its own terms. Bounds are rounded up, and
leaves are scored in whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.common import LOWER, Scratch, chunks, lists, texts, words
from lineseek.plans.sizing import broadcast_if_small

TOP = 10
#: The signs between terms, and the letters that are folded.
APART = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = np.zeros(256, bool)
TERM[128:] = True
TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Terms of queries that are searched together; documents of a leaf; leaves of a tree; numbers in a tree's nodes.
BLOCK_TERMS, LEAF, LEAVES, CELLS = 50_000, 64, 128, 1 << 21
#: Parts of a query's answers that are ranked before the last ranking.
SALTS = 32
#: Share by which bounds in doubles are raised; sums of a few thousand terms are off by far less.
SLACK = 1e-9


class Vocabulary:
    """The terms of a block of queries, found in texts by hash and confirmed byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b" ".join(raw), np.uint8)
        hashes, starts, ends, _ = words(data, np.array([0, len(data)]), inside=TERM)
        order = np.argsort(hashes)
        if len(hashes) != len(terms) or (hashes[order][1:] == hashes[order][:-1]).any():
            raise ValueError("terms that are not whole, or share a hash")
        self.hashes, self.order = hashes[order], order
        self.data, self.starts, self.sizes = data, starts, ends - starts

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each text, and the texts and vocabulary terms of all hits in order."""
        hashes, starts, ends, bounds = words(data, offsets, inside=TERM)
        n = np.diff(bounds)
        if not len(self.hashes) or not len(hashes):
            return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == hashes)
        term, sizes = self.order[place[at]], (ends - starts)[at]
        right = sizes == self.sizes[term]
        for size in np.unique(sizes[right]):
            own = np.flatnonzero(right & (sizes == size))
            inner = np.arange(size)
            right[own] = (LOWER[data[starts[at[own]][:, None] + inner]] == self.data[self.starts[term[own]][:, None] + inner]).all(1)
        return n, np.repeat(np.arange(len(n)), n)[at[right]], term[right]


def _vectors(terms: list[str]):
    names = ["doc_id", "n", "terms", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                n, text, term = vocabulary.find(data, offsets)
                pairs, times = np.unique(text * max(len(terms), 1) + term, return_counts=True)
                begin = np.searchsorted(pairs, np.arange(len(n) + 1) * max(len(terms), 1))
                ids = batch.column(0).slice(first, end - first)
                columns = [ids, pa.array(n, pa.int64()), lists(pairs % max(len(terms), 1), begin, pa.int32()), lists(times, begin, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(n > 0))

    return run


def _held(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each term how many of the task's documents hold it."""
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["term", "df"])

    return run


def saturate(times: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10^9 * tf) div (1000 * tf + 8 * m), with m = 25 + (75 * n * documents) div total."""
    if int(n.max(initial=0)) * 75 * documents >= 1 << 63:
        n = n.astype(object)  # whole numbers of any size
    m = (25 + 75 * n * documents // total).astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * m)


class BallTree:
    """A balanced tree over sparse rows of whole numbers below 2^24, in the coordinates ``weights`` stretches.

    Node k has the children 2k + 1 and 2k + 2; all leaves are on the last level.
    """

    def __init__(self, begin: np.ndarray, columns: np.ndarray, values: np.ndarray, weights: np.ndarray) -> None:
        rows, size = len(begin) - 1, len(weights)
        self.begin, self.columns, self.values = begin, columns, values
        depth = max(0, math.ceil(math.log2(max(rows, 1) / LEAF)))
        self.inner = (1 << depth) - 1
        nodes = 2 * self.inner + 1
        self.centre = np.zeros((nodes, size), np.float32)
        self.most = np.zeros((nodes, size), np.float32)
        self.radius = np.zeros(nodes)
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)] * nodes
        scaled = values * np.sqrt(weights)[columns]
        norms = self.products(scaled**2, np.diff(begin))
        self.rows[0] = np.arange(rows)
        for node in range(nodes):
            own = self.rows[node]
            at, counts = self.entries(own)
            held, y = columns[at], scaled[at]
            self.centre[node] = np.bincount(held, y, minlength=size) / max(len(own), 1)
            c = self.centre[node].astype(np.float64)
            far = norms[own] - 2 * self.products(y * c[held], counts) + c @ c
            far = np.maximum(far, 0) + SLACK * (norms[own] + c @ c)
            self.radius[node] = math.sqrt(far.max(initial=0)) * (1 + SLACK)
            if node >= self.inner:
                np.maximum.at(self.most[node], held, values[at].astype(np.float32))
                continue
            # along the line through the row that is farthest from the centre and the one that is farthest from it
            first = own[np.argmax(far)]
            line = self.dense(first, scaled, size)
            away = norms[own] - 2 * self.products(y * line[held], counts)
            line -= self.dense(own[np.argmax(away)], scaled, size)
            side = np.argsort(self.products(y * line[held], counts), kind="stable")
            half = len(own) // 2
            self.rows[2 * node + 1], self.rows[2 * node + 2] = own[side[:half]], own[side[half:]]
        for node in range(self.inner - 1, -1, -1):
            self.most[node] = np.maximum(self.most[2 * node + 1], self.most[2 * node + 2])

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.begin[rows + 1] - self.begin[rows]
        return np.arange(counts.sum()) + np.repeat(self.begin[rows] - np.cumsum(counts) + counts, counts), counts

    def dense(self, row: int, scaled: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        own = slice(self.begin[row], self.begin[row + 1])
        out[self.columns[own]] = scaled[own]
        return out

    @staticmethod
    def products(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of runs of ``counts`` values, each on its own, so that nothing cancels."""
        return np.add.reduceat(np.append(values, values.dtype.type(0)), np.cumsum(counts) - counts) * (counts > 0)

    def bounds(self, nodes: slice, query: Query) -> np.ndarray:
        """No row of the node has a larger product with the query."""
        ball = self.centre[nodes, query.terms].astype(np.float64) @ query.stretched + query.length * self.radius[nodes]
        reach = self.most[nodes, query.terms].astype(np.float64) @ query.doubles
        return np.minimum(ball, reach) * (1 + SLACK) + 1

    def search(self, query: Query, ids: list, dense: np.ndarray) -> int:
        """Offers the query all rows that can be among its best; returns how many rows were scored. ``dense`` is all 0."""
        dense[query.terms] = query.weights
        scored = 0
        todo = [(-float(self.bounds(slice(0, 1), query)[0]), 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < query.floor():
                break
            if node < self.inner:
                children = self.bounds(slice(2 * node + 1, 2 * node + 3), query)
                for k, b in enumerate(children.tolist(), 2 * node + 1):
                    if b >= query.floor():
                        heapq.heappush(todo, (-b, k))
                continue
            own = self.rows[node]
            at, counts = self.entries(own)
            scores = self.products(dense[self.columns[at]] * self.values[at], counts)
            scored += len(own)
            for k in np.flatnonzero(scores >= max(query.floor(), 1)):
                query.offer(int(scores[k]), ids[own[k]])
        dense[query.terms] = 0
        return scored


class Query:
    """Whole weights on terms, and the best documents so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, item: int, terms: np.ndarray, weights: np.ndarray, stretch: np.ndarray, top: int) -> None:
        self.item, self.terms, self.weights, self.top = item, terms, weights, top
        self.doubles = weights.astype(np.float64)
        self.stretched = self.doubles / np.sqrt(stretch[terms])
        self.length = math.sqrt(self.stretched @ self.stretched)
        self.best: list[tuple[int, int]] = []

    def floor(self) -> int:
        """Documents below this score are not wanted any more."""
        return self.best[0][0] if len(self.best) == self.top else 0

    def offer(self, score: int, doc: int | None) -> None:
        entry = (score, -(1 << 63 if doc is None else doc))
        if len(self.best) < self.top:
            heapq.heappush(self.best, entry)
        elif entry > self.best[0]:
            heapq.heapreplace(self.best, entry)


def _search(queries: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, total: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best documents of this task for each query, from trees over runs of its documents."""
        stretch = np.maximum(weights, 1).astype(np.float64)
        own = [Query(item, terms, w, stretch, top) for item, terms, w in queries]
        dense = np.zeros(len(weights), np.int64)
        rows = LEAF * max(1, min(LEAVES, CELLS // max(2 * len(weights), 1)))
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                columns = part.column(2).flatten().to_numpy()
                counts = part.column(2).value_lengths().to_numpy()
                n = np.repeat(part.column(1).to_numpy(), counts)
                values = saturate(part.column(3).flatten().to_numpy().astype(np.int64), n, documents, total)
                tree = BallTree(np.concatenate([[0], np.cumsum(counts)]), columns, values, stretch)
                ids = part.column(0).to_pylist()
                for query in own:
                    tree.search(query, ids, dense)
        found = [(q.item, score, None if doc == -(1 << 63) else -doc) for q in own for score, doc in q.best]
        item, score, doc = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(APART), 0)


def _block(docs: DataFrame, terms: DataFrame, scratch: Scratch, name: str, top: int) -> DataFrame:
    """item, doc_id and score of the best documents of each task for the queries of one block."""
    rows = terms.collect()
    spelled = sorted({r.term for r in rows})
    place = {t: k for k, t in enumerate(spelled)}
    vectors = scratch.keep(f"{name}-vectors", docs.mapInArrow(_vectors(spelled), "doc_id long, n long, terms array<int>, times array<int>"))
    documents, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(vectors.select("terms").mapInArrow(_held(len(spelled)), "term int, df long").groupBy("term").agg(F.sum("df")).collect())
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held[k] + 1))) if k in held else 0 for k in range(len(spelled))], np.int64)
    by_item: dict[int, list] = {}
    for r in rows:
        if weights[place[r.term]]:
            by_item.setdefault(r.item, []).append((place[r.term], r.times * int(weights[place[r.term]])))
    queries = [(item, np.array([t for t, _ in own]), np.array([w for _, w in own], np.int64)) for item, own in sorted(by_item.items())]
    found = scratch.keep(f"{name}-found", vectors.mapInArrow(_search(queries, weights, documents, total, top), "item long, doc_id long, score long"))
    scratch.drop(f"{name}-vectors")
    return found


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with the highest scores above 0 for each item.

    Terms are runs of ASCII letters and digits and of signs beyond ASCII, lower-cased
    in A-Z only. N documents have a term, L is the number of their terms, n that of
    one. A term weighs floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a document's
    score sums weight * ((10^9 * tf) div (1000 * tf + 8 * m)) over the terms of the
    item, repeats included, with m = 25 + (75 * n * N) div L. Everything but the
    logarithm is in whole numbers. Ties go to the smaller doc_id; null ids count as
    documents and come last among equals.

    Items are searched in blocks of about ``BLOCK_TERMS`` terms, each against all
    documents; a longer item is a block of its own. Null, empty and term-free texts
    of documents count nowhere; such items have no rows. Repeated rows are documents
    (or items) of their own. Very long texts are read whole. Empty tables give no
    rows. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "search")
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    asked = scratch.keep("items", asked)
    terms = asked.select("item", F.explode(_terms(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = scratch.keep("terms", terms)
    blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    docs = texts(docs, key, text)
    found = None
    for k in range(blocks):
        own = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        part = _block(docs, own, scratch, str(k), top)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    early = F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order))
    found = found.withColumn("rank", early).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return found.join(broadcast_if_small(asked.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")
