"""Ball-tree search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lineseek.llm import balltree
from tests.llm.conftest import CLASHES, FOLD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, top=10):
    """(item, rank, doc, score) with whole numbers only, beside the logarithm."""
    held = [(i, Counter(TERM.findall(t.translate(FOLD)))) for i, t in docs if t is not None]
    held = [(i, c) for i, c in held if c]
    documents, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * documents) // total
            score = 0
            for w in TERM.findall((text or "").translate(FOLD)):
                if c[w]:
                    score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("leaf,block", [(balltree.LEAF, balltree.BLOCK_TERMS), (3, 40)])
def test_ranking_equals_brute_force(spark, documents, given, monkeypatch, leaf, block):
    monkeypatch.setattr(balltree, "LEAF", leaf)
    monkeypatch.setattr(balltree, "BLOCK_TERMS", block)
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{given}/benchmark.parquet").select("item_id", "text").collect()][:12]
    items += [(901, None), (902, ""), (903, "... "), (904, "Wort1 WORT1 wort1 und"), (905, "x" * 70_000), (906, "É ß 中文 zz"), (907, "ab"), (None, "und Wort3"), (908, docs[5][1])]
    extra = ", ".join(f"`{c}` int" for c in (*CLASHES, "item", "rank", "term", "a.b"))
    asked = spark.createDataFrame([(*r, *range(len(CLASHES) + 4)) for r in items], f"item_id long, text string, {extra}").repartition(2)
    assert got(balltree.rank(documents, asked)) == brute(docs, items)


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "und Wort3")], "item_id long, text string")
    assert balltree.rank(none, items).count() == 0
    assert balltree.rank(odd, items.where("false")).count() == 0


def vectors(rnd, rows, size):
    counts = rnd.integers(0, 9, rows)
    columns = np.concatenate([np.sort(rnd.choice(size, c, replace=False)) for c in counts]).astype(np.int64)
    return np.concatenate([[0], np.cumsum(counts)]), columns, rnd.integers(1, 1_000_000, counts.sum())


def test_no_row_exceeds_its_nodes_bound_and_subtrees_are_pruned(monkeypatch):
    monkeypatch.setattr(balltree, "LEAF", 8)
    rnd = np.random.default_rng(5)
    begin, columns, values = vectors(rnd, 900, 60)
    stretch = rnd.integers(1, 9000, 60).astype(float)
    tree = balltree.BallTree(begin, columns, values, stretch)
    assert sorted(np.concatenate(tree.rows[tree.inner :])) == list(range(900))
    scored = 0
    for k in range(30):
        terms = np.sort(rnd.choice(60, rnd.integers(1, 6), replace=False))
        query = balltree.Query(k, terms, rnd.integers(1, 9000, len(terms)), stretch, 5)
        dense = np.zeros(60, np.int64)
        dense[terms] = query.weights
        scores = [int((dense[columns[a:b]] * values[a:b]).sum()) for a, b in zip(begin, begin[1:])]
        for node, own in enumerate(tree.rows):
            assert max(scores[i] for i in own) <= tree.bounds(slice(node, node + 1), query)[0]
        scored += tree.search(query, list(range(900)), np.zeros(60, np.int64))
        want = sorted(((s, -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:5]
        assert sorted(query.best, reverse=True) == want
    assert scored < 0.75 * 30 * 900


def test_saturation_beyond_64_bits():
    n, times = np.array([10**9, 3]), np.array([7, 1])
    documents, total = 10**12, 10**15
    want = [10**9 * t // (1000 * t + 8 * (25 + 75 * x * documents // total)) for x, t in zip([10**9, 3], [7, 1])]
    assert balltree.saturate(times, n, documents, total).tolist() == want
