"""Collocations against a count of all runs of words."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lineseek.llm import phrases
from tests.llm.conftest import CLASHES, FOLD

PIECE, TOKEN = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def brute(rows, longest, least, top, cover):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in PIECE.split((text or "").translate(FOLD)):
            w = tuple(TOKEN.findall(piece))
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                count[lang or "und"].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= least]
        within = defaultdict(int)
        for p in found:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i : i + k]] = max(within[p[i : i + k]], f[p])
        ranked = []
        for p in found:
            if 100 * within[p] >= cover * f[p]:
                continue
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.drop("words").collect())


@pytest.mark.parametrize("stretch,cover,top", [(1 << 20, 100, 2000), (3000, 80, 40)])
def test_phrases_equal_brute_force(spark, documents, monkeypatch, stretch, cover, top):
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    rnd = random.Random(3)
    words = ["the", "The", "of", "é", "中", "und", "a\x1cb", "x", "y", "zé"]
    rows = [(rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "  "]) for _ in range(rnd.randrange(60)))) for _ in range(150)]
    rows += [("en", "la la la la la la la la"), ("en", None), ("en", ""), ("fr", "  . , \n"), ("en", "x " * 4000)]
    rows += [(r.lang, r.text) for r in documents.collect()]
    extra = ", ".join(f"`{c}` int" for c in (*CLASHES, "word", "left", "right", "stretch", "a.b"))
    df = spark.createDataFrame([(*r, *range(len(CLASHES) + 5)) for r in rows], f"lang string, text string, {extra}").repartition(3)
    got = rows_of(phrases.mine(df, least=6, top=top, cover=cover))
    assert got == brute(rows, 5, 6, top, cover)
    assert any(len(r[2].split()) == 5 for r in got)


def test_shorter_reach_no_limit_and_no_phrases(spark, none):
    rows = [("en", "a b c a b c a b"), ("en", "a b c d")]
    df = spark.createDataFrame(rows, "lang string, text string")
    for longest in (2, 3):
        assert rows_of(phrases.mine(df, longest=longest, least=2, top=None)) == brute(rows, longest, 2, None, 100)
    assert phrases.mine(df, least=50).count() == 0
    assert phrases.mine(none).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = [(10**14 - 3, 10**15 - 7, 10**13 + 1, 10**14 + 9), (123, 5 * 10**6, 100, 2000)]
    df = spark.createDataFrame(big, "a long, n long, l long, r long")
    assert [r[0] for r in df.select(phrases._score(*map(F.col, "anlr"))).collect()] == [1000 * a * n // (x * y) for a, n, x, y in big]
