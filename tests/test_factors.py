"""Required texts of patterns, and regex matches by candidates."""

import random
import re

import pytest

from lineseek.functions import factors
from lineseek.operators import patterns


@pytest.mark.parametrize("pattern,groups", [
    ("the.*[0-9]+", [{"the"}]), ("the.*and.*[0-9]+", [{"the"}, {"and"}]), ("([a-z]*ing ){2}", [{"ing "}]), ("[a-z]+[0-9]+", []),
    ("tion[.]$", [{"tion."}]), ("(?:cat|dog)s", [{"cat", "dog"}]), ("(?:cat|d?)s", []), ("a(bc)d", [{"abcd"}]), ("(ab){2}", [{"abab"}]),
    ("x*yz", [{"yz"}]), ("(abc)?de", [{"de"}]), ("(?i:the)end", [{"end"}]), ("(?=foo)bar", [{"bar"}]), (r"\d\.\d\.", []), (r"a\.b", [{"a.b"}]),
])
def test_required_texts(pattern, groups):
    assert set(factors.required(pattern)) == {frozenset(g) for g in groups}


def test_required_texts_hold_in_every_match():
    rnd = random.Random(3)
    parts = ["ab", "b", "c+", "d*", "[xy]", "(?:ab|ba)", "(a|bc)", ".", "x{2}", "(?:yc)+", "[c]", "^", "$", r"\b", "(?i:Ab)", "k", "(b)?"]
    for _ in range(4000):
        pattern = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 6)))
        text = "".join(rnd.choice("abcdxyABKK") for _ in range(rnd.randrange(14)))
        for fold in (False, True):
            if re.search(pattern, text, re.IGNORECASE if fold else 0):
                seen = text.lower() if factors.folds(pattern, fold) else text
                assert all(any(t in seen for t in g) for g in factors.required(pattern, fold)), (pattern, text)


def test_candidates_and_scans_give_the_same_lines(spark):
    rnd = random.Random(7)
    words = ["the", "The", "cat", "dogs", "and", "ing ", "12", "K", "é", "tion.", "Σ", "ss"]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randrange(8))) for _ in range(400)]
    lines = spark.createDataFrame(list(enumerate(texts)), "first_pos bigint, line string")
    pats = ["the.*12", "(?:cat|dog)s?", "[0-9]+", "tion[.]$", "(?i)THE.*cat", "(", "é+", "ing the", "K|the", "", "kk", "(?:the |cat )and"]
    table = spark.createDataFrame(list(enumerate(pats)) + [(99, None)], "pattern_id bigint, pattern string").where("pattern is not null")
    for fold in (False, True):
        want = {(k, i) for k, p in enumerate(pats) if p != "(" for i, t in enumerate(texts) if re.search(p, t, re.IGNORECASE if fold else 0)}
        for strategy in ("scan", "factors"):
            rows = patterns.regex_matches(lines, table, fold, strategy=strategy).select("pattern_id", "first_pos").collect()
            assert len(rows) == len(set(rows))
            assert {tuple(r) for r in rows} == want, strategy
    with pytest.raises(ValueError, match="strategy"):
        patterns.regex_matches(lines, table, strategy="other")
