import os
import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Names that the operators use inside, as extra columns of the input.
CLASHES = ("node", "band", "mark", "row", "key", "label", "kept", "x", "n", "component", "hub", "length", "held_out", "spans", "words", "score")
PHRASE = " ".join(f"Wort{i} und" for i in range(40))
ODD = [
    (None, "null id " + PHRASE), (900001, None), (900002, ""), (900003, " \n\t "), (900004, "a"), (900005, "a"), (900006, PHRASE),
    (900006, PHRASE), (900007, PHRASE + " end"), (900008, "x" * 70_000), (900009, "ab " * 30_000), (900010, "É ß 😀 中文 \x1c z̈"),
    (900011, "1" * 30_000 + "." + "2" * 50), (900012, "a@b.com_x@y.zz, a@b.c.@d.e mail: q.r+s@sub.example-x.org. +1 (499) 555-6503"),
    (900013, "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 4111111111111112 +49 30 1234567-"), (900014, "line one here\nline one here\n\nline one here"),
]


@pytest.fixture(scope="session")
def given():
    if not os.path.isdir(SF):
        pytest.skip("tables not present")
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every awkward kind, with columns of clashing names."""
    extra = ", ".join(f"{c} int" for c in CLASHES)
    return spark.createDataFrame([(*r, "en", "s", 1, *range(len(CLASHES))) for r in ODD], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, given, odd):
    """The small table and the awkward rows."""
    return spark.read.parquet(f"{given}/documents.parquet").unionByName(odd, allowMissingColumns=True).repartition(4).cache()


@pytest.fixture(scope="session")
def labels(spark, given):
    return spark.read.parquet(f"{given}/labels.parquet")


def text_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def roots(nodes, links):
    parent = {i: i for i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}
