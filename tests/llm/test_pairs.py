"""Near duplicates, repeated passages, wrappers and the pipeline against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lineseek.llm import embed, html, minhash, passages
from lineseek.llm.components import components
from lineseek.llm.common import Scratch
from tests.llm.conftest import FOLD, WORD, roots, text_of


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(FOLD))
        out[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    return out


def brute_components(texts, size, percent=80):
    s = sets_of(texts, size)
    ids = sorted(s)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return s, roots(ids, links)


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(300, 300)] + [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(60)]
    want = roots({x for p in links for x in p}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(documents, none, size):
    texts = text_of(documents.where("doc_id is not null"))
    s, want = brute_components(texts, size)
    rows = minhash.near_duplicates(documents, size).collect()
    assert len(rows) == documents.count()
    for r in rows:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(none, size).count() == 0


def test_near_duplicates_at_the_edge_and_in_large_groups(spark):
    rnd = random.Random(9)
    rows, n = [], 0
    base = [f"w{i}" for i in range(120)]
    for k in range(150):  # many near copies, some of which only others reach
        words = list(base)
        for _ in range(rnd.randrange(1, 5)):
            words[rnd.randrange(120)] = f"x{rnd.randrange(3)}"
        rows.append((n := n + 1, " ".join(words)))
    for k in range(60):  # shared half, different rest
        rows.append((n := n + 1, " ".join(base[:60] + [f"y{k}_{i}" for i in range(60)])))
    for k in range(40):  # few words
        rows.append((n := n + 1, " ".join(f"s{(k // 2 + i) % 9}" for i in range(4 + k % 5))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, want = brute_components(dict(rows), 4)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 4).collect()} == want


def test_one_document_of_each_group(odd):
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(900006) == 1 and 900007 not in ids and None in ids and {900001, 900002, 900003} <= set(ids) and 900005 not in ids


def brute_passages(texts, least=50):
    first, need = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i].translate(FOLD))
        for j in range(len(w) - least + 1):
            f = first.setdefault(tuple(w[j : j + least]), i)
            if f != i:
                need.setdefault(i, set()).update(range(j, j + least))
    return need


def runs_of(text):
    w = WORD.findall(text.translate(FOLD))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute_near(texts, docs, width=46, percent=80):
    """Of these documents, those with a 50-word window that is near one of an earlier document."""
    runs = {i: runs_of(t) for i, t in texts.items()}
    places = {}
    for i, own in runs.items():
        for at, run in enumerate(own):
            places.setdefault(run, {}).setdefault(i, []).append(at)
    out = set()
    for doc in docs:
        for at in range(len(runs[doc]) - width + 1):
            window = set(runs[doc][at : at + width])
            near = {}
            for run in window:
                for other, where in places[run].items():
                    if other < doc:
                        near.setdefault(other, set()).update(where)
            for other, where in near.items():
                for start in {max(0, p - d) for p in where for d in (0, 10, 20, 30, 45)} if len(where) >= 41 else ():
                    theirs = set(runs[other][start : start + width])
                    if 100 * len(window & theirs) >= percent * len(window | theirs):
                        out.add(doc)
            if doc in out:
                break
    return out


def test_near_passages_are_found_end_to_end(spark):
    """Near copies of 50 to 69 words, each pair half the time behind an earlier text that holds a part of both."""
    rnd = random.Random(12)
    own = lambda n: [f"o{rnd.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], 200
    for k in range(pairs):
        first = own(50 + k % 20)
        second = list(first)
        second[rnd.randrange(len(first))] = "changed"
        if k % 2:
            cut = rnd.randrange(len(first) - 25)
            rows.append((k, " ".join(own(20) + first[cut : cut + 25] + own(20))))
        rows += [(1000 + k, " ".join(own(15) + first + own(15))), (2000 + k, " ".join(own(9) + second + own(30)))]
    found = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "source_id").distinct().collect()
    near = {k for k in range(pairs) if brute_near({i: t for i, t in rows if i % 1000 == k}, [2000 + k])}
    got = {r.doc_id - 2000 for r in found if r.doc_id - 1000 == r.source_id}
    assert len(near) >= 0.9 * pairs
    assert len(near & got) >= 0.95 * len(near)


def test_minima_are_the_nodes_of_the_cartesian_tree():
    rnd = np.random.default_rng(3)
    for n in (0, 5, 6, 7, 50, 200):
        values = rnd.integers(0, 2**63, n).astype(np.uint64)
        want, todo = set(), [(0, n)]
        while todo:
            a, b = todo.pop()
            if b - a >= 6:
                c = a + int(np.argmin(values[a:b]))
                want.add(c)
                todo += [(a, c), (c + 1, b)]
        starts, at = passages.minima(values, np.array([0, n]), 6)
        assert set(at.tolist()) == want and len(starts) == max(0, n - 5)


def test_passages_equal_brute_force(spark, documents, none):
    rnd = random.Random(8)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    shared = [" ".join(f"p{k}q{rnd.randrange(10**6)}" for _ in range(50 + k)) for k in range(12)]
    for k in range(200):
        own = lambda n: " ".join(f"o{rnd.randrange(10**7)}" for _ in range(n))
        middle = shared[k % 12] if k % 3 else "a common line that stands in many of the texts here"
        rows.append((10**6 + k, f"{own(30 + k % 20)} {middle} {own(20)}"))
    near = shared[4].split()
    near[25] = "changed"
    rows.append((2 * 10**6, "begin " + " ".join(near + ["and"] + near[:3]) + " finish"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = {i: t or "" for i, t in rows if i is not None}
    need, got = brute_passages(texts), {}
    words = {i: WORD.findall(t.translate(FOLD)) for i, t in texts.items()}
    for r in passages.repeated(df).collect():
        assert r.source_id < r.doc_id and r.end_word - r.start_word >= 50
        x, y = set(runs_of(" ".join(words[r.doc_id][r.start_word : r.end_word]))), set(runs_of(" ".join(words[r.source_id][r.source_start : r.source_end])))
        assert 100 * len(x & y) >= 80 * len(x | y) and abs(r.similarity - len(x & y) / len(x | y)) < 1e-9
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for doc, words in need.items():
        assert words <= got.get(doc, set()), doc
    assert {2 * 10**6} <= set(got)
    near = brute_near(texts, set(texts) - set(need))
    assert len(near & set(got)) >= 0.9 * len(near)
    assert passages.repeated(none).count() == 0
    cut = passages.remove_repeats(df)
    assert cut.columns == df.columns
    after = {r.doc_id: r.text or "" for r in cut.where("doc_id is not null").collect()}
    assert not brute_passages(after)
    assert all(after[i] == t for i, t in texts.items() if i not in got and i in after)
    assert {i for i in texts if i not in after} <= set(got)


def test_near_passages_share_a_signature():
    rnd = np.random.default_rng(4)
    missed = 0
    for _ in range(2000):
        a = rnd.integers(0, 2**63, 46).astype(np.uint64)  # 46 runs, 41 of them alike: similarity 0.8
        b = a.copy()
        b[20:25] = rnd.integers(0, 2**63, 5).astype(np.uint64)
        missed += not np.intersect1d(*(passages.signatures(x, np.array([0, 46]), 46)[0] for x in (a, b))).size
    assert missed <= 10


def test_passages_behind_a_common_phrase(spark):
    rnd = random.Random(5)
    own = lambda n: [f"o{rnd.randrange(10**9)}" for _ in range(n)]
    phrase, short, after, before = own(44), own(12), own(12), own(40)
    texts = [own(20) + phrase + own(20), own(20) + short + own(9) + short + own(20)]
    texts += [own(30) + phrase + after + own(n) for n in (20, 25)]  # an earlier text holds most of it
    texts += [own(9) + before[:k] + phrase + own(9) for k in (3, 5)]
    texts += [own(5) + before + short + own(4) for _ in range(2)]  # and one that holds a short phrase at several places
    texts += [own(20) + short + own(9) + short + before + own(20) for _ in range(2)]
    twice = own(30)
    texts += [own(9) + twice + own(30) + twice + after + before + own(9), own(9) + twice + after + before + own(9)]
    for _ in range(30):
        phrase, after = own(44), own(6)
        texts += [own(20) + phrase + own(20), *(own(20) + phrase + after + own(20) for _ in range(2))]
    rows = {i: " ".join(t) for i, t in enumerate(texts)}
    got = {}
    for r in passages.repeated(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    want = brute_passages(rows)
    assert {3, 7, 9, 11} <= set(want)
    for doc, words in want.items():
        assert words <= got.get(doc, set()), doc


def test_passages_of_texts_that_repeat_themselves(spark):
    """Runs of one word and of a few, of all lengths, alone and with equal words around them; and not round by round."""
    rnd = random.Random(15)
    own = lambda n: [f"o{rnd.randrange(10**9)}" for _ in range(n)]
    runs = [["la"], ["da", "di"], ["x", "y", "z"]]
    after, before = own(44), own(44)
    texts = [own(3) + run * (30 // len(run)) + own(3) for run in runs]
    for run in runs:
        for n in (7, 20, 49, 51, 60, 90, 150):
            repeated = (run * n)[rnd.randrange(3) :][:n]
            texts += [own(5) + repeated + own(5), own(5) + repeated + after + own(4), own(2) + before + repeated + own(7)]
    rows = {i: " ".join(t) for i, t in enumerate(texts)}
    got = {}
    for r in passages.repeated(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    want = brute_passages(rows)
    assert len(want) > 30
    for doc, words in want.items():
        assert words <= got.get(doc, set()), doc


def test_embeddings_equal_brute_force(spark, given):
    rnd = np.random.default_rng(7)
    rows = []
    for label in (0, 1):
        centre = rnd.standard_normal((30, 16))
        for i in range(300):
            v = centre[i % 30] + rnd.standard_normal(16) * rnd.choice([0.0, 0.05, 0.2])
            rows.append((label * 1000 + i, v.astype(np.float32).tolist(), label, i))
    special = [(5001, None, 1), (5002, [0.0] * 16, 1), (5003, [float("nan")] * 16, 1), (5004, [1.0, None], 1), (5005, [1.0] * 16, None), (5006, [1.0] * 16, None),
               (5007, [], 1), (5008, [2.0] * 16, 1), (5009, [4.0] * 16, 1), (5010, [1.0, 1.0], 1), (5011, [float("inf")] * 16, 1), (5012, [1e30] * 16, 1)]
    rows += [(*r, 0) for r in special]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block int")
    good = [(i, np.array(v, float), lab) for i, v, lab, _ in rows if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None]
    links = []
    for k, (a, v, x) in enumerate(good):
        for b, w, y in good[k + 1 :]:
            if x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links.append((a, b))
    root = roots([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    old = embed.SIDE
    for side in (old, 40):
        embed.SIDE = side
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(df).collect()}
        assert got == {i: (count[i], root[i], root[i] == i) for i in count}
    embed.SIDE = old
    assert embed.near_duplicates(df.where("false")).count() == 0


PAGE = """<!doctype html><html><head><title>No &amp; no</title><style>p{{}}</style></head><body class="home"><header>Site</header>
<nav><ul><li><a href="/a">A</a><li>B</ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside>
{open}<h1>Title {n} &eacute;</h1><!-- no --><p class=x title="a > b">First <b>bo</b>ld {n}<br>next&nbsp;line<p>Second {n} &lt;tag&gt;
<script>var x = "</p>no";</script><div class="ad">Buy</div><form><input value=q>Send</form><ul><li>one {n}<li>two</ul>{close}
<div id="comments"><p>Reader says {n}</p></div><footer>&copy; us</footer>"""


@pytest.mark.parametrize("shape", [("<article>", "</article>"), ("<div class='post-content'>", "</div>"), ("<div><div>", "</div></div>")])
def test_main_text_of_templates(spark, shape):
    rows = [(n, f"http://a.example/{n}", PAGE.format(n=n, open=shape[0], close=shape[1]), n) for n in range(8)]
    rows += [(100, "http://b.example/x", None, 0), (101, None, "", 0), (102, "no url", "plain <b>te</b>xt &amp; more", 0), (103, "http://a.example/9", "<nav>x</nav>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in html.main_text(df).collect()}
    for n in range(8):
        assert got[n].text == f"Title {n} é First bold {n} next line Second {n} <tag> one {n} two"
        assert got[n].n_chars == len(got[n].text) and got[n].url.endswith(f"/{n}")
    assert got[100].text == "" and got[101].text == "" and got[102].text == "plain text & more" and got[103].text == ""
    assert html.main_text(df.where("false")).count() == 0


def test_wrapper_is_a_union_free_expression():
    a, b = html.tree("<div><p>one</p><p>two</p><i>x</i></div>"), html.tree("<div><h2>same</h2><p>three</p></div>")
    assert html.expression(html.merge(a, b)) == '<div>(<h2>"same"</>)?(<p>#TEXT</>)+(<i>"x"</>)?</>'


def test_pipeline_stages_equal_their_parts(spark, documents, labels, given):
    docs = documents
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "passage_dedup", "personal_data", "pack"]
    kept = {}
    for name in ("quality", "near_dedup", "passage_dedup", "personal_data"):
        before = text_of(docs)
        docs = Scratch(spark, "test").keep(name, stages[name](spark, docs, given))
        assert docs.columns == documents.columns
        kept[name] = text_of(docs)
        if name == "near_dedup":
            _, want = brute_components({i: t for i, t in before.items() if i is not None}, 5)
            assert {i for i in kept[name] if i is not None} == {i for i, c in want.items() if i == c}
        if name == "passage_dedup":
            assert not brute_passages({i: t for i, t in kept[name].items() if i is not None})
            changed = {i for i in kept[name] if kept[name][i] != before[i]}
            assert changed <= set(brute_passages({i: t for i, t in before.items() if i is not None})) | changed
    packed = stages["pack"](spark, docs, given).collect()
    assert {r.doc_id for r in packed} == set(kept["personal_data"])


def test_pipeline_runs(spark, given):
    assert corpus_pipeline.run(spark, given).count() > 0
