import random

import pytest
from pyspark.sql import functions as F

from lineseek.operators import automaton, corpus, membership, patterns
from lineseek.operators.search import SearchOptions, result_counts, result_lists, search
from lineseek.sources import index
from lineseek.sources.generators import REQUIRED_LINES

FOUR = ["test line 1", "test line 2", "another test line", "final test line"]


@pytest.fixture
def views(corpus_of):
    exact = corpus.exact_view(corpus_of(FOUR))
    return exact, corpus.folded_view(exact)


@pytest.mark.parametrize(
    "query, options, count",
    [
        ("test", {}, 4), ("line", {}, 4), ("1", {}, 1), ("final", {}, 1), ("xyz", {}, 0), ("TEST", {}, 4),
        ("test line 1", {"whole_line": True}, 1), ("test line", {"whole_line": True}, 0),
        ("TEST", {"case_sensitive": True}, 0), (r"test.*\d", {"regex": True}, 2),
        (r"test.*\d", {"regex": True, "whole_line": True}, 2), ("final", {"invert": True}, 3),
        ("zzz", {"invert": True, "whole_line": True}, 4), ("test", {"max_count": 2}, 2), ("test", {"max_count": 0}, 4),
        (r"\D", {"regex": True}, 4), (r"^\D+$", {"regex": True}, 2), (r"1|2", {"regex": True, "invert": True}, 2),
    ],
)
def test_counts(views, query, options, count):
    chosen = SearchOptions(**options)
    view = views[0] if chosen.case_sensitive else views[1]
    assert search(view, query, chosen).count() == count


def test_max_count_takes_the_first_lines(views):
    assert [r.line for r in search(views[1], "test", SearchOptions(max_count=2)).collect()] == FOUR[:2]


def test_rejected_searches(views):
    for query, options in (("", {}), ("test[", {"regex": True})):
        with pytest.raises(ValueError):
            search(views[1], query, SearchOptions(**options))
    with pytest.raises(ValueError):
        SearchOptions(max_count=-1)
    with pytest.raises(ValueError):
        SearchOptions.from_request({"fuzzy": True})
    assert SearchOptions.from_request({"whole_line_match": True, "use_regex": True}) == SearchOptions(whole_line=True, regex=True)


def test_required_lines(spark, corpus_of):
    lines = corpus_of([*REQUIRED_LINES, *(f"{i};0;{i + 1};{i + 2};0;{i + 3};{i % 5};0;" for i in range(1000))])
    assert corpus.exact_view(lines).count() == 1004
    asked = [*REQUIRED_LINES, "nonexistent1", "test_string_xyz", "invalid;format", "7;0;6;28;0;23;5;", "", "  " + REQUIRED_LINES[0]]
    queries = membership.prepare(spark.createDataFrame([(q,) for q in asked], "query string"))
    want = {q.strip(): q.strip() in REQUIRED_LINES for q in asked}
    for strategy in (membership.lookup, membership.lookup_sorted):
        assert {r.query: r.found for r in strategy(lines, queries).collect()} == want
    assert {r.query: r.maybe for r in membership.lookup_by_hash(lines, queries).collect()} == want
    maybe = {r.query: r.maybe for r in membership.lookup_by_filter(lines, queries, bits=1 << 20).collect()}
    assert all(maybe[q] for q, found in want.items() if found)
    assert membership.single(lines, " " + REQUIRED_LINES[1] + "\0").count() == 1
    assert membership.single(lines, "").count() == 0


def test_edge_needles_are_absent(spark, corpus_of):
    lines = corpus_of(FOUR)
    needles = ["\0\0", "te\x01st", "\\", '"', "'", ";", "|", "&", "你好", "Привет", "\U0001f31f"]
    asked = membership.prepare(spark.createDataFrame([(q,) for q in needles], "query string"))
    assert membership.lookup(lines, asked).where("found").count() == 0


def test_membership_with_a_hot_query_and_a_hot_line(spark, corpus_of):
    lines = corpus_of(["hot"] * 500 + [f"l{i}" for i in range(1000)])
    queries = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"l{i}") for i in range(1500)], "id bigint, query string")
    out = membership.lookup(lines, queries)
    assert out.count() == 1500 and out.where("found").count() == sum(1 for i in range(1500) if i % 3 == 0 or i < 1000)


def test_past_the_broadcast_bound(spark, corpus_of, monkeypatch):
    """The same answers when nothing may be broadcast."""
    monkeypatch.setattr(membership, "broadcast_if_small", lambda df, **k: df)
    monkeypatch.setattr(patterns, "fits", lambda df, **k: False)
    lines = corpus_of(FOUR)
    queries = spark.createDataFrame([("test line 1",), ("no",)], "query string")
    assert {r.query: r.found for r in membership.lookup(lines, queries).collect()} == {"test line 1": True, "no": False}
    check_patterns(spark, corpus_of)


def brute(lines, pats):
    return {(i, p) for p, text in enumerate(pats) for i, line in enumerate(lines) if text in line}


def check_patterns(spark, corpus_of):
    rnd = random.Random(5)
    alphabet = "ab é\U0001f31f;"
    lines = list({"x" + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) + "x" for _ in range(120)})
    pats = {"zzz", "zzzzzzzzzzzzzzzzzzzzz"}
    for size in (1, 2, 3, 4, 5, 6, 7, 11, 15, 16, 17, 23, 40):
        for _ in range(7):
            line = rnd.choice(lines)
            at = rnd.randint(0, max(0, len(line) - size))
            pats.add(line[at:at + size].strip() or "a")
    pats = sorted(pats)
    view = corpus.exact_view(corpus_of(lines)).select("line", "first_pos")
    table = spark.createDataFrame(list(enumerate(pats)), "pattern_id bigint, pattern string")
    want = sorted((p, i) for i, p in brute(lines, pats))
    for strategy in ("grams", "scan", "trie", "auto"):
        got = patterns.substring_matches(view, table, strategy=strategy).select("pattern_id", "first_pos").collect()
        assert sorted(map(tuple, got)) == want, strategy


def test_pattern_strategies_agree_with_brute_force(spark, corpus_of):
    check_patterns(spark, corpus_of)


def test_more_regexes_than_one_scan_takes(spark, corpus_of, monkeypatch):
    monkeypatch.setattr(patterns, "PER_SCAN", 2)
    view = corpus.exact_view(corpus_of(FOUR)).select("line", "first_pos")
    table = spark.createDataFrame(list(enumerate(["1$", "2$", "^a", "test", "bad["])), "pattern_id bigint, pattern string")
    got = sorted(map(tuple, patterns.regex_matches(view, table).select("pattern_id", "first_pos").collect()))
    assert got == [(0, 0), (1, 1), (2, 2), (3, 0), (3, 1), (3, 2), (3, 3)]
    nothing = patterns.regex_matches(view, table.limit(0))
    assert nothing.count() == 0 and nothing.columns == ["pattern_id", "line", "first_pos"]


def test_offsets_overlap(spark, corpus_of):
    view = corpus.exact_view(corpus_of(["aaaa", "banana", "xyz", "a.a.a", "\U0001f31fana"])).select("line", "first_pos")
    def places(needle):
        return sorted((r.line, r.offset) for r in patterns.offsets(view, needle).collect())
    assert places("aa") == [("aaaa", 0), ("aaaa", 1), ("aaaa", 2)]
    assert places("ana") == [("banana", 1), ("banana", 3), ("\U0001f31fana", 1)]
    assert places("a.a") == [("a.a.a", 0), ("a.a.a", 2)]
    assert places("q") == []


def test_prefixes(spark, corpus_of):
    lines = corpus_of(["alpha", "beta", "alphabet"])
    queries = spark.createDataFrame([(q,) for q in ("al", "alphabet", "alphabets", "b", "lpha", "")], "query string")
    got = {r.query: r.found for r in membership.prefix_exists(lines, queries).collect()}
    assert got == {"al": True, "alphabet": True, "alphabets": False, "b": True, "lpha": False, "": False}


@pytest.mark.parametrize("strategy_limit", [0, 3, 200])
def test_batch_search_equals_single_searches(spark, views, corpus_of, strategy_limit, monkeypatch):
    monkeypatch.setattr(patterns, "TESTS_PER_WALK", strategy_limit)
    table = index.build(corpus_of([*FOUR, FOUR[0], "Final TEST line"]))
    views = index.exact(table), index.folded(table)
    cases = [
        ("test", {}), ("TEST", {"case_sensitive": True}), ("test line 1", {"whole_line": True}), (r"\d$", {"regex": True}),
        ("final", {"invert": True}), ("line", {"max_count": 2}), ("Line 1", {}), ("zzz", {}), ("test line 1", {"whole_line": True, "invert": True}),
        ("T", {"max_count": 1, "invert": True}), ("test", {"case_sensitive": True, "max_count": 0}),
    ]
    rows = []
    for i, (q, o) in enumerate(cases):
        c = SearchOptions(**o)
        rows.append((i, q, c.case_sensitive, c.whole_line, c.regex, c.invert, c.max_count))
    queries = spark.createDataFrame(
        rows, "query_id bigint, query string, case_sensitive boolean, whole_line boolean, regex boolean, invert boolean, max_count int"
    )
    exact, folded = views
    got = sorted((r.query_id, r.line) for r in patterns.batch_search(table, queries).collect())
    want = []
    for i, (q, o) in enumerate(cases):
        c = SearchOptions(**o)
        want += [(i, r.line) for r in search(exact if c.case_sensitive else folded, q, c).collect()]
    assert got == sorted(want)
    counts = {r.query_id: r["count"] for r in result_counts(queries, patterns.batch_search(table, queries)).collect()}
    assert counts[7] == 0 and counts[0] == 4 and counts[10] == 4


def test_result_lists(spark, views):
    queries = spark.createDataFrame([(0, "a"), (1, "b")], "query_id bigint, query string")
    matches = views[0].select(F.lit(0).cast("bigint").alias("query_id"), "line", "first_pos")
    got = {r.query_id: (r.matches, r["count"]) for r in result_lists(queries, matches, 2).collect()}
    assert got == {0: (FOUR[:2], 2), 1: ([], 0)}
    with pytest.raises(ValueError):
        result_lists(queries, matches, 0)


def test_raw_containment_differs_from_line_match(spark):
    raw = spark.createDataFrame([("  7;0;6;28  ",)], "raw string")
    assert membership.any_line_contains(raw, "0;6").first()[0] is True
    assert membership.any_line_contains(raw, "  7").first()[0] is True
    assert membership.any_line_contains(raw.limit(0), "x").first()[0] is False


def test_strategies_agree_on_bytes_that_are_not_utf8(spark):
    raw = spark.createDataFrame([(1, bytearray(b"\xc3(needle in hay\xff needle")), (2, bytearray(b"ok needle")), (3, bytearray(b"none"))], "first_pos bigint, b binary")
    lines = raw.select("first_pos", F.col("b").cast("string").alias("line"))
    wanted = spark.createDataFrame([(7, "needle in"), (8, "needle"), (9, "ay� ne")], "pattern_id bigint, pattern string")
    found = [
        {(r.pattern_id, r.first_pos) for r in patterns.substring_matches(lines, wanted, strategy=s).select("pattern_id", "first_pos").collect()}
        for s in ("scan", "grams", "auto")
    ]
    assert found[0] == found[1] == found[2] == {(7, 1), (8, 1), (8, 2), (9, 1)}


def all_places(lines, pats):
    return sorted((p, i, k) for i, line in enumerate(lines) for p, text in enumerate(pats) for k in range(len(line)) if line.startswith(text, k))


def test_offsets_of_many_patterns_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    lines = ["".join(rnd.choice("abé𝄞 ") for _ in range(rnd.randrange(60))) for _ in range(60)] + ["a" * 40, "", "abab" * 9]
    pats = sorted({line[k:k + n] for line in lines for n in (1, 2, 3, 5, 6, 7, 9, 13, 20) for k in [rnd.randrange(40)] if line[k:k + n]})
    view = spark.createDataFrame(list(enumerate(lines)), "first_pos long, line string")
    table = spark.createDataFrame([*enumerate(pats), (-1, ""), (-2, None)], "pattern_id long, pattern string")
    for strategy, chunk in (("auto", 1 << 20), ("auto", 16), ("grams", 1 << 20)):
        monkeypatch.setattr(automaton, "CHUNK", chunk)
        got = patterns.offsets_of_many(view, table, strategy=strategy).select("pattern_id", "first_pos", "offset").collect()
        assert sorted(map(tuple, got)) == all_places(lines, pats), (strategy, chunk)
    assert patterns.offsets_of_many(view, table.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 512])
def test_offsets_of_one_text_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "PIECES", block)
    lines = ["aaaaaa", "baab aab", "x", "", "é𝄞aa", "aa" * 700]
    view = spark.createDataFrame(list(enumerate(lines)), "first_pos long, line string")
    got = patterns.offsets(view, "aa").select("first_pos", "offset").collect()
    assert sorted(map(tuple, got)) == [(i, k) for _, i, k in all_places(lines, ["aa"])]


def test_short_patterns_walk_within_groups_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(automaton, "CHUNK", 8)
    lines = spark.createDataFrame(
        [(1, "the cat", True), (2, "the cat", False), (3, None, True), (4, "x" * 50 + "cat", True), (5, "cat", None)], "first_pos long, line string, kind boolean")
    pats = spark.createDataFrame([(1, "cat", True), (2, "cat", False), (3, "the", True), (4, "cat", True), (5, "cat", None)], "pattern_id long, pattern string, kind boolean")
    got = patterns.substring_matches(lines, pats, strategy="trie", within=("kind",))
    assert got.columns == ["pattern_id", "first_pos", "line", "kind"]
    assert sorted((r.pattern_id, r.first_pos) for r in got.collect()) == [(1, 1), (1, 4), (2, 2), (3, 1), (4, 1), (4, 4)]
    monkeypatch.setattr(automaton, "MAX_ENTRIES", 3)
    assert automaton.short_matches(lines, pats, "line", ("kind",)) is None
    again = patterns.substring_matches(lines, pats, strategy="trie", within=("kind",))
    assert sorted(map(tuple, again.select("pattern_id", "first_pos").collect())) == [(1, 1), (1, 4), (2, 2), (3, 1), (4, 1), (4, 4)]


QUERIES = "query_id bigint, query string, case_sensitive boolean, whole_line boolean, regex boolean, invert boolean, max_count int"


def test_queries_that_differ_in_their_limits_are_one_search(spark, corpus_of, monkeypatch):
    table = index.build(corpus_of([f"aa {i}" for i in range(30)]))
    queries = spark.createDataFrame([(i, "a+", False, False, True, False, i) for i in range(1, 12)], QUERIES)
    asked, passes = [], patterns._passes
    monkeypatch.setattr(patterns, "_passes", lambda lines, pats, test: asked.append(pats.count()) or passes(lines, pats, test))
    got = patterns.batch_search(table, queries).groupBy("query_id").agg(F.count("line").alias("n"), F.max("first_pos").alias("last")).collect()
    assert {r.query_id: r.n for r in got} == {i: i for i in range(1, 12)}
    first = sorted(r.first_pos for r in table.select("first_pos").collect())
    assert {r.query_id: r["last"] for r in got} == {i: first[i - 1] for i in range(1, 12)}
    assert sum(asked) == 1


def test_long_patterns_meet_few_candidates(spark, corpus_of, monkeypatch):
    rng, common = random.Random(3), "the nation of the station and the ration "
    texts = [common * 6 + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) + f" {common * 2}" for _ in range(40)]
    lines = corpus.exact_view(corpus_of([f"x {t} y" for t in texts])).select("line", "first_pos")
    pats = spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts)] + [(100 + i, t[200:320].strip()) for i, t in enumerate(texts)], "pattern_id bigint, pattern string")
    sizes, write = {}, patterns.materialise

    def counted(df, label):
        sizes[label] = (out := write(df, label)).count()
        return out

    monkeypatch.setattr(patterns, "fits", lambda df: False)
    monkeypatch.setattr(patterns, "materialise", counted)
    got = {(r.pattern_id, r.line) for r in patterns.substring_matches(lines, pats, strategy="grams").collect()}
    assert got == {(i, f"x {t} y") for i, t in enumerate(texts)} | {(100 + i, f"x {t} y") for i, t in enumerate(texts)}
    # a gram of nine characters of the common words stands in every line
    assert sizes["pairs"] < 40 * len(texts) * 4


def test_factored_regexes_shuffle_no_line(spark, corpus_of):
    lines = corpus.exact_view(corpus_of([*FOUR, "first of the final lines"])).select("line", "first_pos").coalesce(1)
    lines = lines.localCheckpoint()
    pats = spark.createDataFrame([(1, "final[a-z]* .*line"), (2, "(test|first).*(lines?|of)"), (3, "zzz+")], "pattern_id bigint, pattern string")
    hits = patterns.regex_matches(lines, pats, strategy="factors")
    want = {(1, "final test line"), (1, "first of the final lines"), (2, "first of the final lines")} | {(2, t) for t in FOUR}
    assert sorted((r.pattern_id, r.line) for r in hits.collect()) == sorted(want)
    one = patterns.regex_matches(lines, pats.where("pattern_id <> 2"), strategy="factors")
    assert "hashpartitioning(first_pos" not in one._jdf.queryExecution().toString()
