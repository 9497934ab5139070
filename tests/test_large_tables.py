"""Queries on small tables of the test's own that look like larger or odder ones."""

import numpy as np
import pytest

from lineseek.operators import automaton, patterns, search
from lineseek.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    """Rows -> a table of the given name in a folder of its own; ``files`` makes it a folder of so many files."""

    def make(name, rows, schema, files=2):
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


DOCUMENTS = "doc_id bigint, text string, lang string"


def test_whole_files_of_any_language(spark, tables):
    rows = [(1, "a\nbé", "en"), (2, "c", None), (3, "\n\n", ""), (4, "d", "a/b=c%2F"), (5, None, "xx"), (6, "e\rf", "en")]
    sf = tables("documents", rows, DOCUMENTS)
    got = {tuple(r) for r in catalog.queries()["whole_file_sizes"](spark, sf).select("lang", "n_bytes", "n_lines").collect()}
    assert got == {("en", 10, 3), ("und", 2, 1), ("", 3, 3), ("a/b=c%2F", 2, 1)}


def test_streams_read_tables_of_several_files(spark, tables):
    sf = tables("documents", [(1, "a\nb", "en"), (2, "b\n c ", "en"), (3, "", "en")], DOCUMENTS)
    tables("conversations", [(1, 0, "user", "b\nx")], "conv_id bigint, turn int, role string, text string", 1)
    grown = catalog.queries()["stream_corpus_growth"](spark, sf).collect()
    assert sorted(r.line for r in grown) == ["a", "b", "c"]
    found = catalog.queries()["stream_membership"](spark, sf).collect()
    assert {(r.query, r.found) for r in found} == {("b", True), ("x", False)}


def test_matches_carry_only_what_is_asked(spark):
    """Long lines with many matches: no text goes with them, whatever the patterns' lengths."""
    rows = [(i, "ab " * 400 + "x" * (i % 90)) for i in range(40)]
    lines = spark.createDataFrame(rows, "first_pos bigint, line string")
    words = ["a", "ab", "b a", "ab ab ab ab", "x" * 60, "x" * 80, "nowhere"]
    pats = spark.createDataFrame(list(enumerate(words)), "pattern_id bigint, pattern string")
    hits = patterns.substring_matches(lines, pats, strategy="trie", kept=["first_pos"])
    assert hits.columns == ["pattern_id", "first_pos"]
    assert sorted(map(tuple, hits.collect())) == sorted((i, n) for i, w in enumerate(words) for n, t in rows if w in t)
    places = patterns.offsets_of_many(lines, pats, kept=["first_pos"])
    want = [
        (i, n, k, k == t.find(w)) for i, w in enumerate(words) for n, t in rows for k in range(len(t)) if t.startswith(w, k)
    ]
    assert sorted(map(tuple, places.collect())) == sorted(want)


def test_texts_are_sent_on_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(automaton, "SENT_CHARS", 100)
    monkeypatch.setattr(automaton, "SENT", 4)
    sizes = [10] * 6 + [500, 60, 60, 1]
    runs = [sizes[k] for k in automaton._runs(np.array(sizes))]
    assert sum(runs, []) == sizes and all(len(r) <= 4 and (len(r) == 1 or sum(r) <= 100) for r in runs)


def test_first_matches_are_cut_in_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "CUT_ROWS", 7)
    monkeypatch.setattr(search, "HELD_ROWS", 20)
    rows = [(i % 9, (i * 7919) % 1009 if i % 50 else None, f"t{i}") for i in range(900)] + [(None, 1, "none")]
    hits = spark.createDataFrame(rows, "query_id bigint, first_pos bigint, line string").repartition(3)
    got = sorted((r.query_id, -1 if r.first_pos is None else r.first_pos) for r in search.first_matches(hits, 5).collect())
    want = [(q, p) for q in range(9) for p in sorted(-1 if r[1] is None else r[1] for r in rows if r[0] == q)[:5]]
    assert got == want


def test_lines_of_one_position_count_once(spark, tables):
    sf = tables("documents", [(1, "ab ab", "en"), (1, "xab", "en"), (2, "ab", "en"), (None, "ab q", "en"), (None, "ab r", "en")], DOCUMENTS)
    tables("benchmark", [(1, "ab x")], "item_id bigint, text string", 1)
    got = {tuple(r) for r in catalog.queries()["multi_pattern_offsets"](spark, sf).select("pattern", "n_places", "n_lines", "sum_offset").collect()}
    assert got == {("ab", 6, 3, 4), ("x", 1, 1, 0)}
