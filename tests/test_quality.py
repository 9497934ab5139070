import pytest

from lineseek.operators import corpus, membership, quality
from lineseek.sources import lines
from lineseek.sources.generators import REQUIRED_LINES


@pytest.fixture
def required(spark):
    return quality.required_lines(spark)


def test_missing_present_coverage(spark, required, corpus_of):
    have = corpus_of([REQUIRED_LINES[0], "x", "x", REQUIRED_LINES[2]])
    assert {r.line for r in corpus.missing(required, have).collect()} == {REQUIRED_LINES[1], REQUIRED_LINES[3]}
    assert {r.line for r in corpus.present(required, have).collect()} == {REQUIRED_LINES[0], REQUIRED_LINES[2]}
    c = membership.coverage(required, have).first()
    assert (c.present, c.required, c.complete) == (2, 4, False)
    assert {r.line: r.present for r in quality.required_status(required, have).collect()}[REQUIRED_LINES[1]] is False


def test_repair_by_append(spark, required, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text(f"x\n{REQUIRED_LINES[0]}\n")
    path = str(tmp_path / "c")
    quality.append_missing(spark, required, lines.read_universal(spark, path), path)
    now = lines.refreshed(spark, path)
    assert now.count() == 5 and corpus.missing(required, now).count() == 0


def test_repair_by_rewrite_puts_required_lines_first(spark, required, corpus_of, tmp_path):
    broken = corpus_of(["x", REQUIRED_LINES[1], "x", "y"])
    quality.rewrite_repaired(required, broken, str(tmp_path / "new"))
    back = lines.read_lf(spark, str(tmp_path / "new")).orderBy("pos").collect()
    got = [r.line for r in back]
    assert set(got[:4]) == set(REQUIRED_LINES) and got[4:] == ["x", "x", "y"]


def test_format_check(spark, required, tmp_path):
    good = "".join(f"{x}\n" for x in REQUIRED_LINES)
    for name, payload in (
        ("good", good.encode()), ("crlf", good.replace("\n", "\r\n").encode()), ("short", b"x\n"), ("bad", good.encode() + b"\xff\n"),
    ):
        (tmp_path / name).write_bytes(payload)
    raw = lines.read(spark, str(tmp_path), universal_newlines=False, on_bad_utf8="keep")
    got = {r.path.rsplit("/", 1)[1]: r.failed_rule for r in quality.format_check(raw, required).collect()}
    assert got == {"good": None, "crlf": "line endings", "short": "required lines", "bad": "encoding"}


def test_profile_and_sizes(spark, corpus_of):
    raw = spark.createDataFrame([("p", " abc "), ("p", ""), ("p", "abc"), ("q", "é")], "path string, raw string")
    p = quality.profile(raw, "abc").first()
    assert (p.total_lines, p.distinct_lines, p.blank_lines, p.found_line, p.found_part) == (4, 2, 1, True, True)
    assert quality.profile(raw, "b").first().found_line is False
    sizes = {r.path: (r.lines, r.distinct_lines, r.bytes) for r in quality.size_report(corpus_of(["é", "é", "x"]), ["path"]).collect()}
    assert sizes == {"a": (3, 2, 5)}


def test_samples(spark, corpus_of):
    have = corpus_of([f"l{i}" for i in range(95)])
    assert corpus.sample_entries(have, 5).collect() == corpus.sample_entries(have, 5).collect()
    assert corpus.query_sample(have).count() == 9 and corpus.query_sample(have, cap=4).count() == 4
    assert corpus.distinct_count(have, approximate=True).first()[0] in range(85, 106)
    assert lines.head(have, 10).count() == 10
    assert {r.line: r.last_line_no for r in corpus.line_index(corpus_of(["a", "b", "a"])).collect()} == {"a": 2, "b": 1}
