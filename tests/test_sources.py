import pytest
from pyspark.sql import functions as F

from lineseek.operators.corpus import exact_view, folded_view
from lineseek.operators.membership import lookup, single
from lineseek.operators.search import SearchOptions, search
from lineseek.sources import generators, index, lines, requests as request_sources, sinks


def texts(df):
    return [r.line for r in df.orderBy("pos").collect()]


def test_line_ends(spark, write_bytes):
    path = write_bytes("mix.txt", b"a\r\nb\rc\n d \n\nlast")
    assert texts(lines.read_universal(spark, path)) == ["a", "b", "c", "d", "last"]
    assert texts(lines.read_lf(spark, path)) == ["a", "b\rc", "d", "last"]


def test_line_numbers_count_blank_lines_and_files(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3000), ("empty.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # many splits per file
    try:
        rows = lines.read(spark, str(tmp_path))
        got = rows.where("raw <> ''").select(
            "path", "line_no", "pos", F.split("raw", " ")[0].alias("name"), F.split("raw", " ")[1].cast("bigint").alias("i")
        ).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 8000
    assert all(r.line_no == 2 * r.i and r.path.endswith(r.name) for r in got)
    assert all(r.pos == r.line_no + (10000 if r.name == "b.txt" else 0) for r in got)


def test_bad_utf8_policies(spark, write_bytes):
    path = write_bytes("bad.txt", b"test1\ntest2\n\x00\xff\x00\xff")
    with pytest.raises(Exception, match="(?i)utf"):
        lines.read_universal(spark, path).collect()
    assert texts(lines.read_universal(spark, path, "drop")) == ["test1", "test2"]
    assert lines.read_universal(spark, path, "flag").where("bad_utf8").count() == 1
    with pytest.raises(ValueError):
        lines.read_universal(spark, path, "ignore")


def test_empty_and_identical_files(spark, write_bytes):
    assert lines.read_universal(spark, write_bytes("empty.txt", b"")).count() == 0
    same = lines.read_universal(spark, write_bytes("same.txt", b"test\ntest\ntest"))
    assert exact_view(same).count() == 1
    assert lines.total_lines(lines.read(spark, write_bytes("n.txt", b"a\n\nb\n"))).first()[0] == 3


def test_case_pairs_keep_the_last_original(corpus_of):
    view = folded_view(exact_view(corpus_of(["Ab", "aB", "AB", "x"])))
    assert [r.line for r in search(view, "ab").collect()] == ["AB"]
    view = exact_view(corpus_of(["Ab", "aB", "AB", "x"]))
    assert [r.line for r in search(view, "Ab", SearchOptions(case_sensitive=True)).collect()] == ["Ab"]


def test_unicode_spaces(corpus_of):
    raws = ["\u2000test", "\u205ftest", " \t test \t ", "test  test"]
    assert {r.line for r in exact_view(corpus_of(raws)).collect()} == {"test", "test  test"}


def test_refresh_sees_changes_and_snapshot_does_not(spark, tmp_path, write_bytes):
    path = write_bytes("r.txt", b"test_line\n")
    snap = index.snapshot(spark, lines.read_universal(spark, path), str(tmp_path / "idx"))
    write_bytes("r.txt", b"new_line\n")
    ask = spark.createDataFrame([("test_line",), ("new_line",)], "query string")
    now = {r.query: r.found for r in lookup(lines.refreshed(spark, path), ask).collect()}
    then = {r.query: r.found for r in lookup(snap, ask).collect()}
    assert now == {"test_line": False, "new_line": True} and then == {"test_line": True, "new_line": False}


def test_index_serves_both_views(spark, tmp_path, corpus_of):
    corpus = corpus_of(["Ab", "x", "aB", "AB", "x", "Zed"])
    snap = index.snapshot(spark, corpus, str(tmp_path / "idx"))
    exact, folded = exact_view(corpus), folded_view(exact_view(corpus))
    assert set(index.exact(snap).select("line", "first_pos", "last_line_no", "n_occurrences").collect()) == set(
        exact.select("line", "first_pos", "last_line_no", "n_occurrences").collect()
    )
    assert set(index.folded(snap).select("line", "first_pos").collect()) == set(folded.select("line", "first_pos").collect())
    plan = single(snap, "x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(line,x)" in plan


def test_generators(spark):
    assert [r.line for r in generators.semicolon_lines(spark, 2).orderBy("line").collect()] == ["0;0;1;2;0;3;0;0;", "1;0;2;3;0;4;1;0;"]
    assert generators.random_triples(spark, 20000, 7).distinct().count() <= 1260
    assert generators.random_triples(spark, 100, 7).collect() == generators.random_triples(spark, 100, 7).collect()
    mixed = generators.mixed_lines(spark, 2000)
    assert mixed.where(F.col("line").rlike("pattern_[0-9]+$")).count() == 1500
    assert mixed.where(F.col("line").rlike("^common")).count() == 500
    assert {len(r.line) for r in generators.random_text(spark, 10, 100, 3).collect()} == {100}
    assert generators.numbered_lines(spark, 3).collect()[2].line == "test_line_2"


def test_whole_files_and_sinks(spark, tmp_path, write_bytes):
    assert lines.whole_files(spark, write_bytes("w.txt", b"abc")).first().length == 3
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, ms double")
    for kind in sinks.FORMATS:
        sinks.write_result(df, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_report(df, str(tmp_path / "report"), "Times", "name", "ms", "ms")
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["Times", "=====", "a: 1.50ms", "b: 2.00ms"]
    with pytest.raises(ValueError):
        sinks.write_result(df, str(tmp_path / "x"), "xml")
    out = df.select(sinks.response_json(F.array("name"), F.lit(1), F.col("ms")).alias("j")).first().j
    assert out == '{"success":true,"matches":["a"],"count":1,"duration":1.5}'


def test_service_log_roundtrip(spark):
    rows = [("it's 'x' | IP: 9 | Result: no", "10.0.0.1", True, 0.25, 50.0), ("plain", "h", False, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "q string, ip string, ok boolean, ms double, rate double")
    log = df.select(
        request_sources.service_log_line(
            F.col("ok"), F.col("q"), F.col("ip"),
            F.when(F.col("ok"), "STRING EXISTS").otherwise("STRING NOT FOUND"), F.col("ms"), F.col("rate"),
        ).alias("value")
    ).unionByName(spark.createDataFrame([("other line",)], "value string"))
    back = request_sources.parse_service_log(log).orderBy("query").collect()
    assert [(r.query, r.client_ip, r.found, r.duration_ms, r.hit_rate) for r in back] == sorted(rows)
