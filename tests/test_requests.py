import pytest
from pyspark.sql import functions as F

from lineseek.operators import requests
from lineseek.sources.requests import parse

RAW = {
    "search": '{"command":"search","query":"test","options":{}}',
    "alias": '{"pattern":"test","options":{"whole_line":true,"regex":false}}',
    "old names": '{"query":" x ","options":{"whole_line_match":true,"use_regex":true,"invert_match":true,"max_count":3}}',
    "plain": "plain text",
    "broken json": '{"query": "x"',
    "trailing": '{"query":"x"} and more',
    "two": '{"query":"x"},{"query":"y"}',
    "health": '{"command":"health"}',
    "unknown": '{"command":"zap"}',
    "missing": '{"options":{}}',
    "number": "123",
    "array": "[1]",
    "empty": "",
    "blank": "  \t ",
    "long": "p" * 1001,
    "limit": "p" * 1000,
    "bad regex": '{"query":"test[","options":{"regex":true}}',
    "good regex": '{"query":"test[0-9]","options":{"regex":true}}',
    "negative": '{"query":"x","options":{"max_count":-1}}',
    "huge": "h" * 5000,
    "semicolons": "7;0;6;28;0;23;5;0;",
}


@pytest.fixture
def parsed(spark):
    return parse(spark.createDataFrame(list(RAW.items()), "name string, raw string"))


def by_name(df):
    return {r.name: r for r in df.collect()}


def test_parse(parsed):
    rows = by_name(parsed)
    assert rows["search"].command == "search" and rows["search"].query == "test" and rows["search"].is_json
    assert rows["alias"].query == "test" and rows["alias"].options.whole_line and not rows["alias"].options.regex
    o = rows["old names"].options
    assert (o.whole_line, o.regex, o.invert, o.case_sensitive, o.max_count) == (True, True, True, False, 3)
    assert rows["old names"].query == "x"
    for name in ("plain", "broken json", "trailing", "two", "semicolons"):
        assert not rows[name].is_json and rows[name].query == RAW[name] and rows[name].command == "search"
    assert rows["health"].command == "health" and rows["unknown"].command == "zap"
    assert rows["missing"].query == "" and rows["number"].parse_error and rows["array"].parse_error


def test_validate(parsed):
    rows = by_name(requests.validate(parsed, max_request_bytes=4000))
    codes = {name: r.error_code for name, r in rows.items()}
    assert {n for n, c in codes.items() if c is None} == {
        "search", "alias", "plain", "broken json", "trailing", "two", "health", "limit", "good regex", "semicolons", "old names"
    }
    assert {n for n, c in codes.items() if c == "INVALID_REQUEST"} == {
        "unknown", "missing", "number", "array", "empty", "blank", "negative"
    }
    assert {n for n, c in codes.items() if c == "INVALID_PATTERN"} == {"long", "bad regex"}
    assert codes["huge"] == "REQUEST_TOO_LARGE"
    assert rows["unknown"].error_message == "Unknown command: zap" and rows["empty"].error_message == "Empty query"


def test_strict_json(spark):
    rows = parse(spark.createDataFrame([("a", "invalid json"), ("b", '{"query":"x"}')], "name string, raw string"), strict_json=True)
    assert {r.name: r.error_code for r in requests.validate(rows).collect()} == {"a": "INVALID_REQUEST", "b": None}


def test_dispatch(parsed):
    parts = requests.dispatch(requests.validate(parsed))
    assert [r.name for r in parts["health"].collect()] == ["health"]
    assert parts["metrics"].count() == 0 and parts["search"].count() == 10


def test_error_codes(spark):
    kinds = [*requests.ERROR_CODES, "other"]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    got = [r[0] for r in df.select(requests.error_code(F.col("k"))).collect()]
    assert got == [*requests.ERROR_CODES.values(), "SERVER_ERROR"]
    row = df.select(requests.error_row(F.lit("X"), F.lit("m")).alias("e")).first().e
    assert (row.code, row.message, row.details) == ("X", "m", {})


def test_client_lists(spark):
    log = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "client_ip string")
    def names(allow, deny):
        make = lambda xs: None if xs is None else spark.createDataFrame([(x,) for x in xs], "client_ip string")
        return sorted(r[0] for r in requests.permitted(log, make(allow), make(deny)).collect())
    assert names(None, None) == ["a", "a", "b", "c"]
    assert names([], []) == ["a", "a", "b", "c"]
    assert names(["a", "b"], ["b"]) == ["a", "a"]
    assert names(None, ["a"]) == ["b", "c"]


def test_request_metrics(spark):
    df = spark.createDataFrame([("abc", 2, 0.5), ("é", 0, 0.0)], "query string, count bigint, duration double")
    got = [(r.search_pattern_length, r.search_result_count, r.search_throughput) for r in requests.request_metrics(df).collect()]
    assert got == [(3, 2, 2.0), (1, 0, 0.0)]


def test_patterns_are_compiled_up_to_the_limit_in_force(spark):
    import json

    broken = "a" * 1500 + "("
    rows = [(json.dumps({"query": broken, "options": {"regex": True}}),)]
    df = parse(spark.createDataFrame(rows, "raw string"))
    assert requests.validate(df, max_pattern_chars=5000).first().error_code == "INVALID_PATTERN"
    assert requests.validate(df).first().error_message == "Query too long"


def test_requests_are_stamped_as_they_come(spark):
    rows = requests_source.stamped(spark.createDataFrame([("a",), (None,), ("a",)], "raw string")).collect()
    assert len({r.request_id for r in rows}) == 3 and all(str(uuid.UUID(r.request_id)) == r.request_id for r in rows)
    (stamp,) = {r.received_at for r in rows}
    assert abs(datetime.fromisoformat(stamp) - datetime.now(UTC)) < timedelta(minutes=2)


def test_thousands_are_set_apart(spark):
    row = spark.range(1).select(number(F.lit(1234567.891), 2, thousands=True).alias("a"), number(F.lit(1234.5), 1).alias("b")).first()
    assert tuple(row) == ("1,234,567.89", "1234.5")
