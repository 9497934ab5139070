import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lineseek.functions import regex, verdicts
from lineseek.functions.hashing import bit_address, trace_bound, trace_sampled
from lineseek.functions.text import WHITESPACE, decode_lossy, normalise_query, number, strip


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_equals_python(spark):
    texts = [" a ", "\t x ", "\u3000a b\u2000", "\x1cq\x1f", "", " \n ", "\u200bzero width", "\x85n", "test  test"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in rows)


def test_query_normalisation_keeps_inner_nul(spark):
    rows = spark.createDataFrame([("\0\0 a\0b \0",), ("\0",), ("  x\0",)], "t string")
    assert [r[0] for r in rows.select(normalise_query(F.col("t"))).collect()] == ["a\0b", "", "x"]


def test_lossy_decode_equals_python(spark):
    payloads = [b"ok", b"a\xffb", b"\xc3\xa9\xfe", "keep � é".encode() + b"\x80", b"", b"\xf0\x9f\x8c", b"\xe4\xbd"]
    rows = spark.createDataFrame([(bytearray(p),) for p in payloads], "p binary")
    got = [r[0] for r in rows.select(decode_lossy(F.col("p"))).collect()]
    assert got == [p.decode("utf-8", errors="ignore") for p in payloads]


PATTERNS = [
    r"test.*\d+", r"test.*test.*\d+", r"(test.*?){3}\d+", r"\b\w+\d+\b", r"[a-z]+\d+[a-z]+", r"^specific",
    r"middle.*pattern", r"end$", r".*", r"[a-z]+", r"rare.*pattern", r"(?P<word>\w+) (?P=word)", r"x{,2}y",
    r"[]a]b", r"[^]a]b", r"[[]x", r"[a&&b]", r"\Aab\Z", r"a.b", r"\S\D\W", r"caf\w$", r"\[x\]", r"(?:a|b)+?c",
]
TEXTS = [
    "test line 1", "test test 22", "testtesttest9", "abc123def", "specific", "the end", "middle of pattern", "foo foo",
    "xxy", "]b", "ab", "[x", "&", "a\rb", "a\u0085b", "café", "cafés", "٣ arabic digit", "", "[x]", "abac", "TEST",
]


def test_regex_search_equals_python(spark):
    lines = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for fold in (False, True):
        for p in PATTERNS:
            got = {r.t for r in lines.where(F.col("t").rlike(regex.to_jvm(p, fold))).collect()}
            want = {t for t in TEXTS if re.search(p, t, re.IGNORECASE if fold else 0)}
            assert got == want, (p, fold)


def test_pattern_validity():
    assert regex.is_valid("a+") and not regex.is_valid("test[") and not regex.is_valid("(a")


@given(st.text(alphabet="ab\\EQ.*[", max_size=12))
@settings(max_examples=50, deadline=None)
def test_quoted_is_literal(text):
    # \Q..\E quoting has no Python twin: check that the parts give the text back
    assert regex.quoted(text).replace("\\E\\\\E\\Q", "\\E") == "\\Q" + text + "\\E"


def test_responses(spark):
    texts = ["STRING EXISTS;0.02", "STRING NOT FOUND", "RATE LIMIT EXCEEDED;0.01", "SERVER ERROR;1.00", "STRING EXISTS;x"]
    v, ms = verdicts.parse_response(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(v, ms).collect()]
    assert got == [("STRING EXISTS", 0.02), ("STRING NOT FOUND", 0.0), ("RATE LIMIT EXCEEDED", 0.01),
                   ("SERVER ERROR", 1.0), ("STRING EXISTS", 0.0)]


def test_trace_sampling_is_by_id_and_follows_the_parent(spark):
    ids = spark.createDataFrame([("0" * 32, None), ("f" * 32, None), ("f" * 32, True), ("0" * 32, False)], "t string, p boolean")
    assert [r[0] for r in ids.select(trace_sampled(F.col("t"), 0.5, F.col("p"))).collect()] == [True, False, True, False]
    assert trace_bound(0.5) == 1 << 63
    assert [r[0] for r in ids.select(trace_sampled(F.col("t"), 1.0)).collect()] == [True] * 4
    assert [r[0] for r in ids.select(trace_sampled(F.col("t"), 0.0)).collect()] == [False] * 4


def test_small_helpers(spark):
    row = spark.range(1).select(number(F.lit(85.25), 2), bit_address(F.lit("x")), bit_address(F.lit("x"), 64, "md5")).first()
    assert row[0] == "85.25" and 0 <= row[1] < 1 << 24 and 0 <= row[2] < 64


@pytest.mark.parametrize("pattern, texts", [
    (r"x\vy", ["x\ny", "x\x0by"]), (r"a\100b", ["a@b", "a100b"]), (r"\U00000061b", ["ab", "b"]), (r"(?a)^\w+$", ["abc", "é"]),
    (r"[\101\b]", ["A", "\b", "b"]), (r"(?a:\w)é", ["aé", "éé"]), (r"\0", ["\0", "0"]), (r"(?i)AB", ["xab", "b"]),
])
def test_spellings_that_differ_between_the_dialects(spark, pattern, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t for r in df.where(F.col("t").rlike(regex.to_jvm(pattern))).collect()}
    assert regex.is_valid(pattern) and got == {t for t in texts if re.search(pattern, t)}


def test_patterns_without_a_jvm_form_are_invalid(spark):
    assert not regex.is_valid(r"(a)?(?(1)b|c)") and regex.is_valid(r"\\(?:1)")
    assert not regex.runs_on_jvm(spark, "(") and regex.runs_on_jvm(spark, regex.to_jvm("(a)"))
