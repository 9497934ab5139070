"""Stages that keep rows: odd rows, odd column names, empty tables."""

import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineseek.llm import common, gam, minhash, passages, pii
from lineseek.llm.common import BATCH_BYTES, Scratch
from lineseek.plans.session import shared_dir
from tests.llm.conftest import CLASHES

NAMES = (*CLASHES, "row", "id", "own", "turn", "cuts", "__doc", "__kept", "found_id", "a.b", "doc_id.x", "b`c", "found", "mark", "text.x")


@pytest.fixture(scope="module")
def wide(odd):
    """The awkward rows, with columns of every name that may clash; each tells its row."""
    keep = odd.select("doc_id", "text", "lang")
    names = dict.fromkeys(NAMES)
    return keep.select("*", *(F.concat(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(f" {c}")).alias(c) for c in names))


@pytest.mark.parametrize("stage", [
    minhash.one_of_each, passages.remove_repeats, pii.redact,
    lambda docs: gam.accepted(docs, docs.sparkSession.createDataFrame([(900004, 1), (900006, 0)], "doc_id long, quality int"), F.lit(False)),
], ids=["one_of_each", "remove_repeats", "redact", "accepted"])
def test_rows_keep_their_columns(wide, stage):
    assert stage(wide.where("false")).count() == 0
    out = stage(wide)
    assert out.columns == wide.columns and out.schema.simpleString() == wide.schema.simpleString()
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"{r.doc_id or 0} {c}" for c in dict.fromkeys(NAMES))


def test_secrets_are_found_wherever_they_stand(spark):
    secret = "Zk3" + "a9B7" * 6
    rows = [(1, secret), (2, f"rareword {secret} and more"), (3, f"a1b2c3 d4e5f6 {secret}"), (4, "nothing to see"), (5, f"x.{secret[::-1]},")]
    got = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        at = max(text.find(secret), text.find(secret[::-1]))
        assert got[doc] == (f"id:{at}:{at + len(secret)}" if at >= 0 else "")
    texts = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts[1] == "[ID]" and texts[2] == "rareword [ID] and more" and texts[5] == "x.[ID],"


def test_a_pattern_does_not_end_at_the_slot_before(spark):
    rows = [(k, f"key6: ab12cd{k} then") for k in range(4)] + [(9, "api_key2: zz99yy88")]
    found = pii._placed(pii._matches(spark.createDataFrame(rows, "doc_id long, text string"))).where("kind = 4").withColumn("p", pii._contexts())
    got = {(r.doc_id, r.value): r.p for r in found.collect()}
    assert got[9, "zz99yy88"][0] == "api_key0: "
    assert got[0, "ab12cd0"][0] == "key0: "


@pytest.mark.parametrize("stage, left", [(minhash.one_of_each, "kept"), (passages.remove_repeats, "spans"), (pii.redact, "spans")])
def test_stages_leave_one_small_table_and_merge_texts_at_any_size(odd, stage, left):
    root = Path(shared_dir(odd.sparkSession).removeprefix("file:")) / "lineseek"
    before = set(root.glob("*"))
    out = stage(odd)
    assert [p.name.split("-")[1] for p in set(root.glob("*")) - before] == [left]
    rows = sorted(map(str, out.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert rows == sorted(map(str, stage(odd.repartition(3)).collect()))


def test_workers_get_texts_by_bytes(spark):
    Scratch(spark, "sizes", by_bytes=True)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 500, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= BATCH_BYTES + 200_000


def test_a_cut_range_goes_to_the_ends_that_ask_it():
    text = " ".join(f"w{i}" for i in range(20))
    ranges = [{"from": 0, "to": 5, "is_a": True, "is_b": False}, {"from": -3, "to": 9, "is_a": False, "is_b": True}]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text]), pa.array([ranges])], ["doc", "text", "ranges"])
    got = pa.Table.from_batches(passages._slices([batch])).to_pylist()
    assert [(r["from"], r["to"], r["base"], len(r["codes"]) // 8, r["is_a"], r["is_b"]) for r in got] == [(0, 5, 0, 5, True, False), (-3, 9, 0, 9, False, True)]


@pytest.mark.parametrize("step", [gam._features, minhash._digest(5)], ids=["features", "digest"])
def test_texts_are_taken_in_small_parts(monkeypatch, step):
    texts = [" ".join(f"w{(i * 7 + k) % 5000}" for k in range(600)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    got = pa.Table.from_batches(step([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    monkeypatch.setattr(common, "CHUNK_BYTES", 1 << 20)
    assert got.equals(pa.Table.from_batches(step([batch])))
