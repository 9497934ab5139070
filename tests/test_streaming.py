import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lineseek.operators import admission as batch_admission, alerts as batch_alerts
from lineseek.operators.ordered import micros
from lineseek.plans.catalog_telemetry import rounded
from lineseek.sources import lines as sources
from lineseek.streaming import admission, alerts, lookup, metrics
from lineseek.streaming.run import drain, drain_writer, replay, rocksdb

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "client string, ts timestamp, id bigint, value double, firing boolean"


@pytest.fixture
def files(spark, tmp_path):
    """A shuffled log in several files, read one file per micro-batch, in time order
    between files and out of order within them. The last row only moves the
    watermark."""
    rnd = random.Random(2)
    rows, t = [], 0.0
    for i in range(600):
        t += rnd.choice([0, 0.5, 3, 20])
        rows.append((rnd.choice("aaab"), T0 + dt.timedelta(seconds=t), i, rnd.random() * 100, rnd.random() < 0.5))
    last = ("z", T0 + dt.timedelta(seconds=t + 10_000), 999, 0.0, False)
    parts = [rows[i:i + 150] for i in range(0, 600, 150)] + [[last]]
    for i, part in enumerate(parts):
        rnd.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    table = spark.createDataFrame(rows, SCHEMA)
    return stream, table


def test_rate_limits_equal_batch(spark, files):
    stream, table = files
    log = table.withColumn("ts_us", micros(F.col("ts")))
    with rocksdb(spark):
        got = drain(admission.sliding_log(stream, "client", "ts", "id", 3, 60), "t-log")
        want = batch_admission.sliding_log(log, "client", "ts_us", "id", 3, 60)
        assert set(got.collect()) == set(want.select(*got.columns).collect())
        got = drain(admission.token_bucket(stream, "client", "ts", "id", 0.1, 2), "t-bucket")
        want = batch_admission.token_bucket(log, "client", "ts_us", "id", 0.1, 2)
        assert set(got.collect()) == set(want.select(*got.columns).collect())


def test_transitions_equal_batch(spark, files):
    stream, table = files
    got = drain(alerts.transitions(stream, "client"), "t-trans")
    log = table.withColumn("ts_us", micros(F.col("ts")))
    want = batch_alerts.transitions(log, ["client"], ["ts_us", "id"], slice_seconds=600)
    assert {(r.series, r.id, r.change) for r in got.collect()} == {(r.client, r.id, r.change) for r in want.collect()}


def test_window_metrics_equal_batch(spark, files):
    stream, table = files
    def shaped(df):
        return df.select("ts", F.col("value").alias("duration_ms"), F.col("firing").alias("is_error"), F.lit(True).alias("found"), F.lit(1).alias("bytes"))
    got = drain(metrics.per_window(shaped(stream), delay="5 minutes"), "t-metrics")
    assert set(rounded(got).collect()) == set(rounded(metrics.per_window(shaped(table))).collect())


def test_lookup_reads_the_corpus_of_the_moment(spark, tmp_path):
    asks = tmp_path / "asks"
    asks.mkdir()
    corpus = str(tmp_path / "corpus")
    schema = "id bigint, query string"
    spark.createDataFrame([("old",)], "line string").write.parquet(corpus)
    stream = spark.readStream.schema(schema).parquet(str(asks))
    checkpoint = str(tmp_path / "cp")

    def step():
        writer = lookup.lookup_batches(stream, corpus, str(tmp_path / "out"))
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([(1, "new"), (2, "old")], schema).write.mode("append").parquet(str(asks))
    step()
    spark.createDataFrame([("new",)], "line string").write.mode("append").parquet(corpus)
    spark.createDataFrame([(3, "new")], schema).write.mode("append").parquet(str(asks))
    step()
    got = {r.id: r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "STRING NOT FOUND", 2: "STRING EXISTS", 3: "STRING EXISTS"}


def test_live_lookup(spark, tmp_path):
    spark.createDataFrame([(1, " a \0"), (2, "b")], "id bigint, query string").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("id bigint, query string").parquet(str(tmp_path / "q"))
    out = drain(lookup.live_lookup(stream, spark.createDataFrame([("a",)], "line string")), "t-live")
    assert {r.id: r.found for r in out.collect()} == {1: True, 2: False}


def test_growing_corpus(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    grown = str(tmp_path / "grown")
    checkpoint = str(tmp_path / "cp")
    stream = spark.readStream.text(str(folder)).select(F.btrim("value").alias("line")).where("line <> ''")

    def step():
        lookup.grow_corpus(stream, grown).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    (folder / "1.txt").write_text("a\nb\na\n")
    step()
    (folder / "2.txt").write_text("b\nnew_test_string\n")
    step()
    got = sorted(r.line for r in spark.read.parquet(grown).collect())
    assert got == ["a", "b", "new_test_string"]


def test_dedup_and_routing(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=i), "warning", "test", "Test alert", {"k": str(i)}) for i in range(5)]
    schema = "ts timestamp, level string, source string, message string, details map<string,string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "a"))
    late = replay(spark.createDataFrame(rows[::-1], schema).repartition(3), "ts", "t-alerts", 2, 3)
    only = drain(alerts.dedup(late), "t-dedup").collect()
    assert [(r.details["k"], r.n_suppressed) for r in only] == [("0", 4)]

    def broken(batch, batch_id):
        raise RuntimeError("down")

    sinks = {"broken": broken, **{k: alerts.file_sink(str(tmp_path / k), k) for k in ("json", "parquet", "csv")}}
    drain_writer(alerts.deliver(stream, sinks, str(tmp_path / "failed")), "t-route", spark)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 5 and spark.read.json(str(tmp_path / "json")).count() == 5
    failure = spark.read.parquet(str(tmp_path / "failed")).first()
    assert failure.sink == "broken" and failure.problem == "down" and failure.n_alerts == 5


def test_stream_of_text_lines_is_cleaned_like_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, " a\n\nb "), (2, "c")], "id bigint, text string")
    docs.write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "d"))
    got = drain(sources.clean(sources.from_table(stream, "id", "text")), "t-lines")
    want = sources.clean(sources.from_table(docs, "id", "text"))
    assert set(got.collect()) == set(want.select(*got.columns).collect())


def test_a_new_stream_goes_on_with_the_corpus_it_finds(spark, tmp_path):
    grown = str(tmp_path / "grown")
    for k, text in enumerate(("one\ntwo\n", "two\nthree\n", "one\nfour\n")):
        folder = tmp_path / f"in{k}"
        folder.mkdir()
        (folder / "1.txt").write_text(text)
        stream = spark.readStream.text(str(folder)).withColumnRenamed("value", "line")
        writer = lookup.grow_corpus(stream, grown).option("checkpointLocation", str(tmp_path / f"cp{k}"))
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(grown).collect()) == ["four", "one", "three", "two"]


def test_decisions_do_not_depend_on_batches(spark):
    rows = [(f"c{i % 3}", T0 + dt.timedelta(seconds=7 * i), i, float(i % 5), None if i % 7 == 0 else i % 4 == 1) for i in range(90)]
    table = spark.createDataFrame(rows, "client string, ts timestamp, id bigint, value double, firing boolean")
    log = table.withColumn("ts_us", micros(F.col("ts")))
    with rocksdb(spark):
        got = drain(admission.sliding_log(replay(table, "ts", "t-replay", 4, 60), "client", "ts", "id", 3, 60), "t-late")
        want = batch_admission.sliding_log(log, "client", "ts_us", "id", 3, 60)
        assert set(got.collect()) == set(want.select(*got.columns).collect())
        got = drain(alerts.transitions(replay(table, "ts", "t-replay", 4, 60), "client"), "t-late")
        want = batch_alerts.transitions(log, ["client"], ["ts_us", "id"], slice_seconds=60)
        assert {(r.series, r.id, r.change) for r in got.collect()} == {(r.client, r.id, r.change) for r in want.collect()}


def test_a_part_of_several_files_is_one_batch(spark, monkeypatch):
    """Rows of many keys, some unknown, in files that each hold all times: none is late."""
    from lineseek.streaming import run

    monkeypatch.setattr(run, "ROWS_PER_FILE", 50)
    rows = [(None if i % 40 == 0 else f"c{i % 37}", T0 + dt.timedelta(minutes=7 * i), i, float(i % 5), i % 3 == 1) for i in range(800)]
    random.Random(3).shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    log = table.withColumn("ts_us", micros(F.col("ts")))
    got = drain(alerts.transitions(replay(table, "ts", "t-files", 4, 60), "client"), "t-files").collect()
    want = batch_alerts.transitions(log, ["client"], ["ts_us", "id"], slice_seconds=60).collect()
    assert {(r.series, r.id, r.change) for r in got} == {(r.client, r.id, r.change) for r in want}
    got = drain(admission.token_bucket(replay(table, "ts", "t-files", 4, 60), "client", "ts", "id", 0.0001, 2), "t-files")
    want = batch_admission.token_bucket(log.where("client is not null"), "client", "ts_us", "id", 0.0001, 2)
    assert set(got.where("client is not null").collect()) == set(want.select(*got.columns).collect())


def test_unknown_ids_leave_the_others_known(spark):
    rows = [("a", T0 + dt.timedelta(minutes=7 * i), None if i % 9 == 4 else (1 << 60) + i, 0.0, i % 2 == 0) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = drain(admission.token_bucket(replay(table, "ts", "t-ids", 2, 60), "client", "ts", "id", 0.001, 2), "t-ids").collect()
    assert sorted((r.ts_us, r.id) for r in got if r.client) == [(r.ts_us, r.id) for r in table.select(micros(F.col("ts")).alias("ts_us"), "id").orderBy("ts").collect()]
