import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lineseek.operators import windows
from lineseek.operators.ordered import with_rank, with_running

SECOND = 1_000_000


@pytest.fixture
def series(spark):
    """Two series: one holds most rows and has ties and long pauses."""
    rnd = random.Random(11)
    rows, t = [], 0
    for i in range(3000):
        t += rnd.choice([0, 0, 1, 5, 40, 4000])
        rows.append(("big", t * SECOND, i, float(rnd.randint(0, 50)), rnd.random() < 0.3))
    for i in range(50):
        rows.append(("small", i * 1000 * SECOND, 10_000 + i, float(i), i % 2 == 0))
    df = spark.createDataFrame(rows, "name string, ts_us bigint, id bigint, value double, found boolean").repartition(5)
    return rows, df


def of(rows, name):
    return sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2]))


def test_ranks_and_running_totals(series):
    rows, df = series
    ranked = {r.id: r.rn for r in with_rank(df, ["name"], ["ts_us", "id"], slice_seconds=600).collect()}
    back = {r.id: r.rn for r in with_rank(df, ["name"], ["ts_us", "id"], slice_seconds=600, newest_first=True).collect()}
    total = {r.id: r.s for r in with_running(df, ["name"], ["ts_us", "id"], {"s": F.col("value")}, 600).collect()}
    for name in ("big", "small"):
        mine, s = of(rows, name), 0
        for i, r in enumerate(mine):
            s += r[3]
            assert ranked[r[2]] == i + 1 and back[r[2]] == len(mine) - i and total[r[2]] == s


def test_keep_newest(series):
    rows, df = series
    kept = {r.id for r in windows.keep_newest(df, ["name"], ["ts_us", "id"], 1000, 600).collect()}
    assert kept == {r[2] for name in ("big", "small") for r in of(rows, name)[-1000:]}
    assert windows.keep_newest(df, [], ["ts_us", "id"], 7).count() == 7


def test_rolling_mean(series):
    rows, df = series
    got = {r.id: r.rolling_mean for r in windows.rolling_mean(df, ["name"], ["ts_us", "id"], "value", 100, 600, block=128).collect()}
    assert len(got) == len(rows)
    for name in ("big", "small"):
        values = [r[3] for r in of(rows, name)]
        for i, r in enumerate(of(rows, name)):
            last = values[max(0, i - 99):i + 1]
            assert got[r[2]] == pytest.approx(sum(last) / len(last))


def test_trailing_mean_and_counter_rate(series):
    rows, df = series
    means = {r.id: r.trailing_mean for r in windows.trailing_mean_alarm(df, ["name"], "ts_us", "value", 60, 25, 600).collect()}
    rates = {r.id: r.rate for r in windows.counter_rate(df, ["name"], ["ts_us", "id"], "value", 300, 600).collect()}
    assert len(means) == len(rates) == len(rows)
    for name in ("big", "small"):
        mine = of(rows, name)
        for i, r in enumerate(mine):
            last = [x[3] for x in mine if r[1] - 60 * SECOND <= x[1] <= r[1]]
            assert means[r[2]] == pytest.approx(sum(last) / len(last))
            if i % 17 == 0:
                v = [x[3] for x in mine if r[1] - 300 * SECOND <= x[1] <= r[1]]
                rise = sum(b - a if b >= a else b for a, b in zip(v, v[1:]))
                assert rates[r[2]] == pytest.approx(rise / 300)


def test_error_rate_at_the_limit_is_quiet(spark):
    def alarm(values):
        df = spark.createDataFrame([("e", i * SECOND, v) for i, v in enumerate(values)], "n string, ts_us bigint, v double")
        return windows.trailing_mean_alarm(df, ["n"], "ts_us", "v").orderBy("ts_us").collect()[-1].alarm
    assert not alarm([0.1] * 30) and not alarm([0.0, 0.2] * 10) and alarm([0.1] * 30 + [0.1031])


def test_running_rates(spark):
    df = spark.createDataFrame([("s", 0, 1, True), ("s", SECOND, 2, False), ("s", 4 * SECOND, 3, True)], "n string, ts_us bigint, id bigint, found boolean")
    rate = windows.cumulative_rate(df, ["n"], ["ts_us", "id"], F.lit(0)).orderBy("id").collect()
    assert [r.requests_per_second for r in rate] == [None, 2.0, 0.75]
    found = windows.running_found_rate(df, ["n"], ["ts_us", "id"]).orderBy("id").collect()
    assert [round(r.found_rate, 3) for r in found] == [100.0, 50.0, 66.667]


def test_trailing_window_is_closed(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(seconds=s), s) for s in (0, 1, 60, 61)], "ts timestamp, s int")
    now = F.lit(t0 + dt.timedelta(seconds=61))
    assert sorted(r.s for r in windows.trailing(df, "ts", now, 60).collect()) == [1, 60, 61]
    assert windows.trailing(df, "ts", now, None).count() == 4
    assert windows.expire(df, "ts", now, dt.timedelta(seconds=1)).count() == 2


def test_degradation(spark):
    rows = [("a", i * SECOND, i, 1.0 if i < 1500 else 3.5) for i in range(2100)]
    df = spark.createDataFrame(rows, "n string, ts_us bigint, id bigint, v double")
    got = windows.degradation(df, ["n"], ["ts_us", "id"], "v").first()
    assert (got.n_runs, got.min_mean, got.max_mean, got.stable) == (3, 1.0, 3.5, False)


def test_gauges_and_sessions(spark):
    df = spark.createDataFrame([("m", 1, 90.0), ("m", 2, 80.0), ("m", 3, None), ("k", 1, 79.9)], "m string, ts bigint, v double")
    assert {(r.m, r.latest, r.colour) for r in windows.gauges(df, ["m"], ["ts"], "v").collect()} == {("m", 80.0, "red"), ("k", 79.9, "green")}
    log = spark.createDataFrame([("s", 1, 1, 1), ("s", 2, 2, 1), ("s", 3, 3, -1)], "s string, ts_us bigint, id bigint, d int")
    assert [r.open_sessions for r in windows.open_sessions(log, ["s"], ["ts_us", "id"], F.col("d")).orderBy("id").collect()] == [1, 2, 1]


def test_rows_without_a_key_stay(spark):
    rows = [(None, i * SECOND, i, 1.0, True) for i in range(5)] + [("x", 0, 9, 2.0, False)]
    df = spark.createDataFrame(rows, "name string, ts_us bigint, id bigint, value double, found boolean")
    assert with_rank(df, ["name"], ["ts_us", "id"], slice_seconds=2).where("name is null").count() == 5
    assert windows.keep_newest(df, ["name"], ["ts_us", "id"], 2, 2).where("name is null").count() == 2
    assert windows.rolling_mean(df, ["name"], ["ts_us", "id"], "value", 2, 2, block=2).count() == 6
    assert windows.trailing_mean_alarm(df, ["name"], "ts_us", "value", 60, 0.1, 60).count() == 6
    from lineseek.operators import admission, alerts, stats
    assert {r.name: r.median_response_time for r in stats.median(df, ["name"], "value").collect()} == {None: 1.0, "x": 2.0}
    assert stats.histogram(df, ["name"], "value").where("name is null").agg(F.sum("n")).first()[0] == 5
    changed = alerts.transitions(df, ["name"], ["ts_us", "id"], "found", 2)
    assert [(r.name, r.id) for r in changed.collect()] == [(None, 0)]
    got = admission.sliding_log(df, "name", "ts_us", "id", 2, 60).orderBy("id").collect()
    assert [(r.name, r.admitted) for r in got] == [(None, True)] * 2 + [(None, False)] * 3 + [("x", True)]
