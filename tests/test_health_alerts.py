import datetime as dt

import pytest
from pyspark.sql import functions as F

from lineseek.operators import alerts, health

T0 = dt.datetime(2024, 1, 1)
SECOND = 1_000_000


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def samples(spark):
    rows = [(at(i), i * SECOND, cpu, mem, 10.0, 5, 5) for i, (cpu, mem) in enumerate([(80.0, 10.0), (85.27, 10.0), (79.9, 85.27), (99.0, 99.0)])]
    return spark.createDataFrame(
        rows, "ts timestamp, ts_us bigint, cpu_percent double, memory_percent double, disk_usage_percent double, open_files int, thread_count int"
    )


def test_both_health_rules_at_the_limit(samples):
    strict = [(r.healthy, r.issues) for r in health.system_health(samples).orderBy("ts").collect()]
    assert strict == [
        (True, []), (False, ["high CPU usage: 85.3%"]), (False, ["high memory usage: 85.3%"]),
        (False, ["high memory usage: 99.0%", "high CPU usage: 99.0%"]),
    ]
    assert [r.healthy for r in health.metric_health(samples).orderBy("ts").collect()] == [False, False, False, False]
    relaxed = health.limits_with({"cpu_percent": 90.0})
    assert [r.healthy for r in health.metric_health(samples, relaxed).orderBy("ts").collect()] == [True, True, False, False]
    with pytest.raises(ValueError):
        health.limits_with({"gpu_percent": 1.0})


def test_components(spark):
    rows = [("search", True, []), ("search", False, ["slow", "slow"]), ("system", True, [])]
    report = health.component_report(spark.createDataFrame(rows, "component string, healthy boolean, issues array<string>"))
    got = {r.component: (r.healthy, r.issues) for r in report.collect()}
    assert got == {"search": (False, ["slow"]), "system": (True, [])}
    assert health.overall(report).first().overall_status == "unhealthy"


def test_alerts_from_checks(samples):
    checked = health.system_health(samples)
    system = alerts.from_health(checked).collect()
    assert len(system) == 3 and {a.source for a in system} == {"system"} and system[0].details["cpu_percent"] == "85.27"
    assert alerts.from_issues(checked).count() == 4
    means = samples.select("ts", F.lit(0.2).alias("trailing_mean"), (F.col("cpu_percent") > 90).alias("alarm"))
    assert [a.message for a in alerts.from_error_rate(means).collect()] == ["High error rate detected"]


def test_filter_and_report(spark):
    rows = [("warning", "cpu"), ("warning", "memory"), ("error", "cpu"), ("warning", "cpu")]
    df = spark.createDataFrame(rows, "level string, source string")
    assert alerts.filter_alerts(df).count() == 4 and alerts.filter_alerts(df, "warning").count() == 3
    assert alerts.filter_alerts(df, "warning", "cpu").count() == 2 and alerts.filter_alerts(df, source="memory").count() == 1
    assert {(r.level, r.source): r.n_alerts for r in alerts.report(df).collect()}["warning", "cpu"] == 2


def test_dedup(spark):
    rows = [(i * SECOND, i, "warning", "test", "Test alert") for i in range(5)] + [(400 * SECOND, 9, "warning", "test", "Test alert"), (1, 7, "error", "test", "Test alert")]
    df = spark.createDataFrame(rows, "ts_us bigint, id bigint, level string, source string, message string")
    got = {r.id: r.n_suppressed for r in alerts.dedup(df, "ts_us", 300, "id").collect()}
    assert got == {0: 4, 9: 0, 7: 0}


def test_resolution(spark):
    rows = [(0, 85.0), (1, 85.0), (2, 50.0), (5000, 40.0), (9000, 95.0)]
    df = spark.createDataFrame([(at(s), s * SECOND, i, v) for i, (s, v) in enumerate(rows)], "ts timestamp, ts_us bigint, id bigint, cpu_percent double")
    states = alerts.states(df)
    changes = alerts.transitions(states, ["source"], ["ts_us", "id"], slice_seconds=600)
    out = [(r.level, r.source, r.message) for r in alerts.from_transitions(changes).orderBy("ts").collect()]
    assert out == [
        ("warning", "cpu", "cpu limit exceeded"), ("info", "cpu", "cpu alert resolved"), ("warning", "cpu", "cpu limit exceeded"),
    ]
    assert alerts.active(changes, ["source"], ["ts_us", "id"]).first().since_us == 9000 * SECOND


def test_connection_pool_fires_at_its_limit(spark):
    df = spark.createDataFrame([(at(0), 90.0, 0.1)], "ts timestamp, connection_usage_percent double, error_rate double")
    assert {r.source: r.firing for r in alerts.states(df).collect()} == {"connection_pool": True, "error_rate": False}


def test_unknown_states_change_nothing(spark):
    rows = [("cpu", i * 40_000_000, i, f) for i, f in enumerate([True, None, None, False, None, False, True])]
    states = spark.createDataFrame(rows, "source string, ts_us bigint, id bigint, firing boolean")
    for seconds in (30, 60, 3600):
        got = [(r.id, r.change) for r in alerts.transitions(states, ["source"], ["ts_us", "id"], slice_seconds=seconds).orderBy("id").collect()]
        assert got == [(0, "raised"), (3, "resolved"), (6, "raised")]
