import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineseek.operators import compare, quantiles, stats


def samples(spark, values, group="g"):
    return spark.createDataFrame([(group, float(v)) for v in values], "g string, response_ms double")


def test_small_fixture(spark):
    df = samples(spark, [1, 2, 3, 4])
    s = stats.latency_summary(df, ["g"]).first()
    assert (s.avg_response_time, s.min_response_time, s.max_response_time) == (2.5, 1, 4) and round(s.std_dev, 6) == 1.290994
    assert stats.median(df, []).first()[0] == 2.5
    assert round(stats.percentiles(df, []).first().p95, 6) == 3.85
    assert round(stats.tail_latency(df, []).first().p95_response_time, 6) == 4.75  # above the maximum, by definition


def test_one_and_no_sample(spark):
    one = samples(spark, [7])
    assert stats.tail_latency(one, []).first().p95_response_time is None
    assert stats.latency_summary(one, []).first().std_dev is None
    assert stats.percentiles(one, []).first().p50 == 7
    assert stats.percentiles(one.limit(0), ["g"]).count() == 0
    assert stats.repeat_rate(one.limit(0), ["g"]).first().repeat_rate == 0.0
    assert stats.found_rate(one.withColumn("found", F.lit(True)).limit(0), []).first().found_rate == 0.0


@pytest.mark.parametrize("method", quantiles.METHODS)
def test_quantiles_equal_python(spark, method):
    rnd = random.Random(3)
    groups = {
        "lognormal": [rnd.lognormvariate(2, 1) for _ in range(2000)],
        "negative": [rnd.gauss(0, 5) for _ in range(999)],
        "narrow": [100 + rnd.random() / 1000 for _ in range(500)],
        "few values": [rnd.choice([0.0, 0.5, -1.0]) for _ in range(3000)],
        "hot value": [1.0] * 5000 + [2.0, 3.0],
        "two": [1.0, 9.0],
        "tiny": [5e-324, 1e-300, 0.0, 1e300, -1e300],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    ps = {"a": 0.05, "b": 0.25, "c": 0.5, "d": 0.95, "e": 0.99}
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], "v", ps, method).collect()}
    for g, vs in groups.items():
        for name, p in ps.items():
            want = np.percentile(vs, p * 100) if method == "linear" else statistics.quantiles(vs, n=100)[round(p * 100) - 1]
            assert got[g][name] == pytest.approx(want, rel=1e-9, abs=1e-12), (g, p)
    with pytest.raises(ValueError):
        quantiles.quantiles(df, ["g"], "v", ps, "nearest")


def test_nulls_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    out = quantiles.quantiles(df, [], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()
    assert (out.lo, out.mid, out.hi) == (1.0, 2.0, float("inf")) or np.isnan(out.hi)


def test_histogram(spark):
    h = stats.histogram(samples(spark, range(101)), []).orderBy("bin").collect()
    assert [r.n for r in h] == [2] * 49 + [3]
    flat = stats.histogram(samples(spark, [5, 5]), []).orderBy("bin").collect()
    assert (flat[0].bin_start, flat[-1].bin_end) == (4.5, 5.5) and sum(r.n for r in flat) == 2
    values = [random.Random(1).gauss(10, 3) for _ in range(1000)]
    got = [r.n for r in stats.histogram(samples(spark, values), []).orderBy("bin").collect()]
    assert got == np.histogram(values, bins=50)[0].tolist()


def test_boxplot(spark):
    b = stats.boxplot(samples(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 100, -50]), []).first()
    assert (b.q1, b.median, b.q3) == (2.5, 5, 7.5) and (b.whisker_low, b.whisker_high, b.n_outliers) == (1, 9, 2)


def test_outcomes_and_throughput(spark):
    rows = [(0.0, True, None), (2.0, False, "boom"), (4.0, False, "boom"), (5.0, True, "")]
    df = spark.createDataFrame(rows, "t double, success boolean, error string")
    o = stats.outcomes(df, []).first()
    assert (o.success_rate, o.error_count, o.unique_errors, o.error_rate) == (50.0, 2, 1, 0.5)
    assert stats.outcomes(df.limit(0), []).first().error_rate == 1.0
    assert stats.throughput(df, [], F.col("t")).first()[0] == 0.8
    assert stats.throughput(df.limit(1), [], F.col("t")).first()[0] == 0.0
    assert stats.throughput_fixed(df, [], 8).first()[0] == 0.5


def test_repeat_rate(spark):
    df = spark.createDataFrame([("q", "o")] * 9 + [("r", "o")], "query string, options string")
    assert stats.repeat_rate(df, ["query", "options"]).first().repeat_rate == 80.0


def test_fastest_and_variation(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 1.5)], "algorithm string, response_ms double")
    assert stats.fastest(stats.by_algorithm(df, ["algorithm"])).first().fastest == "b"
    assert round(stats.variation(df, []).first().cv, 6) == round(statistics.stdev([2, 1, 1.5]) / 1.5, 6)


def test_bucket_quantile(spark):
    inf = float("inf")
    rows = [("a", 1.0, 0), ("a", 2.0, 50), ("a", 4.0, 100), ("a", inf, 100), ("b", 1.0, 10), ("b", inf, 100), ("c", 2.0, 4), ("c", inf, 4)]
    df = spark.createDataFrame(rows, "s string, le double, n bigint")
    got = {r.s: r.quantile for r in stats.bucket_quantile(df, ["s"], 0.5).collect()}
    assert got == {"a": 2.0, "b": 1.0, "c": 1.0}


def test_comparison(spark):
    rows = [("local", 1.0, True), ("local", 3.0, True), ("other", 4.0, True), ("other", 4.0, False)]
    df = spark.createDataFrame(rows, "run string, ms double, success boolean").withColumn("error", F.lit(None).cast("string"))
    seconds = spark.createDataFrame([("local", 1.0), ("other", 4.0)], "run string, seconds double")
    c = compare.compare_runs(compare.run_metrics(df, "run", "ms", seconds), "run", "local", "other")
    rows = {r.metric: r for r in c.collect()}
    assert (rows["avg_response_time"].difference, rows["avg_response_time"].difference_pct) == (-2.0, -50.0)
    assert rows["throughput"].local == 2.0 and rows["throughput"].other == 0.5 and rows["p50"].direction == "faster"
    assert compare.recommendation(c).first().recommendation == "performing well"


def test_requirements(spark):
    snap = spark.createDataFrame([(1, 0.4), (1, 0.0), (2, 0.6), (3, 0.5)], "size int, response_ms double")
    again = spark.createDataFrame([(1, 40.0), (2, 1.0), (4, 1.0)], "size int, response_ms double")
    got = {r.size: (r.snapshot_ms, r.reread_ms, r.meets_requirement) for r in compare.requirement_check(snap, again, "size").collect()}
    inf = float("inf")
    assert got == {1: (0.4, 40.0, True), 2: (0.6, 1.0, False), 3: (0.5, inf, False), 4: (inf, 1.0, False)}


def test_a_run_that_failed_throughout_stays_in_the_reports(spark):
    rows = [("good", 1.0 * i, 5.0 + i, True) for i in range(10)] + [("dead", 1.0 * i, None, False) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, at double, response_ms double, ok boolean")
    df = df.withColumn("success", F.col("ok")).withColumn("error", F.when(~F.col("ok"), "down"))
    report = {r.g: r for r in stats.load_test_report(df, ["g"], F.col("at")).collect()}
    assert set(report) == {"good", "dead"} and report["dead"].p95_response_time is None and report["dead"].error_count == 4


def test_histogram_leaves_infinite_values_out(spark):
    df = samples(spark, [1, 2, 3, 4, float("inf"), float("nan"), float("-inf")])
    bins = stats.histogram(df, ["g"], bins=3).orderBy("bin").collect()
    assert [r.n for r in bins] == [1, 1, 2] and bins[0].bin_start == 1 and bins[2].bin_end == 4
