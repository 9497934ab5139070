import random

import pytest

from lineseek.operators.admission import sliding_log, token_bucket, with_verdicts

SECOND = 1_000_000


def log(spark, rows):
    return spark.createDataFrame([(c, int(t * SECOND), i) for c, t, i in rows], "client_ip string, ts_us bigint, id bigint")


def decisions(df):
    return [r.admitted for r in df.orderBy("client_ip", "ts_us", "id").collect()]


def test_sliding_log_fixture(spark):
    times = [0, 10, 20, 60, 60.5, 61, 71]
    df = log(spark, [("c", t, i) for i, t in enumerate(times)])
    assert decisions(sliding_log(df, limit=2)) == [True, True, False, False, True, False, True]


def test_ties_go_by_id_and_zero_limit(spark):
    df = log(spark, [("c", 5, i) for i in range(4)])
    assert decisions(sliding_log(df, limit=3)) == [True, True, True, False]
    assert decisions(sliding_log(df, limit=0)) == [False] * 4


def test_reset_after_a_pause(spark):
    df = log(spark, [("c", i * 0.1, i) for i in range(6)] + [("c", 61, 6)])
    assert decisions(sliding_log(df, limit=5)) == [True] * 5 + [False, True]


def test_token_bucket_fixture(spark):
    times = [1, 2, 2.1, 2.2, 9]
    df = log(spark, [("c", t, i) for i, t in enumerate(times)])
    assert decisions(token_bucket(df, rate=1, burst=2)) == [True, True, True, False, True]
    with pytest.raises(ValueError):
        token_bucket(df, rate=0, burst=1)


def plain_log(times, limit, window):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if k >= t - window]
        ok = len(kept) < limit
        out.append(ok)
        if ok:
            kept.append(t)
    return out


def plain_bucket(times, rate, burst):
    tokens, last, out = burst * SECOND, None, []
    for t in times:
        if last is not None:
            tokens = min(burst * SECOND, tokens + (t - last) * rate)
        last = t
        out.append(tokens >= SECOND)
        tokens -= SECOND if tokens >= SECOND else 0
    return out


def random_rows(seed):
    """Three clients: a flood holding most rows, a bursty one and a quiet one."""
    rnd = random.Random(seed)
    rows = []
    for client, n, gaps in (("flood", 1500, (0, 2)), ("bursty", 400, (0, 0, 0, 1, 70, 61, 60)), ("quiet", 100, (30, 90))):
        t = 1000.0
        for _ in range(n):
            t += rnd.choice(gaps) + rnd.choice((0, 0.25, 0.000001))
            rows.append((client, t))
    rnd.shuffle(rows)
    return [(c, t, i) for i, (c, t) in enumerate(rows)]


@pytest.mark.parametrize("batch_rows", [37, 10_000])
def test_random_logs_equal_a_plain_fold(spark, batch_rows):
    rows = random_rows(batch_rows)
    df = log(spark, rows).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        got_log = {(r.client_ip, r.id): r.admitted for r in sliding_log(df, limit=7).collect()}
        got_bucket = {(r.client_ip, r.id): r.admitted for r in token_bucket(df, rate=1, burst=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for client in ("flood", "bursty", "quiet"):
        mine = sorted((int(t * SECOND), i) for c, t, i in rows if c == client)
        times = [t for t, _ in mine]
        assert [got_log[client, i] for _, i in mine] == plain_log(times, 7, 60 * SECOND), client
        assert [got_bucket[client, i] for _, i in mine] == plain_bucket(times, 1, 5), client


def test_pauses_split_a_client_over_tasks(spark):
    """The fold's partition key holds one stretch, not one client."""
    from lineseek.operators.admission import _stretches
    df = log(spark, [("c", 100 * i + j, 10 * i + j) for i in range(50) for j in range(5)])
    parts = _stretches(df.withColumnRenamed("ts_us", "__t"), "client_ip", 60 * SECOND)
    assert parts.select("__stretch").distinct().count() == 50
    assert parts.groupBy("__stretch").count().where("count <> 5").count() == 0


def test_verdicts(spark):
    df = log(spark, [("c", 0, 0), ("c", 1, 1)])
    out = with_verdicts(df, sliding_log(df, limit=1), ["client_ip", "ts_us", "id"]).orderBy("id").collect()
    assert [r.error_code for r in out] == [None, "RATE_LIMIT_EXCEEDED"]
