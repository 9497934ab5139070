"""The saved index: same answers, fewer files, no shuffle of the index."""

from pyspark.sql import functions as F

from lineseek.operators import corpus, membership
from lineseek.sources import index


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_saved_index_prunes_and_needs_no_shuffle(spark, corpus_of, tmp_path):
    lines = corpus_of([f"line {k} é" for k in range(500)] + ["line 3 é", "", "other"])
    saved = index.save(lines, "saved_index_test", str(tmp_path / "index"), buckets=8)
    try:
        assert sorted(r.line for r in saved.collect()) == sorted({*(f"line {k} é" for k in range(500)), "other"})
        assert saved.where(F.col("part") != index.bucket_of("line", 8)).count() == 0
        asked = ["line 3 é", "line 499 é", "none", "", "other", "other", None]
        queries = spark.createDataFrame([(q,) for q in asked], "query string")
        want = [(q, q in ("line 3 é", "line 499 é", "other")) for q in asked]
        pruned = membership.lookup_pruned(saved, queries, buckets=8)
        assert sorted(((r.query, r.found) for r in pruned.collect()), key=str) == sorted(want, key=str)
        assert "dynamicpruning" in plan_of(pruned)
        ordered = membership.lookup_sorted(saved, queries)
        assert sorted(((r.query, r.found) for r in ordered.collect()), key=str) == sorted(want, key=str)
        plan = plan_of(ordered).split("Initial Plan")[0]
        join = plan[plan.index("SortMergeJoin") :]
        side = join[join.rindex("Exchange") :] if join.rindex("Exchange") > join.index("saved_index_test") else join[join.rindex("Exchange") : join.index("saved_index_test")]
        assert join.count("Exchange hashpartitioning") == 1 and "saved_index_test" not in side.split("FileScan")[0]
        assert join.index("Exchange hashpartitioning") < join.index("saved_index_test")
        assert membership.lookup_pruned(saved, queries.where("false"), buckets=8).count() == 0
    finally:
        spark.sql("drop table saved_index_test")


def test_the_lower_cased_form_is_not_shuffled(corpus_of):
    exact = corpus.exact_view(corpus_of(["One", "one", "TWO"]))
    plan = corpus.with_fold(exact)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(lower(line" in plan
    assert {(r.line, r.is_fold) for r in corpus.with_fold(exact).collect()} == {("One", False), ("one", True), ("TWO", True)}
