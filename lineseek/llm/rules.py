"""Quality rules learned as decision lists, in DataFrame expressions only.

Base statistics of each text are array and string functions. Sequential covering
grows one conjunction of thresholds at a time from aggregated counts of labelled
texts, prunes it on others, sets what it covers aside and goes on. The result is
an ordered CASE expression a person can read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import Scratch, texts

SPACE = r"\x20\x09-\x0D"
BLANKS = " \t\n\u000b\f\r"
RUN = 5
#: name: expression over the base statistics; what rules may test.
TESTS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "capital_runs_per_word": "n_capital_runs / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_lines": "cast(n_dup_lines as double)",
    "words": "cast(n_words as double)",
}
CUTS, CONDITIONS, RULES = 32, 3, 8
#: A rule must reach this share of low-quality texts where it is pruned, on so many texts at least.
PRECISION, SUPPORT = 0.95, 5


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capital_runs of every whole text.

    Words are runs of characters other than space and U+0009 to U+000D; null text
    has none. Runs of five words are compared by 64-bit hashes inside the text.
    Texts without a repeated run skip the sort that places repeats.
    """
    blanks = F.lit(BLANKS)
    d = texts(docs, key, text).withColumn("trimmed", F.btrim("text", blanks))
    d = d.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", f"[{SPACE}]+")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, blanks) != ""))
    d = d.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit("[A-Z]{2,}")).cast("long").alias("n_capital_runs"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    parts = ", ".join(f"words[i + {j}]" for j in range(RUN))
    d = d.withColumn("runs", F.expr(f"if(n_words < {RUN}, array(), transform(sequence(0, cast(n_words as int) - {RUN}), i -> xxhash64({parts})))")).drop("words")
    d = d.withColumn("runs", F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.col("runs")).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("sorted", F.expr("sort_array(transform(runs, (h, i) -> struct(h, i)))")).drop("runs")
    d = d.withColumn("places", F.expr(
        "sort_array(transform(filter(sorted, (x, i) -> x.h = get(sorted, i - 1).h or x.h = get(sorted, i + 1).h), x -> x.i))")).drop("sorted")
    d = d.withColumn("n_repeat_words", F.expr(
        f"aggregate(transform(places, (p, i) -> least({RUN}, coalesce(get(places, i + 1) - p, {RUN}))), 0L, (a, x) -> a + x)"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capital_runs")


@dataclass(frozen=True)
class Condition:
    test: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(TESTS[self.test])
        return value >= self.cut if self.at_least else value < self.cut

    def __str__(self) -> str:
        return f"{self.test} {'>=' if self.at_least else '<'} {self.cut:.6g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """Ordered rules for low quality from statistics with ``y`` (0 low, 1 good) and ``fold`` (0 grow, else prune).

    Every step is one aggregation of the labelled table into at most tests x cuts
    counts. Ties go to the first test and the lowest cut. Null and other labels
    must be filtered before; without low-quality rows there are no rules.
    """
    spread = labelled.agg(*(F.percentile_approx(F.expr(e), [k / CUTS for k in range(1, CUTS)], 10_000).alias(t) for t, e in TESTS.items())).first()
    cuts = {t: sorted(set(spread[t] or [])) for t in TESTS}
    bins = [F.struct(F.lit(t).alias("test"), sum((F.when(F.expr(e) >= c, 1).otherwise(0) for c in cuts[t]), F.lit(0)).alias("bin")) for t, e in TESTS.items()]
    rules: list[list[Condition]] = []
    left = labelled

    def counts(rows: DataFrame) -> dict[str, dict[int, tuple[float, float]]]:
        out: dict = {t: {} for t in TESTS}
        cells = rows.select("y", F.explode(F.array(*bins)).alias("b")).groupBy("b.test", "b.bin").agg(
            F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("n"))
        for r in cells.collect():
            out[r["test"]][r["bin"]] = r["p"], r["n"]
        return out

    while len(rules) < RULES:
        rule: list[Condition] = []
        grow = left.where("fold = 0")
        while len(rule) < CONDITIONS:
            table = counts(grow.where(_all(rule)))
            whole = [sum(x) for x in zip(*table["words"].values(), strict=True)] if table["words"] else [0, 0]
            if not whole[0] or not whole[1]:
                break
            best, choice = 0.0, None
            for t in TESTS:
                below = [0, 0]
                for k, cut in enumerate(cuts[t]):
                    p, n = table[t].get(k, (0, 0))
                    below = [below[0] + p, below[1] + n]
                    for up, (p, n) in ((True, (whole[0] - below[0], whole[1] - below[1])), (False, below)):
                        gain = _gain(p, n, *whole)
                        if gain > best + 1e-9:
                            best, choice = gain, Condition(t, up, cut)
            if choice is None:
                break
            rule.append(choice)
        if not rule:
            # nothing good is left beside low quality, or nothing separates them
            break
        prefixes = [_all(rule[: k + 1]) for k in range(len(rule))]
        tried = left.where("fold <> 0").agg(*(
            F.sum(F.when(c & (F.col("y") == y), 1).otherwise(0)).alias(f"{k}_{y}") for k, c in enumerate(prefixes) for y in (0, 1))).first()
        worth = lambda k: ((tried[f"{k}_0"] or 0) - (tried[f"{k}_1"] or 0)) / max(1, (tried[f"{k}_0"] or 0) + (tried[f"{k}_1"] or 0))
        best_k = max(range(len(rule)), key=lambda k: (worth(k), -k))
        low, good = tried[f"{best_k}_0"] or 0, tried[f"{best_k}_1"] or 0
        if low < SUPPORT or low < PRECISION * (low + good):
            break
        rules.append(rule[: best_k + 1])
        left = left.where(~_all(rules[-1]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that a text meets, from 1; null when none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(_all(rules[k]), F.lit(k + 1)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, rule (text of the rule that rejected it) of every document.

    base_failed: fewer than 10 words, or more than 20 of 100 words in repeated
    five-word runs. The list is learned on labelled texts that pass the base; rows
    with crc32(doc_id) mod 3 of 0 grow rules, 2 prune them, 1 are left for tests.
    A text that meets no rule is kept, as is every one when nothing can be
    learned. Labels other than 0 and 1 are ignored. Null and empty texts have no
    words and fail the base. Repeated rows get equal verdicts; an empty table
    gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    table = scratch.keep("statistics", statistics(docs, key, text).withColumn("base_failed", failed))
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    marks = marks.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 3).where("fold <> 1")
    labelled = scratch.keep("labelled", table.where("not base_failed").join(marks, "doc_id"))
    rules = learn(labelled)
    names = F.lit(None).cast("string")
    for k, rule in enumerate(rules):
        names = F.when(F.col("rule") == k + 1, " and ".join(map(str, rule))).otherwise(names)
    out = table.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", names.alias("rule"))
