"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. These
entities and strings that can only be secrets are seeds: the words to their left
are lexical patterns. Patterns and the strings in their slots form a graph that is
scored in rounds: a pattern by the strings known in its slot, a string by its
patterns. Patterns that prove reliable then mark whatever stands in their slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.common import Scratch, packed, texts, unpacked

#: Kinds in the order of ties; the learned one last.
KINDS = ("email", "ip", "card", "phone", "id")
# Runs are possessive and begin where the run begins (or the last match ended): the same matches, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # what may stand in a slot: a word of six signs or more with a digit
    "id": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+",
}
NEEDS = {"email": "@", "phone": "+"}
#: Signs to the left that the words of a pattern are taken from; longer words are cut.
CONTEXT = 48
ROUNDS = 3
#: A pattern is reliable with this score, and so many different known strings in its slot.
RELIABLE, SUPPORT, DAMPING = 0.8, 5, 1.0
#: Signs, letters and digits that a string has at least which can only be a secret.
SECRET = 24, 4, 6


def _matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, mark, kind, k, start, end, value, left: all matches of all patterns, in code points from 0."""
    d = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"), "text")
    has_digit = F.col("text").rlike("[0-9]")
    for kind, pattern in PATTERNS.items():
        guard = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        guard = guard & has_digit if kind != "email" else guard
        none = F.array().cast("array<string>")
        d = d.withColumn(f"{kind}_gaps", F.when(guard, F.split("text", pattern, -1)).otherwise(none))
        d = d.withColumn(f"{kind}_values", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))

    def last(text: Column) -> Column:
        return F.coalesce(F.substring(text, -CONTEXT, CONTEXT), F.lit(""))

    def listed(number: int, kind: str) -> Column:
        gaps, values = F.col(f"{kind}_gaps"), F.col(f"{kind}_values")

        def left(i: Column) -> Column:
            """The signs before a slot, over the two slots before it where these are near."""
            if kind != "id":
                return F.lit("")
            return last(F.concat(*(last(F.get(of, i - back)) for back in (2, 1) for of in (gaps, values)), last(gaps[i])))

        rows = F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.struct(
            F.lit(number).alias("kind"), i.alias("k"), F.length(gaps[i]).alias("gap"), values[i].alias("value"),
            left(i).alias("left")))
        return F.when(F.size(values) > 0, rows).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,value:string,left:string>>"))

    some = [listed(n, kind) for n, kind in enumerate(PATTERNS)]
    return d.select("row", "doc_id", "mark", F.explode(F.concat(*some)).alias("m")).select("row", "doc_id", "mark", "m.*")


def _placed(matches: DataFrame) -> DataFrame:
    w = Window.partitionBy("row", "kind").orderBy("k")
    size = F.length("value")
    end = F.sum(F.col("gap") + size).over(w)
    return matches.withColumn("end", end).withColumn("start", F.col("end") - size).drop("gap")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(F.transform(doubled, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    value, digits = F.col("value"), F.regexp_replace("value", "[^0-9]", "")
    part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    size = F.length(digits)
    kind = F.col("kind")
    return (F.when(kind == 1, value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(kind == 2, F.when(size.between(12, 19), _luhn(digits)).otherwise(F.lit(False)))
            .when(kind == 3, size.between(9, 15)).otherwise(F.lit(True)))


def _contexts() -> Column:
    """The lexical patterns of a slot: the last two words before it, and the last one if it is a word of letters; digits made alike."""
    two = F.lower(F.regexp_extract("left", r"(\S+\s+\S+\s*|\S+\s*)$", 1))
    one = F.regexp_extract(two, r"(\S+\s*)$", 1)
    plain = [F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "[0-9]", "0") for x in (two, F.when(one.rlike("[a-z]{3}"), one))]
    return F.array_distinct(F.array_compact(F.array(*(F.nullif(x, F.lit("")) for x in plain))))


def patterns(slots: DataFrame, scratch: Scratch) -> DataFrame:
    """Reliable patterns: pattern, score, support. ``slots`` has pattern, value, seed (boolean).

    A string is known by 1 if it is a seed anywhere, else by the best score of its
    supported patterns. A pattern's score is the mean knowledge of the different
    strings in its slot, damped by ``DAMPING``; its support counts those known by
    ``RELIABLE``. Scores settle in a few rounds; each is written, so that rounds do
    not pile up.
    """
    edges = scratch.keep("edges", slots.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    known = scratch.keep("known-0", edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("known")))
    for step in range(1, ROUNDS + 1):
        scores = edges.join(known, "value").groupBy("pattern").agg(
            (F.sum("known") / (F.count(F.lit(1)) + DAMPING)).alias("score"), F.count(F.when(F.col("known") >= RELIABLE, 1)).alias("support"))
        scores = scratch.keep(f"scores-{step}", scores)
        best = F.max(F.when(F.col("support") >= SUPPORT, F.col("score")).otherwise(0.0))
        known = scratch.keep(f"known-{step}", edges.join(scores, "pattern").groupBy("value").agg(
            F.greatest(F.max(F.col("seed").cast("double")), best).alias("known")))
    return scores.where((F.col("score") >= RELIABLE) & (F.col("support") >= SUPPORT))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), kind (number in KINDS), start, end of every span, each once.

    Base kinds: leftmost non-overlapping matches of the pattern; matches that fail
    the kind's test are dropped, not retried. The learned kind ``id``: words that no
    base span overlaps and that stand in the slot of a reliable pattern or can only
    be secrets (``SECRET``), wherever these stand. A pattern is the one or two words
    before a slot, as far as they lie in the last ``CONTEXT`` signs before it.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    matches = scratch.keep("matches", _matches(texts(docs, key, text)))
    placed = scratch.keep("placed", _placed(matches).where(_valid()))
    base = placed.where("kind < 4")
    covered = base.select("row", F.col("start").alias("from"), F.col("end").alias("to"))
    slots = placed.where("kind = 4").withColumn("patterns", _contexts())
    # overlap with a base span of the same text: the nearest base ends and starts by running maxima, no pairs
    marks = slots.select("row", "start", "end", F.lit(1).alias("slot")).unionByName(
        covered.select("row", F.col("from").alias("start"), F.col("to").alias("end"), F.lit(0).alias("slot")))
    before = Window.partitionBy("row").orderBy("start", "slot").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("reach", F.max(F.when(F.col("slot") == 0, F.col("end"))).over(before)).withColumn(
        "next", F.min(F.when(F.col("slot") == 0, F.col("start"))).over(after))
    marks = marks.where("slot = 1").select("row", "start", F.coalesce((F.col("reach") > F.col("start")) | (F.col("next") < F.col("end")), F.lit(False)).alias("inside"))
    letters, digits = F.length(F.regexp_replace("value", "[^A-Za-z]", "")), F.length(F.regexp_replace("value", "[^0-9]", ""))
    secret = (F.length("value") >= SECRET[0]) & (letters >= SECRET[1]) & (digits >= SECRET[2])
    slots = slots.join(marks, ["row", "start"]).withColumn("secret", secret).withColumn("pattern", F.explode_outer("patterns"))
    slots = scratch.keep("slots", slots.drop("patterns", "left"))
    reliable = patterns(slots.where("pattern is not null").select("pattern", "value", (F.col("inside") | F.col("secret")).alias("seed")), scratch)
    learned = slots.where("not inside and not secret").join(reliable.select("pattern"), "pattern").unionByName(slots.where("not inside and secret"))
    columns = ["doc_id", "mark", "kind", "start", "end"]
    return scratch.only("spans", base.select(columns).unionByName(learned.select(columns)).distinct())


def _listed(rows: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _by_text(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    Counts and hash are those of the base spans, kind:start:end by start, then kind,
    joined by commas (code points, end exclusive); spans lists the learned ones
    too. Null texts are empty: no spans. Rows that repeat are answered alike, texts
    that share an id each for itself, null ids like others. An empty table gives no
    rows. Other columns are ignored.
    """
    found = _by_text(spans(docs, key, text))
    rows = texts(docs, key, text).select("doc_id", F.xxhash64("text").alias("mark"))
    out = rows.alias("r").join(found.alias("f"), F.expr("r.doc_id <=> f.doc_id and r.mark = f.mark"), "left")
    out = out.select("r.doc_id", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found"))
    count = lambda n: F.size(F.filter("found", lambda s: s["kind"] == n)).cast("long")
    return out.select(
        "doc_id", *(count(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:4])),
        F.sha2(_listed(F.filter("found", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Texts without spans (null and empty ones among them) and all other columns stay
    as they are, whatever their names; texts of null ids are redacted too. Rows that repeat are redacted alike, texts that share an id each
    for itself. Very long texts are read whole. An empty table gives no rows.
    """
    found = spans(docs)
    w = Window.partitionBy("doc_id", "mark").orderBy("start", "kind")
    found = found.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("group", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = found.groupBy("doc_id", "mark", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    merged = merged.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy("doc_id", "mark").orderBy("start")), F.lit(0)))
    cuts = merged.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "from"))).alias("cuts"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col("row").getField("text")
    parts = F.transform("cuts", lambda c: F.concat(F.substring(text, c["from"].cast("int") + 1, (c["start"] - c["from"]).cast("int")), names[c["kind"]]))
    tail = F.substring(text, F.element_at("cuts", -1)["end"].cast("int") + 1, F.length(text))
    rows = packed(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    # merged at every size: spans that are broadcast while they are few would only behave differently once they have grown
    both = rows.join(cuts.withColumnsRenamed({"doc_id": "found_id"}).hint("merge"), F.expr("id <=> found_id and own = mark"), "left")
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail))
    return unpacked(both, docs.columns, text=new)
