"""Many patterns against many lines.

Substring patterns
    few patterns:  tests are literals of shared scans (``literal_matches``)
    more patterns: patterns and lines are cut into short grams and meet by an
                   equality join on the gram's hash; the text itself then decides.
                   Work grows with the text, not with patterns x lines.
    many of them:  patterns of up to 64 characters are walked as one trie
                   (``operators.automaton``) if it fits a table of bounded size, else
                   those of up to five, as their grams would be every place of the text.
Regex patterns
    texts that every match must hold are read off the pattern. Few patterns are
    literal tests of shared scans, ``PER_SCAN`` to a scan, where these texts are
    looked for before the pattern is tried; of many patterns the rarest texts
    meet the lines by the gram join, and a pattern is tried on its candidates
    only. Patterns without such texts are tried on every line.

Both return ``(pattern_id, <line columns>)``, one row per match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lineseek.functions import factors, regex
from lineseek.operators import automaton
from lineseek.operators.search import SearchOptions, first_matches, limit_per_query, predicate
from lineseek.plans.joins import join_groups
from lineseek.plans.session import materialise
from lineseek.plans.sizing import broadcast_if_small, fits

PER_SCAN = 64
PER_PLAN = 1024
# literal tests that cost as much as cutting the text at every character once, and as walking it by trie
TESTS_PER_WALK = 200
TESTS_PER_TRIE = 20
# patterns beyond which their texts are joined to the lines instead of tested one by one
REGEX_TESTS = 128
# (shortest pattern, gram length, stride). Long grams keep candidate pairs few,
# strides keep cuts few. Patterns shorter than the last band are their own gram.
# A long pattern asks for long grams: short ones stand in so many lines that the
# candidates grow with patterns x lines.
LONG_BANDS = ((256, 129, 128), (64, 33, 32), (16, 9, 8))
LONGEST_BAND = LONG_BANDS[0][0]
MIDDLE_BANDS = ((12, 7, 6), (8, 6, 3), (6, 6, 1))
SHORT_BAND = (4, 4, 1)


def literal_matches(
    lines: DataFrame, tests: Iterable[tuple[int, Column]], id_name: str = "pattern_id"
) -> DataFrame:
    """One scan that evaluates several literal tests on each line, once.

    Lines that match nothing end at the explode; a filter on the ids before it
    would be moved below them and do all tests again.
    """
    ids = F.array_compact(F.array(*[F.when(test, F.lit(i).cast("bigint")) for i, test in tests]))
    return lines.select(F.explode(ids).alias(id_name), *lines.columns)


def _passes(lines: DataFrame, patterns: DataFrame, test: Callable[[Row], Column | None]) -> DataFrame:
    """Literal tests for a whole pattern table; ``test`` may leave a pattern out.

    Patterns come to the driver ``PER_PLAN`` at a time and become the literals of
    scans of ``PER_SCAN`` tests. A longer table is worked off plan by plan, each
    writing its matches down, so that neither plan nor driver grows with it.
    """
    n_plans = -(-patterns.count() // PER_PLAN)
    out = lines.select(F.lit(None).cast("bigint").alias("pattern_id"), "*").limit(0)
    for i in range(n_plans):
        mine = patterns.where(F.pmod(F.xxhash64("pattern_id"), F.lit(n_plans)) == i) if n_plans > 1 else patterns
        tests = [(r["pattern_id"], t) for r in mine.collect() if (t := test(r)) is not None]
        scans = [literal_matches(lines, tests[k:k + PER_SCAN]) for k in range(0, len(tests), PER_SCAN)]
        if scans:
            found = reduce(DataFrame.unionByName, scans)
            found = materialise(found, "matches") if n_plans > 1 else found
            out = found if i == 0 else out.unionByName(found)
    return out


def _bands(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Bands for the pattern lengths at hand. All need q + s - 1 <= length.

    Each band is one more walk over the text, so the middle lengths share one: the
    one its shortest pattern allows.
    """
    middle = [n for n in lengths if MIDDLE_BANDS[-1][0] <= n < LONG_BANDS[-1][0]]
    chosen = [*LONG_BANDS]
    if middle:
        chosen.append(next(b for b in MIDDLE_BANDS if b[0] <= min(middle)))
    return [*chosen, SHORT_BAND]


def _cut(text: Column, q: int, s: int) -> Column:
    """The q-character grams starting at every s-th character, in one pass."""
    # \G: the rest, too short for a gram, is not tried from each of its characters
    return F.regexp_extract_all(text, F.lit(rf"(?s)\G(?=(.{{{q}}})).{{1,{s}}}"), F.lit(1))


def _keyed(patterns: DataFrame, bands: list[tuple[int, int, int]], within: tuple[str, ...]) -> DataFrame:
    """Patterns by gram: one row for each of the s places a cut can fall on."""
    size = F.length("pattern")
    q, s = size, F.lit(1)
    for low, band_q, band_s in reversed(bands):
        q = F.when(size >= low, band_q).otherwise(q)
        s = F.when(size >= low, band_s).otherwise(s)
    return (
        patterns.withColumn("q", q)
        .withColumn("stride", s)
        .withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("stride") - 1)))
        .withColumn("gram_key", F.xxhash64(F.substring(F.col("pattern"), F.col("shift") + 1, F.col("q")), *within))
    )


def substring_matches(
    lines: DataFrame,
    patterns: DataFrame,
    text_col: str = "line",
    line_key: str = "first_pos",
    strategy: str = "auto",
    within: tuple[str, ...] = (),
    kept: list[str] | None = None,
) -> DataFrame:
    """Every (pattern, line) where the line contains the pattern, once each.

    ``patterns`` has ``(pattern_id bigint, pattern string)``; ``line_key`` is
    unique in ``lines``. ``strategy``: auto, scan, grams or trie - same rows each way.
    Bytes that are not UTF-8 count as (and come out as) U+FFFD.
    ``within``: columns of both tables that must be equal as well (``line_key`` is
    then unique together with them). ``kept``: the columns of a line that are put
    out, all by default; every match repeats them, so leave out texts that nobody reads.

    Gram join: a line is cut at every s-th character only, and the pattern is
    keyed by its grams at s consecutive places. An occurrence then always covers
    one cut, and its first occurrence covers exactly one (cut, place) pair, so
    testing for that pair verifies the match and keeps it single without a
    ``distinct``. The big side is cut s times less often than the text is long.
    """
    if strategy not in ("auto", "scan", "grams", "trie"):
        raise ValueError("strategy must be auto, scan, grams or trie")
    patterns = patterns.where(F.length("pattern") > 0).select(F.col("pattern_id").cast("bigint"), "pattern", *within)
    # places are counted in characters: both strategies see the same, valid ones
    lines = lines.withColumn(text_col, F.make_valid_utf8(text_col))
    kept = lines.columns if kept is None else kept
    counts = _counts(patterns)
    found, longest = None, 0
    if strategy in ("auto", "trie"):
        found, longest = _walked(lines, patterns, counts, text_col, within, kept, 0 if strategy == "trie" else TESTS_PER_TRIE)
    others = {n: c for n, c in counts.items() if n > longest}
    if found is None:
        return _by_length(lines, patterns, others, text_col, line_key, strategy, within).select("pattern_id", *kept)
    if not others:
        return found
    rest = _by_length(lines, patterns.where(F.length("pattern") > longest), others, text_col, line_key, strategy, within)
    return found.unionByName(rest.select("pattern_id", *kept))


def _counts(patterns: DataFrame) -> dict[int, int]:
    """Number of patterns of each length; those of the longest band count as one length."""
    size = F.least(F.length("pattern"), F.lit(LONGEST_BAND))
    return {r["n"]: r["count"] for r in patterns.groupBy(size.alias("n")).count().collect()}


def _walked(
    lines: DataFrame, patterns: DataFrame, counts: dict[int, int], text_col: str, within: tuple[str, ...], kept: list[str], least: int,
    every: bool = False,
) -> tuple[DataFrame | None, int]:
    """Matches of the patterns up to a length, and this length, where they fit a trie and are more than ``least``."""
    for longest in (automaton.LONGEST, automaton.SHORT):
        if sum(c for n, c in counts.items() if n <= longest) > least:
            short = patterns.where(F.length("pattern") <= longest)
            if (found := automaton.short_matches(lines, short, text_col, within, every, kept)) is not None:
                return found, longest
    return None, 0


def _by_length(
    lines: DataFrame, patterns: DataFrame, counts: dict[int, int], text_col: str, line_key: str, strategy: str, within: tuple[str, ...],
) -> DataFrame:
    """Walks for the lengths that have enough patterns, literal tests for the others."""
    size = F.least(F.length("pattern"), F.lit(LONGEST_BAND))
    bands = _bands(list(counts))
    walk_of = {n: next(((q, s) for low, q, s in bands if n >= low), (n, 1)) for n in counts}
    per_walk: dict[tuple[int, int], int] = {}
    for n, count in counts.items():
        per_walk[walk_of[n]] = per_walk.get(walk_of[n], 0) + count
    # a walk over the text pays once it replaces enough literal tests
    walks = sorted(
        w for w, count in per_walk.items() if strategy == "grams" or (strategy != "scan" and count * w[1] > TESTS_PER_WALK)
    )
    walked = [n for n in counts if walk_of[n] in walks]

    def holds(r: Row) -> Column:
        same = [F.col(c) == F.lit(r[c]) for c in within]
        return reduce(lambda a, b: a & b, [*same, F.contains(F.col(text_col), F.lit(r["pattern"]))])

    if not walked:
        return _passes(lines, patterns, holds)
    by_gram = _gram_matches(lines, patterns.where(size.isin(walked)), text_col, line_key, within, bands, walks)
    if len(walked) == len(counts):
        return by_gram
    return by_gram.unionByName(_passes(lines, patterns.where(~size.isin(walked)), holds))


def _gram_matches(
    lines: DataFrame, patterns: DataFrame, text_col: str, line_key: str, within: tuple[str, ...],
    bands: list[tuple[int, int, int]], walks: list[tuple[int, int]], every: bool = False,
) -> DataFrame:
    """Lines by gram join; ``every`` occurrence, with its ``offset``, or the first one only."""
    keyed = _keyed(patterns, bands, within)
    small = fits(keyed)
    kept = lines.columns if small else [*within, line_key, text_col]
    grams = (
        lines.select(*kept, F.explode(F.array(*[_cut(F.col(text_col), q, s) for q, s in walks])).alias("grams"))
        .select(*kept, F.posexplode("grams").alias("cut", "gram"))
        .withColumn("gram_key", F.xxhash64("gram", *within))
    )
    at = F.instr(F.col(text_col), F.col("pattern"))
    place = F.col("cut") * F.col("stride") - F.col("shift")
    first_hit = (at > 0) & (at - 1 == place)
    if every:
        first_hit = (place >= 0) & (F.expr(f"substring(`{text_col}`, cut * stride - shift + 1, length(pattern))") == F.col("pattern"))
    put_out = ["pattern_id", *lines.columns, *([place.cast("bigint").alias("offset"), (at - 1 == place).alias("is_first")] if every else [])]
    on = ["gram_key", *within]
    if small:
        # the gram lookup happens where the line is read; no shuffle
        return grams.join(F.broadcast(keyed), on).where(first_hit).select(*put_out)
    # Pattern tables past the bound: shuffle (gram, line key, cut), not the text,
    # then bring the texts to the candidate pairs only. A frequent gram is split by
    # AQE's skew join.
    numbered = materialise(patterns.withColumn("__row", F.monotonically_increasing_id()), "patterns")
    keyed = _keyed(numbered, bands, within).select(*on, "__row", "stride", "shift")
    pairs = materialise(grams.select(*on, line_key, "cut").join(keyed, on).drop("gram_key"), "pairs")
    spelled = pairs.join(broadcast_if_small(numbered.select("__row", "pattern_id", "pattern")), "__row")
    return lines.join(broadcast_if_small(spelled), [*within, line_key]).where(first_hit).select(*put_out)


def _compiled(spark: SparkSession, pattern: str, ignore_case: bool) -> str | None:
    """The pattern in the JVM's spelling, if it is one that runs there."""
    if not regex.is_valid(pattern):
        return None
    translated = regex.to_jvm(pattern, ignore_case)
    return translated if regex.runs_on_jvm(spark, translated) else None


def _guarded(text: Column, pattern: str, translated: str, ignore_case: bool, lowered: bool = False) -> Column:
    """The test for a pattern behind those for the texts that its matches must hold; ``lowered``: the text is in lower case."""
    within = F.lower(text) if not lowered and factors.folds(pattern, ignore_case) else text
    groups = [reduce(lambda a, b: a | b, [F.contains(within, F.lit(t)) for t in sorted(g)]) for g in factors.required(pattern, ignore_case)]
    return reduce(lambda a, b: a & b, [*groups, text.rlike(translated)])


def regex_matches(
    lines: DataFrame, patterns: DataFrame, ignore_case: bool = False, text_col: str = "line", line_key: str = "first_pos",
    strategy: str = "auto",
) -> DataFrame:
    """Every (pattern, line) where the regex is found in the line.

    Invalid patterns match nothing here; ``operators.requests`` reports them. A
    pattern that the JVM refuses is left out as well, so it fails no other one.
    ``strategy``: auto, scan (tests on every line) or factors (candidates by the
    gram join; ``line_key`` is unique in ``lines``) - same rows each way.
    """
    if strategy not in ("auto", "scan", "factors"):
        raise ValueError("strategy must be auto, scan or factors")
    patterns = patterns.select("pattern_id", "pattern")
    spark = lines.sparkSession

    def test(r: Row) -> Column | None:
        translated = _compiled(spark, r["pattern"], ignore_case)
        return None if translated is None else _guarded(F.col(text_col), r["pattern"], translated, ignore_case)

    if strategy == "scan" or strategy == "auto" and patterns.limit(REGEX_TESTS + 1).count() <= REGEX_TESTS:
        return _passes(lines, patterns, test)
    known = materialise(patterns.join(_factored(patterns.select("pattern").distinct(), ignore_case), "pattern", "left"), "factored")
    without = _passes(lines, known.where("texts is null").select("pattern_id", "pattern"), test)
    return _candidates(lines, known.where("texts is not null"), text_col, line_key).unionByName(without)


FACTORS = "pattern string, translated string, folded boolean, texts array<string>"


def _factored(patterns: DataFrame, ignore_case: bool) -> DataFrame:
    """pattern, translated, folded and texts (of the rarest group) of the patterns that have any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pattern in batch["pattern"]:
                if pattern is None or not regex.is_valid(pattern):
                    continue
                group = factors.best(factors.required(pattern, ignore_case))
                if group:
                    rows.append((pattern, regex.to_jvm(pattern, ignore_case), factors.folds(pattern, ignore_case), sorted(group)))
            yield pd.DataFrame(rows, columns=["pattern", "translated", "folded", "texts"])

    return patterns.mapInPandas(run, FACTORS)


def _candidates(lines: DataFrame, known: DataFrame, text_col: str, line_key: str) -> DataFrame:
    """Lines that hold one of the texts of a pattern, and on which it is found. Lines without a key are left out.

    The pattern is tried where the text is found, so that no line is shuffled.
    """
    known = known.distinct().select(F.monotonically_increasing_id().alias("number"), "*")
    known = materialise(known.select("number", "pattern_id", "translated", "folded", "texts"), "numbered")
    asked = broadcast_if_small(known.select("number", "pattern_id", "translated"))
    lines = lines.where(F.col(line_key).isNotNull())
    parts = [lines.select(F.lit(None).cast(known.schema["pattern_id"].dataType).alias("pattern_id"), "*").limit(0)]
    for folded, several in [(r["folded"], r["several"]) for r in known.select("folded", (F.size("texts") > 1).alias("several")).distinct().collect()]:
        mine = known.where((F.col("folded") == folded) & ((F.size("texts") > 1) == several))
        texts = mine.select(F.col("number").alias("pattern_id"), F.explode("texts").alias("pattern"))
        seen = lines.withColumn("__seen", F.lower(text_col) if folded else F.col(text_col))
        hits = substring_matches(seen, texts, "__seen", line_key, kept=lines.columns).withColumnRenamed("pattern_id", "number")
        found = hits.join(asked, "number").where(F.expr(f"`{text_col}` rlike translated"))
        # a line may hold several texts of a pattern
        found = found.dropDuplicates(["number", line_key]) if several else found
        parts.append(found.select("pattern_id", *lines.columns))
    return reduce(DataFrame.unionByName, parts)


def offsets_of_many(
    lines: DataFrame, patterns: DataFrame, text_col: str = "line", line_key: str = "first_pos", strategy: str = "auto",
    kept: list[str] | None = None,
) -> DataFrame:
    """(pattern_id, <line columns>, offset, is_first): every place of every pattern, overlapping ones included.

    Patterns come from the trie walk (``strategy`` auto; grams leaves it out) as far
    as they fit it. Of others each occurrence covers exactly one (cut, place) pair of
    the gram join, so it comes out once, tested at its own place. ``is_first``: the
    pattern's first place in the line. Empty and null patterns have no place; invalid
    bytes count as U+FFFD. ``kept``: the columns of a line that are put out, all by
    default; every place repeats them.
    """
    if strategy not in ("auto", "grams"):
        raise ValueError("strategy must be auto or grams")
    patterns = patterns.where(F.length("pattern") > 0).select(F.col("pattern_id").cast("bigint"), "pattern")
    lines = lines.withColumn(text_col, F.make_valid_utf8(text_col))
    kept = lines.columns if kept is None else kept
    counts, parts, longest = _counts(patterns), [], 0
    if strategy == "auto":
        found, longest = _walked(lines, patterns, counts, text_col, (), kept, 0, every=True)
        parts = [found] if found is not None else []
    lengths = sorted(n for n in counts if n > longest)
    if lengths:
        bands = _bands(lengths)
        walks = sorted({next(((q, s) for low, q, s in bands if n >= low), (n, 1)) for n in lengths})
        others = patterns.where(F.length("pattern") > longest)
        by_gram = _gram_matches(lines, others, text_col, line_key, (), bands, walks, every=True)
        parts.append(by_gram.select("pattern_id", *kept, "offset", "is_first"))
    nothing = (F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("boolean").alias("is_first"))
    empty = lines.select(F.lit(None).cast("bigint").alias("pattern_id"), *kept, *nothing).limit(0)
    return reduce(DataFrame.unionByName, parts) if parts else empty


#: Pieces of a line whose places are put together in one array.
PIECES = 512


def offsets(lines: DataFrame, needle: str, text_col: str = "line") -> DataFrame:
    """All 0-based places of a text in each line, overlapping ones included.

    The line is cut in front of every occurrence; the running length of the
    pieces gives the places, block by block of ``PIECES`` pieces, so that no array
    grows with the number of places in a line.
    """
    if not needle:
        raise ValueError("INVALID_REQUEST: empty query")

    def running(values: Column, start: Column, size_of: Callable[[Column], Column]) -> Column:
        """The sum before each value."""
        nothing = F.struct(start.alias("at"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(
            values, nothing,
            lambda acc, x: F.struct((acc["at"] + size_of(x)).alias("at"), F.array_append(acc["before"], acc["at"]).alias("before")),
            lambda acc: acc["before"],
        )

    pieces = F.split(F.col(text_col), f"(?={regex.quoted(needle)})")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__pieces") - 1) / PIECES).cast("int")),
        lambda b: F.slice("__pieces", b * PIECES + 1, F.lit(PIECES)),
    )
    sizes = F.transform("__blocks", lambda block: F.aggregate(block, F.lit(0), lambda n, piece: n + F.length(piece)))
    cut = lines.where(F.contains(F.col(text_col), F.lit(needle))).withColumn("__pieces", pieces).withColumn("__blocks", blocks)
    cut = cut.withColumn("__starts", running(sizes, F.lit(0), lambda n: n))
    each = cut.select(*lines.columns, F.explode(F.arrays_zip("__blocks", "__starts")).alias("__b"))
    places = running(F.col("__b.__blocks"), F.col("__b.__starts"), F.length)
    both = each.select(*lines.columns, F.explode(places).alias("offset")).withColumn("offset", F.col("offset").cast("bigint"))
    # every piece but the one that leads the line starts at an occurrence
    return both.where((F.col("offset") > 0) | F.startswith(F.col(text_col), F.lit(needle)))


def batch_search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """A batch of option searches: matches ``(query_id, line, first_pos)``.

    ``index`` is the table of ``sources.index`` (persisted, or just built);
    ``queries``: (query_id, query, case_sensitive, whole_line, regex, invert,
    max_count), already validated. Both search views are laid under each other,
    so each kind of query needs one scan for both: whole-line queries are an
    equality join, substrings the pattern join, regex and inverted queries literal
    tests. Queries that differ in their limits alone are one search, and those with
    a limit keep their first matches only.
    """
    q = queries.fillna({"case_sensitive": False, "whole_line": False, "regex": False, "invert": False})
    limit = F.greatest(F.coalesce("max_count", F.lit(0)), F.lit(0))
    q = q.select(F.col("query_id").cast("bigint").alias("query_id"), "query", F.col("case_sensitive").alias("sensitive"), *ASKED[2:], limit.alias("limit"), (limit > 0).alias("limited"))
    searches = q.groupBy(*ASKED, "limited").agg(F.max("limit").alias("most"))
    searches = materialise(searches.select(F.monotonically_increasing_id().alias("pattern_id"), "*"), "searches")
    own = join_groups(q, searches.select("pattern_id", *ASKED, "limited"), [*ASKED, "limited"]).select("pattern_id", "query_id")
    own = broadcast_if_small(materialise(own, "own"))
    sizes = {r["limited"]: r["most"] for r in searches.groupBy("limited").agg(F.max("most").alias("most")).collect()}
    kinds = [r[0] for r in searches.select("sensitive").distinct().collect()]
    sensitive = F.struct(F.lit(True).alias("sensitive"), F.col("line").alias("text"), "first_pos")
    folded = F.struct(
        F.lit(False).alias("sensitive"), F.col("line_lower").alias("text"), F.col("fold_first_pos").alias("first_pos")
    )
    asked = [v for kind, v in ((True, sensitive), (False, F.when(F.col("is_fold"), folded))) if kind in kinds or not kinds]
    views = index.select("line", F.explode(F.array_compact(F.array(*asked))).alias("v")).select("line", "v.*")
    parts = []
    for limited in sizes or (False,):
        found = _found(views, searches.where(F.col("limited") == limited))
        if limited:
            # cut where they are found: neither a sort nor a written table meets all matches
            found = materialise(first_matches(found, sizes[limited], "pattern_id"), "first")
        out = found.join(own, "pattern_id").select("query_id", "line", "first_pos")
        parts.append(limit_per_query(out, queries.where(F.col("max_count") > 0)) if limited else out)
    return reduce(DataFrame.unionByName, parts)


#: What makes two queries one search.
ASKED = ("query", "sensitive", "whole_line", "regex", "invert")


def _found(views: DataFrame, searches: DataFrame) -> DataFrame:
    """All matches of different searches: (pattern_id, line, first_pos)."""
    q = searches.withColumn("pattern", F.when(F.col("sensitive"), F.col("query")).otherwise(F.lower("query")))
    joined = q.where("not regex and not invert")
    whole = joined.where("whole_line").select("pattern_id", "sensitive", F.col("pattern").alias("text"))
    parts = [
        views.join(broadcast_if_small(whole), ["sensitive", "text"]),
        substring_matches(views, joined.where("not whole_line"), "text", within=("sensitive",), kept=["line", "first_pos"]),
        _passes(views, q.where("regex or invert"), _option_test),
    ]
    return reduce(DataFrame.unionByName, [p.select("pattern_id", "line", "first_pos") for p in parts])


def _option_test(r: Row) -> Column:
    options = SearchOptions(r["sensitive"], r["whole_line"], r["regex"], r["invert"])
    test = predicate(r["query"], options, F.col("text"))
    if options.regex and regex.is_valid(r["query"]):
        fold = not options.case_sensitive
        test = _guarded(F.col("text"), r["query"], regex.to_jvm(r["query"], ignore_case=fold), fold, lowered=fold)
        test = ~test if options.invert else test
    return (F.col("sensitive") == r["sensitive"]) & test
