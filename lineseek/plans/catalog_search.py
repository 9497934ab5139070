"""Catalogue: corpus, search and membership."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.operators import corpus, membership, patterns, quality, search
from lineseek.operators.search import SearchOptions
from lineseek.plans.registry import (
    SQL_BATCH, SQL_EXACT, SQL_FOLDED, SQL_LINES, r, register, rs, spread, sql_lines, sql_strip, table,
)
from lineseek.plans.joins import join_groups
from lineseek.plans.session import materialise, scratch_path
from lineseek.plans.sizing import broadcast_if_small, fits
from lineseek.sources import index, lines as sources, sinks


def doc_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_table(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", small_ids=True)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.clean(doc_raw(spark, sf_dir))


def saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the documents' lines, saved once in a session and used by every query on it."""
    name = f"lineseek_index_{hashlib.md5(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()}"
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return index.save(doc_lines(spark, sf_dir), name, scratch_path(spark, "saved-index"))


@register("""WITH l AS (
  SELECT path, line_no, line FROM (
    SELECT doc_id::HUGEINT + 1099511627776 AS path, unnest(generate_series(0, len(parts) - 1)) AS line_no, """ + sql_strip("unnest(parts)") + """ AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE line <> '')
SELECT line, count(*) AS n_occurrences, min(path * 4294967296 + line_no)::VARCHAR AS first_pos,
  max(path * 4294967296 + line_no)::VARCHAR AS last_pos, arg_max(line_no, path * 4294967296 + line_no) AS last_line_no FROM l GROUP BY line""")
def positions_of_large_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact view of documents whose ids lie beyond 2^40."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + F.lit(1 << 40)).alias("doc_id"), "text")
    view = corpus.exact_view(sources.clean(sources.from_table(docs, "doc_id", "text")))
    place = [F.col(c).cast("string").alias(c) for c in ("first_pos", "last_pos")]
    return view.select("line", "n_occurrences", *place, "last_line_no")


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_view(doc_lines(spark, sf_dir))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.folded_view(exact(spark, sf_dir))


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of benchmark items and conversation turns, as queries."""
    def texts(name: str, key: str) -> DataFrame:
        return sources.from_table(table(spark, sf_dir, name), key, "text").select(F.col("raw").alias("query"))

    both = texts("benchmark", "item_id").unionByName(texts("conversations", "conv_id"))
    return membership.prepare(both).where(F.col("query") != "").distinct()


def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines a corpus is required to hold: those of the benchmark items."""
    items = sources.from_table(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return sources.clean(items).select("line").distinct()


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct benchmark words, as patterns."""
    word = F.explode(F.split(F.regexp_replace("text", "\n", " "), " ")).alias("pattern")
    found = table(spark, sf_dir, "benchmark").select(word).where(F.col("pattern") != "").distinct()
    return found.select(F.xxhash64("pattern").alias("pattern_id"), "pattern")


SQL_REQUIRED = f"""required AS (
  SELECT DISTINCT line FROM (SELECT {sql_strip('unnest(string_split(text, chr(10)))')} AS line FROM benchmark)
  WHERE line <> '')"""

# ---------------------------------------------------------------- membership

MEMBERSHIP_SQL = f"""WITH {SQL_LINES}, {SQL_BATCH}, corpus AS (SELECT DISTINCT line FROM lines)
SELECT query, line IS NOT NULL AS found,
       CASE WHEN line IS NOT NULL THEN 'STRING EXISTS' ELSE 'STRING NOT FOUND' END AS verdict
FROM batch LEFT JOIN corpus ON query = line"""


@register(MEMBERSHIP_SQL)
def membership_verdict(spark, sf_dir):
    return membership.lookup(doc_lines(spark, sf_dir), query_batch(spark, sf_dir))


@register(MEMBERSHIP_SQL)
def membership_sorted(spark, sf_dir):
    """Ordered search in the saved index, which is bucketed and sorted by line."""
    return membership.lookup_sorted(saved_index(spark, sf_dir), query_batch(spark, sf_dir))


@register(MEMBERSHIP_SQL)
def index_lookup(spark, sf_dir):
    """Same lookup in the saved index, of which only the folders of the batch are read."""
    return membership.lookup_pruned(saved_index(spark, sf_dir), query_batch(spark, sf_dir))


@register(f"WITH {SQL_LINES}, {SQL_BATCH} SELECT query FROM batch WHERE query IN (SELECT line FROM lines)")
def membership_semi(spark, sf_dir):
    return membership.semi(query_batch(spark, sf_dir), doc_lines(spark, sf_dir))


@register(
    f"WITH {SQL_LINES}, {SQL_BATCH} SELECT query FROM batch WHERE NOT EXISTS (SELECT 1 FROM lines WHERE line = query)"
)
def membership_anti(spark, sf_dir):
    return membership.anti(query_batch(spark, sf_dir), doc_lines(spark, sf_dir))


@register(f"""WITH {SQL_LINES}, {SQL_BATCH}
SELECT query, query IN (SELECT line FROM lines) AS maybe FROM batch""")
def membership_hash_only(spark, sf_dir):
    return membership.lookup_by_hash(doc_lines(spark, sf_dir), query_batch(spark, sf_dir))


def _bit(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 12))::BIGINT % 16777216)"


@register(f"""WITH {SQL_LINES}, {SQL_BATCH}, bits AS (SELECT DISTINCT {_bit('line')} AS b FROM lines),
f AS (SELECT query IN (SELECT line FROM lines) AS found, {_bit('query')} IN (SELECT b FROM bits) AS maybe FROM batch)
SELECT count(*) AS n_queries, count(*) FILTER (found) AS n_found, count(*) FILTER (maybe) AS n_maybe,
       count(*) FILTER (maybe AND NOT found) AS false_positives,
       count(*) FILTER (found AND NOT maybe) AS false_negatives,
       {rs("count(*) FILTER (maybe AND NOT found) / count(*) FILTER (NOT found)", 9)} AS false_positive_rate
FROM f""")
def bloom_fpr(spark, sf_dir):
    out = membership.filter_error(doc_lines(spark, sf_dir), query_batch(spark, sf_dir), digest="md5")
    return out.withColumn("false_positive_rate", r(F.col("false_positive_rate"), 9))


@register(f"WITH {SQL_LINES} SELECT DISTINCT line FROM lines WHERE line = (SELECT min(line) FROM lines)")
def exact_single(spark, sf_dir):
    """One needle, the smallest line there is; the needle is looked up first."""
    ln = doc_lines(spark, sf_dir)
    needle = ln.agg(F.min("line")).first()[0]
    return membership.single(ln, needle or "")


@register(f"""WITH {SQL_LINES}, p AS (
  SELECT DISTINCT word AS query FROM (
    SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM benchmark) WHERE word <> '')
SELECT query, EXISTS (SELECT 1 FROM (SELECT DISTINCT line FROM lines) l WHERE starts_with(l.line, query)) AS found
FROM p""")
def search_prefix_batch(spark, sf_dir):
    queries = words(spark, sf_dir).select(F.col("pattern").alias("query"))
    return membership.prefix_exists(doc_lines(spark, sf_dir).select("line").distinct(), queries)


@register(f"""WITH {SQL_LINES}, {SQL_REQUIRED}
SELECT count(*) FILTER (line IN (SELECT line FROM lines)) AS present, count(*) AS required,
       bool_and(line IN (SELECT line FROM lines)) AS complete FROM required""")
def required_coverage(spark, sf_dir):
    return membership.coverage(required(spark, sf_dir), doc_lines(spark, sf_dir))


@register(f"WITH {SQL_LINES} SELECT coalesce(bool_or(contains(raw, 'tion the')), false) AS found FROM raw")
def any_line_contains(spark, sf_dir):
    return membership.any_line_contains(doc_raw(spark, sf_dir), "tion the")


@register(f"WITH {SQL_LINES} SELECT bool_or(raw = 'The') AS found FROM raw")
def raw_line_exists(spark, sf_dir):
    return membership.raw_line_exists(doc_raw(spark, sf_dir), "The")


@register(f"""WITH {SQL_LINES}, {SQL_BATCH}, corpus AS (SELECT DISTINCT line FROM lines)
SELECT kind, query, line IS NOT NULL AS found,
       CASE WHEN line IS NOT NULL THEN 'STRING EXISTS' ELSE 'STRING NOT FOUND' END AS verdict
FROM batch LEFT JOIN corpus ON query = line CROSS JOIN (VALUES ('json'), ('parquet'), ('csv'), ('orc')) AS k(kind)""")
def result_sinks(spark, sf_dir):
    """The answers of the batch written to every kind of sink and read back."""
    answers = materialise(membership.lookup(doc_lines(spark, sf_dir), query_batch(spark, sf_dir)), "answers")
    parts = []
    for kind in sinks.FORMATS:
        path = scratch_path(spark, f"sink-{kind}")
        sinks.write_result(answers, path, kind)
        parts.append(sinks.read_result(spark, path, answers.schema, kind).select(F.lit(kind).alias("kind"), "*"))
    return reduce(DataFrame.unionByName, parts)


# -------------------------------------------------------------------- search

def _search(spark, sf_dir, query: str, **options) -> DataFrame:
    chosen = SearchOptions(**options)
    view = exact(spark, sf_dir) if chosen.case_sensitive else folded(spark, sf_dir)
    return search.search(view, query, chosen)


@register(f"WITH {SQL_FOLDED} SELECT line, first_pos FROM folded WHERE contains(line_lower, 'then ')")
def search_substring_ci(spark, sf_dir):
    return _search(spark, sf_dir, "Then ")


@register(f"WITH {SQL_EXACT} SELECT line, first_pos FROM exact WHERE contains(line, 'Then ')")
def search_substring_cs(spark, sf_dir):
    return _search(spark, sf_dir, "Then ", case_sensitive=True)


@register(f"""WITH {SQL_FOLDED}, n AS (SELECT arg_max(line, (n_occurrences, line)) AS needle FROM exact)
SELECT line, first_pos FROM folded WHERE line_lower = (SELECT lower(needle) FROM n)""")
def search_whole_line(spark, sf_dir):
    """The most frequent line, searched in upper case."""
    view = exact(spark, sf_dir)
    needle = view.agg(F.max_by("line", F.struct("n_occurrences", "line"))).first()[0]
    return search.search(corpus.folded_view(view), needle.upper().lower(), SearchOptions(whole_line=True))


@register(f"WITH {SQL_FOLDED} SELECT line, first_pos FROM folded WHERE NOT contains(line_lower, 'e')")
def search_invert(spark, sf_dir):
    return _search(spark, sf_dir, "E", invert=True)


@register(f"WITH {SQL_EXACT} SELECT line, first_pos FROM exact WHERE line <> 'no such line'")
def search_invert_whole_line(spark, sf_dir):
    return _search(spark, sf_dir, "no such line", case_sensitive=True, whole_line=True, invert=True)


@register(f"""WITH {SQL_FOLDED}
SELECT line, first_pos FROM folded WHERE contains(line_lower, 'the') ORDER BY first_pos LIMIT 25""")
def search_max_count(spark, sf_dir):
    return _search(spark, sf_dir, "the", max_count=25)


@register(f"WITH {SQL_EXACT} SELECT line, first_pos FROM exact WHERE regexp_matches(line, '[A-Z][a-z]+ the [a-z]+ing')")
def search_regex(spark, sf_dir):
    return _search(spark, sf_dir, "[A-Z][a-z]+ the [a-z]+ing", case_sensitive=True, regex=True)


@register(f"WITH {SQL_FOLDED} SELECT line, first_pos FROM folded WHERE regexp_matches(line_lower, '^the .*ing[.]$')")
def search_regex_ci(spark, sf_dir):
    return _search(spark, sf_dir, "^THE .*ing[.]$", regex=True)


@register(f"WITH {SQL_EXACT} SELECT line, first_pos FROM exact WHERE starts_with(line, 'The ')")
def search_prefix(spark, sf_dir):
    return exact(spark, sf_dir).where(F.startswith(F.col("line"), F.lit("The "))).select("line", "first_pos")


@register(f"""WITH {SQL_EXACT}
SELECT line, first_pos, pos AS "offset" FROM (
  SELECT line, first_pos, unnest(generate_series(0, length(line) - 4)) AS pos FROM exact WHERE contains(line, 'the '))
WHERE substr(line, pos + 1, 4) = 'the '""")
def substring_offsets(spark, sf_dir):
    return patterns.offsets(exact(spark, sf_dir).select("line", "first_pos"), "the ")


SQL_WORDS = """p AS (SELECT DISTINCT word AS pattern FROM (
    SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM benchmark) WHERE word <> '')"""


@register(f"""WITH {SQL_EXACT}, {SQL_WORDS}
SELECT pattern, first_pos FROM p JOIN exact ON contains(line, pattern)""")
def multi_pattern_substring(spark, sf_dir):
    pats = words(spark, sf_dir)
    hits = patterns.substring_matches(exact(spark, sf_dir).select("line", "first_pos"), pats, kept=["first_pos"])
    return hits.join(broadcast_if_small(pats), "pattern_id").select("pattern", "first_pos")


@register(f"""WITH {SQL_EXACT}, {SQL_WORDS},
hits AS (SELECT pattern, line, first_pos FROM p JOIN exact ON contains(line, pattern)),
places AS (SELECT pattern, first_pos, line, unnest(generate_series(0, length(line) - length(pattern))) AS k FROM hits)
SELECT pattern, count(*) AS n_places, count(DISTINCT first_pos) AS n_lines, sum(k)::BIGINT AS sum_offset, max(k) AS max_offset
FROM places WHERE substr(line, k + 1, length(pattern)) = pattern GROUP BY pattern""")
def multi_pattern_offsets(spark, sf_dir):
    """All places of all words at once, summed up for each word."""
    pats = words(spark, sf_dir)
    lines = materialise(exact(spark, sf_dir).select("line", "first_pos"), "lines")
    # a position is one line's, but for documents of one id: only these are told apart by it, others by their first places
    shared = lines.groupBy("first_pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first_pos", F.lit(True).alias("shared"))
    shared = materialise(shared, "shared")
    lines = join_groups(lines, shared, ["first_pos"], "left", small=fits(shared))
    hits = patterns.offsets_of_many(lines, pats, kept=["first_pos", "shared"])
    parts = hits.groupBy("pattern_id", "shared", F.when(F.col("shared"), F.col("first_pos")).alias("first_pos")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_first").alias("firsts"), F.sum("offset").alias("s"), F.max("offset").alias("m"))
    found = parts.groupBy("pattern_id").agg(
        F.sum("n").alias("n_places"), F.sum(F.when(F.col("shared"), 1).otherwise(F.col("firsts"))).alias("n_lines"),
        F.sum("s").alias("sum_offset"), F.max("m").alias("max_offset"))
    return pats.join(found, "pattern_id").drop("pattern_id")


# Pattern list of the regex queries; ASCII classes, so that every engine agrees.
REGEXES = (
    "the.*[0-9]+",
    "the.*and.*[0-9]+",
    "([a-z]*ing ){2}",
    "[a-z]+[0-9]+[a-z]+",
    "^The",
    "ion.*ing",
    "tion[.]$",
    "[A-Z]{3,}",
)


@register(f"""WITH {SQL_EXACT}, p AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(REGEXES))})
  AS t(pattern_id, pattern))
SELECT pattern_id::BIGINT AS pattern_id, first_pos FROM p JOIN exact ON regexp_matches(line, pattern)""")
def multi_pattern_regex(spark, sf_dir):
    pats = spark.createDataFrame(list(enumerate(REGEXES)), "pattern_id bigint, pattern string")
    hits = patterns.regex_matches(exact(spark, sf_dir).select("line", "first_pos"), pats)
    return hits.select("pattern_id", "first_pos")


@register(f"""WITH {SQL_EXACT}, words AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{{4,}}') AS w FROM benchmark),
pats AS (SELECT item_id AS pattern_id, w[1] || '[a-z]* .*' || w[2] AS pattern FROM words WHERE len(w) >= 2)
SELECT pattern_id, first_pos FROM exact JOIN pats ON regexp_matches(line, pattern)""")
def batch_regex(spark, sf_dir):
    """A pattern of every benchmark item (its first two longer words), met through the texts that its matches must hold."""
    words_of = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)).alias("w"))
    pats = words_of.where(F.size("w") >= 2).select(
        F.col("item_id").cast("bigint").alias("pattern_id"), F.concat(F.col("w")[0], F.lit("[a-z]* .*"), F.col("w")[1]).alias("pattern"))
    hits = patterns.regex_matches(exact(spark, sf_dir).select("line", "first_pos"), pats, strategy="factors")
    return hits.select("pattern_id", "first_pos")


@register(f"""WITH {SQL_FOLDED}, q AS (
  SELECT item_id AS query_id, {sql_strip("string_split(text, ' ')[1]")} AS query, item_id % 2 = 0 AS cs,
         item_id % 5 = 1 AS wl, item_id % 7 = 2 AS rx, item_id % 11 = 3 AS inv,
         CASE WHEN item_id % 3 = 0 THEN 4 END AS k
  FROM benchmark),
m AS (
  SELECT query_id, k, line, first_pos FROM q JOIN exact ON cs AND
    (CASE WHEN rx THEN regexp_matches(line, query) WHEN wl THEN line = query ELSE contains(line, query) END) <> inv
  UNION ALL
  SELECT query_id, k, line, first_pos FROM q JOIN folded ON NOT cs AND
    (CASE WHEN rx THEN regexp_matches(line_lower, lower(query)) WHEN wl THEN line_lower = lower(query)
          ELSE contains(line_lower, lower(query)) END) <> inv)
SELECT query_id, first_pos, line FROM m
QUALIFY k IS NULL OR row_number() OVER (PARTITION BY query_id ORDER BY first_pos) <= k""")
def batch_search(spark, sf_dir):
    """First word of each benchmark item, searched with mixed options."""
    i = F.col("item_id")
    queries = table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"),
        F.get(F.split("text", " "), F.lit(0)).alias("query"),
        (i % 2 == 0).alias("case_sensitive"),
        (i % 5 == 1).alias("whole_line"),
        (i % 7 == 2).alias("regex"),
        (i % 11 == 3).alias("invert"),
        F.when(i % 3 == 0, F.lit(4)).alias("max_count"),
    )
    queries = membership.prepare(queries)
    snap = index.snapshot(spark, doc_lines(spark, sf_dir), scratch_path(spark, "index"))
    return patterns.batch_search(snap, queries)


@register(f"""WITH {SQL_EXACT}, {SQL_WORDS}
SELECT pattern, count(line) AS count FROM p LEFT JOIN exact ON contains(line, pattern) GROUP BY pattern""")
def result_counts(spark, sf_dir):
    """Matches per pattern; a pattern without any counts 0."""
    pats = words(spark, sf_dir)
    hits = patterns.substring_matches(exact(spark, sf_dir).select("line", "first_pos"), pats, kept=[])
    return search.result_counts(pats, hits, "pattern_id").select("pattern", "count")


@register(f"""WITH {SQL_EXACT}, {SQL_WORDS},
top AS (
  SELECT pattern, line, row_number() OVER (PARTITION BY pattern ORDER BY first_pos) AS rn
  FROM p JOIN exact ON contains(line, pattern) QUALIFY rn <= 3)
SELECT p.pattern, coalesce(string_agg(line, chr(10) ORDER BY rn), '') AS matches, count(line) AS count
FROM p LEFT JOIN top USING (pattern) GROUP BY p.pattern""")
def result_lists(spark, sf_dir):
    """First three matches of each pattern, put together in order."""
    pats = words(spark, sf_dir)
    lines = materialise(exact(spark, sf_dir).select(F.monotonically_increasing_id().alias("line_id"), "line", "first_pos"), "lines")
    hits = patterns.substring_matches(lines, pats, line_key="line_id", kept=["line_id", "first_pos"])
    # the text comes to the few matches that are put out, not to all
    top = materialise(search.first_matches(hits, 3, "pattern_id"), "top")
    hits = lines.select("line_id", "line").join(broadcast_if_small(top), "line_id")
    lists = search.result_lists(pats, hits, 3, "pattern_id")
    return lists.select("pattern", F.array_join("matches", "\n").alias("matches"), "count")


# -------------------------------------------------------------------- corpus

@register(f"WITH {SQL_LINES} SELECT count(DISTINCT line) AS distinct_lines FROM lines")
def distinct_line_count(spark, sf_dir):
    return corpus.distinct_count(doc_lines(spark, sf_dir))


@register(f"WITH {SQL_LINES} SELECT DISTINCT line FROM lines ORDER BY line")
def sorted_lines(spark, sf_dir):
    return corpus.sorted_lines(doc_lines(spark, sf_dir))


@register(f"WITH {SQL_EXACT} SELECT line, last_line_no FROM exact")
def line_index_last(spark, sf_dir):
    return corpus.line_index(doc_lines(spark, sf_dir))


@register(f"WITH {SQL_FOLDED} SELECT line_lower, line, n_occurrences, first_pos, last_pos FROM folded")
def casefold_original(spark, sf_dir):
    return folded(spark, sf_dir)


@register("WITH l AS (SELECT unnest(string_split(text, chr(10))) FROM documents) SELECT count(*) AS total_lines FROM l")
def total_lines(spark, sf_dir):
    return sources.total_lines(doc_raw(spark, sf_dir))


@register(f"WITH {SQL_LINES} SELECT path, line_no, raw FROM raw WHERE line_no < 5")
def corpus_head(spark, sf_dir):
    return sources.head(doc_raw(spark, sf_dir), 5).select("path", "line_no", "raw")


@register(f"""WITH {SQL_LINES}, s AS (SELECT raw, {sql_strip('raw')} AS line FROM raw)
SELECT count(*) AS total_lines, count(DISTINCT line) FILTER (line <> '') AS distinct_lines,
       count(*) FILTER (line = '') AS blank_lines, coalesce(bool_or(line = 'The'), false) AS found_line,
       coalesce(bool_or(contains(raw, 'The')), false) AS found_part FROM s""")
def corpus_profile(spark, sf_dir):
    return quality.profile(doc_raw(spark, sf_dir), "The")


SQL_PAGES = f"""WITH s AS (
  SELECT page_id, {sql_strip("unnest(regexp_split_to_array(html, chr(13) || chr(10) || '|' || chr(10) || '|' || chr(13)))")}
         AS line FROM pages)"""


@register(f"""{SQL_PAGES}
SELECT page_id, count(*) AS lines, count(DISTINCT line) AS distinct_lines,
       sum(strlen(line))::BIGINT AS bytes FROM s WHERE line <> '' GROUP BY page_id""")
def corpus_sizes(spark, sf_dir):
    """Every page as a corpus of its own, split at all three line ends."""
    pages = sources.universal(table(spark, sf_dir, "pages"), "page_id", "html")
    return quality.size_report(sources.clean(pages), ["path"]).withColumnRenamed("path", "page_id")


@register(f"WITH {SQL_LINES} SELECT line FROM (SELECT DISTINCT line FROM lines) ORDER BY md5(line), line LIMIT 5")
def sample_entries(spark, sf_dir):
    return corpus.sample_entries(doc_lines(spark, sf_dir), 5, digest="md5")


@register(f"""WITH {SQL_LINES}, d AS (SELECT DISTINCT line FROM lines)
SELECT line FROM d QUALIFY row_number() OVER (ORDER BY md5(line), line)
  <= least(1000, (SELECT count(*) // 10 FROM d))""")
def query_sample(spark, sf_dir):
    return corpus.query_sample(doc_lines(spark, sf_dir), digest="md5")


@register(f"WITH {SQL_LINES}, {SQL_REQUIRED} SELECT line FROM required EXCEPT SELECT line FROM lines")
def required_missing(spark, sf_dir):
    return corpus.missing(required(spark, sf_dir), doc_lines(spark, sf_dir))


@register(f"WITH {SQL_LINES}, {SQL_REQUIRED} SELECT line FROM required INTERSECT SELECT line FROM lines")
def required_present(spark, sf_dir):
    return corpus.present(required(spark, sf_dir), doc_lines(spark, sf_dir))


@register(f"WITH {SQL_LINES}, {SQL_REQUIRED} SELECT line, line IN (SELECT line FROM lines) AS present FROM required")
def required_status(spark, sf_dir):
    return quality.required_status(required(spark, sf_dir), doc_lines(spark, sf_dir))


@register(f"""WITH {SQL_LINES}, {SQL_REQUIRED}
SELECT 0 AS part, 0::BIGINT AS pos, line FROM required
UNION ALL SELECT 1, pos, line FROM lines WHERE line NOT IN (SELECT line FROM required)""")
def repair_union(spark, sf_dir):
    return corpus.repaired(required(spark, sf_dir), doc_lines(spark, sf_dir))


@register(f"""WITH {SQL_LINES}, {SQL_REQUIRED}, all_lines AS (
  SELECT line FROM required UNION ALL SELECT line FROM lines WHERE line NOT IN (SELECT line FROM required))
SELECT line, count(*) AS n_occurrences FROM all_lines GROUP BY line""")
def repair_rewrite(spark, sf_dir):
    """Repair into new text files, then read the files back."""
    path = scratch_path(spark, "repaired")
    quality.rewrite_repaired(required(spark, sf_dir), doc_lines(spark, sf_dir), path)
    return corpus.exact_view(sources.read_lf(spark, path)).select("line", "n_occurrences")


@register(f"""WITH {SQL_LINES}, {SQL_REQUIRED}, all_lines AS (
  SELECT line FROM lines UNION ALL SELECT line FROM required WHERE line NOT IN (SELECT line FROM lines))
SELECT line, count(*) AS n_occurrences FROM all_lines GROUP BY line""")
def repair_append(spark, sf_dir):
    """Text corpus on disk, missing required lines appended, then read again."""
    path = scratch_path(spark, "appended")
    doc_lines(spark, sf_dir).select("line").write.text(path)
    # the lines are written out before the corpus files change
    quality.append_missing(spark, required(spark, sf_dir), doc_lines(spark, sf_dir), path)
    return corpus.exact_view(sources.refreshed(spark, path)).select("line", "n_occurrences")


@register(f"""WITH {SQL_LINES}, req AS (SELECT arg_max(line, (n, line)) AS line FROM (SELECT line, count(*) AS n FROM lines GROUP BY line)),
has AS (SELECT path, count(DISTINCT line) AS n_present FROM lines WHERE line IN (SELECT line FROM req) GROUP BY path),
f AS (SELECT path, bool_or(ends_with(raw, chr(13))) AS crlf FROM raw GROUP BY path)
SELECT path, CASE WHEN crlf THEN 'line endings' WHEN n_present IS NULL THEN 'required lines' END AS failed_rule,
       NOT crlf AND n_present IS NOT NULL AS ok, crlf, coalesce(n_present, 0) AS n_present FROM f LEFT JOIN has USING (path)""")
def format_check(spark, sf_dir):
    """Line ends of every document, each of which is required to hold the most frequent line."""
    need = exact(spark, sf_dir).agg(F.max_by("line", F.struct("n_occurrences", "line")).alias("line"))
    return quality.format_check(doc_raw(spark, sf_dir), need)


@register("""WITH l AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(text, chr(10))) AS raw FROM documents)
SELECT lang, sum(strlen(raw) + 1)::BIGINT AS n_bytes, count(*) AS n_lines FROM l GROUP BY lang""")
def whole_file_sizes(spark, sf_dir):
    """Lines written as text files of bounded length, a folder for each language; the files read whole."""
    path = scratch_path(spark, "whole")
    # the folder's name is spelled in hexadecimal, so that it can be that of any language
    folder = F.concat(F.lit("x"), F.hex(F.coalesce("lang", F.lit("und")))).alias("lang")
    rows = table(spark, sf_dir, "documents").select(folder, F.explode(F.split("text", "\n")).alias("raw"))
    rows.write.partitionBy("lang").option("maxRecordsPerFile", 10_000).text(path)
    files = sources.whole_files(spark, path)
    ends = F.length("content") - F.length(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\n", ""))
    lang = F.decode(F.unhex(F.regexp_extract("path", "/lang=x([^/]*)/[^/]*$", 1)), "UTF-8")
    per_file = files.select(lang.alias("lang"), "length", ends.cast("bigint").alias("ends"))
    return per_file.groupBy("lang").agg(F.sum("length").alias("n_bytes"), F.sum("ends").alias("n_lines"))


@register(f"""WITH {SQL_LINES}
SELECT path, count(*) AS n_lines, true AS numbered_in_order FROM raw GROUP BY path""")
def text_files_numbered(spark, sf_dir):
    """Documents written as text files and read back with line numbers.

    Each line carries its document and its number there; read in order, the line
    number of the file runs ahead of it by one constant per document.
    """
    path = scratch_path(spark, "numbered")
    doc_raw(spark, sf_dir).select(F.concat_ws("\t", "path", "line_no", "raw")).write.text(path)
    rows = sources.read(spark, path, universal_newlines=False)
    part = F.split("raw", "\t", 3)
    lead = rows.select(
        part[0].cast("bigint").alias("path"), (F.col("line_no") - part[1].cast("bigint")).alias("ahead")
    )
    return lead.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_lines"), (F.min("ahead") == F.max("ahead")).alias("numbered_in_order")
    )
