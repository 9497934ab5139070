"""The operators of this subpackage over the given tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.llm import balltree, bpe, embed, gam, html, lm, minhash, packing, passages, phrases, pieces, pii, rules
from lineseek.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3) == 1)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decision_list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_subspace_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op8_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_log_frequency_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), fold(7) == 2)


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents")).drop("words")


def op13_distinct_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_additive_quality, op2_best_fit_packing, op3_decision_list_rules, op4_segment_tree_bpe, op5_subspace_near_duplicates, op6_minmax_near_duplicates,
    op7_compact_window_passages, op8_wrapper_main_text, op9_log_frequency_bloom_lm, op10_bootstrapped_pii, op11_ball_tree_search, op12_setm_collocations, op13_distinct_chunk_pieces,
)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE: dict[str, str] = {
    "op11_ball_tree_search": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS place, doc_id, ws, len(ws) AS n
            FROM (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}') AS ws FROM documents) WHERE len(ws) > 0),
        sizes AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
        asked AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}')) AS term FROM benchmark) GROUP BY ALL),
        held AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, n, unnest(ws) AS term FROM docs) GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM held, sizes WHERE term IN (SELECT term FROM asked) GROUP BY term),
        scored AS (
            SELECT item_id, place, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN held USING (term), sizes GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_setm_collocations": rf"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS ws FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents)),
        sizes AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
        runs AS (
            SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
            FROM pieces, range(1, 6) AS sizes_of(k) WHERE len(ws) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 100),
        found AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, a FROM f WHERE k >= 2),
        inner_runs AS (
            SELECT lang, a, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))) AS phrase
            FROM found, range(2, 5) AS lengths(j) WHERE j < k),
        left_over AS (SELECT c.* FROM found c WHERE NOT EXISTS (SELECT 1 FROM inner_runs s WHERE s.lang = c.lang AND s.phrase = c.phrase AND 100 * s.a >= 100 * c.a)),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, sizes.n,
                (1000::HUGEINT * c.a::HUGEINT * sizes.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
            FROM left_over c JOIN range(1, 5) AS lengths(j) ON j < c.k JOIN sizes ON sizes.lang = c.lang
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:c.k], ' ')),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS turn FROM cuts),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE turn = 1)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM ranked WHERE rank <= 2000
    """,
}
