"""From raw documents to packed token sequences: quality, near duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.llm import gam, minhash, packing, passages, pii
from lineseek.llm.common import Scratch, table


def _sized(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of ``before``, with the length of the new text."""
    size = F.length("text").cast(before.schema["n_chars"].dataType) if "n_chars" in before.columns else None
    return after.select(*(size.alias(c) if c == "n_chars" else c for c in before.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; fold 1 of 3 is never learned from."""
    return gam.accepted(docs, table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 3 == 1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in 80 of 100 five-word runs."""
    return minhash.one_of_each(docs, size=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier document holds."""
    return _sized(docs, passages.remove_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _sized(docs, pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("personal_data", personal_data), ("pack", pack)]
#: The stages learn, hash and tokenize; SQL cannot express them. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next one."""
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
        if last:
            scratch.drop(last)
        last = name
    return docs
