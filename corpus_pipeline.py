"""A corpus pipeline: quality rules, exact dedup, near-dedup, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents; those that run Python over whole texts write their result to the shared folder, in small batches. Every row is judged by itself: rows whose doc_id is null or repeated don't
share a fate. Null and empty texts fail the quality rules; in a later stage alone, exact dedup keeps one row of all empty texts, near-dedup links no empty text,
redaction leaves them, and packing gives each its end id. An empty table stays empty; columns beside those of documents are dropped. A text of any length is one row and is never cut but by packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from typedframe.llm import exact_dedup, near_dedup, packing, pii, quality
from typedframe.llm.io import persisted, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return persisted(quality.kept_rows(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.first_rows(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.first_rows(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return persisted(pii.redacted(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), special=packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: SQL can't express the tokenisers, the near-duplicate components and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name in ("exact_dedup", "near_dedup"):
            docs = persisted(docs)
    return docs
