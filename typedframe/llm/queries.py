"""The queries of this subpackage with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, near_dedup, packing, pii, quality, secret_scan, substring_dedup, suffix_dedup, warc
from .io import read, spread


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(spread(read(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).drop("n_bytes", "ids")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read(spark, sf_dir, "pages")).drop("url")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(spread(read(spark, sf_dir, "documents")), percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))  # as the library takes them unless told otherwise
    return packing.pack(spread(read(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), special=special)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spread(read(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spread(read(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(spread(read(spark, sf_dir, "documents")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(spread(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_warc, op4_near_dedup, op5_packing, op6_quality, op7_exact_dedup, op8_substring_dedup, op9_pii, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.SQL, "op3_warc": warc.SQL, "op4_near_dedup": near_dedup.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_substring_dedup": substring_dedup.SQL, "op9_pii": pii.SQL, "op10_secrets": secret_scan.SQL}
