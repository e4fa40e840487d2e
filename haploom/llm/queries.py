"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, line_dedup, mixing, ngram_join, preference, quality_classifier, quality_rules, sharding, topk
from .common import table

MAX_REPEATS = 1.25
SHARD_BYTES = 1 << 20


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS, whole_budget=True)
    return mixed.select("row.doc_id", "source", "epoch", "block", "tokens")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"), threshold=line_dedup.BY_LENGTH, short=True)
    return out.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), limit=SHARD_BYTES).select("row.doc_id", "n_bytes", "shard", "part", "shard_bytes", "shard_rows")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preference.pairs(*preference.swapped_replies(table(spark, sf_dir, "conversations")))
    return made.select("pair_id", "n_common", *[F.md5(c).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")], "chosen_mask", "rejected_mask")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_source_mixing, op3_byte_bpe, op4_ngram_jaccard, op5_line_dedup, op6_sharding, op7_topk_search, op8_quality_classifier, op9_preference_pairs, op10_quality_rules)
}
