"""A corpus pipeline of training-data operators: each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from haploom.llm.common import cut, delete, stored

#: No source repeats more than this; at least once each document is taken.
MAX_REPEATS = 2.0
SHINGLE, PERCENT = 5, 80


def _rows(columns: list[str], text: Column) -> list[Column]:
    """The fields of ``row``, with another text and what follows from it; only names that the documents have."""
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return [changed.get(c, F.col("row")[c]).alias(c) for c in columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that they remove.

    Null and empty texts are rejected; rows with null or repeated ids are judged
    one by one; other columns are carried through, whatever their names. A
    filter would be pushed below the rules and evaluate them twice; the rows
    come out of an array that is empty for rejected documents instead.
    """
    judged = quality_rules.clean(docs.select(F.struct("*").alias("row"), F.col("text")))
    row = F.struct(*_rows(docs.columns, F.col("clean_text")))
    return judged.select(F.inline(F.filter(F.array(row), lambda _: F.col("kept"))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that had nothing else go.

    Null and empty texts stay as they are; see ``line_dedup`` for null and repeated ids; other columns are carried through.
    """
    out = line_dedup.dedup(docs)
    worded = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return worded.select(*_rows(docs.columns, F.col("text")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by word shingles: the one of smallest id, a null id being the largest.

    Documents without words have no links. A row is known by hashes of its id
    and text; of rows that are alike in both, or share the smallest id of a
    group, one stays: the one of smallest hashes, then of smallest other columns.
    """
    found = cut(ngram_join.classes(docs, size=SHINGLE, percent=PERCENT))
    alike = found.where("class IS NOT NULL").groupBy("class", "doc_id", "t").agg(F.count(F.lit(1)).alias("times"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "times")
    first = cut(alike.groupBy("class").agg(F.min(key).alias("first")).select("first.doc_id", "first.t", "first.times"))
    wordless = found.where("class IS NULL").select("doc_id", "t").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_t"))

    def kept(those: DataFrame) -> DataFrame:
        return rows.join(those, rows["row.doc_id"].eqNullSafe(those["doc_id"]) & (rows["_t"] == those["t"]), "left_semi")

    out = kept(first.where("times = 1").select("doc_id", "t").union(wordless)).select("row.*")
    repeated = first.where("times > 1")
    if repeated.isEmpty():
        return out
    return out.union(kept(repeated).groupBy("row.doc_id", "_t").agg(F.min("row").alias("row")).select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, by the weights of its source; null sources are one, null texts count as empty, repeated rows are taken each."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null texts count as empty."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("source mixing", mix), ("byte-level BPE", tokens)]

#: The stages of edit distances, components and merges aren't expressible in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents`` under ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        done = stored(stage(spark, docs, sf_dir))
        if before is not None:
            delete(before)
        docs = before = done
    return docs
