"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.plans.checkpoints import cut, delete, release, remove, shared_folder, stored

__all__ = ["BLANKS", "LOWER", "UPPER", "cut", "delete", "let", "literal_rows", "release", "remove", "shared_folder", "shuffle_partitions", "stored", "table", "word_count", "words_of"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Separators of words: space and the code points 9 to 13.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Array of the runs of characters other than space and U+0009 to U+000D; empty for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    """Number of such runs, without building the array of them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: bound as the variable of a one-element transform."""
    return F.transform(F.array(value), body)[0]


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small constant table made inside the plan, without Python workers."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
