"""A deterministic projection of star-schema tables onto unitigs, alignments and observed bases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploom.plans.checkpoints import release

#: A part of the unitigs has about so many rows of alignments.
PART_ROWS = 4_000_000
#: A part's number and the number of parts.
Part = tuple[int, int]
WHOLE: Part = (0, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unitig, length, n_hap: one for each part."""
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unitig"), (4000 + 100 * size).alias("length"), (1 + size % 4).alias("n_hap"))


def by_parts(spark: SparkSession, sf_dir: str, make: Callable[[Part], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """The unions of what ``make`` writes for each part of the unitigs.

    Every unitig is in one part, and all parts are made, one after the other, so
    that the tables between the steps of one part only are on disk at once.
    """
    parts = max(1, -(-table(spark, sf_dir, "lineitem").count() // PART_ROWS))
    out = None
    for k in range(parts):
        made = make((k, parts))
        release(spark)
        out = made if out is None else tuple(x.union(y) for x, y in zip(out, made, strict=True))
    return out


def alignments(spark: SparkSession, sf_dir: str, part: Part = WHOLE) -> DataFrame:
    """unitig, read_id, s, e, mapq, de, hap, rev, clip, cigar, length: one for each read and unitig of the part."""
    first = Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    if part != WHOLE:
        lines = lines.where(F.pmod("l_partkey", F.lit(part[1])) == part[0])
    # dealt by unitig at once: that serves the window, the join and counts by unitig and position
    lines = lines.repartition("l_partkey").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    line, q = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    rows = lines.join(unitigs(spark, sf_dir), F.col("l_partkey") == F.col("unitig"))
    rows = rows.withColumn("s", (F.col("l_orderkey") * 7919 + line * 104729) % (F.col("length") - 1500))
    span = 1200 + 60 * q
    return rows.select(
        "unitig",
        (F.col("l_orderkey") * 8 + line).alias("read_id"),
        "s",
        F.least(F.col("length"), F.col("s") + span).alias("e"),
        F.round(F.col("l_discount") * 600).cast("long").alias("mapq"),
        F.col("l_tax").alias("de"),
        ((F.col("l_orderkey") + line) % F.col("n_hap")).alias("hap"),
        (F.col("l_orderkey") % 2 == 1).alias("rev"),
        (q * 7 % 200).alias("clip"),
        F.concat((q * 7 % 200).cast("string"), F.lit("S"), (span - q).cast("string"), F.lit("M"), (q % 5 + 1).cast("string"), F.lit("I"), q.cast("string"), F.lit("D"), (line * 3).cast("string"), F.lit("H")).alias("cigar"),
        "length",
    )


def observations(aln: DataFrame) -> DataFrame:
    """unitig, read_id, pos, base, rev: what each read shows at the positions 100, 300, ... that it covers."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(44).cast("long")))
    rows = aln.select("unitig", "read_id", "s", "e", "hap", "rev", at.alias("j")).withColumn("pos", F.col("j") * 200 + 100).where("pos > s AND pos <= e")
    error = ((F.col("read_id") * 31 + F.col("j") * 17) % 97 == 0).cast("long")
    letter = (F.col("hap") * (F.col("j") + 1) + F.col("unitig") + error) % 4
    return rows.select("unitig", "read_id", "pos", F.substring(F.lit("ACGT"), letter.cast("int") + 1, F.lit(1)).alias("base"), "rev")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: a small directed graph of suppliers' nations, weighted by shared customers' nations."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    hop = (F.col("s_nationkey") * 7 + F.col("s_suppkey") * 3 + 1) % 25
    return s.select(F.col("s_nationkey").cast("long").alias("src"), hop.cast("long").alias("dst")).where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
