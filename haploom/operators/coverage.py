"""Depth, eligibility and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploom.plans.config import Config


def depth(aln: DataFrame, unitigs: DataFrame) -> DataFrame:
    """unitig, length, n_reads, bases, cov (whole number, rounded down) of every unitig."""
    sums = aln.groupBy("unitig").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.col("e") - F.col("s")).alias("bases"))
    out = unitigs.join(sums, "unitig", "left").select("unitig", "length", F.coalesce("n_reads", F.lit(0)).cast("long").alias("n_reads"), F.coalesce("bases", F.lit(0)).cast("long").alias("bases"))
    return out.withColumn("cov", F.floor(F.col("bases") / F.col("length")).cast("long"))


def eligible(depths: DataFrame, lo: int, hi: int, min_length: int) -> DataFrame:
    """Unitigs long enough whose mean depth, rounded half to even, is within bounds."""
    mean = F.rint(F.col("bases") / F.col("length"))
    return depths.where(mean.between(lo, hi) & (F.col("length") > min_length))


def accepted(aln: DataFrame, c: Config) -> DataFrame:
    """Alignments of good quality that span enough without clips, or end near a tip."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+)[SH]"), 1)
    clipped = F.exists(ops, lambda n: n.cast("int") > c.max_clipping)
    whole = ~clipped & (F.col("e") - F.col("s") > c.min_overlap)
    tip = F.least(F.col("s"), F.col("length") - F.col("e")) < c.end_gap
    return aln.where((F.col("mapq") >= c.min_mapq) & (F.coalesce("de", F.lit(0.0)) <= c.max_divergence) & (whole | tip))


def one_per_read(records: DataFrame, key: list[str], supplementary: str, place: list[str]) -> DataFrame:
    """The last record of a key that isn't supplementary, else its first supplementary one."""
    ordered = records.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*place)))
    w = Window.partitionBy(*key).orderBy(F.col(supplementary).cast("int"), F.when(F.col(supplementary), F.col("_at")).otherwise(-F.col("_at")))
    return ordered.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_at")


def union_length(rows: DataFrame, key: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """key, covered (positions in any interval), summed (all lengths), islands."""
    before = Window.partitionBy(*key).orderBy(s, e).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(e).over(before), F.lit(-1))
    new = rows.withColumn("_r", reached)
    fresh = F.greatest(F.col(e) - F.greatest(F.col(s), F.col("_r")), F.lit(0))
    return new.groupBy(*key).agg(F.sum(fresh).alias("covered"), F.sum(F.col(e) - F.col(s)).alias("summed"), F.count_if(F.col(s) > F.col("_r")).alias("islands"))


def binned(rows: DataFrame, key: str, width: int) -> DataFrame:
    """key, bin, n: how many intervals cover each bin from the first whole number of widths up to the last, exclusive."""
    lo, hi = F.floor(F.col("s") / width), F.floor(F.col("e") / width)
    bins = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.select(key, F.explode(bins).alias("bin")).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))


def point_depth(points: DataFrame, intervals: DataFrame, key: list[str], width: int = 1000) -> DataFrame:
    """points with cov of the first interval (by s) that holds the point, both ends included; 0 without any.

    Both sides are dealt by ranges of the position, so a long unitig isn't one group.
    """
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    at = points.withColumn("_b", F.floor(F.col("pos") / width))
    joined = at.join(spread.select(*key, "_b", "s", "e", "cov"), [*key, "_b"]).where("pos BETWEEN s AND e")
    found = joined.groupBy(*key, "pos").agg(F.min_by("cov", F.struct("s", "e", "cov")).alias("cov"))
    return points.select(*key, "pos").distinct().join(found, [*key, "pos"], "left").withColumn("cov", F.coalesce("cov", F.lit(0)))


def strong_tails(reads: DataFrame, key: list[str], gap: int, least: int) -> DataFrame:
    """key, left_strong, right_strong, spans: whether more than ``least`` reads reach near either end."""
    left, right = F.col("s") < gap, F.col("e") > F.col("length") - gap
    return reads.groupBy(*key).agg((F.count_if(left) > least).alias("left_strong"), (F.count_if(right) > least).alias("right_strong"), ((F.min("s") < gap) & (F.max("e") > F.max("length") - gap)).alias("spans"))


def split_long(unitigs: DataFrame, limit: int) -> DataFrame:
    """unitig, piece (from 0), start, length of even pieces; the last takes the rest."""
    n = F.ceil(F.col("length") / limit).cast("long")
    rows = unitigs.select("unitig", "length", n.alias("n")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    size = F.floor(F.col("length") / F.col("n")).cast("long")
    last = F.col("length") - size * (F.col("n") - 1)
    return rows.select("unitig", "piece", (F.col("piece") * size).alias("start"), F.when(F.col("piece") == F.col("n") - 1, last).otherwise(size).alias("piece_length"))
