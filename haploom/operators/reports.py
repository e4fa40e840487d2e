"""Summary reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def n50(rows: DataFrame, key: list[str], length: str = "length", tie: str = "unitig") -> DataFrame:
    """key, total, n, n50, l50: the first length, longest first, at which the running sum exceeds half the total.

    Lengths are first added up by value, so the window runs over distinct lengths only.
    """
    by_value = rows.groupBy(*key, F.col(length).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*key).orderBy(F.desc("v"))
    run = by_value.withColumn("after", F.sum(F.col("v") * F.col("c")).over(w)).withColumn("before_n", F.sum("c").over(w) - F.col("c")).withColumn("total", F.sum(F.col("v") * F.col("c")).over(Window.partitionBy(*key)))
    hit = F.col("after") * 2 > F.col("total")
    needed = F.floor((F.col("total") / 2 - (F.col("after") - F.col("v") * F.col("c"))) / F.col("v")) + 1
    out = run.groupBy(*key).agg(F.max("total").alias("total"), F.sum("c").alias("n"), F.coalesce(F.max(F.when(hit, F.col("v"))), F.lit(0)).alias("n50"), F.max_by(F.when(hit, F.col("before_n") + needed), F.when(hit, F.col("v"))).alias("l50"))
    return out.select(*key, F.col("total").cast("long"), F.col("n").cast("long"), F.col("n50").cast("long"), F.coalesce("l50", F.lit(0)).cast("long").alias("l50"))


def multiplicity(bins: DataFrame, width: int) -> DataFrame:
    """multiplicity, bp, bar: bins by how many strains cover them, 1 to 10."""
    sums = bins.where("n BETWEEN 1 AND 10").groupBy(F.col("n").alias("multiplicity")).agg((F.count(F.lit(1)) * width).alias("bp"))
    share = F.col("bp") / F.max("bp").over(Window.partitionBy(F.lit(1)))  # ten rows at most
    return sums.select("multiplicity", "bp", F.repeat(F.lit("*"), F.floor(share * 20).cast("int")).alias("bar"))


def depth_histogram(depths: DataFrame, width: int) -> DataFrame:
    """cov, bins: length in whole windows of all unitigs of a depth."""
    return depths.groupBy("cov").agg(F.sum(F.floor(F.col("length") / width)).cast("long").alias("bins"))


def divergence_histogram(rates: DataFrame, least: float) -> DataFrame:
    """bin, label, bp: length by divergence on a log scale, ten bins a decade."""
    i = (-10 * F.log10("rate")).cast("int")
    kept = rates.where(F.col("rate") >= least).groupBy(i.alias("bin")).agg(F.sum("length").cast("long").alias("bp"))
    return kept.select("bin", F.round(F.pow(F.lit(10.0), -F.col("bin") / 10), 5).alias("label"), "bp")


def totals(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, total, n, n50, l50 of each table of lengths, in one aggregation."""
    rows = [df.select(F.lit(name).alias("stage"), F.col("length").cast("long").alias("length")) for name, df in stages.items()]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return n50(union, ["stage"])


def per_unitig(phased: DataFrame) -> DataFrame:
    """Totals, counts and medians of the new segments of each unitig, the longest total first; ``phased`` is the table of segments."""
    out = phased.groupBy("Reference_unitig").agg(
        F.sum("Length").alias("total"), F.count(F.lit(1)).alias("n"), F.median("Length").alias("median_length"), F.median("Coverage").alias("median_coverage"), F.median(F.col("SNP_density").cast("double")).alias("median_density")
    )
    return out.orderBy(F.desc("total"), "Reference_unitig")
