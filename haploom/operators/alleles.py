"""Allele counts, SNP calls, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BASES = ["A", "C", "G", "T"]


def allele_depth(obs: DataFrame) -> DataFrame:
    """unitig, pos, base, n, forward, reverse."""
    return obs.groupBy("unitig", "pos", "base").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("rev")).alias("forward"), F.count_if("rev").alias("reverse"))


def allele_pivot(obs: DataFrame) -> DataFrame:
    """unitig, pos, dp and a column of counts for each base: conditional sums, in one shuffle."""
    return obs.groupBy("unitig", "pos").agg(F.count(F.lit(1)).alias("dp"), *[F.count_if(F.col("base") == b).alias(f"n_{b.lower()}") for b in BASES])


def _ranked(obs: DataFrame) -> DataFrame:
    """unitig, pos, dp, alleles: structs (n, base, f, r) by depth, deepest first, base in order among equals."""
    by_depth = lambda a, b: F.when(a["n"] != b["n"], (b["n"] - a["n"]).cast("int")).when(a["base"] < b["base"], -1).when(a["base"] > b["base"], 1).otherwise(0)
    counts = allele_depth(obs)
    return counts.groupBy("unitig", "pos").agg(F.sum("n").alias("dp"), F.array_sort(F.collect_list(F.struct("n", "base", F.col("forward").alias("f"), F.col("reverse").alias("r"))), by_depth).alias("alleles"))


def snp_calls(obs: DataFrame, frequency: float, least: int) -> DataFrame:
    """unitig, pos, ref, alt, dp, alt_n: sites whose second allele is deep enough."""
    second = F.get("alleles", F.lit(1))
    rows = _ranked(obs).where(F.size("alleles") >= 2)
    return rows.where(second["n"] >= F.greatest(F.lit(least), F.lit(frequency) * F.col("dp"))).select("unitig", "pos", F.col("alleles")[0]["base"].alias("ref"), second["base"].alias("alt"), "dp", second["n"].alias("alt_n"))


def strand_supported(obs: DataFrame, frequency: float, least: int) -> DataFrame:
    """SNP calls whose two deepest alleles are the deepest on both strands, with enough of the second on each."""
    first, second = F.col("alleles")[0], F.get("alleles", F.lit(1))

    def ok(strand: str) -> Column:
        counted = F.aggregate("alleles", F.lit(0).cast("long"), lambda s, x: s + F.when(x[strand] > 1, x[strand]).otherwise(0))
        others = F.array_max(F.transform(F.slice("alleles", 3, 8), lambda x: x[strand]))
        alone = F.coalesce(others, F.lit(-1)) < F.least(first[strand], second[strand])
        return alone & (second[strand] > 2) & (F.try_divide(second[strand], counted) >= F.lit(0.6 * frequency))

    rows = _ranked(obs).where((F.size("alleles") >= 2) & (second["n"] >= F.greatest(F.lit(least), F.lit(frequency) * F.col("dp"))))
    return rows.where(F.coalesce(ok("f") & ok("r"), F.lit(False))).select("unitig", "pos", first["base"].alias("ref"), second["base"].alias("alt"))


def consensus(votes: DataFrame, key: list[str], frequency: float, split: float, least: int) -> DataFrame:
    """key, pos, n, base (if clear), second_flag, alt_flag; ``votes`` has key, pos, base, ref, one row a read."""
    counts = votes.groupBy(*key, "pos", "ref", "base").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key, "pos").orderBy(F.desc("n"), "base")
    ranked = counts.withColumn("rk", F.row_number().over(w))
    out = ranked.groupBy(*key, "pos").agg(
        F.sum("n").alias("n"),
        F.max(F.when(F.col("rk") == 1, F.col("n"))).alias("top"),
        F.max(F.when(F.col("rk") == 1, F.col("base"))).alias("top_base"),
        F.coalesce(F.max(F.when(F.col("rk") == 2, F.col("n"))), F.lit(0)).alias("second"),
        F.coalesce(F.max(F.when(F.col("base") != F.col("ref"), F.col("n"))), F.lit(0)).alias("other"),
    )
    clear = (F.col("n") >= 3) & (F.col("top") > 2)
    return out.select(*key, "pos", F.col("n").cast("long").alias("n"), F.when(clear, F.col("top_base")).alias("base"), (F.col("second") >= F.greatest(F.lit(least), F.lit(split) * F.col("n"))).alias("second_flag"), (F.col("other") >= F.greatest(F.lit(least), F.lit(frequency) * F.col("n"))).alias("alt_flag"))


def extent(reads: DataFrame, key: list[str]) -> DataFrame:
    """key, n_reads, first (second smallest start), last (second largest end), cov; null for a single read."""
    sums = reads.groupBy(*key).agg(F.count(F.lit(1)).alias("n_reads"), F.get(F.sort_array(F.collect_list("s")), F.lit(1)).alias("first"), F.get(F.sort_array(F.collect_list("e"), False), F.lit(1)).alias("last"), F.sum(F.col("e") - F.col("s")).alias("bases"))
    return sums.select(*key, "n_reads", "first", "last", F.round(F.try_divide(F.col("bases"), F.col("last") - F.col("first")), 6).alias("cov"))


def gap_flags(sites: DataFrame, extents: DataFrame, key: list[str], limit: int) -> DataFrame:
    """key, n_sites, widest (gap between neighbouring sites), gapped (a gap, lead or tail over the limit; gaps only, with one site)."""
    w = Window.partitionBy(*key).orderBy("pos")
    gaps = sites.withColumn("g", F.col("pos") - F.lag("pos").over(w)).groupBy(*key).agg(F.count(F.lit(1)).alias("n_sites"), F.max("g").alias("widest"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = gaps.join(extents, key)
    far = (F.col("widest") > limit) | (F.col("lo") - F.col("first") > limit) | (F.col("last") - F.col("hi") > limit)
    return rows.select(*key, "n_sites", "widest", F.when(F.col("n_sites") > 1, F.coalesce(far, F.lit(False))).otherwise(False).alias("gapped"))


def rate_flags(sites: DataFrame, extents: DataFrame, key: list[str], divergence: float) -> DataFrame:
    """key, n_sites, rate (heterozygous sites for each base of the cluster's extent), strange (a rate over ``divergence``)."""
    counts = sites.groupBy(*key).agg(F.count(F.lit(1)).alias("n_sites"))
    rows = extents.where("last > first").join(counts, key, "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0).cast("long")))
    rate = F.round(F.col("n_sites") / (F.col("last") - F.col("first")), 9)
    return rows.select(*key, "n_sites", rate.alias("rate"), (F.col("n_sites") > divergence * (F.col("last") - F.col("first"))).alias("strange"))


def span(reads: DataFrame, key: list[str]) -> DataFrame:
    """key, start (smallest), end (largest) of all reads."""
    return reads.groupBy(*key).agg(F.min("s").alias("start"), F.max("e").alias("end"))
