"""Bases of reads at positions, and variant calls from pileup rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploom.functions import sequence as fn


def blocks(reads: DataFrame) -> DataFrame:
    """unitig, read_id, rev, begin, seq: the gapless blocks of each alignment with their own bases.

    ``reads`` has unitig, read_id, rev, s, cigar and seq (with soft clips, along the unitig).
    """
    parts = F.explode(fn.aligned_blocks(F.col("cigar"), F.col("s")))
    rows = reads.select("unitig", "read_id", "rev", "seq", parts.alias("b"))
    return rows.select("unitig", "read_id", "rev", F.col("b.ref").alias("begin"), F.substring("seq", (F.col("b.query") + 1).cast("int"), F.col("b.n").cast("int")).alias("seq"))


def all_bases(reads: DataFrame) -> DataFrame:
    """unitig, read_id, pos, base, rev of every aligned base; gaps and skips show none."""
    letters = F.posexplode(F.split(F.upper("seq"), ""))
    rows = blocks(reads).where(F.length("seq") > 0).select("unitig", "read_id", "rev", "begin", letters.alias("k", "base"))
    return rows.select("unitig", "read_id", (F.col("begin") + F.col("k")).alias("pos"), "base", "rev")


def bases_at(reads: DataFrame, points: DataFrame, width: int = 1000) -> DataFrame:
    """unitig, read_id, pos, base, rev at ``points`` (unitig, pos) only.

    Blocks are dealt by the ranges of positions that they touch and joined with
    the points of the range, so no read is spread into all its bases.
    """
    own = blocks(reads).where(F.length("seq") > 0)
    end = F.col("begin") + F.length("seq")
    spread = own.withColumn("_b", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((end - 1) / width))))
    at = points.select("unitig", "pos").distinct().withColumn("_b", F.floor(F.col("pos") / width))
    seen = spread.join(at, ["unitig", "_b"]).where((F.col("pos") >= F.col("begin")) & (F.col("pos") < end))
    return seen.select("unitig", "read_id", F.col("pos").cast("long").alias("pos"), F.upper(F.substring("seq", (F.col("pos") - F.col("begin") + 1).cast("int"), F.lit(1))).alias("base"), "rev")


def variants(pileup: DataFrame) -> DataFrame:
    """Variant rows (CHROM, POS, ID, REF, ALT, QUAL, FILTER, INFO, FORMAT, sample) of pileup rows.

    An indel at a position takes the place of its SNP; the first one gives type
    and sequence and all of them the support. ``pileup`` has unitig, pos, ref,
    bases, mapqs and names. Numbers in ids follow unitig and position: rows are
    numbered inside a unitig and the unitigs' sizes are added up before.
    """
    read = F.col("r")
    rows = pileup.where("bases <> '' AND NOT bases RLIKE '^[.]*$'").select("unitig", "pos", "ref", "mapqs", F.split("names", ",").alias("names"), fn.pileup_reads(F.col("bases")).alias("r"))
    first = F.get(read["indels"], F.lit(0))
    indel = F.size(read["indels"]) > 0
    shown = F.split(F.upper(read["tokens"]), "")
    is_alt = lambda x: x.isin("A", "C", "G", "T")
    alts = F.array_sort(F.array_distinct(F.filter(shown, is_alt)))
    support = F.when(indel, F.transform(read["indels"], lambda x: F.get("names", x["at"]))).otherwise(F.filter("names", lambda _, i: F.coalesce(is_alt(F.get(shown, i)), F.lit(False))))
    longer = F.concat("ref", first["seq"])
    inserted = first["sign"] == "+"
    quals = F.transform(F.split("mapqs", ""), lambda c: F.ascii(c) - 33)
    ordered = F.array_sort(quals)
    n = F.size(quals)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    called = rows.where(indel | (F.size(alts) > 0)).select(
        "unitig", "pos", "names", support.alias("support"), middle.cast("int").alias("QUAL"),
        F.when(~indel, "SNP").when(inserted, "INS").otherwise("DEL").alias("kind"),
        F.when(indel & ~inserted, longer).otherwise(F.col("ref")).alias("REF"),
        F.when(~indel, F.array_join(alts, ",")).when(inserted, longer).otherwise(F.col("ref")).alias("ALT"),
    )
    sizes = called.groupBy("unitig").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("unitig").rowsBetween(Window.unboundedPreceding, -1)  # a row for each unitig
    offsets = sizes.select("unitig", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = called.withColumn("k", F.row_number().over(Window.partitionBy("unitig").orderBy("pos"))).join(offsets, "unitig")
    others = F.array_except("names", "support")
    info = F.concat(F.lit("ALT_HAP="), F.array_join("support", ","), F.when(F.size(others) > 0, F.concat(F.lit(";REF_HAP="), F.array_join(others, ","))).otherwise(""))
    return placed.select(
        F.col("unitig").alias("CHROM"), F.col("pos").alias("POS"), F.concat_ws("_", "kind", (F.col("before") + F.col("k") - 1).cast("string")).alias("ID"), "REF", "ALT", "QUAL", F.lit("PASS").alias("FILTER"), info.alias("INFO"), F.lit("GT:DV:DP").alias("FORMAT"),
        F.concat_ws(":", F.lit("0/1"), F.size("support").cast("string"), F.size("names").cast("string")).alias("sample"),
    )
