"""Readers and writers of GFA, FASTA, SAM, VCF, BED and mpileup text, by Spark's text and CSV sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the columns of a variant file.
VCF_COLUMNS = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "sample"]


def _fields(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith(kind + "\t")).select(F.split("value", "\t").alias("f"))


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments: unitig, seq, length, dp; links: from_seg, from_orient, to_seg, to_orient, overlap, ex); paths are left out."""
    f = F.col("f")
    tag = lambda name, kind: F.regexp_extract(F.array_join(f, "\t"), rf"\t{name}:{kind}:([^\t]+)", 1)
    depth = F.coalesce(tag("DP", "f").try_cast("double"), tag("dp", "i").try_cast("double"))
    segments = _fields(spark, path, "S").select(f[1].alias("unitig"), f[2].alias("seq"), F.length(f[2]).alias("length"), depth.cast("int").alias("dp"))
    links = _fields(spark, path, "L").select(f[1].alias("from_seg"), f[2].alias("from_orient"), f[3].alias("to_seg"), f[4].alias("to_orient"), f[5].alias("overlap"), tag("ex", "i").try_cast("int").alias("ex"))
    return segments, links


def write_gfa(segments: DataFrame, links: DataFrame, path: str) -> None:
    s = segments.select(F.concat_ws("\t", F.lit("S"), "unitig", F.when(F.length("seq") == 0, "A").otherwise(F.col("seq")), F.concat(F.lit("LN:i:"), F.col("length").cast("string")), F.concat(F.lit("dp:i:"), F.col("dp").cast("string"))).alias("value"))
    extra = F.concat(F.lit("ex:i:"), F.col("ex").cast("string"))
    link = links.select(F.concat_ws("\t", F.lit("L"), "from_seg", "from_orient", "to_seg", "to_orient", F.coalesce("overlap", F.lit("0M")), extra).alias("value"))
    s.union(link).write.mode("overwrite").text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """unitig, seq, length; a record is read whole, its lines joined."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.btrim("value")) > 0)
    head = F.split(F.split("value", "\n")[0], r"\s")[0]
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(head.alias("unitig"), seq.alias("seq"), F.length(seq).alias("length"))


def lookup_fasta(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The first record of that name (unitig, seq, length); raises KeyError if there is none."""
    found = read_fasta(spark, path).where(F.col("unitig") == name).limit(1)
    if found.isEmpty():
        raise KeyError(f"no sequence {name} in {path}")
    return found


def write_fasta(segments: DataFrame, path: str) -> None:
    segments.select(F.concat(F.lit(">"), "unitig", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """read_id, unitig, ref_start (from 0), mapq, is_reverse, is_supplementary, cigar, seq, de, sa of SAM text."""
    f = F.col("f")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"), "value")
    flag = f[1].cast("int")
    return rows.select(
        f[0].alias("read_id"), f[2].alias("unitig"), (f[3].cast("int") - 1).alias("ref_start"), f[4].cast("int").alias("mapq"),
        (flag.bitwiseAND(F.lit(16)) > 0).alias("is_reverse"), (flag.bitwiseAND(F.lit(2048)) > 0).alias("is_supplementary"), f[5].alias("cigar"), f[9].alias("seq"),
        F.regexp_extract("value", r"\tde:f:([^\t]+)", 1).try_cast("double").alias("de"), F.regexp_extract("value", r"\tSA:Z:([^\t]+)", 1).alias("sa"),
    )


def write_sam(lengths: DataFrame, reads: DataFrame, path: str) -> None:
    """SAM text sorted by unitig and position: a header from ``lengths`` (unitig, length), then ``reads`` with a YC tag where they have yc."""
    first = reads.sparkSession.range(1).select(F.lit("@HD\tVN:1.6\tSO:coordinate").alias("value"))
    names = lengths.orderBy("unitig").select(F.concat(F.lit("@SQ\tSN:"), "unitig", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    flag = F.when(F.col("rev"), 16).otherwise(0) + F.when(F.col("supplementary"), 2048).otherwise(0)
    tag = F.concat(F.lit("YC:Z:"), F.col("yc"))
    body = reads.orderBy("unitig", "s", "read_id").select(
        F.concat_ws("\t", "read_id", flag.cast("string"), "unitig", (F.col("s") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"), tag).alias("value")
    )
    first.coalesce(1).union(names).union(body).write.mode("overwrite").text(path)


def supplementary(sa: Column) -> Column:
    """array<struct<unitig, pos, strand, cigar, mapq>> of an SA tag."""
    parts = F.filter(F.split(sa, ";"), lambda x: x != "")
    field = lambda x, k: F.split(x, ",")[k]
    return F.transform(parts, lambda x: F.struct(field(x, 0).alias("unitig"), field(x, 1).cast("int").alias("pos"), field(x, 2).alias("strand"), field(x, 3).alias("cigar"), field(x, 4).cast("int").alias("mapq")))


def read_vcf(spark: SparkSession, path: str, snps_only: bool = True) -> DataFrame:
    """Rows of a variant file; by default those that passed and change one base."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    out = rows.select(*[F.get(f, F.lit(k)).alias(name) for k, name in enumerate(VCF_COLUMNS)]).withColumn("POS", F.col("POS").cast("int"))
    return out.where("FILTER = 'PASS' AND length(REF) = 1 AND length(ALT) = 1") if snps_only else out


def write_vcf(variants: DataFrame, path: str, once: bool = False, lengths: DataFrame | None = None) -> None:
    """Variant rows under a header, a whole one if ``lengths`` are given; with ``once`` an existing file stays."""
    if lengths is None:
        head = variants.sparkSession.range(1).select(F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.lit("#" + "\t".join(VCF_COLUMNS)))).alias("value"))
    else:
        head = vcf_header(lengths).orderBy("part", "value").select("value")
    body = variants.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in VCF_COLUMNS]).alias("value"))
    head.coalesce(1).union(body).write.mode("ignore" if once else "overwrite").text(path)


#: What the columns of a strain variant file hold.
VCF_META = [
    '##FILTER=<ID=PASS,Description="All filters passed">',
    '##INFO=<ID=ALT_HAP,Number=.,Type=String,Description="Segments with an alternative base">',
    '##INFO=<ID=REF_HAP,Number=.,Type=String,Description="Segments with the reference base">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DV,Number=1,Type=Integer,Description="Depth of alternative bases">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">',
]


def vcf_header(lengths: DataFrame, sample: str = "sample") -> DataFrame:
    """part, value: the lines before the rows of a variant file; a contig line for each of ``lengths`` (unitig, length)."""
    spark = lengths.sparkSession
    line = lambda part, texts: spark.range(1).select(F.lit(part).alias("part"), F.explode(F.array(*[F.lit(x) for x in texts])).alias("value"))
    contigs = lengths.select(F.lit(1).alias("part"), F.concat(F.lit("##contig=<ID="), "unitig", F.lit(",length="), F.col("length").cast("string"), F.lit(">")).alias("value"))
    return line(0, ["##fileformat=VCFv4.2"]).union(contigs).union(line(2, VCF_META)).union(line(3, ["#" + "\t".join([*VCF_COLUMNS[:-1], sample])]))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """name, s, e, cov; lines that don't parse are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f[0].alias("name"), *[F.get(f, F.lit(k)).try_cast("long").alias(n) for k, n in ((1, "s"), (2, "e"), (3, "cov"))])
    return rows.dropna()


def read_mpileup(spark: SparkSession, path: str) -> DataFrame:
    """unitig, pos, ref, depth, bases, quals, mapqs, names of lines that have all eight fields."""
    f = F.col("f")
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) >= 8")
    return rows.select(f[0].alias("unitig"), f[1].cast("long").alias("pos"), f[2].alias("ref"), f[3].cast("int").alias("depth"), f[4].alias("bases"), f[5].alias("quals"), f[6].alias("mapqs"), f[7].alias("names"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whichever file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """unitig, read_id, cluster (null for "NA"), start from partitioned CSV; none where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "unitig string, read_id string, cluster long, start int")
    df = spark.read.option("header", True).csv(path)
    return df.select("unitig", "read_id", F.col("cluster").try_cast("long").alias("cluster"), F.col("start").cast("int").alias("start"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    out = clusters.withColumn("cluster", F.coalesce(F.col("cluster").cast("string"), F.lit("NA")))
    out.repartition("unitig").write.mode("overwrite").option("header", True).partitionBy("unitig").csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header and a given schema."""
    return spark.read.option("header", True).option("sep", "\t").schema(schema).csv(path)


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).option("sep", "\t").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id: one for each line that isn't blank."""
    return spark.read.text(path).select(F.btrim("value").alias("id")).where("id <> ''")
