"""Queries that write the projected tables as the engine's text formats in the shared folder and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.functions import sequence as fn
from haploom.operators import alleles, graphs, reports
from haploom.plans.checkpoints import shared_folder
from haploom.plans.projection import alignments, links, table
from haploom.plans.queries import _ALN, _CL, _CONS, _COUNTS, C, _clusters, _consensus, _obs, _snps, query
from haploom.plans.run import Tables
from haploom.sources import formats


def _place(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all machines share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """unitig, seq, length, dp: a short made-up sequence for each part, an empty one for some."""
    seq = F.repeat(F.substring(F.lit("ACGTTGCA"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(4)), (F.col("p_size") % 8).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("unitig"), seq.alias("seq"), F.length(seq).alias("length"), F.col("p_size").cast("int").alias("dp"))


_SEGMENTS = "seg AS (SELECT concat('u',p_partkey) AS unitig, repeat(substr('ACGTTGCA', CAST(p_partkey%5+1 AS INTEGER), 4), CAST(p_size%8 AS INTEGER)) AS seq, CAST(p_size AS INTEGER) AS dp FROM part)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    return links(spark, d).select(name("src").alias("from_seg"), F.lit("+").alias("from_orient"), name("dst").alias("to_seg"), F.when(F.col("weight") % 2 == 0, "+").otherwise("-").alias("to_orient"), F.lit(None).cast("string").alias("overlap"), F.col("weight").cast("int").alias("ex"))


_LINKS = "edges AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST((s_nationkey*7+s_suppkey*3+1)%25 AS BIGINT) AS dst, CAST(count(*) AS INTEGER) AS weight FROM supplier WHERE s_nationkey < (s_nationkey*7+s_suppkey*3+1)%25 GROUP BY ALL)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = _place(spark, "graph.gfa")
    formats.write_gfa(_segments(spark, d), _links(spark, d), path)
    return formats.read_gfa(spark, path)


@query(f"WITH {_SEGMENTS}, w AS (SELECT unitig, CASE WHEN seq='' THEN 'A' ELSE seq END AS seq, dp FROM seg) SELECT unitig, seq, length(seq) AS length, dp FROM w")
def gfa_segments(spark, d):
    return _graph(spark, d)[0]


@query(f"WITH {_LINKS} SELECT concat('u',src) AS from_seg, '+' AS from_orient, concat('u',dst) AS to_seg, CASE WHEN weight%2=0 THEN '+' ELSE '-' END AS to_orient, '0M' AS overlap, weight AS ex FROM edges")
def gfa_links(spark, d):
    return _graph(spark, d)[1]


@query(f"WITH {_SEGMENTS} SELECT unitig, seq, length(seq) AS length FROM seg")
def fasta_records(spark, d):
    path = _place(spark, "segments.fasta")
    formats.write_fasta(_segments(spark, d), path)
    return formats.read_fasta(spark, path)


@query(f"WITH {_SEGMENTS} SELECT unitig, seq, length(seq) AS length FROM seg WHERE unitig='u7'")
def fasta_lookup(spark, d):
    path = _place(spark, "segments.fasta")
    formats.write_fasta(_segments(spark, d), path)
    return formats.lookup_fasta(spark, path, "u7")


def _sam(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "reads.sam")
    rows = alignments(spark, d)
    text = lambda c: F.col(c).cast("string").alias(c)
    reads = rows.select(text("read_id"), text("unitig"), "s", "mapq", "rev", (F.col("clip") > 190).alias("supplementary"), "cigar", F.lit("*").alias("seq"), fn.colour(F.col("hap"), F.lit(4)).alias("yc"))
    formats.write_sam(rows.select(text("unitig"), "length").distinct(), reads, path)
    return formats.read_sam(spark, path)


_SAM = f"WITH {_ALN}, sam AS (SELECT CAST(read_id AS VARCHAR) AS read_id, CAST(unitig AS VARCHAR) AS unitig, CAST(s AS INTEGER) AS ref_start, CAST(mapq AS INTEGER) AS mapq, rev AS is_reverse, clip>190 AS is_supplementary, cigar FROM aln) SELECT * FROM sam"


@query(_SAM)
def sam_records(spark, d):
    return _sam(spark, d).select("read_id", "unitig", "ref_start", "mapq", "is_reverse", "is_supplementary", "cigar")


@query(_SAM + " WHERE unitig='11'")
def sam_region(spark, d):
    return _sam(spark, d).select("read_id", "unitig", "ref_start", "mapq", "is_reverse", "is_supplementary", "cigar").where("unitig = '11'")


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Variant rows: of the SNPs, every third didn't pass, every fifth adds a base."""
    snps = _snps(_obs(spark, d))
    dot = F.lit(".")
    fifth, third = (F.floor(F.col("pos") / 100) % k == 0 for k in (5, 3))
    return snps.select(
        F.col("unitig").cast("string").alias("CHROM"), (F.col("pos") + 1).alias("POS"), dot.alias("ID"), F.col("ref").alias("REF"), F.when(fifth, F.concat("alt", F.lit("A"))).otherwise(F.col("alt")).alias("ALT"),
        F.lit(60).alias("QUAL"), F.when(third, "LOW").otherwise("PASS").alias("FILTER"), dot.alias("INFO"), dot.alias("FORMAT"), dot.alias("sample"),
    )


_VCF = f"""WITH {_COUNTS} SELECT CAST(unitig AS VARCHAR) AS "CHROM", CAST(pos+1 AS INTEGER) AS "POS", ref AS "REF", alt AS "ALT" FROM snps WHERE (pos//100)%3<>0 AND (pos//100)%5<>0"""


@query(_VCF)
def vcf_snps(spark, d):
    path = _place(spark, "variants.vcf")
    formats.write_vcf(_variants(spark, d), path)
    return formats.read_vcf(spark, path).select("CHROM", "POS", "REF", "ALT")


@query(_VCF)
def vcf_written_once(spark, d):
    """The second writing leaves the file as it is."""
    path = _place(spark, "variants.vcf")
    rows = _variants(spark, d)
    formats.write_vcf(rows, path, once=True)
    formats.write_vcf(rows.limit(1).withColumn("REF", F.lit("N")), path, once=True)
    return formats.read_vcf(spark, path).select("CHROM", "POS", "REF", "ALT")


@query(f"""WITH {_SEGMENTS} SELECT concat('##contig=<ID=',unitig,',length=',length(seq),'>') AS value FROM seg
UNION ALL SELECT unnest(['##fileformat=VCFv4.2', {", ".join("'" + x + "'" for x in formats.VCF_META)}, concat_ws(chr(9), {", ".join("'" + x + "'" for x in ["#" + formats.VCF_COLUMNS[0], *formats.VCF_COLUMNS[1:]])})])""")
def vcf_header(spark, d):
    path = _place(spark, "variants.vcf")
    formats.write_vcf(_variants(spark, d).limit(0), path, lengths=_segments(spark, d).select("unitig", "length"))
    return spark.read.text(path)


@query("SELECT concat('n',l_partkey%50) AS name, l_orderkey AS s, l_orderkey+l_linenumber AS e, CAST(l_quantity AS BIGINT) AS cov FROM lineitem WHERE l_linenumber<7")
def bed_records(spark, d):
    path = _place(spark, "depth.bed")
    rows = table(spark, d, "lineitem")
    broken = F.when(F.col("l_linenumber") < 7, (F.col("l_orderkey") + F.col("l_linenumber")).cast("string")).otherwise("broken")
    rows.select(F.concat_ws("\t", F.concat(F.lit("n"), (F.col("l_partkey") % 50).cast("string")), F.col("l_orderkey").cast("string"), broken, F.col("l_quantity").cast("long").cast("string")).alias("value")).write.text(path)
    return formats.read_bed(spark, path)


@query("SELECT concat('u',user_id) AS unitig, event_id AS pos, 'A' AS ref, CAST(1 AS INTEGER) AS depth, '.' AS bases, 'I' AS quals, ']' AS mapqs, event_type AS names FROM events WHERE event_id%4<>0")
def mpileup_records(spark, d):
    path = _place(spark, "pile.txt")
    e = table(spark, d, "events")
    whole = F.concat_ws("\t", F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id").cast("string"), F.lit("A"), F.lit("1"), F.lit("."), F.lit("I"), F.lit("]"), F.col("event_type"))
    e.select(F.when(F.col("event_id") % 4 != 0, whole).otherwise("too\tshort").alias("value")).write.text(path)
    return formats.read_mpileup(spark, path)


@query("SELECT concat('u',l_partkey%20) AS unitig, concat('r',l_orderkey,'_',l_linenumber) AS read_id, CASE WHEN l_suppkey%5=0 THEN NULL ELSE CAST(l_suppkey%5 AS BIGINT) END AS cluster, CAST(l_linenumber AS INTEGER) AS start FROM lineitem")
def cluster_table(spark, d):
    path = _place(spark, "clusters")
    k = F.col("l_suppkey") % 5
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("u"), (F.col("l_partkey") % 20).cast("string")).alias("unitig"), F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("read_id"), F.when(k != 0, k.cast("long")).alias("cluster"), F.col("l_linenumber").cast("int").alias("start"))
    none = formats.read_clusters(spark, path)  # no file yet: no clusters
    formats.write_clusters(rows, path)
    return formats.read_clusters(spark, path).union(none)


@query("SELECT p_name AS name, CAST(p_size AS INTEGER) AS size, p_retailprice AS price FROM part UNION ALL SELECT p_name, -1, 0 FROM part WHERE p_size<10")
def appended_table(spark, d):
    """A tab-separated table that is appended to."""
    path = _place(spark, "stats")
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    formats.write_table(rows, path)
    formats.write_table(rows.where("size < 10").select("name", F.lit(-1).alias("size"), F.lit(0.0).alias("price")), path, append=True)
    return formats.read_table(spark, path, "name string, size int, price double")


@query("SELECT concat('u',c_custkey) AS id FROM customer")
def id_list(spark, d):
    path = _place(spark, "ids.txt")
    name = F.concat(F.lit(" u"), F.col("c_custkey").cast("string"), F.lit(" "))
    table(spark, d, "customer").select(F.explode(F.array(name, F.lit(""))).alias("value")).write.text(path)
    return formats.read_ids(spark, path)


@query(f"WITH {_CL} SELECT unitig, cluster, min(s) AS start, max(e) AS \"end\" FROM cl GROUP BY ALL")
def cluster_span(spark, d):
    return alleles.span(_clusters(spark, d), ["unitig", "cluster"])


@query(f"WITH {_CL} SELECT unitig, cluster, read_id, s FROM cl WHERE s<500")
def cached_table(spark, d):
    """A table of a stage, read again by the next one."""
    t = Tables(spark, _place(spark, "tables"))
    t.put("clusters", _clusters(spark, d).select("unitig", "cluster", "read_id", "s"))
    return t.get("clusters").where("s < 500")


@query(f"""WITH {_CONS}, k AS (SELECT unitig, cluster, count(*) AS n FROM cons WHERE alt_flag GROUP BY ALL)
SELECT ext.unitig, ext.cluster, coalesce(n,0) AS n_sites, round(coalesce(n,0)/(last-first),9) AS rate, coalesce(n,0)>0.003::DOUBLE*(last-first) AS strange FROM ext LEFT JOIN k ON ext.unitig=k.unitig AND ext.cluster=k.cluster WHERE last>first""")
def strange_clusters(spark, d):
    key = ["unitig", "cluster"]
    return alleles.rate_flags(_consensus(spark, d).where("alt_flag").select(*key, "pos"), alleles.extent(_clusters(spark, d), key), key, 0.003)


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS "Reference_unitig", CAST(sum(l_orderkey%5000) AS BIGINT) AS total, count(*) AS n, median(l_orderkey%5000) AS median_length, median(CAST(l_quantity AS BIGINT)) AS median_coverage, median(l_discount) AS median_density FROM lineitem GROUP BY 1""")
def unitig_summary(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("Reference_unitig"), (F.col("l_orderkey") % 5000).alias("Length"), F.col("l_quantity").cast("long").alias("Coverage"), F.col("l_discount").cast("string").alias("SNP_density"))
    return reports.per_unitig(rows)


@query("SELECT CAST(row_number() OVER (ORDER BY 4000+100*p_size DESC, p_partkey) AS BIGINT) AS place, p_partkey AS unitig, CAST(4000+100*p_size AS BIGINT) AS length FROM part QUALIFY place<=100")
def longest_unitigs(spark, d):
    """The hundred longest unitigs, in order."""
    from pyspark.sql.window import Window

    from haploom.plans.projection import unitigs

    top = unitigs(spark, d).select("unitig", "length").orderBy(F.desc("length"), "unitig").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("length"), "unitig")).cast("long"))


_GRAPH = f"{_SEGMENTS}, {_LINKS}, dpt AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_nationkey%4 AS INTEGER) AS dp FROM nation)"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("unitig"), (F.col("n_nationkey") % 4).cast("int").alias("dp"))


@query(f"WITH {_GRAPH} SELECT src AS from_seg, dst AS to_seg, weight FROM edges SEMI JOIN (SELECT node FROM dpt WHERE dp<>0) a ON edges.src=a.node SEMI JOIN (SELECT node FROM dpt WHERE dp<>0) b ON edges.dst=b.node")
def covered_links(spark, d):
    e = links(spark, d).select(F.col("src").alias("from_seg"), F.col("dst").alias("to_seg"), F.col("weight").cast("int").alias("weight"))
    return graphs.drop_uncovered(_nations(spark, d), e)[1]


@query(f"WITH RECURSIVE {_GRAPH}, p(node, layer) AS (SELECT src, 0::BIGINT FROM edges UNION SELECT dst, layer+1 FROM p JOIN edges ON p.node=edges.src) SELECT node, max(layer) AS layer FROM p GROUP BY node")
def topological_layers(spark, d):
    return graphs.layers(links(spark, d))


@query("""SELECT DISTINCT CAST(a AS VARCHAR) AS from_seg, fo AS from_orient, CAST(b AS VARCHAR) AS to_seg, t AS to_orient FROM (SELECT l_partkey%40 AS a, l_suppkey%40 AS b, CASE WHEN l_linenumber%2=0 THEN '+' ELSE '-' END AS fo, CASE WHEN l_linenumber%3=0 THEN '+' ELSE '-' END AS t FROM lineitem)
WHERE a<>b AND a IN (SELECT n_nationkey FROM nation) AND b IN (SELECT n_nationkey FROM nation)""")
def cleaned_links(spark, d):
    """Links without self-links, repeats and those to segments that aren't there."""
    text = lambda c: (F.col(c) % 40).cast("string")
    sign = lambda k: F.when(F.col("l_linenumber") % k == 0, "+").otherwise("-")
    rows = table(spark, d, "lineitem").select(text("l_partkey").alias("from_seg"), sign(2).alias("from_orient"), text("l_suppkey").alias("to_seg"), sign(3).alias("to_orient"))
    return graphs.clean_links(rows, _nations(spark, d).select(F.col("unitig").cast("string").alias("unitig")))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, substr(CAST(l_shipdate AS VARCHAR),1,10) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(i AS INTEGER) AS place, CAST(length(replace(substr(s,1,CAST(i AS INTEGER)),'-','')) AS INTEGER) AS base FROM (SELECT *, unnest(range(1,length(s)+1)) AS i FROM g)""")
def bases_before_gaps(spark, d):
    rows = table(spark, d, "lineitem")
    gapped = F.substring(F.col("l_shipdate").cast("string"), 1, 10)  # a date has two gaps
    at = rows.select("l_orderkey", "l_linenumber", F.posexplode(fn.bases_before(gapped)).alias("i", "base"))
    return at.select("l_orderkey", "l_linenumber", (F.col("i") + 1).alias("place"), "base")


@query("""SELECT l_orderkey, l_linenumber, concat('u',l_partkey) AS unitig, CAST(l_suppkey AS INTEGER) AS pos, CASE WHEN l_linenumber%2=0 THEN '+' ELSE '-' END AS strand, concat(l_linenumber*10,'M') AS cigar, CAST(60 AS INTEGER) AS mapq FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'x', 1, '+', '5S', 0 FROM lineitem""")
def sa_tags(spark, d):
    """The supplementary alignments of a tag, a row each."""
    rows = table(spark, d, "lineitem")
    tag = F.concat(F.lit("u"), F.col("l_partkey").cast("string"), F.lit(","), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ",+,").otherwise(",-,"), (F.col("l_linenumber") * 10).cast("string"), F.lit("M,60;x,1,+,5S,0;"))
    return rows.select("l_orderkey", "l_linenumber", F.inline(formats.supplementary(tag)))
