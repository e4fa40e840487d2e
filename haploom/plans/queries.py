"""One query for each operator over the projected tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploom.functions import sequence as fn
from haploom.operators import alleles, coverage, distances, graphs, haplotypes, reports
from haploom.operators.components import components, components_within
from haploom.plans.checkpoints import dealt_once, delete, release, stored
from haploom.plans.config import Config
from haploom.plans.projection import WHOLE, alignments, by_parts, links, observations, table, unitigs

C = Config(min_depth=8)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_UNITIGS = "unitigs AS (SELECT p_partkey AS unitig, CAST(4000+100*p_size AS BIGINT) AS length, CAST(1+p_size%4 AS BIGINT) AS n_hap FROM part)"
_ALN = _UNITIGS + """, one AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey,l_linenumber,l_partkey ORDER BY l_suppkey,l_quantity,l_extendedprice) AS rn FROM lineitem),
placed AS (SELECT u.unitig, u.length, u.n_hap, l_orderkey*8+l_linenumber AS read_id, (l_orderkey*7919+l_linenumber*104729)%(u.length-1500) AS s, CAST(l_quantity AS BIGINT) AS q, l_orderkey, l_linenumber, l_discount, l_tax FROM one JOIN unitigs u ON l_partkey=u.unitig WHERE rn=1),
aln AS (SELECT unitig, read_id, s, least(length, s+1200+60*q) AS e, CAST(round(l_discount*600) AS BIGINT) AS mapq, l_tax AS de, (l_orderkey+l_linenumber)%n_hap AS hap, l_orderkey%2=1 AS rev, q*7%200 AS clip, length,
  concat(q*7%200,'S',1200+60*q-q,'M',q%5+1,'I',q,'D',l_linenumber*3,'H') AS cigar, l_linenumber*3 AS hard, q FROM placed)"""
_OBS = _ALN + """, obs AS (SELECT unitig, read_id, 200*j+100 AS pos, substr('ACGT', CAST(1+(hap*(j+1)+unitig+CASE WHEN (read_id*31+j*17)%97=0 THEN 1 ELSE 0 END)%4 AS INTEGER), 1) AS base, rev FROM aln, (SELECT unnest(range(0,45)) AS j) WHERE 200*j+100>s AND 200*j+100<=e)"""
_COUNTS = _OBS + """, ad AS (SELECT unitig, pos, base, count(*) AS n, count(*) FILTER (NOT rev) AS f, count(*) FILTER (rev) AS r FROM obs GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY unitig,pos ORDER BY n DESC, base) AS k, sum(n) OVER (PARTITION BY unitig,pos) AS dp FROM ad),
snps AS (SELECT unitig, pos, max(base) FILTER (k=1) AS ref, max(base) FILTER (k=2) AS alt, CAST(max(dp) AS BIGINT) AS dp, max(n) FILTER (k=2) AS alt_n FROM rk GROUP BY ALL HAVING max(n) FILTER (k=2) >= greatest(3, 0.2*max(dp)))"""
_PAIRS = "pairs AS (SELECT x.unitig, x.read_id AS a, y.read_id AS b, least(x.e,y.e)-greatest(x.s,y.s) AS overlap FROM aln x JOIN aln y ON x.unitig=y.unitig AND x.read_id<y.read_id AND least(x.e,y.e)-greatest(x.s,y.s)>=1000)"
_DIST = _COUNTS + ", " + _PAIRS + """, seen AS (SELECT obs.* FROM obs SEMI JOIN snps ON obs.unitig=snps.unitig AND obs.pos=snps.pos),
shared AS (SELECT x.unitig, x.read_id AS a, y.read_id AS b, count(*) AS n_common, count(*) FILTER (x.base<>y.base) AS mism FROM seen x JOIN seen y ON x.unitig=y.unitig AND x.pos=y.pos AND x.read_id<y.read_id GROUP BY ALL),
dist AS (SELECT unitig,a,b,overlap,n_common,mism,round(mism/overlap,9) AS d FROM pairs JOIN shared USING (unitig,a,b))"""
#: Clusters: reads of a unitig by haplotype.
_CL = _COUNTS + ", cl AS (SELECT unitig, hap AS cluster, read_id, s, e, length FROM aln), ext AS (SELECT unitig, cluster, count(*) AS n_reads, list_sort(list(s))[2] AS first, list_reverse_sort(list(e))[2] AS last, sum(e-s) AS bases FROM cl GROUP BY ALL)"
_EDGES = "edges AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST((s_nationkey*7+s_suppkey*3+1)%25 AS BIGINT) AS dst, count(*) AS weight FROM supplier WHERE s_nationkey < (s_nationkey*7+s_suppkey*3+1)%25 GROUP BY ALL)"


def query(sql: str | None):
    """Register a query; ``sql`` is its DuckDB text, None where SQL can't express it or is too slow on whole tables."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _obs(spark: SparkSession, d: str, part=WHOLE) -> DataFrame:
    return observations(alignments(spark, d, part))


def _snps(obs: DataFrame) -> DataFrame:
    return alleles.snp_calls(obs, C.allele_frequency, C.min_alt)


def _clusters(spark: SparkSession, d: str, part=WHOLE) -> DataFrame:
    return alignments(spark, d, part).select("unitig", F.col("hap").alias("cluster"), "read_id", "s", "e", "length")


@query(f"WITH {_ALN} SELECT u.unitig, u.length, count(read_id) AS n_reads, CAST(coalesce(sum(e-s),0) AS BIGINT) AS bases, CAST(coalesce(sum(e-s),0)//u.length AS BIGINT) AS cov FROM unitigs u LEFT JOIN aln ON u.unitig=aln.unitig GROUP BY u.unitig, u.length")
def unitig_coverage(spark, d):
    return coverage.depth(alignments(spark, d), unitigs(spark, d))


_DEPTH = f"{_ALN}, depth AS (SELECT u.unitig, u.length, count(read_id) AS n_reads, CAST(coalesce(sum(e-s),0) AS BIGINT) AS bases FROM unitigs u LEFT JOIN aln ON u.unitig=aln.unitig GROUP BY u.unitig, u.length)"


@query(f"WITH {_DEPTH} SELECT unitig, length, bases FROM depth WHERE round_even(bases/length,0) BETWEEN 8 AND 500 AND length>1000")
def eligible_unitigs(spark, d):
    return coverage.eligible(coverage.depth(alignments(spark, d), unitigs(spark, d)), C.min_depth, C.max_depth, C.min_length).select("unitig", "length", "bases")


@query(f"WITH {_DEPTH} SELECT unitig FROM depth EXCEPT SELECT unitig FROM depth WHERE round_even(bases/length,0) BETWEEN 8 AND 500 AND length>1000")
def filtered_out(spark, d):
    all_of = coverage.depth(alignments(spark, d), unitigs(spark, d))
    return all_of.join(coverage.eligible(all_of, C.min_depth, C.max_depth, C.min_length), "unitig", "left_anti").select("unitig").distinct()


@query(f"WITH {_ALN} SELECT unitig, read_id, s, e, mapq FROM aln WHERE mapq>=20 AND de<=0.05 AND ((NOT (clip>100 OR hard>100) AND e-s>1000) OR least(s,length-e)<500)")
def read_filter(spark, d):
    return coverage.accepted(alignments(spark, d), C).select("unitig", "read_id", "s", "e", "mapq")


@query("""WITH r AS (SELECT user_id, event_type, event_id, CAST(value AS BIGINT)%3=0 AS supp, row_number() OVER (PARTITION BY user_id,event_type ORDER BY event_id) AS place FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id,event_type ORDER BY supp, CASE WHEN supp THEN place ELSE -place END) AS rn FROM r) SELECT user_id, event_type, event_id, supp FROM k WHERE rn=1""".replace("CAST(value AS BIGINT)", "CAST(trunc(value) AS BIGINT)"))
def one_aln_per_read(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", (F.col("value").cast("long") % 3 == 0).alias("supp"))
    return coverage.one_per_read(rows, ["user_id", "event_type"], "supp", ["event_id"])


@query(f"WITH {_COUNTS} SELECT unitig, pos, base, n, f AS forward, r AS reverse FROM ad")
def allele_depth(spark, d):
    return alleles.allele_depth(_obs(spark, d))


@query(f"WITH {_OBS} SELECT unitig, pos, count(*) AS dp, count(*) FILTER (base='A') AS n_a, count(*) FILTER (base='C') AS n_c, count(*) FILTER (base='G') AS n_g, count(*) FILTER (base='T') AS n_t FROM obs GROUP BY ALL")
def allele_pivot(spark, d):
    return alleles.allele_pivot(_obs(spark, d))


@query(f"WITH {_COUNTS} SELECT * FROM snps")
def snp_calls(spark, d):
    return _snps(_obs(spark, d))


@query(f"""WITH {_COUNTS}, st AS (SELECT unitig, pos, max(base) FILTER (k=1) AS ref, max(base) FILTER (k=2) AS alt, max(dp) AS dp, max(n) FILTER (k=2) AS n2,
 max(f) FILTER (k=1) AS f1, max(f) FILTER (k=2) AS f2, coalesce(max(f) FILTER (k>2),-1) AS fo, sum(f) FILTER (f>1) AS fs,
 max(r) FILTER (k=1) AS r1, max(r) FILTER (k=2) AS r2, coalesce(max(r) FILTER (k>2),-1) AS ro, sum(r) FILTER (r>1) AS rs FROM rk GROUP BY unitig, pos)
SELECT unitig, pos, ref, alt FROM st WHERE n2>=greatest(3,0.2*dp) AND fo<least(f1,f2) AND ro<least(r1,r2) AND f2>2 AND r2>2 AND f2/fs>=0.6*0.2 AND r2/rs>=0.6*0.2""")
def strand_filter(spark, d):
    return alleles.strand_supported(_obs(spark, d), C.allele_frequency, C.min_alt)


@query(f"WITH {_ALN}, {_PAIRS} SELECT * FROM pairs")
def read_overlap_pairs(spark, d):
    return distances.overlap_pairs(alignments(spark, d), C.min_overlap)


def _distances(spark, d, part=WHOLE):
    aln = alignments(spark, d, part)
    obs = observations(aln)
    return distances.distances(aln, obs, _snps(obs), C.min_overlap)


@query(f"WITH {_DIST} SELECT * FROM dist")
def read_distance(spark, d):
    return _distances(spark, d)


@query(f"WITH {_DIST} SELECT unitig,a,b,overlap FROM pairs ANTI JOIN shared USING (unitig,a,b)")
def no_common_snp_pairs(spark, d):
    aln = alignments(spark, d)
    obs = observations(aln)
    return distances.without_common(aln, obs, _snps(obs), C.min_overlap)


@query(f"WITH {_DIST} SELECT unitig,a,b,CASE WHEN d=0 THEN 1e-6::DOUBLE ELSE d END AS w FROM dist WHERE d<=0")
def distance_edges(spark, d):
    return distances.weighted_edges(_distances(spark, d), C.cluster_divergence / 2).select("unitig", "a", "b", "w")


#: No read's number reaches this, so numbers of nodes can't meet.
_READS = Decimal(10) ** 19


def _node(read: str) -> Column:
    """A number for a unitig's read."""
    return (F.col("unitig").cast("decimal(18,0)") * F.lit(_READS) + F.col(read)).cast("decimal(38,0)")


def _read(node: str) -> Column:
    return (F.col(node) % F.lit(_READS)).cast("long")


def _read_components(spark, d, part):
    """unitig, node (read), component (its smallest read) by edges of zero distance."""
    return components_within(distances.weighted_edges(_distances(spark, d, part), C.cluster_divergence / 2), "unitig")


def _labels(spark, d, part):
    """node, label by zero-distance edges of reads, nodes numbered by unitig and read."""
    done, rest = graphs.label_propagation_within(distances.weighted_edges(_distances(spark, d, part), C.cluster_divergence / 2), "unitig")
    found = done.select(_node("node").alias("node"), _node("label").alias("label"))
    if not rest.isEmpty():
        found = found.union(graphs.label_propagation(rest.select(_node("a").alias("src"), _node("b").alias("dst"), "w")))
    return found


@query(f"""WITH RECURSIVE {_DIST}, ed AS (SELECT unitig::HUGEINT*10000000000000000000+a AS a, unitig::HUGEINT*10000000000000000000+b AS b FROM dist WHERE d<=0), both_ AS (SELECT a,b FROM ed UNION SELECT b,a FROM ed),
reach(node, low) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ UNION (SELECT b, min(reach.low) FROM reach JOIN both_ ON reach.node=both_.a JOIN recurring.reach r2 ON r2.node=both_.b WHERE reach.low<r2.low GROUP BY b))
SELECT CAST(node//10000000000000000000 AS BIGINT) AS unitig, CAST(node%10000000000000000000 AS BIGINT) AS read_id, CAST(low%10000000000000000000 AS BIGINT) AS component FROM reach""")
def read_components(spark, d):
    (found,) = by_parts(spark, d, lambda part: (_read_components(spark, d, part),))
    return found.select("unitig", F.col("node").alias("read_id"), "component")


@query(None)
def label_propagation(spark, d):
    # edges are within a unitig, so that labels of one don't reach another
    (labels,) = by_parts(spark, d, lambda part: (_labels(spark, d, part),))
    return labels


@query(f"WITH {_CL} SELECT unitig, cluster, n FROM (SELECT unitig, cluster, count(*) AS n FROM cl GROUP BY ALL) WHERE n>=6")
def cluster_sizes(spark, d):
    return _clusters(spark, d).groupBy("unitig", "cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= C.min_final_size)


_VOTES = _CL + ", votes AS (SELECT o.unitig, cl.cluster, o.pos, o.base, snps.ref FROM obs o JOIN snps ON o.unitig=snps.unitig AND o.pos=snps.pos JOIN cl ON cl.unitig=o.unitig AND cl.read_id=o.read_id)"
_CONS = _VOTES + """, vc AS (SELECT unitig, cluster, pos, ref, base, count(*) AS n FROM votes GROUP BY ALL), vr AS (SELECT *, row_number() OVER (PARTITION BY unitig,cluster,pos ORDER BY n DESC, base) AS k FROM vc),
cons AS (SELECT unitig, cluster, pos, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n)>=3 AND max(n)>2 THEN max(base) FILTER (k=1) END AS base, coalesce(max(n) FILTER (k=2),0)>=greatest(3,0.3*sum(n)) AS second_flag, coalesce(max(n) FILTER (base<>ref),0)>=greatest(3,0.2*sum(n)) AS alt_flag FROM vr GROUP BY unitig, cluster, pos)"""


def _consensus(spark, d, part=WHOLE):
    obs = _obs(spark, d, part)
    votes = obs.join(_snps(obs).select("unitig", "pos", "ref"), ["unitig", "pos"]).join(_clusters(spark, d, part).select("unitig", "cluster", "read_id"), ["unitig", "read_id"])
    return alleles.consensus(votes, ["unitig", "cluster"], C.allele_frequency, C.split_allele_frequency, C.min_alt)


@query(f"WITH {_CONS} SELECT * FROM cons")
def cluster_consensus(spark, d):
    return _consensus(spark, d)


@query(f"WITH {_CL} SELECT unitig, cluster, n_reads, first, last, CASE WHEN last<>first THEN round(bases/(last-first),6) END AS cov FROM ext")
def cluster_extent(spark, d):
    return alleles.extent(_clusters(spark, d), ["unitig", "cluster"])


@query(f"""WITH {_CONS}, g AS (SELECT unitig, cluster, pos, pos-lag(pos) OVER (PARTITION BY unitig,cluster ORDER BY pos) AS g FROM cons WHERE alt_flag),
h AS (SELECT unitig, cluster, count(*) AS n_sites, max(g) AS widest, min(pos) AS lo, max(pos) AS hi FROM g GROUP BY ALL)
SELECT h.unitig, h.cluster, n_sites, widest, CASE WHEN n_sites>1 THEN coalesce(widest>1500 OR lo-first>1500 OR last-hi>1500, false) ELSE false END AS gapped FROM h JOIN ext ON h.unitig=ext.unitig AND h.cluster=ext.cluster""")
def snp_gap_flags(spark, d):
    sites = _consensus(spark, d).where("alt_flag").select("unitig", "cluster", "pos")
    return alleles.gap_flags(sites, alleles.extent(_clusters(spark, d), ["unitig", "cluster"]), ["unitig", "cluster"], C.gap_limit)


@query(f"""WITH {_CONS}, o AS (SELECT *, row_number() OVER (PARTITION BY unitig ORDER BY last, first, cluster) AS ord FROM ext WHERE n_reads>1),
sh AS (SELECT x.unitig, x.cluster AS a, y.cluster AS b, count(*) AS shared, count(*) FILTER (x.base<>y.base) AS mism FROM cons x JOIN cons y ON x.unitig=y.unitig AND x.pos=y.pos AND x.alt_flag AND y.alt_flag GROUP BY ALL)
SELECT x.unitig, x.cluster AS a, y.cluster AS b, CASE WHEN sh.shared IS NULL THEN 1.0 WHEN least(x.last,y.last)-greatest(x.first,y.first)>1000 THEN round(mism/(least(x.last,y.last)-greatest(x.first,y.first)),9) ELSE 1.0 END::DOUBLE AS d
FROM o x JOIN o y ON x.unitig=y.unitig AND x.ord<y.ord LEFT JOIN sh ON sh.unitig=x.unitig AND sh.a=x.cluster AND sh.b=y.cluster""")
def cluster_distance(spark, d):
    ext = alleles.extent(_clusters(spark, d), ["unitig", "cluster"]).where("n_reads > 1")
    cons = _consensus(spark, d).where("alt_flag").select("unitig", "cluster", "pos", "base")
    return distances.cluster_distances(ext, cons, C.min_overlap)


@query(f"WITH {_ALN} SELECT i.unitig, i.read_id AS inner, o.read_id AS outer FROM aln i JOIN aln o ON i.unitig=o.unitig AND o.s<i.s AND o.e>i.e".replace("AS inner", 'AS "inner"').replace("AS outer", 'AS "outer"'))
def nested_intervals(spark, d):
    return graphs.nested(alignments(spark, d), ["unitig"], "read_id")


_TRANS = f"{_EDGES}, p AS (SELECT a.src, c.dst FROM edges a JOIN edges c ON a.dst=c.src UNION SELECT a.src, c.dst FROM edges a JOIN edges b ON a.dst=b.src JOIN edges c ON b.dst=c.src), tr AS (SELECT DISTINCT src, dst FROM edges JOIN p USING (src,dst))"


@query(f"WITH {_TRANS} SELECT * FROM tr")
def transitive_edges(spark, d):
    return graphs.transitive(links(spark, d))


@query(f"WITH {_TRANS}, left_ AS (SELECT src, dst FROM edges EXCEPT SELECT * FROM tr), n AS (SELECT *, count(*) OVER (PARTITION BY src) AS o, count(*) OVER (PARTITION BY dst) AS i FROM left_) SELECT src, dst FROM n WHERE o=1 AND i=1")
def branch_free_edges(spark, d):
    return graphs.branch_free(graphs.without_transitive(links(spark, d)).select("src", "dst"))


_TWIN = "te AS (SELECT CAST(l_partkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) + 1000000000 AS dst FROM lineitem WHERE l_linenumber=1 AND l_quantity>=30)"


@query(f"""WITH {_TWIN}, b AS (SELECT src,dst FROM te UNION SELECT dst,src FROM te), s AS (SELECT src, list_sort(list(DISTINCT dst)) AS n FROM b GROUP BY src)
SELECT x.src AS a, y.src AS b FROM s x JOIN s y ON x.n=y.n AND x.src<y.src UNION SELECT x.src, y.src FROM b JOIN s x ON b.src=x.src JOIN s y ON b.dst=y.src WHERE x.src<y.src AND list_filter(x.n, lambda v: v<>y.src)=list_filter(y.n, lambda v: v<>x.src)""")
def twin_nodes(spark, d):
    e = table(spark, d, "lineitem").where("l_linenumber = 1 AND l_quantity >= 30").select(F.col("l_partkey").cast("long").alias("src"), (F.col("l_suppkey").cast("long") + 1_000_000_000).alias("dst"))
    return graphs.twins(e)


@query(f"""WITH RECURSIVE {_EDGES}, roots AS (SELECT DISTINCT src FROM edges WHERE src NOT IN (SELECT dst FROM edges)), leafs AS (SELECT DISTINCT dst FROM edges WHERE dst NOT IN (SELECT src FROM edges)),
w(src,dst,path) AS (SELECT src,dst,[src,dst] FROM edges WHERE src IN (SELECT src FROM roots) UNION ALL SELECT w.src, e.dst, list_append(path,e.dst) FROM w JOIN edges e ON w.dst=e.src WHERE NOT list_contains(path,e.dst) AND len(path)<=5)
SELECT src, dst, array_to_string(path,'>') AS path FROM w WHERE dst IN (SELECT dst FROM leafs)""")
def full_paths(spark, d):
    e = links(spark, d)
    src, dst = e.select(F.col("src").alias("node")).distinct(), e.select(F.col("dst").alias("node")).distinct()
    found = graphs.full_paths(e, src.join(dst, "node", "left_anti"), dst.join(src, "node", "left_anti"), 5)
    return found.select("src", "dst", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src,dst FROM edges UNION SELECT dst,src FROM edges), w(src,dst,h) AS (SELECT src,dst,1 FROM b UNION SELECT w.src,b.dst,h+1 FROM w JOIN b ON w.dst=b.src WHERE h<4)
SELECT src, dst, CAST(min(h) AS INTEGER) AS hops FROM w WHERE src<>dst GROUP BY src,dst""")
def khop(spark, d):
    return graphs.within_hops(links(spark, d), 4)


@query(f"WITH {_UNITIGS}, n AS (SELECT *, CAST(ceil(length/2500) AS BIGINT) AS n FROM unitigs) SELECT unitig, piece, piece*(length//n) AS start, CASE WHEN piece=n-1 THEN length-(length//n)*(n-1) ELSE length//n END AS piece_length FROM (SELECT *, unnest(range(0,n)) AS piece FROM n)")
def split_long_unitigs(spark, d):
    return coverage.split_long(unitigs(spark, d), 2500)


@query(f"WITH {_CL} SELECT unitig, cluster, count(*) FILTER (s<500)>2 AS left_strong, count(*) FILTER (e>length-500)>2 AS right_strong, min(s)<500 AND max(e)>max(length)-500 AS spans FROM cl GROUP BY unitig, cluster")
def strong_tails(spark, d):
    return coverage.strong_tails(_clusters(spark, d), ["unitig", "cluster"], C.end_gap, C.tip_reads)


@query(f"""WITH {_ALN}, o AS (SELECT unitig, s, e, coalesce(max(e) OVER (PARTITION BY unitig ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),-1) AS r FROM aln)
SELECT unitig, CAST(sum(greatest(e-greatest(s,r),0)) AS BIGINT) AS covered, CAST(sum(e-s) AS BIGINT) AS summed, count(*) FILTER (s>r) AS islands FROM o GROUP BY unitig""")
def interval_union(spark, d):
    return coverage.union_length(alignments(spark, d), ["unitig"])


@query(f"""WITH {_ALN}, x AS (SELECT a.unitig AS src, b.unitig AS dst, count(*) AS n FROM aln a JOIN aln b ON a.read_id=b.read_id AND a.unitig<b.unitig GROUP BY ALL) SELECT * FROM x WHERE n>=1""")
def read_links(spark, d):
    a = alignments(spark, d).select("read_id", "unitig")
    both = a.withColumnRenamed("unitig", "src").join(a.withColumnRenamed("unitig", "dst"), "read_id").where("src < dst")
    return both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n >= 1")


@query(f"""WITH {_ALN}, o AS (SELECT read_id, unitig, s, e, length, lead(unitig) OVER w AS next_unitig, lead(s) OVER w AS next_s FROM aln WINDOW w AS (PARTITION BY read_id ORDER BY s, unitig))
SELECT read_id, unitig, next_unitig FROM o WHERE next_unitig IS NOT NULL AND (length-e<500 OR next_s<500)""")
def adjacent_segments(spark, d):
    w = Window.partitionBy("read_id").orderBy("s", "unitig")
    rows = alignments(spark, d).withColumn("next_unitig", F.lead("unitig").over(w)).withColumn("next_s", F.lead("s").over(w))
    return rows.where("next_unitig IS NOT NULL AND (length - e < 500 OR next_s < 500)").select("read_id", "unitig", "next_unitig")


@query(f"WITH {_EDGES}, sinks AS (SELECT DISTINCT dst AS n FROM edges WHERE dst NOT IN (SELECT src FROM edges)) SELECT DISTINCT e.src, e.dst, CAST(888 AS INTEGER) AS weight FROM edges e JOIN sinks ON e.dst=n WHERE e.src%2=0")
def parental_links(spark, d):
    e = links(spark, d).select("src", "dst")
    tips = e.select("dst").join(e.select(F.col("src").alias("dst")), "dst", "left_anti").distinct()
    return e.where("src % 2 = 0").join(tips, "dst", "left_semi").select("src", "dst", F.lit(888).alias("weight"))


@query(f"WITH {_EDGES} SELECT src, dst, weight FROM edges WHERE src%5<>0 AND dst%5<>0")
def drop_removed_links(spark, d):
    e = links(spark, d)
    removed = e.select(F.explode(F.array("src", "dst")).alias("node")).where("node % 5 = 0").distinct()
    return graphs.without_segments(e, removed).select("src", "dst", "weight")


_CHAIN = "ce AS (SELECT o_orderkey AS src, o_orderkey+1 AS dst FROM orders WHERE o_orderkey%7<>0 UNION SELECT o_orderkey, o_orderkey+3 FROM orders WHERE o_orderkey%11=0)"


@query(f"""WITH RECURSIVE {_CHAIN}, n AS (SELECT *, count(*) OVER (PARTITION BY src) AS o, count(*) OVER (PARTITION BY dst) AS i FROM ce), k AS (SELECT src,dst FROM n WHERE o=1 AND i=1),
w(head,node,place) AS (SELECT src,src,0 FROM k WHERE src NOT IN (SELECT dst FROM k) UNION ALL SELECT w.head,k.dst,place+1 FROM w JOIN k ON w.node=k.src) SELECT node, min(node) OVER (PARTITION BY head) AS chain, CAST(place AS BIGINT) AS place FROM w""")
def linear_chains(spark, d):
    return graphs.linear_chains(_chain_edges(spark, d), components).withColumnRenamed("at", "place")


def _chain_edges(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"))
    return o.where("src % 7 <> 0").select("src", (F.col("src") + 1).alias("dst")).union(o.where("src % 11 = 0").select("src", (F.col("src") + 3).alias("dst")))


@query(None)
def simplify_links(spark, d):
    e = links(spark, d)
    depth = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("depth")).union(e.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("depth"))).groupBy("node").agg(F.max("depth").alias("depth"))
    return graphs.simplified(e, depth, C.depth_ratio)


@query(None)
def independent_set(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 31 + F.col("l_linenumber")) % 997).alias("dst")).where("src <> dst").distinct()
    nodes = e.select("src").union(e.select("dst")).distinct().select(F.col("src").alias("node"), (F.col("src") * 7919 % 1009).alias("length"))
    return graphs.independent_set(nodes, e)


@query(f"""WITH {_ALN}, c AS (SELECT *, 1200+60*q-q AS m, q%5+1 AS i FROM aln) SELECT unitig, read_id, s+m+q AS ref_end, CASE WHEN rev THEN hard ELSE clip END AS query_start, CASE WHEN rev THEN hard ELSE clip END+m+i AS query_end, clip+m+i+hard AS query_length FROM c""")
def cigar_span(spark, d):
    return alignments(spark, d).select("unitig", "read_id", fn.cigar_span(F.col("cigar"), F.col("s"), F.col("rev")).alias("x")).select("unitig", "read_id", "x.*")


@query("SELECT o_orderkey, reverse(translate(translate(substr('ACGTTGCAGGTC', CAST(1+o_orderkey%6 AS INTEGER), 6),'ACGT','tgca'),'tgca','TGCA')) AS rc FROM orders")
def reverse_complement(spark, d):
    part = F.substring(F.lit("ACGTTGCAGGTC"), (F.col("o_orderkey") % 6).cast("int") + 1, F.lit(6))
    return table(spark, d, "orders").select("o_orderkey", fn.reverse_complement(part).alias("rc"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name,b.p_name) AS INTEGER) AS dist FROM part a JOIN part b ON a.p_brand=b.p_brand AND a.p_size=b.p_size AND a.p_type=b.p_type AND a.p_partkey<b.p_partkey")
def edit_distance(spark, d):
    p = table(spark, d, "part")
    a, b = (p.select("p_brand", "p_size", "p_type", F.col("p_partkey").alias(x), F.col("p_name").alias(f"{x}_name")) for x in "ab")
    return a.join(b, ["p_brand", "p_size", "p_type"]).where("a < b").select("a", "b", F.levenshtein("a_name", "b_name").alias("dist"))


@query("""WITH g AS (SELECT o_orderkey, concat(repeat('-',CAST(o_orderkey%3 AS INTEGER)),'AC',repeat('-',CAST(o_orderkey%9 AS INTEGER)),'GT',repeat('-',CAST(o_custkey%7 AS INTEGER)),'A') AS s FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_orderkey%9>=5 THEN o_orderkey%9 ELSE 0 END + CASE WHEN o_custkey%7>=5 THEN o_custkey%7 ELSE 0 END AS BIGINT) AS gap_score FROM orders""")
def gap_runs(spark, d):
    dash = lambda n: F.repeat(F.lit("-"), n.cast("int"))
    s = F.concat(dash(F.col("o_orderkey") % 3), F.lit("AC"), dash(F.col("o_orderkey") % 9), F.lit("GT"), dash(F.col("o_custkey") % 7), F.lit("A"))
    return table(spark, d, "orders").select("o_orderkey", F.aggregate(fn.inner_gap_runs(s, 5), F.lit(0).cast("long"), lambda a, x: a + x).alias("gap_score"))


@query(f"""WITH {_COUNTS}, iv AS (SELECT unitig, s, e, mapq AS cov FROM aln WHERE rev) SELECT p.unitig, p.pos, CAST(coalesce(arg_min(cov,(s,e,cov)),0) AS BIGINT) AS cov FROM snps p LEFT JOIN iv ON iv.unitig=p.unitig AND p.pos BETWEEN s AND e GROUP BY p.unitig, p.pos""")
def point_in_interval(spark, d):
    aln = alignments(spark, d)
    return coverage.point_depth(_snps(observations(aln)).select("unitig", "pos"), aln.where("rev").select("unitig", "s", "e", F.col("mapq").alias("cov")), ["unitig"])


def _n50_sql(source: str, key: str) -> str:
    return f"""WITH t AS (SELECT {key} AS key, length, row_number() OVER w AS i, sum(length) OVER w AS run, sum(length) OVER (PARTITION BY {key}) AS total FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY length DESC, id ROWS UNBOUNDED PRECEDING))
SELECT key, CAST(max(total) AS BIGINT) AS total, count(*) AS n, CAST(coalesce(max(length) FILTER (run*2>total),0) AS BIGINT) AS n50, coalesce(min(i) FILTER (run*2>total),0) AS l50 FROM t GROUP BY key"""


@query(_n50_sql("(SELECT p_brand, CAST(4000+100*p_size AS BIGINT) AS length, p_partkey AS id FROM part)", "p_brand"))
def n50(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("key"), (4000 + 100 * F.col("p_size").cast("long")).alias("length"))
    return reports.n50(rows, ["key"])


@query(f"WITH {_DEPTH}" + _n50_sql("(SELECT 'input' AS stage, length, unitig AS id FROM depth UNION ALL SELECT 'selected', length, unitig FROM depth WHERE round_even(bases/length,0) BETWEEN 8 AND 500 AND length>1000 UNION ALL SELECT 'reads', e-s, read_id*10000000+unitig FROM aln)", "stage").replace("WITH t AS", ", t AS"))
def stage_totals(spark, d):
    aln = alignments(spark, d)
    all_of = coverage.depth(aln, unitigs(spark, d))
    chosen = coverage.eligible(all_of, C.min_depth, C.max_depth, C.min_length)
    return reports.totals({"input": all_of, "selected": chosen, "reads": aln.select((F.col("e") - F.col("s")).alias("length"))}).withColumnRenamed("stage", "key")


_BINS = f"{_ALN}, bins AS (SELECT unitig, bin, count(*) AS n FROM (SELECT unitig, unnest(range(s//100, e//100)) AS bin FROM aln) GROUP BY ALL)"


@query(f"WITH {_BINS} SELECT * FROM bins")
def binned_depth(spark, d):
    return coverage.binned(alignments(spark, d), "unitig", C.report_window)


@query(f"WITH {_BINS}, m AS (SELECT n AS multiplicity, CAST(count(*)*100 AS BIGINT) AS bp FROM bins WHERE n BETWEEN 1 AND 10 GROUP BY n) SELECT multiplicity, bp, repeat('*', CAST(floor(bp/(max(bp) OVER ())*20) AS INTEGER)) AS bar FROM m")
def multiplicity_hist(spark, d):
    return reports.multiplicity(coverage.binned(alignments(spark, d), "unitig", C.report_window), C.report_window)


@query(f"WITH {_DEPTH} SELECT CAST(bases//length AS BIGINT) AS cov, CAST(sum(length//100) AS BIGINT) AS bins FROM depth GROUP BY 1")
def depth_hist(spark, d):
    return reports.depth_histogram(coverage.depth(alignments(spark, d), unitigs(spark, d)), C.report_window)


_RATE = f"{_COUNTS}, rates AS (SELECT u.unitig, u.length, count(pos) AS n_snp, round(count(pos)/u.length,9) AS rate FROM unitigs u LEFT JOIN snps ON u.unitig=snps.unitig GROUP BY u.unitig, u.length)"


def _rates(spark, d):
    found = _snps(_obs(spark, d)).groupBy("unitig").agg(F.count(F.lit(1)).alias("n_snp"))
    u = unitigs(spark, d).select("unitig", "length").join(found, "unitig", "left").withColumn("n_snp", F.coalesce("n_snp", F.lit(0)).cast("long"))
    return u.withColumn("rate", F.round(F.col("n_snp") / F.col("length"), 9))


@query(f"WITH {_RATE} SELECT CAST(trunc(-10*log10(rate)) AS INTEGER) AS bin, round(pow(10.0,-CAST(trunc(-10*log10(rate)) AS INTEGER)/10),5) AS label, CAST(sum(length) AS BIGINT) AS bp FROM rates WHERE rate>=1e-5 GROUP BY ALL")
def divergence_hist(spark, d):
    return reports.divergence_histogram(_rates(spark, d), C.min_divergence)


@query(f"WITH {_RATE}, c AS (SELECT unitig, count(DISTINCT hap) AS k FROM aln GROUP BY unitig), b AS (SELECT unitig, sum(e-s) AS bases FROM aln GROUP BY unitig) SELECT r.unitig AS Reference_unitig, r.length AS Length, CAST(coalesce(bases,0)//r.length AS BIGINT) AS Coverage, rate AS SNP_density, n_snp>0 AS Is_processed, coalesce(k,0)>1 AS Is_phased FROM rates r LEFT JOIN c ON r.unitig=c.unitig LEFT JOIN b ON r.unitig=b.unitig")
def ref_info(spark, d):
    aln = alignments(spark, d)
    per = aln.groupBy("unitig").agg(F.count_distinct("hap").alias("k"), F.sum(F.col("e") - F.col("s")).alias("bases"))
    rows = _rates(spark, d).join(per, "unitig", "left")
    return rows.select(F.col("unitig").alias("Reference_unitig"), F.col("length").alias("Length"), F.coalesce(F.floor(F.col("bases") / F.col("length")), F.lit(0)).cast("long").alias("Coverage"), F.col("rate").alias("SNP_density"), (F.col("n_snp") > 0).alias("Is_processed"), (F.coalesce("k", F.lit(0)) > 1).alias("Is_phased"))


@query(f"""WITH {_CL}, b AS (SELECT unitig, CAST(sum(e-s) AS BIGINT)//max(length) AS refcov FROM aln GROUP BY unitig), x AS (SELECT ext.*, CASE WHEN last>first THEN CAST(bases AS BIGINT)//(last-first) END AS dp FROM ext)
SELECT concat(x.unitig,'_',x.cluster) AS strain_unitig, x.unitig AS reference_unitig, dp AS coverage, CAST(coalesce(CASE WHEN refcov>0 THEN 100*dp//refcov END,0) AS BIGINT) AS abundance, first AS start_position, last AS end_position FROM x JOIN b ON x.unitig=b.unitig""")
def phased_info(spark, d):
    cl = _clusters(spark, d)
    ext = cl.groupBy("unitig", "cluster").agg(F.get(F.sort_array(F.collect_list("s")), F.lit(1)).alias("first"), F.get(F.sort_array(F.collect_list("e"), False), F.lit(1)).alias("last"), F.sum(F.col("e") - F.col("s")).alias("bases"))
    ref = cl.groupBy("unitig").agg(F.floor(F.sum(F.col("e") - F.col("s")) / F.max("length")).cast("long").alias("refcov"))
    dp = F.when(F.col("last") > F.col("first"), F.floor(F.col("bases") / (F.col("last") - F.col("first"))).cast("long"))
    rows = ext.withColumn("dp", dp).join(ref, "unitig")
    return rows.select(F.concat_ws("_", F.col("unitig").cast("string"), F.col("cluster").cast("string")).alias("strain_unitig"), F.col("unitig").alias("reference_unitig"), F.col("dp").alias("coverage"), F.coalesce(F.floor(F.try_divide(100 * F.col("dp"), F.col("refcov"))), F.lit(0)).cast("long").alias("abundance"), F.col("first").alias("start_position"), F.col("last").alias("end_position"))


@query(f"""WITH {_COUNTS}, q AS (SELECT o.unitig, o.pos, o.base, o.read_id, a.mapq, a.hap FROM obs o JOIN aln a ON o.unitig=a.unitig AND o.read_id=a.read_id),
v AS (SELECT s.unitig, s.pos, s.ref, s.alt, CAST(trunc(median(mapq)) AS INTEGER) AS qual, list_sort(list(DISTINCT hap) FILTER (base=s.alt)) AS ah, list_sort(list(DISTINCT hap) FILTER (base=s.ref)) AS rh, count(*) FILTER (base=s.alt) AS dv, count(*) AS dp FROM snps s JOIN q ON q.unitig=s.unitig AND q.pos=s.pos GROUP BY s.unitig, s.pos, s.ref, s.alt)
SELECT unitig, pos, ref, alt, qual, concat('ALT_HAP=',array_to_string(ah,','),CASE WHEN len(list_filter(rh, lambda x: NOT list_contains(ah,x)))>0 THEN concat(';REF_HAP=',array_to_string(list_filter(rh, lambda x: NOT list_contains(ah,x)),',')) ELSE '' END) AS info, concat('0/1:',dv,':',dp) AS sample FROM v""")
def variant_rows(spark, d):
    aln = alignments(spark, d)
    obs = observations(aln)
    seen = obs.join(aln.select("unitig", "read_id", "mapq", "hap"), ["unitig", "read_id"])
    rows = _snps(obs).select("unitig", "pos", "ref", "alt").join(seen, ["unitig", "pos"])
    hap = F.col("hap").cast("string")
    v = rows.groupBy("unitig", "pos", "ref", "alt").agg(F.median("mapq").cast("int").alias("qual"), F.sort_array(F.collect_set(F.when(F.col("base") == F.col("alt"), hap))).alias("ah"), F.sort_array(F.collect_set(F.when(F.col("base") == F.col("ref"), hap))).alias("rh"), F.count_if(F.col("base") == F.col("alt")).alias("dv"), F.count(F.lit(1)).alias("dp"))
    only = F.array_except("rh", "ah")
    info = F.concat(F.lit("ALT_HAP="), F.array_join("ah", ","), F.when(F.size(only) > 0, F.concat(F.lit(";REF_HAP="), F.array_join(only, ","))).otherwise(""))
    return v.select("unitig", "pos", "ref", "alt", "qual", info.alias("info"), F.concat_ws(":", F.lit("0/1"), F.col("dv").cast("string"), F.col("dp").cast("string")).alias("sample"))


@query(f"WITH {_CL}, k AS (SELECT unitig, cluster, dense_rank() OVER (PARTITION BY unitig ORDER BY cluster) AS colour FROM (SELECT DISTINCT unitig, cluster FROM cl)) SELECT cl.unitig, cl.read_id, CAST(colour AS INTEGER) AS colour FROM cl JOIN k ON cl.unitig=k.unitig AND cl.cluster=k.cluster")
def phased_reads(spark, d):
    cl = _clusters(spark, d)
    colours = cl.select("unitig", "cluster").distinct().withColumn("colour", F.dense_rank().over(Window.partitionBy("unitig").orderBy("cluster")))
    return cl.join(colours, ["unitig", "cluster"]).select("unitig", "read_id", "colour")


@query("SELECT p_partkey, CASE WHEN x=0 THEN '0.000' ELSE printf('%.2f', x) END AS text FROM (SELECT p_partkey, CASE WHEN p_partkey%10=0 THEN 0.0 ELSE p_retailprice END::DOUBLE AS x FROM part)")
def number_format(spark, d):
    x = F.when(F.col("p_partkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", fn.three_digits(x).alias("text"))


@query(f"""WITH {_CL}, m AS (SELECT unitig, min(cluster) AS merged, count(DISTINCT cluster) AS k FROM cl WHERE cluster<2 GROUP BY unitig) SELECT cl.unitig, cl.read_id, CASE WHEN cl.cluster<2 AND k=2 THEN merged ELSE cl.cluster END AS cluster FROM cl LEFT JOIN m ON cl.unitig=m.unitig""")
def relabelled_reads(spark, d):
    cl = _clusters(spark, d)
    merged = cl.where("cluster < 2").groupBy("unitig").agg(F.min("cluster").alias("merged"), F.count_distinct("cluster").alias("k")).where("k = 2").select("unitig", "merged", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("cluster"))
    return cl.join(merged, ["unitig", "cluster"], "left").select("unitig", "read_id", F.coalesce("merged", "cluster").alias("cluster"))


@query("""WITH p AS (SELECT o_orderkey, concat('A^]',CASE WHEN o_orderkey%2=0 THEN '+2ac' ELSE '-11ACGTACGTACG' END,',.$',CASE WHEN o_orderkey%3=0 THEN '*' ELSE '>' END) AS b FROM orders)
SELECT o_orderkey, 'MMMS' AS tokens, CASE WHEN o_orderkey%2=0 THEN '+' ELSE '-' END AS indels FROM p""")
def pileup_tokens(spark, d):
    b = F.concat(F.lit("A^]"), F.when(F.col("o_orderkey") % 2 == 0, "+2ac").otherwise("-11ACGTACGTACG"), F.lit(",.$"), F.when(F.col("o_orderkey") % 3 == 0, "*").otherwise(">"))
    return table(spark, d, "orders").select("o_orderkey", fn.pileup_tokens(b).alias("tokens"), fn.pileup_indels(b).alias("indels"))


@query(None)
def phased_clusters(spark, d):
    """Flagship: one row for each cluster of the reads of eligible unitigs, with extent, depth, the unitig's SNPs and the cluster's consensus at them."""
    return by_parts(spark, d, lambda part: (_phased(spark, d, part),))[0]


def _phased(spark, d, part):
    from haploom.operators.clustering import phase

    key = ["unitig", "cluster"]
    every = alignments(spark, d, part)
    chosen = coverage.eligible(coverage.depth(every, unitigs(spark, d)), C.min_depth, C.max_depth, C.min_length).select("unitig")
    mine = every.join(chosen, "unitig", "left_semi")
    kept = coverage.accepted(mine, C)
    sites = alleles.strand_supported(observations(mine.where(F.col("mapq") >= C.min_mapq)), C.allele_frequency, C.min_alt).select("unitig", "pos", "ref")
    with dealt_once(spark):
        seen = stored(observations(kept).join(sites, ["unitig", "pos"]).select("unitig", "read_id", "pos", "base", "ref"))
        rows = kept.select("unitig", "read_id", "s", "e", "length")
        found = stored(phase(rows, seen, C).where("cluster IS NOT NULL").join(rows, ["unitig", "read_id"]))
        stats = alleles.extent(found, key).where(F.col("n_reads") >= C.min_final_size)
        votes = seen.join(found.select(*key, "read_id"), ["unitig", "read_id"])
        clear = alleles.consensus(votes, key, C.allele_frequency, C.split_allele_frequency, C.min_alt).where("base IS NOT NULL")
        bases = F.sort_array(F.collect_list(F.struct("pos", "base")))
        shown = clear.groupBy(*key).agg(F.array_join(F.transform(bases, lambda x: F.concat(x["pos"].cast("string"), x["base"])), ",").alias("consensus"))
        n_snp = sites.groupBy("unitig").agg(F.count(F.lit(1)).alias("n_snp"))
        out = stored(stats.join(n_snp, "unitig", "left").join(shown, key, "left"))
    delete(seen)
    delete(found)
    del every, mine, kept, sites, seen, rows, found, stats, votes, clear, shown, n_snp
    release(spark)
    return out


@query(None)
def recursive_clusters(spark, d):
    from haploom.operators.clustering import phase

    aln = alignments(spark, d)
    obs = observations(aln)
    seen = obs.join(_snps(obs).select("unitig", "pos", "ref"), ["unitig", "pos"]).select("unitig", "read_id", "pos", "base", "ref")
    return phase(aln.select("unitig", "read_id", "s", "e", "length"), seen, C)


@query(ORACLES["edit_distance"])
def alignment_path(spark, d):
    from haploom.functions.align import alignment_udf

    p = table(spark, d, "part")
    a, b = (p.select("p_brand", "p_size", "p_type", F.col("p_partkey").alias(x), F.col("p_name").alias(f"{x}_name")) for x in "ab")
    pairs = a.join(b, ["p_brand", "p_size", "p_type"]).where("a < b")
    track = alignment_udf()("a_name", "b_name")["track"]
    return pairs.select("a", "b", (F.length(track) - F.length(F.replace(track, F.lit("|"), F.lit("")))).alias("same"), F.length(track).alias("n")).select("a", "b", (F.col("n") - F.col("same")).alias("dist"))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def unitig_adjacency(spark, d):
    return graphs.symmetric(links(spark, d))


@query(f"WITH {_EDGES} SELECT dst AS node FROM edges WHERE src%3=1 AND dst%3=1 UNION SELECT src FROM edges WHERE src%3=0 AND dst%3=0")
def root_leaf_prune(spark, d):
    e = links(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return haplotypes.subnodes(e, nodes.where("node % 3 = 0"), nodes.where("node % 3 = 1"))


_WALK = ORACLES["full_paths"].rpartition("SELECT src, dst, array_to_string")[0]


def _paths(spark, d):
    e = links(spark, d)
    src, dst = e.select(F.col("src").alias("node")).distinct(), e.select(F.col("dst").alias("node")).distinct()
    return graphs.full_paths(e, src.join(dst, "node", "left_anti"), dst.join(src, "node", "left_anti"), 5)


@query(_WALK + "SELECT DISTINCT path[i] AS src, path[i+1] AS dst, CAST(1 AS INTEGER) AS weight FROM (SELECT path, unnest(range(1,len(path))) AS i FROM w WHERE dst IN (SELECT dst FROM leafs))")
def path_links(spark, d):
    return haplotypes.path_links(_paths(spark, d))


@query(_WALK + "SELECT node, bool_or(src_) AS is_src, bool_or(NOT src_) AS is_sink FROM (SELECT src AS node, true AS src_ FROM w WHERE dst IN (SELECT dst FROM leafs) UNION ALL SELECT dst, false FROM w WHERE dst IN (SELECT dst FROM leafs)) GROUP BY node")
def endpoints(spark, d):
    ends = _paths(spark, d).select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("s")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("s")))))
    return ends.groupBy("node").agg(F.bool_or("s").alias("is_src"), F.bool_or(~F.col("s")).alias("is_sink"))


@query(f"WITH {_ALN} SELECT a.unitig AS from_unitig, a.hap AS from_cluster, b.unitig AS to_unitig, b.hap AS to_cluster, count(*) AS weight FROM aln a JOIN aln b ON a.read_id=b.read_id AND a.unitig<b.unitig WHERE (a.length-a.e<500 OR a.s<500) AND (b.length-b.e<500 OR b.s<500) GROUP BY ALL")
def cluster_links(spark, d):
    tips = alignments(spark, d).where("length - e < 500 OR s < 500").select("read_id", "unitig", "hap")
    a, b = (tips.select("read_id", F.col("unitig").alias(f"{x}_unitig"), F.col("hap").alias(f"{x}_cluster")) for x in ("from", "to"))
    return a.join(b, "read_id").where("from_unitig < to_unitig").groupBy("from_unitig", "from_cluster", "to_unitig", "to_cluster").agg(F.count(F.lit(1)).alias("weight"))


@query(f"""WITH {_CL}, x AS (SELECT unitig, cluster, first, last FROM ext WHERE n_reads>1 AND last>first), p AS (SELECT unitig, length, substr(repeat('ACGTTGCAGGTC', 1000), 1, CAST(length AS INTEGER)) AS seq FROM unitigs)
SELECT x.unitig, x.cluster, md5(concat(substr(seq, 1, CAST(first AS INTEGER)), reverse(substr(seq, CAST(first+1 AS INTEGER), CAST(last-first AS INTEGER))))) AS child FROM x JOIN p ON x.unitig=p.unitig""")
def child_segments(spark, d):
    ext = alleles.extent(_clusters(spark, d), ["unitig", "cluster"]).where("n_reads > 1 AND last > first")
    seq = F.substring(F.repeat(F.lit("ACGTTGCAGGTC"), F.lit(1000)), F.lit(1), F.col("length").cast("int"))
    # sequences are made after the join: by their size nobody could tell that they are too long to be broadcast
    rows = ext.join(unitigs(spark, d).select("unitig", "length"), "unitig").withColumn("seq", seq)
    first, n = F.col("first").cast("int"), (F.col("last") - F.col("first")).cast("int")
    return rows.select("unitig", "cluster", F.md5(F.concat(F.substring("seq", F.lit(1), first), F.reverse(F.substring("seq", first + 1, n)))).alias("child"))
