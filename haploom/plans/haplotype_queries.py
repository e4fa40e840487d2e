"""Queries for the operators that make a graph of clusters, over the projected tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.functions import sequence as fn
from haploom.operators import alleles, coverage, distances, haplotypes, pileup
from haploom.plans.checkpoints import cut, dealt_once, release
from haploom.plans.projection import WHOLE, Part, alignments, by_parts, links, table, unitigs
from haploom.plans.queries import _CHAIN, _CL, _UNITIGS, C, ORACLES, _clusters, _consensus, query

#: Two clusters of a unitig are neighbours up to this distance; the projected haplotypes are never alike.
NEAR = 0.002

_NODE = "unitig*10+cluster"
_ROLES = f"""roles AS (SELECT unitig, cluster, {_NODE} AS node, length, n=1 AS single, n>1 AND spans AND ls AND rs AS "full", CASE WHEN n=1 THEN spans ELSE first<500 AND ls END AS root, CASE WHEN n=1 THEN spans ELSE last>length-500 AND rs END AS leaf,
 first+CASE WHEN n>1 AND spans AND NOT ls THEN 501 ELSE 0 END AS first, last-CASE WHEN n>1 AND spans AND ls AND NOT rs THEN 501 ELSE 0 END AS last
 FROM (SELECT ext.*, length, ls, rs, first<500 AND last>length-500 AS spans, count(*) OVER (PARTITION BY ext.unitig) AS n FROM (SELECT * FROM ext WHERE n_reads>1 AND last>first) ext JOIN (SELECT unitig, cluster, max(length) AS length, count(*) FILTER (s<500)>2 AS ls, count(*) FILTER (e>length-500)>2 AS rs FROM cl GROUP BY ALL) t ON ext.unitig=t.unitig AND ext.cluster=t.cluster))"""
_DIST = f"cd AS ({ORACLES['cluster_distance']})"
_GRAPH = f"""{_ROLES}, {_DIST}, ov AS (SELECT x.node AS src, y.node AS dst FROM cd JOIN roles x ON cd.unitig=x.unitig AND cd.a=x.cluster JOIN roles y ON cd.unitig=y.unitig AND cd.b=y.cluster WHERE cd.d<={NEAR}),
apart AS (SELECT src, dst FROM ov JOIN roles x ON src=x.node JOIN roles y ON dst=y.node WHERE NOT (x.first<y.first AND x.last>y.last) AND NOT (y.first<x.first AND y.last>x.last)),
gone AS (SELECT dst AS node FROM apart JOIN roles x ON src=x.node JOIN roles y ON dst=y.node WHERE x.leaf AND y.leaf UNION SELECT src FROM apart JOIN roles x ON src=x.node JOIN roles y ON dst=y.node WHERE x.root AND y.root),
kept AS (SELECT src, dst FROM apart WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)),
og AS (SELECT src, dst FROM kept EXCEPT SELECT a.src, a.dst FROM kept a JOIN kept b ON a.dst=b.src JOIN kept c ON c.src=a.src AND c.dst=b.dst)"""
#: Paths of at most four clusters, a unitig's number of haplotypes.
_PATHS = f"""{_GRAPH}, alive AS (SELECT * FROM roles WHERE node NOT IN (SELECT node FROM gone)),
walk(path) AS (SELECT [src,dst] FROM og JOIN alive ON src=node WHERE root UNION SELECT list_append(path,dst) FROM walk JOIN og ON path[-1]=src WHERE NOT list_contains(path,dst)),
bad AS (SELECT DISTINCT path FROM (SELECT path, unnest(range(1,len(path)+1)) AS i FROM walk) JOIN roles ON node=path[i] WHERE "full" OR leaf AND i<len(path)),
paths AS (SELECT path FROM walk ANTI JOIN bad USING (path) WHERE path[-1] IN (SELECT node FROM alive WHERE leaf))"""


def _nodes(spark: SparkSession, d: str, part: Part = WHOLE) -> DataFrame:
    cl, key = _clusters(spark, d, part), ["unitig", "cluster"]
    ext = alleles.extent(cl, key).where("n_reads > 1 AND last > first")
    tails = coverage.strong_tails(cl, key, C.end_gap, C.tip_reads).drop("spans")
    at = ext.join(tails, key).join(unitigs(spark, d).select("unitig", "length"), "unitig")
    with dealt_once(spark):
        return cut(haplotypes.roles(at, C.end_gap).withColumn("node", F.col("unitig") * 10 + F.col("cluster")))


def _edges(spark: SparkSession, d: str, nodes: DataFrame, part: Part) -> DataFrame:
    ext = alleles.extent(_clusters(spark, d, part), ["unitig", "cluster"]).where("n_reads > 1")
    cons = _consensus(spark, d, part).where("alt_flag").select("unitig", "cluster", "pos", "base")
    near = distances.cluster_distances(ext, cons, C.min_overlap).where(F.col("d") <= NEAR)
    known = nodes.select("node")
    e = near.select((F.col("unitig") * 10 + F.col("a")).alias("src"), (F.col("unitig") * 10 + F.col("b")).alias("dst"))
    release(spark)
    with dealt_once(spark):
        e = cut(e)  # few are near; the tables that they come from aren't needed any more
    del ext, cons, near
    release(spark)
    return cut(e.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi"))


def _overlap_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes left, all nodes)."""

    def made(part: Part) -> tuple[DataFrame, DataFrame, DataFrame]:
        nodes = _nodes(spark, d, part)
        return *haplotypes.overlap_graph(_edges(spark, d, nodes, part), nodes), nodes

    return by_parts(spark, d, made)


@query(f'WITH {_CL}, {_ROLES} SELECT unitig, cluster, first, last, single, "full", root, leaf FROM roles')
def cluster_roles(spark, d):
    return _nodes(spark, d).select("unitig", "cluster", "first", "last", "single", "full", "root", "leaf")


@query(f"WITH {_CL}, x AS (SELECT ext.unitig, ext.cluster, bases/nullif(last-first,0) AS cov FROM ext WHERE n_reads>1), m AS (SELECT unitig, sum(e-s)/max(length) AS mean FROM cl GROUP BY unitig) SELECT x.unitig, x.cluster FROM x JOIN m ON x.unitig=m.unitig WHERE coalesce(round(cov,6),0)>=mean*0.4")
def covered_clusters(spark, d):
    cl = _clusters(spark, d)
    ext = alleles.extent(cl, ["unitig", "cluster"]).where("n_reads > 1")
    mean = cl.groupBy("unitig").agg((F.sum(F.col("e") - F.col("s")) / F.max("length")).alias("mean"))
    return haplotypes.covered_enough(ext, mean, 0.4).select("unitig", "cluster")


@query(f"WITH {_CL} SELECT unitig, cluster, coalesce(list_sort(list(s))[3], min(s)) AS first, coalesce(list_reverse_sort(list(e))[3], max(e)) AS last FROM cl GROUP BY unitig, cluster")
def trimmed_ends(spark, d):
    return haplotypes.trimmed_ends(_clusters(spark, d), ["unitig", "cluster"], 3)


@query(f"WITH {_CL}, {_GRAPH} SELECT src, dst FROM og")
def overlap_graph(spark, d):
    return _overlap_graph(spark, d)[0]


@query(f"WITH RECURSIVE {_CL}, {_PATHS} SELECT array_to_string(path,'>') AS path FROM paths")
def usable_paths(spark, d):
    graph, left, _ = _overlap_graph(spark, d)
    return haplotypes.usable_paths(graph, left, 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(
    f"""WITH RECURSIVE {_CL}, {_PATHS}, st AS (SELECT DISTINCT path[i] AS src, path[i+1] AS dst FROM (SELECT path, unnest(range(1,len(path))) AS i FROM paths)),
je AS (SELECT src*2+1 AS a, dst*2 AS b FROM st UNION SELECT dst*2, src*2+1 FROM st), reach(a,b) AS (SELECT a,a FROM je UNION SELECT reach.a, je.b FROM reach JOIN je ON reach.b=je.a), comp AS (SELECT a, min(b) AS j FROM reach GROUP BY a),
bd AS (SELECT j, max(first) FILTER (a%2=0)+CAST(floor((min(last) FILTER (a%2=1)-max(first) FILTER (a%2=0))/2) AS BIGINT) AS border FROM comp JOIN roles ON a//2=node GROUP BY j),
own AS (SELECT a//2 AS node, max(border) FILTER (a%2=0) AS l, max(border) FILTER (a%2=1) AS r FROM comp JOIN bd USING (j) GROUP BY 1)
SELECT roles.node, coalesce(l, CASE WHEN root THEN first END) AS "left", coalesce(r, CASE WHEN leaf THEN length-1 END) AS "right" FROM own JOIN roles ON own.node=roles.node"""
)
def path_boundaries(spark, d):
    graph, left, nodes = _overlap_graph(spark, d)
    return haplotypes.boundaries(haplotypes.usable_paths(graph, left, 3), nodes)


_READ = """r AS (SELECT o_orderkey AS read_id, o_custkey%500 AS s, CAST(o_orderkey%5+1 AS BIGINT) AS c, CAST(o_orderkey%11+5 AS BIGINT) AS m, CAST(o_orderkey%3+1 AS BIGINT) AS i, CAST(o_orderkey%7+2 AS BIGINT) AS m2, CAST(o_orderkey%4+1 AS BIGINT) AS dl, CAST(o_orderkey%9+3 AS BIGINT) AS m3 FROM orders),
q AS (SELECT *, substr(repeat('ACGTTGCAGGTC',5), 1, CAST(c+m+i+m2+m3 AS INTEGER)) AS seq FROM r)"""


def _reads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c, m, i, m2, dl, m3 = k % 5 + 1, k % 11 + 5, k % 3 + 1, k % 7 + 2, k % 4 + 1, k % 9 + 3
    cigar = F.concat(*[x for n, op in ((c, "S"), (m, "M"), (i, "I"), (m2, "="), (dl, "D"), (m3, "M")) for x in (n.cast("string"), F.lit(op))])
    seq = F.substring(F.repeat(F.lit("ACGTTGCAGGTC"), F.lit(5)), F.lit(1), (c + m + i + m2 + m3).cast("int"))
    return table(spark, d, "orders").select(F.lit(0).cast("long").alias("unitig"), k.alias("read_id"), (F.col("o_custkey") % 500).alias("s"), (k % 2 == 1).alias("rev"), cigar.alias("cigar"), seq.alias("seq"))


@query(f"""WITH {_READ}, p AS (SELECT q.*, pos FROM q, (SELECT unnest(range(0,700,20)) AS pos) WHERE pos>=s AND pos<s+m+m2+dl+m3)
SELECT read_id, pos, CASE WHEN pos<s+m THEN substr(seq,CAST(c+pos-s+1 AS INTEGER),1) WHEN pos<s+m+m2 THEN substr(seq,CAST(c+i+pos-s+1 AS INTEGER),1) ELSE substr(seq,CAST(c+i+pos-s-dl+1 AS INTEGER),1) END AS base FROM p WHERE NOT (pos>=s+m+m2 AND pos<s+m+m2+dl)""")
def bases_at(spark, d):
    points = spark.range(0, 700, 20).select(F.lit(0).cast("long").alias("unitig"), F.col("id").alias("pos"))
    return pileup.bases_at(_reads(spark, d), points).select("read_id", "pos", "base")


@query(f"WITH {_READ} SELECT base, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(concat(substr(seq,CAST(c+1 AS INTEGER),CAST(m AS INTEGER)),substr(seq,CAST(c+m+i+1 AS INTEGER),CAST(m2+m3 AS INTEGER))),'')) AS base FROM q) GROUP BY base")
def aligned_bases(spark, d):
    return pileup.all_bases(_reads(spark, d)).groupBy("base").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_UNITIGS}, p AS (SELECT unitig, length, substr(repeat('ACGTTGCAGGTC', 1000), 1, CAST(length AS INTEGER)) AS parent FROM unitigs), x AS (SELECT *, 500+unitig%300 AS st, length-400-unitig%200 AS en FROM p),
y AS (SELECT *, concat(substr(parent,CAST(st+1 AS INTEGER),CAST(100 AS INTEGER)),'A',substr(parent,CAST(st+102 AS INTEGER),CAST(en-st-101 AS INTEGER))) AS cons FROM x)
SELECT unitig, md5(concat(substr(parent,101,CAST(st-100 AS INTEGER)),cons)) AS filled, md5(substr(cons,101)) AS cut_off FROM y""")
def child_sequences(spark, d):
    parent = F.substring(F.repeat(F.lit("ACGTTGCAGGTC"), F.lit(1000)), F.lit(1), F.col("length").cast("int"))
    rows = unitigs(spark, d).select("unitig", parent.alias("parent"), (500 + F.col("unitig") % 300).alias("st"), (F.col("length") - 400 - F.col("unitig") % 200).alias("en"))
    changes = F.array(F.struct((F.col("st") + 100).alias("pos"), F.lit("A").alias("base")))
    rows = rows.withColumn("cons", fn.patched(F.col("parent"), F.col("st"), F.col("en"), changes))
    child = lambda left, fill: F.md5(fn.child_sequence(F.col("parent"), F.col("cons"), F.col("st"), F.col("en"), left, F.col("en"), F.lit(fill)))
    return rows.select("unitig", child(F.lit(100).cast("long"), True).alias("filled"), child(F.col("st") + 100, False).alias("cut_off"))


@query(f"""WITH {_UNITIGS}, n AS (SELECT unitig, CAST(ceil(length/2500) AS BIGINT) AS n FROM unitigs), l AS (SELECT unitig AS a, CASE WHEN unitig%3=0 THEN '+' ELSE '-' END AS ao, (unitig*7)%2000 AS b, CASE WHEN unitig%2=0 THEN '+' ELSE '-' END AS bo FROM unitigs WHERE unitig<2000)
SELECT CASE WHEN na.n>1 THEN concat(a,'_s',CASE WHEN ao='+' THEN na.n ELSE 1 END) ELSE CAST(a AS VARCHAR) END AS from_seg, ao AS from_orient, CASE WHEN nb.n>1 THEN concat(b,'_s',CASE WHEN bo='-' THEN nb.n ELSE 1 END) WHEN nb.n IS NULL THEN CAST(b AS VARCHAR) ELSE CAST(b AS VARCHAR) END AS to_seg, bo AS to_orient FROM l LEFT JOIN n na ON a=na.unitig LEFT JOIN n nb ON b=nb.unitig
UNION SELECT concat(unitig,'_s',k), '+', concat(unitig,'_s',k+1), '+' FROM (SELECT unitig, unnest(range(1,n)) AS k FROM n)""")
def split_links(spark, d):
    u = unitigs(spark, d)
    name = F.col("unitig").cast("string")
    pieces = coverage.split_long(u, 2500).select(name.alias("unitig"), "piece")
    counted = pieces.join(pieces.groupBy("unitig").agg(F.count(F.lit(1)).alias("n")), "unitig")
    sign = lambda k: F.when(F.col("unitig") % k == 0, "+").otherwise("-")
    edges = u.where("unitig < 2000").select(name.alias("from_seg"), sign(3).alias("from_orient"), (F.col("unitig") * 7 % 2000).cast("string").alias("to_seg"), sign(2).alias("to_orient"))
    return haplotypes.split_links(edges, counted)


@query(f"""WITH RECURSIVE {_CHAIN}, s AS (SELECT src AS n FROM ce UNION SELECT dst FROM ce), c AS (SELECT *, count(*) OVER (PARTITION BY src) AS o, count(*) OVER (PARTITION BY dst) AS i FROM ce), k AS (SELECT src,dst FROM c WHERE o=1 AND i=1),
w(head,node,place) AS (SELECT n,n,0 FROM s WHERE n NOT IN (SELECT dst FROM k) UNION ALL SELECT w.head,k.dst,place+1 FROM w JOIN k ON w.node=k.src)
SELECT string_agg(CAST(node AS VARCHAR),'_' ORDER BY place) AS unitig, string_agg(substr('ACGTTGCAGGTC',CAST(1+node%6 AS INTEGER),4),'' ORDER BY place) AS seq FROM w GROUP BY head""")
def merged_segments(spark, d):
    from haploom.plans.queries import _chain_edges

    e = _chain_edges(spark, d)
    nodes = e.select("src").union(e.select("dst")).distinct()
    name = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")  # noqa: E731  equal widths, so that names are in order
    segments = nodes.select(name("src").alias("unitig"), F.substring(F.lit("ACGTTGCAGGTC"), (1 + F.col("src") % 6).cast("int"), F.lit(4)).alias("seq"), F.lit(1).alias("dp"))
    edges = e.select(name("src").alias("from_seg"), F.lit("+").alias("from_orient"), name("dst").alias("to_seg"), F.lit("+").alias("to_orient"))
    whole = haplotypes.merged_segments(segments, edges)[0]
    short = F.array_join(F.transform(F.split("unitig", "_"), lambda x: x.cast("long").cast("string")), "_")
    return whole.select(short.alias("unitig"), "seq")


_CLIPS = """pr AS (SELECT l_orderkey*8+l_linenumber AS read_id, l_suppkey%20 AS unitig, (l_partkey*3)%20 AS nxt, CASE WHEN l_quantity<25 THEN 'L' ELSE 'R' END AS side, CASE WHEN l_discount<0.05 THEN '+' ELSE '-' END AS strand FROM lineitem),
cp AS (SELECT DISTINCT read_id, unitig, nxt, side, strand FROM pr WHERE unitig<>nxt), cs AS (SELECT DISTINCT unitig, read_id, read_id%3 AS cluster FROM (SELECT unitig, read_id FROM pr UNION SELECT nxt, read_id FROM pr)),
sg AS (SELECT unitig, cluster, cluster<>1 AS is_src, cluster<>0 AS is_sink FROM (SELECT DISTINCT unitig, cluster FROM cs) WHERE unitig%4<>3), rm AS (SELECT DISTINCT unitig FROM sg WHERE unitig%4<>2)"""


@query(f"""WITH {_CLIPS}, ow AS (SELECT cp.*, cs.cluster, CASE WHEN side='L' THEN 1 ELSE 0 END AS late FROM cp JOIN cs ON cp.unitig=cs.unitig AND cp.read_id=cs.read_id JOIN sg ON sg.unitig=cp.unitig AND sg.cluster=cs.cluster),
os AS (SELECT unitig, cluster, nxt, arg_max(side,(read_id,late,strand)) AS side, arg_max(strand,(read_id,late,strand)) AS strand FROM ow GROUP BY ALL),
o1 AS (SELECT unitig, cluster, read_id, arg_max(nxt,(late,nxt)) AS nxt FROM ow GROUP BY ALL), ct AS (SELECT unitig, cluster, nxt FROM o1 GROUP BY ALL HAVING count(*)>=3),
lk AS (SELECT ct.*, CASE WHEN side='R' THEN '+' ELSE '-' END AS fo, CASE WHEN side='R' THEN strand WHEN strand='+' THEN '-' ELSE '+' END AS "to" FROM ct JOIN os USING (unitig,cluster,nxt)),
sh AS (SELECT o1.unitig, o1.cluster, o1.nxt, cs.cluster AS tc, count(*) AS w FROM o1 JOIN ct USING (unitig,cluster,nxt) JOIN cs ON cs.unitig=o1.nxt AND cs.read_id=o1.read_id GROUP BY ALL HAVING count(*)>=3),
di AS (SELECT lk.*, tc, w FROM sh JOIN lk USING (unitig,cluster,nxt) JOIN sg ON sg.unitig=sh.nxt AND sg.cluster=tc), rs AS (SELECT lk.*, is_src, is_sink, EXISTS (SELECT 1 FROM cs WHERE cs.unitig=lk.nxt) AS known, lk.nxt IN (SELECT unitig FROM rm) AS gone FROM lk ANTI JOIN di USING (unitig,cluster,nxt) JOIN sg USING (unitig,cluster))
SELECT unitig AS from_unitig, cluster AS from_cluster, fo AS from_orient, nxt AS to_unitig, tc AS to_cluster, "to" AS to_orient, CAST(w AS INTEGER) AS weight FROM di
UNION ALL SELECT unitig, cluster, fo, nxt, NULL, "to", CASE WHEN known THEN 666 ELSE 555 END FROM rs WHERE NOT known OR NOT gone
UNION ALL SELECT rs.unitig, rs.cluster, fo, nxt, t.cluster, "to", 666 FROM rs JOIN sg t ON t.unitig=nxt WHERE known AND gone AND CASE WHEN CASE WHEN rs.is_src AND rs.is_sink THEN "to"='+' ELSE rs.is_sink END THEN t.is_src ELSE t.is_sink END""")
def linked_clusters(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read_id"), (F.col("l_suppkey") % 20).alias("unitig"), (F.col("l_partkey") * 3 % 20).alias("next"), F.when(F.col("l_quantity") < 25, "L").otherwise("R").alias("side"), F.when(F.col("l_discount") < 0.05, "+").otherwise("-").alias("strand"))
    clips = rows.where("unitig <> next").distinct()
    clusters = rows.select("unitig", "read_id").union(rows.select("next", "read_id")).distinct().withColumn("cluster", F.col("read_id") % 3)
    made = clusters.select("unitig", "cluster").distinct().where("unitig % 4 <> 3").select("unitig", "cluster", (F.col("cluster") != 1).alias("is_src"), (F.col("cluster") != 0).alias("is_sink"))
    return haplotypes.linked_clusters(clips, clusters, made, clips.select("unitig", "next"), made.where("unitig % 4 <> 2").select("unitig"))


_PARENT = "lk AS (SELECT CAST(src AS VARCHAR) AS f, CASE WHEN weight%2=0 THEN '+' ELSE '-' END AS fo, CAST(dst AS VARCHAR) AS t, CASE WHEN (src+dst)%2=0 THEN '+' ELSE '-' END AS t_o FROM edges), rm AS (SELECT DISTINCT CAST(dst AS VARCHAR) AS u, dst FROM edges WHERE dst%3=0), sg AS (SELECT concat(u,'_',k) AS seg, u, k<>1 AS is_src, k<>0 AS is_sink FROM rm, (SELECT unnest([0,1,2]) AS k)), md AS (SELECT concat(u,'_0') AS f, '+' AS fo, concat(u,'_2') AS t, '-' AS t_o FROM rm WHERE dst%2=0), ends AS (SELECT f AS seg, CASE WHEN fo='+' THEN 'R' ELSE 'L' END AS side FROM md UNION SELECT t, CASE WHEN t_o='+' THEN 'L' ELSE 'R' END FROM md)"


@query(f"""WITH {ORACLES['drop_removed_links'].split('WITH ', 1)[1].rsplit(' SELECT src, dst, weight FROM edges', 1)[0]}, {_PARENT}
SELECT f AS from_seg, fo AS from_orient, seg AS to_seg, t_o AS to_orient, 888 AS ex FROM lk JOIN sg ON lk.t=sg.u WHERE f NOT IN (SELECT u FROM rm) AND CASE WHEN t_o='+' THEN is_src ELSE is_sink END AND (seg, CASE WHEN t_o='+' THEN 'L' ELSE 'R' END) NOT IN (SELECT (seg, side) FROM ends)
UNION SELECT seg, fo, t, t_o, 888 FROM lk JOIN sg ON lk.f=sg.u WHERE t NOT IN (SELECT u FROM rm) AND CASE WHEN fo='+' THEN is_sink ELSE is_src END AND (seg, CASE WHEN fo='+' THEN 'R' ELSE 'L' END) NOT IN (SELECT (seg, side) FROM ends)""")
def parental_segment_links(spark, d):
    e = links(spark, d)
    sign = lambda c: F.when(c % 2 == 0, "+").otherwise("-")
    old = e.select(F.col("src").cast("string").alias("from_seg"), sign(F.col("weight")).alias("from_orient"), F.col("dst").cast("string").alias("to_seg"), sign(F.col("src") + F.col("dst")).alias("to_orient"))
    gone = e.where("dst % 3 = 0").select("dst", F.col("dst").cast("string").alias("unitig")).distinct()
    seg = lambda k: F.concat("unitig", F.lit(f"_{k}"))
    segments = gone.select("unitig", F.explode(F.array(*[F.struct(seg(k).alias("seg"), F.lit(k != 1).alias("is_src"), F.lit(k != 0).alias("is_sink")) for k in range(3)])).alias("x")).select("unitig", "x.*")
    made = gone.where("dst % 2 = 0").select(seg(0).alias("from_seg"), F.lit("+").alias("from_orient"), seg(2).alias("to_seg"), F.lit("-").alias("to_orient"))
    return haplotypes.parental_links(old, segments, gone, made)


@query("""WITH p AS (SELECT o_orderkey AS k, o_orderkey%3 AS kind FROM orders)
SELECT concat('u',k%50) AS CHROM, k AS POS, CASE kind WHEN 0 THEN 'C' WHEN 1 THEN 'C' ELSE 'CGT' END AS REF, CASE kind WHEN 0 THEN 'A,T' WHEN 1 THEN 'CACGTACGTACG' ELSE 'C' END AS ALT, CAST(30+k%5 AS INTEGER) AS QUAL, 'PASS' AS FILTER, CASE kind WHEN 0 THEN 'ALT_HAP=r2,r4;REF_HAP=r1,r3' WHEN 1 THEN 'ALT_HAP=r1;REF_HAP=r2,r3,r4' ELSE 'ALT_HAP=r3;REF_HAP=r1,r2,r4' END AS INFO, 'GT:DV:DP' AS FORMAT, CASE kind WHEN 0 THEN '0/1:2:4' ELSE '0/1:1:4' END AS sample FROM p""")
def pileup_variants(spark, d):
    k = F.col("o_orderkey")
    bases = F.when(k % 3 == 0, ".a^].T$").when(k % 3 == 1, ".+11ACGTACGTACG,.*").otherwise(".,.-2gt$,")
    bases = F.when(k % 3 == 2, ".,.-2GT$,").otherwise(bases)
    low, high = F.char(63 + k % 5 - 4), F.char(63 + k % 5 + 4)
    mid = F.char(63 + k % 5)
    rows = table(spark, d, "orders").select(F.concat(F.lit("u"), (k % 50).cast("string")).alias("unitig"), k.alias("pos"), F.lit("C").alias("ref"), bases.alias("bases"), F.concat(high, mid, low, mid).alias("mapqs"), F.lit("r1,r2,r3,r4").alias("names"))
    return pileup.variants(rows).drop("ID")


@query(f"WITH {_CL}, k AS (SELECT unitig, cluster, dense_rank() OVER (PARTITION BY unitig ORDER BY cluster) AS r, count(*) OVER (PARTITION BY unitig) AS n FROM (SELECT DISTINCT unitig, cluster FROM cl)) SELECT unitig, cluster, CASE WHEN r=1 THEN '#440154' WHEN r=n THEN '#fde725' WHEN n=3 THEN '#21908d' END AS colour FROM k WHERE n<4")
def cluster_colours(spark, d):
    from pyspark.sql.window import Window

    u = Window.partitionBy("unitig")
    ranked = _clusters(spark, d).select("unitig", "cluster").distinct().select("unitig", "cluster", F.dense_rank().over(u.orderBy("cluster")).alias("r"), F.count(F.lit(1)).over(u).alias("n"))
    return ranked.where("n < 4").select("unitig", "cluster", fn.colour(F.col("r"), F.col("n")).alias("colour"))
