"""From clusters of reads to segments and links of the phased graph.

A node is a cluster's name (or number) that is unique over all unitigs; tables
of nodes carry their unitig where one is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploom.functions import sequence as fn
from haploom.operators import graphs
from haploom.operators.components import components
from haploom.plans.checkpoints import cut

#: Weights that tell why a link was made.
NO_CLUSTERS, FALLBACK, PARENTAL = 555, 666, 888


def covered_enough(clusters: DataFrame, depths: DataFrame, fraction: float) -> DataFrame:
    """Clusters (with unitig and cov) whose coverage is at least ``fraction`` of their unitig's mean (unitig, mean)."""
    return clusters.join(depths.select("unitig", "mean"), "unitig").where(F.coalesce("cov", F.lit(0)) >= F.col("mean") * fraction).drop("mean")


def trimmed_ends(reads: DataFrame, key: list[str], k: int) -> DataFrame:
    """key, first, last: the k-th smallest start and k-th largest end; the outermost ones of a key with fewer reads."""
    sums = reads.groupBy(*key).agg(F.sort_array(F.collect_list("s")).alias("s"), F.sort_array(F.collect_list("e"), False).alias("e"))
    at = lambda c: F.coalesce(F.get(c, F.lit(k - 1)), F.get(c, F.lit(0)))
    return sums.select(*key, at("s").alias("first"), at("e").alias("last"))


def roles(clusters: DataFrame, gap: int) -> DataFrame:
    """``clusters`` with full, root, leaf and single, and with first and last moved inwards where a spanning cluster has a weak tail.

    ``clusters`` has unitig, first, last, length, left_strong, right_strong, one
    row a cluster. Of several clusters of a unitig those that reach both ends
    with strong tails are full; a strong left (right) tail near the end makes a
    root (leaf), full ones included. The only cluster of a unitig is root and leaf if it reaches both ends.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("unitig"))
    at_left, at_right = F.col("first") < gap, F.col("last") > F.col("length") - gap
    spans, left, right = at_left & at_right, F.col("left_strong"), F.col("right_strong")
    single = F.col("_n") == 1
    marked = clusters.withColumn("_n", n).withColumns(
        {
            "single": single,
            "full": ~single & spans & left & right,
            "root": F.when(single, spans).otherwise(at_left & left),
            "leaf": F.when(single, spans).otherwise(at_right & right),
            "_l": F.when(~single & spans & ~left, gap + 1).otherwise(0),
            "_r": F.when(~single & spans & left & ~right, gap + 1).otherwise(0),
        }
    )
    return marked.withColumn("first", F.col("first") + F.col("_l")).withColumn("last", F.col("last") - F.col("_r")).drop("_n", "_l", "_r")


def without_nested(edges: DataFrame, extents: DataFrame) -> DataFrame:
    """Edges (src, dst) between nodes neither of which lies strictly inside the other; ``extents`` has node, first, last."""
    x, y = (extents.select(F.col("node").alias(k), F.col("first").alias(f"_{k}f"), F.col("last").alias(f"_{k}l")) for k in ("src", "dst"))
    inside = lambda a, b: (F.col(f"_{a}f") < F.col(f"_{b}f")) & (F.col(f"_{a}l") > F.col(f"_{b}l"))
    return edges.join(x, "src").join(y, "dst").where(~inside("src", "dst") & ~inside("dst", "src")).select(edges.columns)


def subnodes(edges: DataFrame, roots: DataFrame, leafs: DataFrame) -> DataFrame:
    """node: leafs that follow a leaf and roots that a root follows."""
    ends = lambda df, k: df.select(F.col("node").alias(k)).distinct()
    late = edges.join(ends(leafs, "src"), "src", "left_semi").join(ends(leafs, "dst"), "dst", "left_semi").select(F.col("dst").alias("node"))
    early = edges.join(ends(roots, "src"), "src", "left_semi").join(ends(roots, "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return late.union(early).distinct()


def overlap_graph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) without nested pairs, sub-nodes and first edges of two-step detours.

    ``edges`` has src and dst in order of position, ``nodes`` node, first, last, root and leaf.
    """
    apart = cut(without_nested(edges.where("src <> dst").select("src", "dst").distinct(), nodes))
    gone = cut(subnodes(apart, nodes.where("root"), nodes.where("leaf")))
    left = cut(graphs.without_segments(apart, gone).select("src", "dst"))
    detours = graphs.transitive(left, 2, first_hop=True)
    return cut(left.join(detours, ["src", "dst"], "left_anti")), cut(nodes.join(gone, "node", "left_anti"))


def usable_paths(edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """path: simple paths from a root to a leaf that pass no full cluster and no leaf before their end."""
    found = graphs.full_paths(edges, nodes.where("root").select("node"), nodes.where("leaf").select("node"), hops).select("path")
    found = cut(found.distinct())
    inner = found.select("path", F.posexplode("path").alias("at", "node")).join(nodes.select("node", "full", "leaf"), "node")
    bad = inner.where(F.col("full") | F.col("leaf") & (F.col("at") < F.size("path") - 1)).select("path").distinct()
    return cut(found.join(bad, "path", "left_anti"))


def _steps(paths: DataFrame) -> DataFrame:
    """src, dst of neighbours on a path, once each."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    return paths.where(F.size("path") > 1).select(F.inline(pairs)).distinct()


def path_links(paths: DataFrame) -> DataFrame:
    """src, dst, weight 1 of neighbours on a path."""
    return _steps(paths).withColumn("weight", F.lit(1))


def boundaries(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, left, right of every node on a path; ``nodes`` has node, first, last, length, root, leaf.

    Where nodes meet, all right ends and left ends that any path joins, directly
    or through others, are one junction, cut in the middle between its
    latest start and its earliest end. A root begins at its own start, a leaf ends with the unitig.
    """
    steps = cut(_steps(paths))
    end = lambda c, side: F.struct(F.col(c).alias("node"), F.lit(side).alias("side"))
    junction = cut(components(steps.select(end("src", "r").alias("a"), end("dst", "l").alias("b"))).select(F.col("node.node").alias("node"), F.col("node.side").alias("side"), "component"))
    ends = junction.join(nodes.select("node", "first", "last"), "node")
    start, stop = F.max(F.when(F.col("side") == "l", F.col("first"))), F.min(F.when(F.col("side") == "r", F.col("last")))
    borders = ends.groupBy("component").agg((start + F.floor((stop - start) / 2)).cast("long").alias("border"))
    at = ends.join(borders, "component").groupBy("node").agg(F.max(F.when(F.col("side") == "l", F.col("border"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("border"))).alias("r"))
    own = paths.select(F.explode("path").alias("node")).distinct().join(nodes, "node").join(at, "node", "left")
    left = F.coalesce("l", F.when(F.col("root"), F.col("first")))
    right = F.coalesce("r", F.when(F.col("leaf"), F.col("length") - 1))
    return own.select("node", left.cast("long").alias("left"), right.cast("long").alias("right"))


def remaining(nodes: DataFrame, edges: DataFrame, used: DataFrame) -> DataFrame:
    """node: clusters that are neither used nor next to a used one, longest first without each other's neighbours."""
    near = graphs.symmetric(edges).join(used.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    free = nodes.join(used.select("node").union(near).distinct(), "node", "left_anti")
    return graphs.independent_set(free.select("node", (F.col("last") - F.col("first")).alias("length")), edges)


def read_neighbours(clips: DataFrame, clusters: DataFrame, near: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(links, reads): where the clipped reads of a cluster go on.

    ``clips`` has unitig, read_id, side, next, strand; ``clusters`` unitig,
    read_id, cluster; ``near`` the pairs (unitig, next) within reach in the graph. A read
    counts for one neighbour: of its clips a left one comes before a right one, then
    the neighbour last by name. ``links`` has unitig, cluster, next, orients and n of neighbours
    with ``least`` reads, ``reads`` their reads.
    """
    own = clips.join(clusters, ["unitig", "read_id"])
    late = F.when(F.col("side") == "L", 1).otherwise(0)
    orients = own.groupBy("unitig", "cluster", "next").agg(F.max_by(fn.link_orients(F.col("side"), F.col("strand")), F.struct(F.col("read_id"), late, F.col("strand"))).alias("orients"))
    one = own.join(near.select("unitig", "next").distinct(), ["unitig", "next"], "left_semi").groupBy("unitig", "cluster", "read_id").agg(F.max_by("next", F.struct(late, F.col("next"))).alias("next"))
    counts = one.groupBy("unitig", "cluster", "next").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    links = counts.join(orients, ["unitig", "cluster", "next"])
    return links, one.join(links.select("unitig", "cluster", "next"), ["unitig", "cluster", "next"], "left_semi")


def linked_clusters(clips: DataFrame, clusters: DataFrame, segments: DataFrame, near: DataFrame, removed: DataFrame, least_neighbour: int = 3, least_cluster: int = 3) -> DataFrame:
    """from_unitig, from_cluster, from_orient, to_unitig, to_cluster (null: the parent), to_orient, weight.

    ``segments`` has unitig, cluster, is_src, is_sink of the new segments, ``removed`` the unitigs (unitig) that go.
    A link to a cluster of the neighbour needs ``least_cluster`` of the reads. Without any, the link
    goes to the neighbour's source or sink clusters if the neighbour is removed, else to the neighbour.
    """
    made = segments.select("unitig", "cluster", "is_src", "is_sink")
    links, reads = read_neighbours(clips, clusters.join(made.select("unitig", "cluster"), ["unitig", "cluster"], "left_semi"), near, least_neighbour)
    links, reads = cut(links), cut(reads)
    there = clusters.select(F.col("unitig").alias("next"), "read_id", F.col("cluster").alias("to_cluster"))
    shared = reads.join(there, ["next", "read_id"]).groupBy("unitig", "cluster", "next", "to_cluster").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least_cluster)
    target = made.select(F.col("unitig").alias("next"), F.col("cluster").alias("to_cluster"), F.col("is_src").alias("to_src"), F.col("is_sink").alias("to_sink"))
    key = ["unitig", "cluster", "next"]
    direct = cut(shared.join(target.select("next", "to_cluster"), ["next", "to_cluster"], "left_semi").join(links.select(*key, "orients"), key))
    known = clusters.select(F.col("unitig").alias("next")).distinct().withColumn("known", F.lit(True))
    gone = removed.select(F.col("unitig").alias("next")).distinct().withColumn("gone", F.lit(True))
    rest = links.join(direct.select(*key), key, "left_anti").join(known, "next", "left").join(gone, "next", "left").join(made, ["unitig", "cluster"])
    parent = rest.where("known IS NULL OR gone IS NULL").select(*key, "orients", F.lit(None).cast(made.schema["cluster"].dataType).alias("to_cluster"), F.when(F.col("known").isNull(), NO_CLUSTERS).otherwise(FALLBACK).alias("weight"))
    both = F.col("is_src") & F.col("is_sink")
    to_source = F.when(both, F.col("orients.to_orient") == "+").otherwise(F.col("is_sink"))
    wired = rest.where("known AND gone AND (is_src OR is_sink)").join(target, "next").where(F.when(to_source, F.col("to_src")).otherwise(F.col("to_sink"))).select(*key, "orients", "to_cluster", F.lit(FALLBACK).alias("weight"))
    out = direct.select(*key, "orients", "to_cluster", F.col("weight").cast("int").alias("weight")).union(parent).union(wired)
    return out.select(F.col("unitig").alias("from_unitig"), F.col("cluster").alias("from_cluster"), "orients.from_orient", F.col("next").alias("to_unitig"), "to_cluster", "orients.to_orient", "weight")


def _ends(links: DataFrame) -> DataFrame:
    """seg, side (L or R) of the segment ends that a link touches."""
    out = F.struct(F.col("from_seg").alias("seg"), F.when(F.col("from_orient") == "+", "R").otherwise("L").alias("side"))
    into = F.struct(F.col("to_seg").alias("seg"), F.when(F.col("to_orient") == "+", "L").otherwise("R").alias("side"))
    return links.select(F.inline(F.array(out, into))).distinct()


def parental_links(links: DataFrame, segments: DataFrame, removed: DataFrame, made: DataFrame) -> DataFrame:
    """from_seg, from_orient, to_seg, to_orient, ex: links of unitigs that stay to the new segments beside them.

    ``links`` are those of the old graph, ``segments`` has seg, unitig, is_src and is_sink, ``made`` the
    links of new segments. A link of the old graph is taken over by the source (or, on the
    other strand, sink) segments of the removed end's unitig that have no link on that side.
    """
    ends = _ends(made)
    gone = removed.select("unitig").distinct()
    new = segments.select("seg", "unitig", "is_src", "is_sink")

    def taken(near: str, far: str, forward: bool) -> DataFrame:
        kept = links.join(gone.select(F.col("unitig").alias(f"{near}_seg")), f"{near}_seg", "left_anti")
        plus = F.col(f"{far}_orient") == "+"
        at = kept.join(new, F.col(f"{far}_seg") == F.col("unitig"))
        source = plus if forward else ~plus
        chosen = at.where(F.when(source, F.col("is_src")).otherwise(F.col("is_sink")))
        side = F.when(source, "L").otherwise("R") if forward else F.when(plus, "R").otherwise("L")
        free = chosen.withColumn("side", side).join(ends, ["seg", "side"], "left_anti")
        renamed = {f"{far}_seg": F.col("seg"), f"{near}_seg": F.col(f"{near}_seg")}
        return free.select(renamed["from_seg"].alias("from_seg"), "from_orient", renamed["to_seg"].alias("to_seg"), "to_orient", F.lit(PARENTAL).alias("ex"))

    return taken("from", "to", True).union(taken("to", "from", False)).distinct()


def split_links(links: DataFrame, pieces: DataFrame) -> DataFrame:
    """Links of a graph whose long segments were cut into ``pieces`` (unitig, piece from 0, n).

    A link at a segment's left end goes to its first piece, one at its right end to
    its last, and the pieces are chained; a piece is called unitig_s1, unitig_s2 and so on.
    """
    n = pieces.groupBy("unitig").agg(F.max("n").alias("n")).where("n > 1")

    def named(df: DataFrame, side: str, right: Column) -> DataFrame:
        seg = f"{side}_seg"
        piece = F.when(right, F.col("n")).otherwise(F.lit(1))
        return df.join(n.withColumnRenamed("unitig", seg), seg, "left").withColumn(seg, F.when(F.col("n").isNull(), F.col(seg)).otherwise(F.concat(F.col(seg), F.lit("_s"), piece.cast("string")))).drop("n")

    moved = named(named(links, "from", F.col("from_orient") == "+"), "to", F.col("to_orient") == "-")
    chain = pieces.where("n > 1 AND piece > 0")
    name = lambda k: F.concat("unitig", F.lit("_s"), k.cast("string"))
    inner = chain.select(name(F.col("piece")).alias("from_seg"), F.lit("+").alias("from_orient"), name(F.col("piece") + 1).alias("to_seg"), F.lit("+").alias("to_orient"))
    return moved.select("from_seg", "from_orient", "to_seg", "to_orient").union(inner).distinct()


def _strands(links: DataFrame) -> DataFrame:
    """src, dst of segments with their orientation (name and sign), each link on both strands."""
    sign = fn.flipped
    forward = F.struct(F.concat("from_seg", "from_orient").alias("src"), F.concat("to_seg", "to_orient").alias("dst"))
    back = F.struct(F.concat("to_seg", sign(F.col("to_orient"))).alias("src"), F.concat("from_seg", sign(F.col("from_orient"))).alias("dst"))
    return links.select(F.inline(F.array(forward, back))).distinct()


def merged_segments(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, links, members) after unbranched chains have become one segment each.

    Chains are found on both strands at once; the strand whose first name is the
    smaller one is kept. ``members`` has seg, merged, orient for every segment.
    """
    placed = cut(graphs.linear_chains(_strands(links.where("from_seg <> to_seg")), components))
    seg, sign = F.expr("substring(node, 1, length(node) - 1)"), F.right("node", F.lit(1))
    both = placed.select(seg.alias("seg"), sign.alias("orient"), "chain", "at")
    # a segment stands in two chains, one for each strand, unless its chain runs into its own other strand
    best = both.groupBy("seg").agg(F.min("chain").alias("chain"), F.count_distinct("chain").alias("k"))
    mixed = best.where("k < 2").select("chain").distinct()
    own = both.join(best.select("seg", "chain"), ["seg", "chain"]).join(mixed, "chain", "left_anti")
    named = own.join(segments.select(F.col("unitig").alias("seg"), "seq", "dp"), "seg")
    oriented = F.when(F.col("orient") == "-", fn.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    parts = F.sort_array(F.collect_list(F.struct("at", "seg", oriented.alias("seq"), "dp", F.length("seq").alias("n"))))
    grown = cut(named.groupBy("chain").agg(parts.alias("p")))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["n"])
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["n"] * F.coalesce(x["dp"], F.lit(0)))
    whole = grown.select("chain", F.array_join("p.seg", "_").alias("unitig"), F.array_join("p.seq", "").alias("seq"), F.rint(F.try_divide(mean, total)).cast("int").alias("dp"))
    joined = named.select("seg", "chain", "orient").join(whole.select("chain", F.col("unitig").alias("merged")), "chain")
    members = segments.select(F.col("unitig").alias("seg")).join(joined, "seg", "left").select("seg", F.coalesce("merged", "seg").alias("merged"), F.coalesce("orient", F.lit("+")).alias("orient"), "chain")
    members = cut(members)
    alone = segments.join(members.where("chain IS NULL").select(F.col("seg").alias("unitig")), "unitig", "left_semi")
    new = whole.select("unitig", "seq", F.length("seq").alias("length"), "dp").unionByName(alone.select("unitig", "seq", F.length("seq").alias("length"), "dp"))
    inside = placed.select(F.col("node"), "chain", "at")
    a, b = inside.select(F.col("node").alias("src"), F.col("chain").alias("ca"), F.col("at").alias("ia")), inside.select(F.col("node").alias("dst"), F.col("chain").alias("cb"), F.col("at").alias("ib"))
    used = a.join(b, (F.col("ca") == F.col("cb")) & (F.col("ib") == F.col("ia") + 1)).join(mixed.select(F.col("chain").alias("ca")), "ca", "left_anti").select("src", "dst")
    spelt = links.withColumn("src", F.concat("from_seg", "from_orient")).withColumn("dst", F.concat("to_seg", "to_orient"))
    open_links = spelt.join(used, ["src", "dst"], "left_anti").select(links.columns)

    def moved(df: DataFrame, side: str) -> DataFrame:
        m = members.select(F.col("seg").alias(f"{side}_seg"), F.col("merged"), F.col("orient").alias("_o"))
        turned = F.when(F.col("_o") == "-", fn.flipped(F.col(f"{side}_orient"))).otherwise(F.col(f"{side}_orient"))
        return df.join(m, f"{side}_seg").withColumn(f"{side}_orient", turned).withColumn(f"{side}_seg", F.col("merged")).drop("merged", "_o")

    return new, moved(moved(open_links, "from"), "to").select(links.columns).distinct(), members.select("seg", "merged", "orient")


def simplified_links(links: DataFrame, depths: DataFrame, ratio: float) -> DataFrame:
    """Oriented links after ``graphs.simplified`` on both strands; ``depths`` has seg and dp."""
    both = _strands(links)
    sides = F.explode(F.array(F.concat("seg", F.lit("+")), F.concat("seg", F.lit("-"))))
    left = cut(graphs.simplified(both, depths.select(sides.alias("node"), F.col("dp").alias("depth")), ratio))
    back = left.select(*(F.concat(F.expr(f"substring({c}, 1, length({c}) - 1)"), fn.flipped(F.right(c, F.lit(1)))).alias(n) for c, n in (("dst", "src"), ("src", "dst"))))
    sure = left.join(back, ["src", "dst"], "left_semi")
    spelt = links.withColumn("src", F.concat("from_seg", "from_orient")).withColumn("dst", F.concat("to_seg", "to_orient"))
    return spelt.join(sure, ["src", "dst"], "left_semi").select(links.columns)
