"""Graph rewrites on edge tables (src, dst) and on assembly links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haploom.plans.checkpoints import cut, dealt_once, stored

#: Labels go round for about so many edges of whole groups at once; a group of more than the second number goes through the rounds of ``label_propagation``.
_TOGETHER, _LARGE = 200_000, 4_000_000

def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def paths(edges: DataFrame, hops: int, starts: DataFrame | None = None) -> DataFrame:
    """path (array of nodes): simple paths of 1 to ``hops`` edges, from ``starts`` (node) or from anywhere."""
    e = edges.select("src", "dst").distinct()
    first = e if starts is None else e.join(starts.select(F.col("node").alias("src")), "src", "left_semi")
    level = first.where("src <> dst").select(F.array("src", "dst").alias("path"))
    found = [level]
    for k in range(hops - 1):
        if k >= 2:  # later steps go on from files instead of repeating the joins of all before
            level = cut(level)
            found[-1] = level
            if not level.limit(1).count():
                break
        step = level.withColumn("src", F.element_at("path", -1)).join(e, "src").where(~F.array_contains("path", F.col("dst")))
        level = step.select(F.concat("path", F.array("dst")).alias("path"))
        found.append(level)
    return reduce(DataFrame.union, found)


def full_paths(edges: DataFrame, roots: DataFrame, leafs: DataFrame, hops: int) -> DataFrame:
    """src, dst, path: simple paths from a root to a leaf."""
    found = paths(edges, hops, roots).select(F.col("path")[0].alias("src"), F.element_at("path", -1).alias("dst"), "path")
    return found.join(leafs.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "path")


def transitive(edges: DataFrame, hops: int = 3, first_hop: bool = False) -> DataFrame:
    """Edges that a longer simple path of up to ``hops`` edges bypasses; with ``first_hop`` the first edge of such a path instead."""
    long = paths(edges, hops).where(F.size("path") > 2)
    ends = long.select(F.col("path")[0].alias("src"), F.element_at("path", -1).alias("dst"), F.col("path")[1].alias("via")).join(edges.select("src", "dst"), ["src", "dst"])
    return (ends.select("src", F.col("via").alias("dst")) if first_hop else ends.select("src", "dst")).distinct()


def without_transitive(edges: DataFrame, hops: int = 3) -> DataFrame:
    return edges.join(transitive(edges, hops), ["src", "dst"], "left_anti")


def branch_free(edges: DataFrame) -> DataFrame:
    """Edges whose source has one successor and whose target has one predecessor."""
    n = edges.withColumn("o", F.count(F.lit(1)).over(Window.partitionBy("src"))).withColumn("i", F.count(F.lit(1)).over(Window.partitionBy("dst")))
    return n.where("o = 1 AND i = 1").drop("o", "i")


def twins(edges: DataFrame) -> DataFrame:
    """a, b: nodes a < b whose neighbours are the same, each other left out."""
    both = symmetric(edges)
    sets = both.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("n"))
    # apart: an equality join on the whole list; adjacent: on the lists without each other, for joined nodes only
    apart = sets.select("n", F.col("src").alias("a")).join(sets.select("n", F.col("src").alias("b")), "n").where("a < b").select("a", "b")
    pairs = both.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    a, b = (sets.select(F.col("src").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where(F.array_remove("na", F.col("b")) == F.array_remove("nb", F.col("a"))).select("a", "b")
    return apart.union(near).distinct()


def nested(intervals: DataFrame, key: list[str], node: str, width: int = 2000) -> DataFrame:
    """key, inner, outer: intervals strictly inside another, found by the range that the inner one begins in."""
    bins = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width)))
    outer = intervals.select(*key, F.col(node).alias("outer"), F.col("s").alias("os"), F.col("e").alias("oe"), bins.alias("_b"))
    inner = intervals.select(*key, F.col(node).alias("inner"), "s", "e", F.floor(F.col("s") / width).alias("_b"))
    return inner.join(outer, [*key, "_b"]).where("os < s AND oe > e").select(*key, "inner", "outer")


def within_hops(edges: DataFrame, hops: int, starts: DataFrame | None = None) -> DataFrame:
    """src, dst, hops: fewest edges between nodes, both directions allowed, up to the limit; from ``starts`` (node) or from anywhere."""
    e = symmetric(edges)
    first = e if starts is None else e.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    best = first.select("src", "dst").withColumn("hops", F.lit(1))
    front = best
    for k in range(2, hops + 1):
        step = front.select("src", F.col("dst").alias("mid")).join(e.withColumnRenamed("src", "mid"), "mid").where("src <> dst").select("src", "dst").distinct()
        front = cut(step.join(best, ["src", "dst"], "left_anti").withColumn("hops", F.lit(k)))
        best = best.union(front)
    return best


def label_propagation(edges: DataFrame) -> DataFrame:
    """node, label: synchronous rounds in which a node takes the heaviest label around it, the smallest of equals, until nothing changes.

    A node counts its own label too. Where labels go round in a circle of states
    (two nodes that swap theirs), each node goes on with its smallest label of
    these states; a state that comes again after that ends the rounds.
    """
    both = edges.select("src", "dst", "w").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst")
    both = cut(both.union(both.select("src", F.col("src").alias("dst"), F.lit(1e-6).alias("w")).distinct()))
    labels = both.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    states, known = [], {}
    while True:
        at = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(20,0)"))).first()[0]
        if at in known:
            circle = states[known[at] :]
            if len(circle) < 2:
                break
            labels = cut(reduce(DataFrame.union, circle).groupBy("node").agg(F.min("label").alias("label")))
            at = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(20,0)"))).first()[0]
            if at in known:
                break
        known[at] = len(states)
        states.append(labels)
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        labels = cut(votes.groupBy("src").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("m")).select(F.col("src").alias("node"), (-F.col("m.l")).alias("label")))
    return labels


def _state(node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A hash of each node with its label; sums of these tell states apart."""
    x = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + label.astype(np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _settled(key: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, label) of whole groups of edges, by the rounds of ``label_propagation`` for each group."""
    keys, nodes, n = np.concatenate([key, key]), np.concatenate([a, b]), len(key)
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(2 * n, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    number = np.empty(2 * n, np.int64)
    number[order] = np.cumsum(new) - 1
    keys, nodes = keys[new], nodes[new]
    label = every = np.arange(len(nodes))  # numbers are in the order of the nodes
    src, dst = np.concatenate([number, every]), np.concatenate([number[n:], number[:n], every])
    w = np.concatenate([w, w, np.full(len(every), 1e-6)])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
    going = np.ones(len(first), bool)
    known: list[dict[int, int]] = [{} for _ in first]
    kept, states = every, []  # states of the nodes that are kept, whose groups still change
    while True:
        starts = np.searchsorted(group[kept], np.arange(len(first) + 1))
        hashes = np.concatenate([[np.uint64(0)], np.cumsum(_state(kept, label[kept]))])
        hashes = hashes[starts[1:]] - hashes[starts[:-1]]
        label = label.copy()
        for g in np.flatnonzero(going):
            at, mine = int(hashes[g]), slice(starts[g], starts[g + 1])
            if at in known[g]:
                circle = states[known[g][at] :]
                if len(circle) > 1:
                    label[kept[mine]] = np.min([x[mine] for x in circle], 0)
                    at = int(_state(kept[mine], label[kept[mine]]).sum(dtype=np.uint64))
                if len(circle) < 2 or at in known[g]:
                    going[g] = False
                    continue
            known[g][at] = len(states)
        if not going.any():
            return keys, nodes, nodes[label]
        states.append(label[kept])
        still = going[group[kept]]
        if 2 * still.sum() < len(kept):
            kept, states = kept[still], [x[still] for x in states]
        mine = going[group[src]]
        src, dst, w = src[mine], dst[mine], w[mine]
        pair = src * len(nodes) + label[dst]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        votes, voter, voted = np.round(np.add.reduceat(w[order], new), 9), pair[new] // len(nodes), pair[new] % len(nodes)
        order = np.lexsort((voted, -votes, voter))
        voter, voted = voter[order], voted[order]
        best = np.concatenate([[True], voter[1:] != voter[:-1]])
        label = label.copy()
        label[voter[best]] = voted[best]


def label_propagation_within(edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, node, label) like ``label_propagation`` for edges (a, b, w) between nodes of one ``key``, and the edges (key, a, b, w) of groups that are too large for a task, which aren't in it.

    All but w are whole numbers. A window brings a group's edges together where
    they lie, without a shuffle if they are dealt by the key already. Each group
    has its own rounds.
    """
    shape = "key long, node long, label long, w double, whole boolean"
    names = ["key", "node", "label", "w", "whole"]

    def rows(key: np.ndarray, node: np.ndarray, label: np.ndarray, w: np.ndarray, whole: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(label), pa.array(w), pa.array(np.full(len(key), whole))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            *columns, times = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            large = times > _LARGE
            if large.any():
                yield rows(*(c[large] for c in columns), False)
            held.append([c[~large] for c in columns])
            n += int((~large).sum())
            if n >= _TOGETHER:
                k, a, b, w = map(np.concatenate, zip(*held, strict=True))
                last = k == k[-1]  # it may go on in the next batch
                if not last.all():
                    found = _settled(k[~last], a[~last], b[~last], w[~last])
                    yield rows(*found, np.zeros(len(found[0])), True)
                held, n = [[x[last] for x in (k, a, b, w)]], int(last.sum())
        if n:
            found = _settled(*map(np.concatenate, zip(*held, strict=True)))
            yield rows(*found, np.zeros(len(found[0])), True)

    long = lambda c, name: F.col(c).cast("long").alias(name)
    e = edges.where(F.col(key).isNotNull() & (F.col("a") != F.col("b"))).select(key, long("a", "a"), long("b", "b"), F.col("w").cast("double").alias("w"))
    e = e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).select(long(key, "key"), "a", "b", "w", "n")
    with dealt_once(edges.sparkSession):
        out = stored(e.mapInArrow(run, shape))
    name = F.col("key").cast(edges.schema[key].dataType).alias(key)
    return out.where("whole").select(name, "node", "label"), out.where("NOT whole").select(name, F.col("node").alias("a"), F.col("label").alias("b"), "w")


def linear_chains(edges: DataFrame, components) -> DataFrame:
    """node, chain, at: order of nodes in each unbranched chain; chain is its smallest node, circles are left out."""
    kept = cut(branch_free(edges.select("src", "dst").distinct()))
    chain = components(kept.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("component", "chain")
    # pointer doubling: distance to the first node of the chain
    heads = kept.select(F.col("src").alias("node")).distinct().join(kept.select(F.col("dst").alias("node")), "node", "left_anti")
    back = kept.select(F.col("dst").alias("node"), F.col("src").alias("to"), F.lit(1).cast("long").alias("n"))
    state = cut(back.union(heads.select("node", F.col("node").alias("to"), F.lit(0).cast("long").alias("n"))))
    size = chain.groupBy("chain").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, size - 1).bit_length()):
        state = cut(state.alias("x").join(state.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", F.col("y.to").alias("to"), (F.col("x.n") + F.col("y.n")).alias("n")))
    placed = state.join(heads.select(F.col("node").alias("to")), "to", "left_semi")
    return placed.join(chain, "node").select("node", "chain", F.col("n").alias("at"))


def simplified(edges: DataFrame, depths: DataFrame, ratio: float) -> DataFrame:
    """Edges after dropping, until nothing changes, what competes with a fitting only successor (or predecessor).

    For a node with one successor n of less than ``ratio`` times its depth, whose
    only other predecessor s has more successors, s -> n goes; likewise backwards.
    All drops of a direction happen at once, successors first.
    """
    known = depths.select("node", F.when(F.col("depth") > 0, F.col("depth").cast("double")).otherwise(0.1).alias("depth"))

    def pass_once(e: DataFrame, a: str, b: str) -> DataFrame:
        out_n, in_n = Window.partitionBy(a), Window.partitionBy(b)
        counted = e.withColumn("o", F.count(F.lit(1)).over(out_n)).withColumn("i", F.count(F.lit(1)).over(in_n))
        fits = counted.where("o = 1 AND i = 2").join(known.select(F.col("node").alias(a), F.col("depth").alias("da")), a).join(known.select(F.col("node").alias(b), F.col("depth").alias("db")), b).where(F.col("db") / F.col("da") < ratio)
        drop = counted.where("o > 1 AND i = 2").join(fits.select(b).distinct(), b, "left_semi").select("src", "dst")
        return e.join(drop, ["src", "dst"], "left_anti")

    e = cut(edges.select("src", "dst").distinct())
    n = e.count()
    while n:  # edges only get fewer, so it ends
        e = cut(pass_once(pass_once(e, "src", "dst"), "dst", "src"))
        now = e.count()
        if now == n:
            break
        n = now
    return e


def clean_links(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Links between existing, different segments, once each."""
    s = segments.select("unitig").distinct()
    ok = links.where("from_seg <> to_seg").join(s.withColumnRenamed("unitig", "from_seg"), "from_seg", "left_semi").join(s.withColumnRenamed("unitig", "to_seg"), "to_seg", "left_semi")
    return ok.dropDuplicates(["from_seg", "from_orient", "to_seg", "to_orient"])


def without_segments(links: DataFrame, removed: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Links that touch none of ``removed`` (node)."""
    return links.join(removed.select(F.col("node").alias(a)), a, "left_anti").join(removed.select(F.col("node").alias(b)), b, "left_anti")


def independent_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node: maximal independent set, longest first (smaller id of equals), by rounds of local winners.

    A node that outranks all its free neighbours is taken and its neighbours go; that equals the sequential greedy choice.
    """
    free = cut(nodes.select("node", F.col("length").alias("l")))
    both, taken = cut(symmetric(edges)), []
    while free.limit(1).count():
        near = both.join(free.select(F.col("node").alias("src"), F.col("l").alias("ls")), "src").join(free.select(F.col("node").alias("dst"), F.col("l").alias("ld")), "dst")
        beaten = near.where("ld > ls OR (ld = ls AND dst < src)").select(F.col("src").alias("node")).distinct()
        winners = cut(free.join(beaten, "node", "left_anti").select("node"))
        taken.append(winners)
        gone = both.join(winners.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).union(winners)
        free = cut(free.join(gone.distinct(), "node", "left_anti"))
    return reduce(DataFrame.union, taken) if taken else nodes.select("node").limit(0)


def drop_uncovered(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (unitig, dp) of some depth, and the links (from_seg, to_seg) between them."""
    gone = segments.where("dp = 0").select("unitig")
    left = links.join(gone.withColumnRenamed("unitig", "from_seg"), "from_seg", "left_anti").join(gone.withColumnRenamed("unitig", "to_seg"), "to_seg", "left_anti")
    return segments.where("dp IS NULL OR dp <> 0"), left


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer) of a directed graph without circles: a node comes after all from which an edge leads to it; raises ValueError where there is a circle.

    Each round takes off the nodes that no edge leads to; rounds are as many as the longest path is long.
    """
    left = cut(edges.select("src", "dst").distinct())
    rest = cut(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    found, k = [], 0
    while not rest.isEmpty():
        free = cut(rest.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            raise ValueError("the graph has a circle")
        found.append(free.withColumn("layer", F.lit(k).cast("long")))
        rest = cut(rest.join(free, "node", "left_anti"))
        left = cut(left.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
        k += 1
    out = rest.withColumn("layer", F.lit(0).cast("long"))
    for part in found:
        out = out.union(part)
    return out
