"""Connected components by alternating large-star and small-star steps, and within groups by forests of their edges.

Both steps are a minimum per node (partial aggregates, so a hub costs one row
per task) and a plain join back (which adaptive execution may split when
skewed). Edges are written to the checkpoint folder after each round; nothing
is collected but two numbers that tell whether a round changed anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploom.plans.checkpoints import cut, dealt_once, delete, release, stored

#: A task holds about so many edges at once.
_HELD = 1_000_000


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge with two different ends.

    ``component`` is the smallest node id reachable. Null ends, self-loops and
    repeated edges are ignored; without edges the result is empty.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = cut(e)
    before = _state(e)
    while before[0]:
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u != v")
        e = cut(small.distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _forest(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, root): every node, once, with the smallest node that these edges join it to."""
    keys, nodes, n = np.concatenate([key, key]), np.concatenate([a, b]), len(key)
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(2 * n, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    number = np.empty(2 * n, np.int64)
    number[order] = np.cumsum(new) - 1
    u, v, keys, nodes = number[:n], number[n:], keys[new], nodes[new]
    root = np.arange(len(nodes))
    while len(u):
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
        root[np.maximum(u, v)] = np.minimum(u, v)  # a root points at a smaller one, so there are no circles
        while (root[root] != root).any():
            root = root[root]
    return keys, nodes, nodes[root]


def _rows(key: np.ndarray, node: np.ndarray, root: np.ndarray, whole: bool) -> pa.RecordBatch:
    """Whole groups with every node, parts of others as edges."""
    kept = np.ones(len(key), bool) if whole else node != root
    return pa.RecordBatch.from_pydict({"key": key[kept], "node": node[kept], "root": root[kept], "whole": np.full(int(kept.sum()), whole)})


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges (key, node, root) that join the same nodes, whatever comes together in a task."""
    held, n = [], 0
    for batch in batches:
        held.append(_columns(batch))
        n += len(batch)
        if n >= _HELD:
            yield _rows(*_forest(*map(np.concatenate, zip(*held, strict=True))), False)
            held, n = [], 0
    if n:
        yield _rows(*_forest(*map(np.concatenate, zip(*held, strict=True))), False)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of edges that come sorted by key; a key of more nodes than a task may hold comes as edges again, not ``whole``."""
    held, n, large = [], 0, None
    for batch in batches:
        held.append(_columns(batch))
        n += len(batch)
        if n < _HELD:
            continue
        key, a, b = map(np.concatenate, zip(*held, strict=True))
        last = key == key[-1]
        for part, whole in ((~last & (key != large), True), (~last & (key == large), False)) if large is not None else ((~last, True),):
            if part.any():
                yield _rows(*_forest(key[part], a[part], b[part]), whole)
        rest = _forest(key[last], a[last], b[last])
        joined = rest[1] != rest[2]
        if joined.sum() * 2 >= _HELD:
            yield _rows(*rest, False)
            held, n, large = [], 0, key[-1]
        else:
            held, n = [tuple(x[joined] for x in rest)], int(joined.sum())
    if n:
        key, a, b = map(np.concatenate, zip(*held, strict=True))
        for part, whole in ((key != large, True), (key == large, False)) if large is not None else ((np.ones(n, bool), True),):
            if part.any():
                yield _rows(*_forest(key[part], a[part], b[part]), whole)


def components_within(edges: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """(key, node, component) like ``components``, for edges between nodes of one ``key``; all three are whole numbers.

    Edges are thinned to forests where they are found, then those of a key meet
    in one task, where they are joined in pieces of bounded size. Only keys of
    too many nodes for that go through the steps of ``components``.
    """
    spark = edges.sparkSession
    long = lambda c, name: F.col(c).cast("long").alias(name)
    kind, shape = edges.schema[key].dataType, "key long, node long, root long, whole boolean"
    found = edges.where(F.col(key).isNotNull() & (F.col(a) != F.col(b))).select(long(key, "key"), long(a, "node"), long(b, "root"))
    with dealt_once(spark):
        thin = stored(found.mapInArrow(_thinned, shape))
    del edges, found
    release(spark)
    out = stored(thin.select("key", "node", "root").repartition("key").sortWithinPartitions("key").mapInArrow(_joined, shape))
    delete(thin)
    release(spark)
    done = out.where("whole").select("key", "node", F.col("root").alias("component"))
    rest = out.where("NOT whole")
    if not rest.isEmpty():
        node = lambda c: F.struct("key", F.col(c).alias("node"))
        late = components(rest.select(node("node").alias("a"), node("root").alias("b")))
        done = done.union(late.select("node.key", "node.node", F.col("component.node")))
    return done.select(F.col("key").cast(kind).alias(key), "node", "component")
