"""Exact top-k search by inner product with a table of pivot distances.

Vectors of integers are lengthened by one component so that the inner product
becomes a distance: a candidate c gets sqrt(M^2 - |c|^2), a query 0, and
|q - c|^2 = |q|^2 + M^2 - 2 q.c with M^2 the largest |c|^2. The distances from
every vector to the pivots are computed once. For a query, the largest
difference of pivot distances is a lower bound of its distance to a candidate,
hence an upper bound of the score; candidates are evaluated in the order of
that bound until the k-th best score exceeds all bounds that remain.

Queries and candidates are dealt into blocks by a hash; each pair of blocks is
a task, whose k best per query are merged by a second top-k. Pivots are
``PIVOTS`` rows that lie far apart, of a bounded sample (``SAMPLE`` rows with
the smallest hash); they are the only thing that is broadcast. How much is
eliminated is up to the data: vectors in groups lose most candidates, evenly
spread ones of many dimensions hardly any.

Defined cases: null ids and vectors that are null or hold null or non-finite
components take no part; a vector that is shorter than another counts as
filled up with zeros, so an empty one scores 0; where norms are so large that
scores may not be exact as doubles, the best are computed again as integers,
and scores beyond 64 bits are the largest or smallest such number; fewer than k
candidates give fewer rows; a repeated id is a candidate for each of its rows,
but not for queries of its own id; ties go to the smaller id; an empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIVOTS, SAMPLE = 64, 2048
#: Squared norms up to which doubles hold scores exactly.
EXACT = 2.0**52
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCKS = 512, 2048, 48
#: Candidates evaluated per query and round.
ROUND = 128


def integer_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v = floor(64 x) as array<long>, of the rows whose vectors take part."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    ok = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * 64)).alias("v"))


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    """The lists of one or more Arrow columns as rows of a matrix, filled up with zeros."""
    lengths = np.concatenate([np.diff(np.asarray(c.offsets)) for c in columns])
    flat = np.concatenate([np.asarray(c.flatten()) for c in columns])
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), within] = flat
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the columns that only one has, which add nothing to a product."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def _alike_t(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = _alike(a, b)
    return a, b.T


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows, each the farthest from those before it."""
    taken, gap = [], np.full(len(rows), np.inf)
    for _ in range(min(n, len(rows))):
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, np.square(rows - rows[taken[-1]]).sum(1))
        if gap.max() == 0:
            break
    return rows[taken]


def best(q_ids: np.ndarray, q: np.ndarray, qd: np.ndarray, c_ids: np.ndarray, c: np.ndarray, cd: np.ndarray, radius2: float, k: int, seen: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores) with a query's k best, by elimination with pivot distances.

    ``qd`` and ``cd`` are distances to the pivots, ``radius2`` the squared norm
    of lengthened candidates; ``seen`` gets the number of candidates evaluated for each query.
    """
    bound = np.zeros((len(q), len(c)), np.float32)
    for p in range(qd.shape[1]):
        np.maximum(bound, np.abs(qd[:, p, None] - cd[None, :, p]), out=bound)
    # float32 and the square roots err by far less than this
    low2 = np.square(np.maximum(bound.astype(np.float64) * (1 - 1e-5) - 1e-2 - 1e-5 * float(np.sqrt(radius2)), 0))
    norms = (q.astype(np.float64) ** 2).sum(1)
    upper = (norms[:, None] + radius2 - low2) / 2
    order = np.argsort(-upper, axis=1, kind="stable")
    real, rough = c.astype(np.float64), float(np.sqrt(norms.max(initial=0) * radius2)) >= EXACT
    for i in range(len(q)):
        own, slack = q[i].astype(np.float64), 2.0**-46 * float(np.sqrt(norms[i] * radius2)) if rough else 0.0
        ids, scores = np.empty(0, np.int64), np.empty(0, object if rough else np.float64)
        ranked = order[i]
        begin = 0
        while begin < len(ranked):
            if len(ids) >= k and float(scores[-1]) - slack > upper[i, ranked[begin]]:
                break
            at = ranked[begin : begin + (ROUND if begin == 0 else 4 * ROUND)]
            begin += len(at)
            at = at[c_ids[at] != q_ids[i]]
            found = real[at] @ own
            if len(ids) >= k:
                near = found >= float(scores[-1]) - slack
                at, found = at[near], found[near]
            if rough:
                found = np.array([sum(int(x) * int(y) for x, y in zip(c[j], q[i], strict=True)) for j in at] or np.empty(0), object)
            ids, scores = np.concatenate([ids, c_ids[at]]), np.concatenate([scores, found])
            top = np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], int) if rough else np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        if seen is not None:
            seen.append(begin)
        yield int(q_ids[i]), ids, np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in scores], np.int64)


def search(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product for each row where ``is_query``."""
    rows = rows.select(vec_id, vector, is_query.alias("_q"))
    whole = integer_vectors(rows, vec_id, vector)
    real = lambda e: e.cast("double")
    total, radius2 = whole.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + real(e) * real(e)))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    spark = rows.sparkSession
    if not total:
        return spark.createDataFrame([], schema)
    flagged = rows.where("_q").select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    queries, candidates = integer_vectors(flagged, "vec_id", "x"), whole
    drawn = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    width = max(len(r[0]) for r in drawn)
    sample = np.array([list(r[0]) + [0] * (width - len(r[0])) for r in drawn], np.float64).reshape(len(drawn), width)
    longer = np.hstack([sample, np.sqrt(np.maximum(radius2 - (sample * sample).sum(1), 0))[:, None]])
    pivots = spark.sparkContext.broadcast(far_apart(longer, PIVOTS))

    def measured(lengthen: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = pivots.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix([batch.column(1)]).astype(np.float64)
                last = np.sqrt(np.maximum(radius2 - (v * v).sum(1), 0)) if lengthen else np.zeros(len(v))
                d2 = (v * v).sum(1)[:, None] + (last * last)[:, None] + (p * p).sum(1) - 2 * (np.matmul(*_alike_t(v, p[:, :-1])) + last[:, None] * p[None, :, -1])
                d = np.sqrt(np.maximum(d2, 0)).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)), pa.array(d.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "d"])

        return run

    n_queries = queries.count()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(LEAST_BLOCKS, -(-total // CANDIDATE_BLOCK))
    out = "vec_id long, v array<bigint>, d array<float>"

    def dealt(df: DataFrame, lengthen: bool, own: str, n: int, other: str, m: int) -> DataFrame:
        table = df.mapInArrow(measured(lengthen), out)
        return table.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("side", F.lit(int(lengthen)))

    both = dealt(queries, False, "qb", q_blocks, "cb", c_blocks).unionByName(dealt(candidates, True, "cb", c_blocks, "qb", q_blocks))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {0: ([], [], []), 1: ([], [], [])}

        def finished() -> pa.RecordBatch:
            out_q, out_c, out_s = [], [], []
            if held[0][0] and held[1][0]:
                (qi, q, qd), (ci, c, cd) = ((np.concatenate(held[s][0]), _matrix(held[s][1]), np.concatenate(held[s][2])) for s in (0, 1))
                for i, ids, scores in best(qi, *_alike(q, c)[:1], qd, ci, *_alike(q, c)[1:], cd, radius2, k):
                    out_q.append(np.full(len(ids), i, np.int64))
                    out_c.append(ids)
                    out_s.append(scores)
            cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cat(x)) for x in (out_q, out_c, out_s)], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            qb, cb, side = (np.asarray(batch.column(batch.schema.get_field_index(n))) for n in ("qb", "cb", "side"))
            ids, v, d = (batch.column(batch.schema.get_field_index(n)) for n in ("vec_id", "v", "d"))
            ids, d = np.asarray(ids), _matrix([d]).astype(np.float32)
            change = np.flatnonzero(np.concatenate([[True], (qb[1:] != qb[:-1]) | (cb[1:] != cb[:-1]) | (side[1:] != side[:-1])]))
            for a, b in zip(change, [*change[1:], len(ids)], strict=True):
                if (qb[a], cb[a]) != key:
                    if key is not None:
                        yield finished()
                    key, held = (qb[a], cb[a]), {0: ([], [], []), 1: ([], [], [])}
                for store, x in zip(held[int(side[a])], (ids[a:b], v.slice(a, b - a), d[a:b]), strict=True):
                    store.append(x)
        if key is not None:
            yield finished()

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = both.select("qb", "cb", "side", "vec_id", "v", "d").repartition(n_parts, "qb", "cb").sortWithinPartitions("qb", "cb", "side", "vec_id")
    found = tasks.mapInArrow(pairs, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
