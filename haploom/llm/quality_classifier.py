"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is cut into pieces that are compressed once with each dictionary. The
difference of the two compressed sizes over their sum says which kind of text
it resembles: for the whole text, and for its pieces, of which the least, the
lower quartile and the median count. A logistic curve over these normalised
differences, and nothing else, turns them into a probability.

What is fitted comes from bounded samples of labelled rows: the first
``DICT_ROWS`` rows of each label, at most half of them, for the dictionaries,
and the next ``FIT_ROWS`` of each label for the curve, in the order of the
crc32 of their id, since rows that made the dictionaries compress too well.
Their texts are taken whole; a row with which a sample would have more than
``SAMPLE_BYTES`` is left out of it. The curve's rows are weighted back to the
labels' true shares, which are counted over all labelled rows. Everything else
is one pass over whole texts without a shuffle.

Defined cases: null texts count as empty and get the score of an empty text;
texts may be of any length; a null id isn't held out, and isn't learned from;
without labelled rows of both kinds, or of texts for them, every score is 0.5; a row that is labelled
more than once takes its smallest label; labels other than 0 and 1 are left out; repeated ids are scored
row by row; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICT_ROWS, DICT_BYTES = 2000, 112_640
FIT_ROWS = 4000
SAMPLE_BYTES = 64 << 20
PIECE, LEVEL = 256, 3
QUANTILES = (0.0, 0.25, 0.5)
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pieces(text: str) -> list[bytes]:
    b = text.encode("utf-8", "replace")
    return [b[i : i + PIECE] for i in range(0, len(b), PIECE)]


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few pieces: their own text serves as dictionary
        return b"".join(pieces)[-DICT_BYTES:]


class Sizes:
    """Compressed sizes of a text by both dictionaries."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        self.compressors = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (bad, good)]

    def features(self, text: str) -> tuple[float, ...]:
        """Normalised difference of sizes of the whole text, and quantiles of those of its pieces."""
        pieces = _pieces(text)
        if not pieces:
            return (0.0,) * (1 + len(QUANTILES))
        bad, good = (np.array([len(c.compress(p)) for p in pieces], float) for c in self.compressors)
        whole = (bad.sum() - good.sum()) / (bad.sum() + good.sum())
        return (whole, *np.quantile((bad - good) / (bad + good), QUANTILES))


class Model(NamedTuple):
    """What a score needs: the dictionaries, and the curve's centre, scale and weights."""

    bad: bytes
    good: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(_design(x, self.mean, self.scale) @ self.weights)


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -4, 4)
    return np.hstack([np.ones((len(z), 1)), z, z * z, z**3 / 4])


def fit_curve(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 60, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a ridge logistic regression of rows that count by their ``share`` (in sum 1), by damped Newton steps."""
    mean = share @ x
    scale = np.sqrt(share @ (x - mean) ** 2) + 1e-9
    z = _design(x, mean, scale)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = _logistic(z @ w)
        step = np.linalg.solve((z.T * (share * p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (share * (y - p)) - ridge * w)
        w += step * min(1.0, 2 / max(1e-12, float(np.abs(step).max())))
    return mean, scale, w


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """The model of the labelled rows that aren't held out; None without both labels."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("at", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    spark = docs.sparkSession

    def texts_of(ids: list[int]) -> DataFrame:
        table = spark.sql("SELECT explode(from_json(:ids, 'array<bigint>')) AS doc_id", args={"ids": str(list(ids))})
        return docs.join(F.broadcast(table), "doc_id")  # at most 2 * (DICT_ROWS + FIT_ROWS) ids

    def chosen(y: int) -> list[int]:
        """The first ids of a label: every task sorts out its own before they meet."""
        return [r[0] for r in known.where(F.col("y") == y).orderBy("at", "doc_id").limit(DICT_ROWS + FIT_ROWS).select("doc_id").collect()]

    dealt = {y: chosen(y) for y in (0, 1)}
    bytes_of = {r[0]: r[1] for r in texts_of(dealt[0] + dealt[1]).groupBy("doc_id").agg(F.sum(F.octet_length("text"))).collect()}

    def within(ids: list[int]) -> list[int]:
        out, left = [], SAMPLE_BYTES
        for i in ids:
            if (bytes_of.get(i) or 0) <= left:
                out.append(i)
                left -= bytes_of.get(i) or 0
        return out

    halves = {y: min(DICT_ROWS, (rows.get(y, 0) + 1) // 2) for y in (0, 1)}
    pieces = {0: [], 1: []}
    for y, ids in dealt.items():
        for r in sorted(r[0] or "" for r in texts_of(within(ids[: halves[y]])).select("text").collect()):  # SAMPLE_BYTES at most
            pieces[y] += _pieces(r)
    if not pieces[0] or not pieces[1]:
        return None
    model = Model(_dictionary(pieces[0]), _dictionary(pieces[1]), np.zeros(0), np.zeros(0), np.zeros(0))
    dictionaries = spark.sparkContext.broadcast((model.bad, model.good))
    names = [f"x{k}" for k in range(1 + len(QUANTILES))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*dictionaries.value)
        for batch in batches:
            x = [sizes.features(v.as_py() or "") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in x], pa.float64()) for k in range(len(names)))], ["doc_id", *names])

    truth = {i: y for y, ids in dealt.items() for i in ids[halves[y] :][:FIT_ROWS] or ids}
    sample = sorted(tuple(r) for r in texts_of(list(truth)).mapInArrow(measure, "doc_id long, " + ", ".join(f"{n} double" for n in names)).collect())
    y = np.array([truth[r[0]] for r in sample], float)
    if len(set(y)) < 2:
        return None
    share = np.array([rows[truth[r[0]]] / (y == truth[r[0]]).sum() for r in sample])
    return Model(model.bad, model.good, *fit_curve(np.array([r[1:] for r in sample]), y, share / share.sum()))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Labels are learned only from rows that aren't held out; a score depends on the text alone.
    """
    model = fit(docs, labels, doc_id, text, label)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizes = Sizes(own.bad, own.good)
        for batch in batches:
            x = np.array([sizes.features(v.as_py() or "") for v in batch.column(1)]).reshape(-1, 1 + len(QUANTILES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.probability(x), pa.float64())], ["doc_id", "score"])

    rated = rows.mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
