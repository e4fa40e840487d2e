"""Mixing sources to target weights, with DataFrame functions only.

A source's share of all tokens is raised to an exponent and the powers are
normalised to weights. The exponent, between 0 (all sources alike) and 1 (as
they are), is found by bisection: the smallest at which no source repeats more
than ``max_repeats`` times, or at which the entropy of the weights has come
down to ``target_entropy`` (a share of the highest possible, ln of the number
of sources). Five halvings are taken at once: one aggregate over the sources'
totals gives the sums at all exponents that these can ask for, so there may be
any number of sources. A source's budget is its weight times the token budget,
and one token at least, which is one document.

Budgets are realised as block permutations: every epoch of a source is a
permutation of its documents by a hash of epoch and id, and documents are taken from
the epochs in turn until the budget is spent; the output falls into blocks, each of which
holds every source's share of the block's tokens.

Running sums over a permutation are taken in two steps, inside ranges of the
hash and over the ranges; their number grows with the source's tokens, so one
source may hold any share of the rows. The ranges don't affect the result.

Defined cases: a null source is a source of its own, the empty name; a null
text counts as empty; a document counts one token more than it has words, so
that none is free; repeated ids are rows of their own; an empty table gives no
rows; texts may be of any length, they are only counted; extra columns are
left to the caller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, word_count

#: Halvings of the exponent's range, so many of them at once.
ROUNDS, AT_ONCE = 40, 5
#: More sources than these aren't broadcast.
FEW_SOURCES = 100_000
#: A source's permutation hash is dealt into ranges of about so many tokens, at least ``RANGES`` of them.
RANGE_TOKENS, RANGES = 1 << 22, 256
HASH = 1 << 32


def weights(totals: DataFrame, budget: int | None, max_repeats: float | None, target_entropy: float | None) -> DataFrame:
    """source, tokens, exponent, weight, budget of each source; ``totals`` has source and tokens, one row a source.

    Without a budget it is the smallest at which every document of every source is taken once.
    Only sums over the sources come to the driver.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")
    sources, total, least, most = totals.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not sources:
        return totals.select("source", "tokens", F.lit(0.0).alias("exponent"), F.lit(1.0).alias("weight"), F.col("tokens").alias("budget"))
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(total)))

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """Sum of the powers p^a, and of p^a ln p, at each exponent a."""
        power = [F.pow("p", F.lit(a)) for a in exponents]
        row = shares.agg(*[F.sum(x).alias(f"z{k}") for k, x in enumerate(power)], *[F.sum(x * F.log("p")).alias(f"s{k}") for k, x in enumerate(power)]).first()
        return [(row[k], row[k + len(exponents)]) for k in range(len(exponents))]

    def too_flat(a: float, z: float, s: float) -> bool:
        """Whether the exponent must grow; the smallest source repeats most."""
        if target_entropy is not None:
            return math.log(z) - a * s / z > target_entropy * math.log(sources)
        if budget is None:
            return (least / most) ** (a - 1) > max_repeats
        return (least / total) ** (a - 1) / z * (budget / total) > max_repeats

    low, exponent, width = 0.0, 0.0, 1.0
    if too_flat(0.0, *sums([0.0])[0]):
        for _ in range(0, ROUNDS, AT_ONCE):
            width /= 1 << AT_ONCE
            points = [low + width * k for k in range(1, 1 << AT_ONCE)]
            up = sum(too_flat(a, z, s) for a, (z, s) in zip(points, sums(points), strict=True))  # falls with the exponent
            low += width * up
        exponent = low + width
    norm = sums([exponent])[0][0]
    each = shares.withColumn("exponent", F.lit(exponent)).withColumn("weight", F.pow("p", F.lit(exponent)) / F.lit(norm))
    if budget is not None:
        amount = F.greatest(F.floor(F.col("weight") * F.lit(float(budget))).cast("long"), F.lit(1).cast("long"))
    else:
        spend = each.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
        amount = F.greatest(F.floor(F.col("weight") * F.lit(spend) + 0.5).cast("long"), F.col("tokens"))
    return each.select("source", "tokens", "exponent", "weight", amount.alias("budget"))


def _hash(epoch: Column) -> Column:
    """32 bits that order an epoch's permutation."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", epoch.cast("string"), F.col("_id").cast("string"), F.col("_t"))), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, budget: int | None = None, max_repeats: float | None = 2.0, target_entropy: float | None = None, block_tokens: int = 1 << 20, whole_budget: bool = False, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """row (the input row as a struct), source, epoch, block, tokens: one row for each time a document is taken.

    ``whole_budget`` takes the number of all tokens as the budget.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), (word_count(F.col(text)) + 1).alias("tokens"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_t"))
    totals = cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    if whole_budget:
        budget = totals.agg(F.sum("tokens")).first()[0] or 0
    plan = cut(weights(totals, budget, max_repeats, target_entropy).select("source", F.col("tokens").alias("_total"), F.col("budget").alias("_budget")))
    sources, spend = plan.agg(F.count(F.lit(1)), F.sum("_budget")).first()
    plan = plan.withColumn("_blocks", F.lit(max(1, math.ceil((spend or 0) / block_tokens))))
    taken = rows.join(F.broadcast(plan) if sources <= FEW_SOURCES else plan, "source")
    epochs = taken.where("_budget > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_budget") - 1) / F.col("_total")))))
    ranges = F.least(F.greatest(F.ceil(F.col("_total") / RANGE_TOKENS), F.lit(RANGES)), F.lit(1 << 30)).cast("long")
    placed = epochs.withColumn("_h", _hash(F.col("epoch"))).withColumn("_range", F.floor(F.col("_h") * ranges / HASH).cast("int"))
    slim = placed.select("source", "epoch", "_range", "tokens")
    sums = slim.groupBy("source", "epoch", "_range").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source", "epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "epoch", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "epoch", "_range").orderBy("_h", "_id", "_t").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("_at", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["source", "epoch", "_range"])
    spent = at.withColumn("_spent", F.col("epoch") * F.col("_total") + F.col("_before") + F.col("_at")).where("_spent < _budget")
    block = F.floor(F.col("_spent") * F.col("_blocks") / F.col("_budget")).cast("long")
    return spent.select("row", "source", "epoch", block.alias("block"), "tokens")
