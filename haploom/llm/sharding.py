"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by leading bits of a hash of id and text. It starts
with one bucket; only buckets over the byte limit split on another bit, until
every bucket fits. Buckets are decided on sums by hash prefix, not on rows:
rows are added up by their next ``STEP`` bits (with partial aggregates), those
sums by all shorter prefixes, and a prefix is a shard if it fits while its
parent doesn't. What is still too large then goes on with the bits that follow.
Rows find their shard by their own bits.

Rows that are alike in id and text are alike in all ``HASH_BITS`` bits. If they
exceed the limit, they are dealt to parts of as many rows as fit, whichever
these are; they are counted out in salted runs, so there may be any number, and only a run's last part is smaller. A
single row over the limit is a shard or a part of its own.

Defined cases: a null text counts as empty and an empty text as 0 bytes; null
ids hash as the empty string; texts may be of any length; repeated rows hash
alike and go to one bucket while it fits; an empty table gives no rows; extra
columns are left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

LIMIT_BYTES = 16 << 20
HASH_BITS, STEP = 60, 24
#: Alike rows are counted out in salted runs of so many full parts each.
RUN = 8


def _prefix(h: Column, bits: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - bits).cast("int"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """bits, prefix, shard_bytes, shard_rows of every shard; ``rows`` has _h and _bytes.

    A shard of all bits may exceed the limit, if its rows are alike.
    """
    parts, low, left = [], 0, rows.select("_h", "_bytes")
    while True:
        high = min(low + STEP, HASH_BITS)
        fine = left.select(_prefix(F.col("_h"), F.lit(high)).alias("fine"), "_bytes").groupBy("fine").agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        levels = fine.select("fine", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("bits"))
        shift = (F.lit(high) - F.col("bits")).cast("int")
        sums = levels.withColumn("prefix", F.call_function("shiftright", F.col("fine"), shift)).groupBy("bits", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        over = sums.where((F.col("bytes") > limit) & (F.col("n") > 1)).select("bits", "prefix")
        # the children of buckets that are too large, and where this round began
        children = over.where(F.col("bits") < high).select((F.col("bits") + 1).alias("bits"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        first = sums.where((F.col("bits") == low) & F.lit(low == 0)).select("bits", "prefix")
        made = cut(sums.join(children.union(first), ["bits", "prefix"]))
        fits = (F.col("bytes") <= limit) | (F.col("n") == 1)
        parts.append(made.where(fits | (F.col("bits") == HASH_BITS)).select("bits", "prefix", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows")))
        rest = made.where(~fits & (F.col("bits") == high)).select("prefix")
        if high == HASH_BITS or rest.isEmpty():
            break
        left = left.withColumn("prefix", _prefix(F.col("_h"), F.lit(high))).join(rest, "prefix", "left_semi").drop("prefix")
        low = high
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (the input row as a struct), n_bytes, shard (its bits as text, "" for the only one), part, shard_bytes, shard_rows (of the part, if there are parts)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(t)))
    rows = docs.select(F.struct("*").alias("row"), F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("_h"), F.octet_length(t).cast("long").alias("_bytes"))
    table = directory(rows, limit)
    # each row's shard is the one of its prefixes that the directory has: one equality join for each depth in use
    depths = sorted(r[0] for r in table.select("bits").distinct().collect())  # HASH_BITS + 1 at most
    probes = rows.withColumn("bits", F.explode(F.array(*[F.lit(d) for d in depths or [0]]))).withColumn("prefix", _prefix(F.col("_h"), F.col("bits")))
    name = F.when(F.col("bits") > 0, F.lpad(F.bin("prefix"), F.col("bits"), F.lit("0"))).otherwise(F.lit("")).alias("shard")
    found = probes.join(table, ["bits", "prefix"])
    out = ["row", F.col("_bytes").alias("n_bytes"), name, "part", "shard_bytes", "shard_rows"]
    full = (F.col("bits") == HASH_BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    whole = found.where(~full).withColumn("part", F.lit(0).cast("long")).select(*out)
    if HASH_BITS not in depths:
        return whole
    per = F.greatest(F.floor(F.lit(limit) / F.col("_bytes")), F.lit(1))
    salts = F.greatest(F.floor(F.col("shard_rows") / (per * RUN)), F.lit(1))
    salted = found.where(full).withColumn("_per", per).withColumn("_salts", salts).withColumn("_s", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts")))
    place = F.row_number().over(Window.partitionBy("prefix", "_s").orderBy("_h")) - 1
    dealt = salted.withColumn("part", (F.col("_s") + F.floor(place / F.col("_per")) * F.col("_salts")).cast("long"))
    own = F.count(F.lit(1)).over(Window.partitionBy("prefix", "_s", "part"))
    return whole.union(dealt.withColumn("shard_rows", own).withColumn("shard_bytes", own * F.col("_bytes")).select(*out))
