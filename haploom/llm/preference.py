"""Preference formatting, with DataFrame functions only.

The chosen and the rejected conversation of a pair are compared turn by turn;
their longest common prefix is rendered once as the prompt, what follows in
either as its completion. Completions come with masks: runs of characters that
are trained on (the text of assistant turns and the end mark) and that aren't.

Defined cases: null roles and texts count as empty; turns are ordered by
number (null first), then role and text, so ties and repeated rows have one
order; texts may be of any length; turns without a pair's id are one pair without an id on each side, which don't meet; an empty table gives no rows; pairs
that lack one side have an empty other side; if one conversation is a prefix of the
other, or both are alike, the prompt is that prefix and a completion is empty; extra
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
#: Conversations among which replies are swapped.
DEAL = 1024


def _turns(turns: DataFrame, pair_id: str, side: str) -> DataFrame:
    one = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    said = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return turns.groupBy(F.col(pair_id).alias("pair_id")).agg(said.alias(side))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Runs as "skipped+trained" lengths, one for each turn, joined by commas."""

    def run(turn: Column) -> Column:
        head = F.length(F.concat(F.lit(START), turn["role"], F.lit(MIDDLE)))
        rest = F.length(turn["text"]) + len(END)
        own = turn["role"] == TRAINED_ROLE
        return F.concat(F.when(own, head).otherwise(head + rest).cast("string"), F.lit("+"), F.when(own, rest).otherwise(0).cast("string"))

    return F.array_join(F.transform(turns, run), ",")


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the beginning that are alike in role and text."""
    first = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: ~F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False)))
    return F.array_min(first)


def pairs(chosen: DataFrame, rejected: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Both inputs have ``pair_id``, turn, role and text, one row for each turn.
    """
    a, b = _turns(chosen, pair_id, "a"), _turns(rejected, pair_id, "b")
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = a.join(b, "pair_id", "full").select("pair_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    n = common_turns(F.col("a"), F.col("b"))
    split = both.withColumn("n", n)
    tail = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    return split.select(
        "pair_id",
        F.col("n").cast("int").alias("n_common"),
        _text(F.slice("a", 1, F.col("n"))).alias("prompt"),
        _text(tail(F.col("a"))).alias("chosen"),
        _text(tail(F.col("b"))).alias("rejected"),
        _mask(tail(F.col("a"))).alias("chosen_mask"),
        _mask(tail(F.col("b"))).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns made from plain conversations.

    Chosen is a conversation up to its last assistant turn; rejected is the same
    with that turn's text taken from another conversation. Conversations with a
    reply are dealt by a hash of their id into groups of about ``DEAL``; in a
    group, ordered by their replies' digests, each takes the reply of one of
    those that follow the replies equal to its own, in a circle. Conversations
    without an id or an assistant turn are left out, and those of a group in
    which all replies are equal, as there is none to reject. A turn without a
    number comes before all others.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("pair_id IS NOT NULL")
    reply = F.max(F.when(F.col("role") == TRAINED_ROLE, F.struct("turn", "text")))
    last = cut(turns.groupBy("pair_id").agg(reply.alias("r")).where("r IS NOT NULL").select("pair_id", F.col("r.turn").alias("last"), F.col("r.text").alias("reply")))
    dealt = F.conv(F.substring(F.md5(F.col("pair_id").cast("string")), 1, 8), 16, 10).cast("long") % max(1, last.count() // DEAL)
    slim = last.select("pair_id", dealt.alias("deal"), F.md5("reply").alias("digest"))
    group, alike = Window.partitionBy("deal"), Window.partitionBy("deal", "digest")
    placed = slim.withColumn("at", F.row_number().over(group.orderBy("digest", "pair_id")) - 1).withColumn("n", F.count(F.lit(1)).over(group))
    placed = cut(placed.withColumn("m", F.count(F.lit(1)).over(alike)).withColumn("first", F.min("at").over(alike)))
    partner = (F.col("first") + F.col("m") + (F.col("at") - F.col("first")) % (F.col("n") - F.col("m"))) % F.col("n")
    wanted = placed.where("n > m").select("pair_id", "deal", partner.cast("int").alias("at"))
    other = wanted.join(placed.select("deal", "at", F.col("pair_id").alias("from")), ["deal", "at"]).select("pair_id", "from")
    replies = last.select(F.col("pair_id").alias("from"), F.col("reply").alias("other"))
    ends = last.select("pair_id", "last").join(other, "pair_id").join(replies, "from").drop("from")
    made = turns.join(ends, "pair_id").where("turn IS NULL OR turn <= last")
    chosen = made.select("pair_id", "turn", "role", "text")
    swapped = F.when(F.col("turn").eqNullSafe(F.col("last")) & (F.col("role") == TRAINED_ROLE), F.col("other")).otherwise(F.col("text"))
    return chosen, made.select("pair_id", "turn", "role", swapped.alias("text"))
