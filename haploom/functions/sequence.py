"""Column functions on CIGAR strings, sequences, alignments and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    n = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), 1), lambda x: x.cast("long"))
    op = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), 1)
    return F.zip_with(n, op, lambda a, b: F.struct(a.alias("n"), b.alias("op")))


def _total(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda s, x: s + F.when(F.contains(F.lit(kinds), x["op"]), x["n"]).otherwise(0))


def cigar_span(cigar: Column, start: Column, reverse: Column) -> Column:
    """struct<ref_end, query_start, query_end, query_length>; query coordinates follow the read's own strand."""
    ops = cigar_ops(cigar)
    clip = lambda at: F.when(F.element_at(ops, at)["op"].isin("S", "H"), F.element_at(ops, at)["n"]).otherwise(0)
    length = _total(ops, "MIS=XH")
    used = _total(ops, "MI=X")
    before = F.when(F.size(ops) > 0, clip(1)).otherwise(0)
    begin = F.when(reverse, length - before - used).otherwise(before)
    return F.struct((start + _total(ops, "MD=X")).alias("ref_end"), begin.alias("query_start"), (begin + used).alias("query_end"), length.alias("query_length"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def flipped(strand: Column) -> Column:
    return F.translate(strand, "+-", "-+")


def inner_gap_runs(aligned: Column, least: int) -> Column:
    """Lengths of the gap runs of ``least`` or more that touch neither end."""
    inner = F.regexp_replace(F.regexp_replace(aligned, "^-+", ""), "-+$", "")
    return F.filter(F.transform(F.regexp_extract_all(inner, F.lit("(-+)"), 1), F.length), lambda n: n >= least)


def three_digits(x: Column) -> Column:
    """Text of a number: below 1 cut after three digits from the first that isn't 0, else rounded to two places."""
    places = F.regexp_instr(F.format_string("%.30f", x), F.lit("[1-9]")) - 2
    small = F.substring(F.format_string("%.30f", x), F.lit(1), F.least(places, F.lit(28)) + 4)
    return F.when(x == 0, F.lit("0.000")).when(x < 1, small).otherwise(F.format_string("%.2f", x))


def pileup_tokens(bases: Column) -> Column:
    """Read-base tokens of a pileup string, without starts, ends and indels: "M" for a base, "S" for a gap or skip.

    Indels are length-prefixed, so the string is walked once, with the number
    of characters left to skip as state.
    """
    chars = F.split(bases, "")

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        # mode 0: bases; 1: after ^; 2: reading a length; 3: inside an indel
        inside = (acc["mode"] == 3) & (acc["left"] > 0)
        ended = (acc["mode"] == 2) & ~digit
        return (
            F.when(acc["mode"] == 1, F.struct(F.lit(0).alias("mode"), F.lit(0).alias("left"), acc["out"].alias("out")))
            .when((acc["mode"] == 2) & digit, F.struct(F.lit(2).alias("mode"), (acc["left"] * 10 + c.try_cast("int")).alias("left"), acc["out"].alias("out")))
            .when(ended | inside, F.struct(F.when(acc["left"] > 1, 3).otherwise(0).alias("mode"), (acc["left"] - 1).alias("left"), acc["out"].alias("out")))
            .when(c == "^", F.struct(F.lit(1).alias("mode"), F.lit(0).alias("left"), acc["out"].alias("out")))
            .when(c == "$", F.struct(F.lit(0).alias("mode"), F.lit(0).alias("left"), acc["out"].alias("out")))
            .when(c.isin("+", "-"), F.struct(F.lit(2).alias("mode"), F.lit(0).alias("left"), acc["out"].alias("out")))
            .otherwise(F.struct(F.lit(0).alias("mode"), F.lit(0).alias("left"), F.concat(acc["out"], F.when(c.rlike("[<>*#]"), "S").otherwise("M")).alias("out")))
        )

    zero = F.struct(F.lit(0).alias("mode"), F.lit(0).alias("left"), F.lit("").alias("out"))
    return F.when(F.length(bases) > 0, F.aggregate(chars, zero, step, lambda a: a["out"])).otherwise(F.lit(""))


def pileup_indels(bases: Column) -> Column:
    """Signs of the indels of a pileup string, in order."""
    return F.array_join(F.regexp_extract_all(bases, F.lit(r"([+-])\d+"), 1), "")


def aligned_blocks(cigar: Column, start: Column) -> Column:
    """array<struct<ref, query, n>> of the gapless blocks of an alignment; both places count from 0, the query's with soft clips."""

    def step(acc: Column, x: Column) -> Column:
        both, ref, query = (F.contains(F.lit(kinds), x["op"]) for kinds in ("M=X", "M=XDN", "M=XIS"))
        block = F.array(F.struct(acc["ref"].alias("ref"), acc["query"].alias("query"), x["n"].alias("n")))
        return F.struct(
            (acc["ref"] + F.when(ref, x["n"]).otherwise(0)).alias("ref"),
            (acc["query"] + F.when(query, x["n"]).otherwise(0)).alias("query"),
            F.when(both, F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(start.cast("long").alias("ref"), F.lit(0).cast("long").alias("query"), F.array().cast("array<struct<ref:bigint,query:bigint,n:bigint>>").alias("out"))
    return F.aggregate(cigar_ops(cigar), zero, step, lambda acc: acc["out"])


def _part(s: Column, begin: Column, end: Column) -> Column:
    """Characters ``begin`` (from 0) to before ``end``; what lies outside the string is left out."""
    begin = F.greatest(begin, F.lit(0))
    return F.substring(s, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def patched(parent: Column, start: Column, end: Column, changes: Column) -> Column:
    """``parent`` from ``start`` to before ``end`` with ``changes`` (sorted array<struct<pos, base>>, positions from 0) put in."""
    inner = F.filter(changes, lambda x: (x["pos"] >= start) & (x["pos"] < end))

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(inner, i - 1)["pos"] + 1).otherwise(start)
        return F.concat(_part(parent, before, x["pos"]), x["base"])

    rest = F.when(F.size(inner) > 0, F.element_at(inner, -1)["pos"] + 1).otherwise(start)
    return F.concat(F.array_join(F.transform(inner, piece), ""), _part(parent, rest, end))


def child_sequence(parent: Column, consensus: Column, start: Column, end: Column, left: Column, right: Column, fill: Column) -> Column:
    """A new segment's sequence between ``left`` and ``right``, of a consensus that lies from ``start`` to ``end`` on its parent.

    With ``fill``, what the consensus lacks on the left comes from the parent; an empty result is "A".
    """
    longer = F.length(consensus) - (end - start)
    stop = right - start + longer + 1
    filled = F.concat(_part(parent, left, start), _part(consensus, F.lit(0), stop))
    out = F.when(fill & (start > left), filled).otherwise(_part(consensus, left - start, stop))
    return F.when(F.length(out) > 0, out).otherwise(F.lit("A"))


def link_orients(side: Column, strand: Column) -> Column:
    """struct<from_orient, to_orient> of a link that a clipped read shows: clipped on the right or left, going on along a strand."""
    right = side == "R"
    return F.struct(F.when(right, "+").otherwise("-").alias("from_orient"), F.when(right, strand).otherwise(flipped(strand)).alias("to_orient"))


def pileup_reads(bases: Column) -> Column:
    """struct<tokens, indels> of a pileup string.

    ``tokens`` has a character for each read (its base as written, or "*" for a
    gap or skip), ``indels`` is array<struct<at, sign, seq>>, ``at`` being the
    place of the read (from 0).
    """
    none = F.array().cast("array<struct<at:int,sign:string,seq:string>>")

    def state(mode, left, tokens, indels, sign=None, seq=None) -> Column:
        sign, seq = F.lit("") if sign is None else sign, F.lit("") if seq is None else seq
        mode, left = (x if isinstance(x, Column) else F.lit(x) for x in (mode, left))
        return F.struct(mode.alias("mode"), left.cast("int").alias("left"), tokens.alias("tokens"), indels.alias("indels"), sign.alias("sign"), seq.alias("seq"))

    def step(acc: Column, c: Column) -> Column:
        t, d = acc["tokens"], acc["indels"]
        digit = c.rlike("[0-9]")
        # mode 0: bases; 1: after ^; 2: reading a length; 3: inside an indel
        inside = ((acc["mode"] == 2) & ~digit) | (acc["mode"] == 3)
        seq = F.concat(acc["seq"], c)
        done = acc["left"] <= 1
        more = F.concat(d, F.array(F.struct((F.length(t) - 1).alias("at"), acc["sign"].alias("sign"), seq.alias("seq"))))
        return (
            F.when(acc["mode"] == 1, state(0, 0, t, d))
            .when((acc["mode"] == 2) & digit, state(2, acc["left"] * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), t, d, acc["sign"]))
            .when(inside, state(F.when(done, 0).otherwise(3), acc["left"] - 1, t, F.when(done, more).otherwise(d), acc["sign"], seq))
            .when(c == "^", state(1, 0, t, d))
            .when(c == "$", state(0, 0, t, d))
            .when(c.isin("+", "-"), state(2, 0, t, d, c))
            .otherwise(state(0, 0, F.concat(t, F.when(c.rlike("[<>*#]"), "*").otherwise(c)), d))
        )

    out = F.aggregate(F.split(bases, ""), state(0, 0, F.lit(""), none), step, lambda a: F.struct(a["tokens"].alias("tokens"), a["indels"].alias("indels")))
    return F.when(F.length(bases) > 0, out).otherwise(F.struct(F.lit("").alias("tokens"), none.alias("indels")))


#: Colours at equal steps along a scale from dark violet to yellow, as red, green, blue.
SCALE = [(68, 1, 84), (71, 44, 122), (59, 81, 139), (44, 113, 142), (33, 144, 141), (39, 173, 129), (92, 200, 99), (170, 220, 50), (253, 231, 37)]
#: Fixed value: the colour of reads without a cluster.
GREY = "#505050"


def colour(rank: Column, n: Column) -> Column:
    """Hex colour of rank 1 to ``n`` on the scale, between its steps by proportion; grey without a rank."""
    at = (rank - 1) / F.greatest(n - 1, F.lit(1)) * (len(SCALE) - 1)
    low = F.least(F.floor(at), F.lit(len(SCALE) - 2)).cast("int")

    def channel(k: int) -> Column:
        scale = F.array(*[F.lit(c[k]) for c in SCALE])
        a, b = F.get(scale, low), F.get(scale, low + 1)
        return F.lpad(F.lower(F.hex(F.round(a + (b - a) * (at - low)).cast("int"))), 2, "0")

    return F.when(rank.isNull(), F.lit(GREY)).otherwise(F.concat(F.lit("#"), channel(0), channel(1), channel(2)))


def bases_before(gapped: Column) -> Column:
    """For each place of an aligned sequence, the number of its bases up to there, gaps ("-") left out: the place without gaps."""
    upto = lambda i: F.length(F.replace(F.substring(gapped, F.lit(1), i), F.lit("-"), F.lit("")))
    return F.when(F.length(gapped) > 0, F.transform(F.sequence(F.lit(1), F.length(gapped)), upto)).otherwise(F.array().cast("array<int>"))
