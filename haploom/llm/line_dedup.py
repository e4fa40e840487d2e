"""Line dedup: a segment-partition edit join over distinct lines, with DataFrame functions only.

Distinct lines are split into threshold + 1 segments. Lengths are in bands of
one size of segments; half of a line's segments are placed from its beginning,
the others from its end. Of two lines within the threshold, one has a segment
that the other has unchanged, moved by no more places than there are segments
before it on its side (the multi-match-aware selection), so segments are
indexed by (band, segment number, text), and the few substrings that can match
probe the index. A line near the lower end of its band also stands in the band
below. A segment that may have moved is known by what follows its first blank,
so that most of its places give the same key. Pairs found are verified by a
banded bit-parallel edit distance. Lines linked so, directly or through
others, are one class; of each class the first line in the smallest document
id stays, the others are removed.

A key of more than ``HOT`` lines isn't joined: its lines are taken without the
segment that they share, and what is left of them is split and indexed again
under that key, until no key is hot. Lines that share a long beginning so meet
only those that are nearly alike in the rest. Beyond ``REFINED`` edits that
would make more keys than pairs, and such lines are joined as they are.

With ``BY_LENGTH`` the threshold grows with the shorter line: one edit for 40
characters up to 200, the root of an eighth of the length beyond, so that the
number of keys is in proportion to the text for lines of any length. Families
of versions of one line are then many, so lines are compared with the heads of
their keys first and only with those of other classes after that; see ``classes``.

A line counts without blanks at its ends. Only exact repeats are removed of
lines shorter than ``MIN_CHARS`` characters, for which one edit is another word; lines
without a letter or digit in them stay there. Equal lines are told by 96 bits
of two hashes, linked ones by their texts.

Defined cases: a null text stays null; an empty text and one without lines to
remove stay as they are; texts and lines may be of any length; rows that share an id count as one document, each row keeping
its own first line of a class; a null id comes after all others, and rows with
null ids are one document if their texts are alike; an empty table gives no
rows; extra columns are carried through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haploom.operators.components import components

from .common import BLANKS, cut, delete, let, stored

THRESHOLD = 1
#: Stands for a threshold that grows with the length.
BY_LENGTH = None
#: Lengths at which bands of threshold 1 begin, from MIN_CHARS on.
_SHORT_BANDS = (32, 40, 52, 64)
#: Shorter lines are compared for equality only.
MIN_CHARS = 24
#: Lines of one key that are paired directly; thresholds up to which larger keys are split on.
HOT, REFINED = 256, 3
#: Letters that are counted to sift pairs of lines; for one edit, more of them cost more than they save.
_LETTERS = "ent"
#: Further letters, for thresholds that grow.
_MORE = "aisrould"
#: Letters of the profiles of lines.
_PROFILE = "etanoirsuldhcgmbpfwk.,ETASI"
#: How far into a segment a blank is looked for.
_SLACK = 10


def _line(raw: Column) -> Column:
    """``raw`` without blanks at its ends; trimming a set of characters at the right is costly, so it is done where there are any."""
    blank = F.lit(False)
    for c in BLANKS:
        blank = blank | F.endswith(raw, F.lit(c)) | F.startswith(raw, F.lit(c))
    return F.when(blank, F.btrim(raw, F.lit(BLANKS))).otherwise(raw)


def _lines(rows: DataFrame, short: bool) -> DataFrame:
    """_id, _t, at, line of the lines that may be removed."""
    raw = rows.select("_id", "_t", F.posexplode(F.split("_text", "\n")).alias("at", "raw"))
    long = F.length("line") >= MIN_CHARS
    return raw.select("_id", "_t", "at", _line(F.col("raw")).alias("line")).where(long | F.col("line").rlike(r"[\p{L}\p{N}]") if short else long)


def _known(line: str = "line") -> tuple[Column, Column]:
    """h, g: the hashes by which equal lines are told."""
    return F.xxhash64(line).alias("h"), F.hash(line).alias("g")


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of strings if it is at most ``threshold``, else threshold + 1.

    The band of 2 * threshold + 1 diagonals around the main one is held in the
    low bits of two words (vertical steps of +1 and of -1), moved on by one
    character of ``b`` at a time; ``a`` must not be the shorter one.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1

    def run(x: Column, y: Column) -> Column:
        m, n = F.size(x), F.size(y)

        def step(acc: Column, j: Column) -> Column:
            c = F.get(y, j - 1)
            eq = F.lit(0)
            for r in range(width):  # bit r: row j - threshold + r
                eq = eq + F.when(F.get(x, j - threshold + r - 1) == c, 1 << r).otherwise(0)

            def cell(e: Column) -> Column:
                # diagonal zero steps
                carried = e.bitwiseAND(acc["vp"]) + acc["vp"]
                d0 = carried.bitwiseXOR(acc["vp"]).bitwiseOR(e).bitwiseOR(acc["vn"]).bitwiseAND(F.lit(full))
                return let(d0, lambda z: tail(z))

            def tail(z: Column) -> Column:
                hp = acc["vn"].bitwiseOR(F.bitwise_not(z.bitwiseOR(acc["vp"]))).bitwiseAND(F.lit(full))
                hn = z.bitwiseAND(acc["vp"])
                down = F.shiftright(z, 1)
                vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(full))
                vn = down.bitwiseAND(hp)
                # along the lowest diagonal until row m is reached, along row m from there
                low = F.lit(width - 1)
                along = F.shiftright(z, width - 1).bitwiseAND(F.lit(1))
                row = m - j + threshold  # bit of row m in this column
                flat = F.call_function("shiftright", hp, row).bitwiseAND(F.lit(1)) - F.call_function("shiftright", hn, row).bitwiseAND(F.lit(1))
                grown = F.when(row >= low, F.lit(1) - along).otherwise(flat)
                return F.struct(vp.alias("vp"), vn.alias("vn"), (acc["d"] + grown).alias("d"))

            return let(eq, cell)

        zero = F.struct(F.lit(full ^ ((1 << threshold) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(m, F.lit(threshold)).alias("d"))
        found = F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda acc: acc["d"])
        return F.when(F.abs(m - n) > threshold, F.lit(threshold + 1)).when(n == 0, m).otherwise(F.least(found, F.lit(threshold + 1)))

    return let(F.struct(_chars(a).alias("x"), _chars(b).alias("y")), lambda s: run(s["x"], s["y"]))


def _marks(hashes: DataFrame) -> tuple[DataFrame, int]:
    """(word, bits) of a bitmap in which a bit for each h is set, and the number of bits as a power of two.

    There are sixteen times as many bits as hashes, 2^26 at most: what the bitmap lets through is joined exactly, so that a full one costs time only.
    """
    power = min(26, max(16, math.ceil(math.log2(16 * max(1, hashes.count())))))
    at = F.col("h").bitwiseAND(F.lit((1 << power) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.select(F.shiftright(at, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), power


def _sifted(lines: DataFrame, marks: tuple[DataFrame, int]) -> DataFrame:
    """``lines`` with ``hit``: false if the line's hash is surely not among the marked ones."""
    words, power = marks
    at = F.col("h").bitwiseAND(F.lit((1 << power) - 1))
    bit = F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("long")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    joined = lines.withColumn("word", F.shiftright(at, 6)).join(F.broadcast(words), "word", "left")  # 2^20 words at most
    return joined.withColumn("hit", bit == 1).drop("word", "bits")


def _letters(line: Column, letters: str = _LETTERS) -> Column:
    """A byte with the number of occurrences of each of a few frequent letters."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(letters):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(255)).cast("long"), 8 * k))
    return out


def _apart(x: Column, y: Column, letters: str = _LETTERS) -> Column:
    """By how much the letters' numbers differ at least; an edit changes two of them by one at most."""
    apart = F.lit(0)
    for k in range(len(letters)):
        one, other = (F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255)) for c in (x, y))
        gap = F.abs(one - other)
        apart = apart + F.least(gap, 256 - gap)
    return apart


def allowed(n: Column) -> Column:
    """Edits within which a line of ``n`` characters is linked to a line that isn't shorter, by its length."""
    return F.greatest(F.lit(1), F.least((n / 40).cast("int"), F.sqrt(n / 8).cast("int")))


def _band(n: Column, threshold: int | None) -> Column:
    """low, t: the length from which on lines are in the band of length ``n``, and its threshold."""
    if threshold is not BY_LENGTH:
        wide = 8 * threshold
        return F.struct((n - n % wide).alias("low"), F.lit(threshold).alias("t"))
    first = F.lit(MIN_CHARS)
    for low in _SHORT_BANDS:
        first = F.when(n >= low, low).otherwise(first)
    return let(allowed(n), lambda t: F.struct(F.when(t > 1, F.greatest(40 * t, 8 * t * t)).otherwise(first).alias("low"), t.alias("t")))


def _rest_band(n: Column, t: Column) -> Column:
    """low, t of what is left of a line without a segment."""
    return F.struct((n - n % (t + 1)).alias("low"), t.alias("t"))


def _keys(prefix: Column, line: Column, n: Column, band: Column, places: bool) -> Column:
    """Keys of the line's segments in a band, at all places where they may be found; with ``places`` as structs of key, start, size and t.

    A segment that can't have moved is known by its text. Another one is known
    by the text from its first blank on, if that comes early, so that places
    between two blanks have one key.
    """
    low, t = band["low"], band["t"]
    size = (low / (t + 1)).cast("int")
    slack = F.least(F.lit(_SLACK), (size / 4).cast("int"))

    def key(number: Column, text: Column, start: Column, chars: Column) -> Column:
        hashed = F.xxhash64(prefix, low, number, text)
        return hashed if not places else F.struct(hashed.alias("key"), start.alias("start"), chars.alias("size"), t.alias("t"))

    def segment(number: Column, i: Column, first: Column) -> Column:
        def moved(s: Column) -> Column:
            starts = F.transform(F.sequence(F.lit(1), 2 * i + 1), lambda k: k + F.greatest(F.instr(F.substring(s, k, slack + 1), " ") - 1, F.lit(0)))
            return F.transform(F.array_distinct(starts), lambda p: key(number, F.substring(s, p, size - slack), first + p - 1, size - slack))

        return F.when(i == 0, F.array(key(number, F.substring(line, first, size), first, size))).otherwise(let(F.substring(line, first, size + 2 * i), moved))

    left = F.transform(F.sequence(F.lit(0), (t / 2).cast("int")), lambda i: segment(i, i, i * size - i + 1))
    right = F.transform(F.sequence(F.lit(0), ((t - 1) / 2).cast("int")), lambda i: segment(-1 - i, i, n - (i + 1) * size - i + 1))
    return F.flatten(F.concat(left, right))


def _sign(line: Column) -> Column:
    """Length and letters of a line in one number."""
    return F.shiftleft(F.length(line).cast("long"), 24).bitwiseOR(_letters(line))


def _banded(state: DataFrame, threshold: int | None) -> DataFrame:
    """``state`` of whole lines with their own bands and those below."""
    n = F.length("rest")
    return state.withColumn("own", _band(n, threshold)).withColumn("below", _band(n - F.col("own.t"), threshold))


def _whole(*more: str | Column) -> list[str | Column]:
    """The columns of a state that are the same for all whole lines, and others."""
    return [F.lit(0).cast("long").alias("prefix"), "h", F.lit(0).cast("long").alias("r"), F.col("line").alias("rest"), *more]


def _keys_of(places: bool) -> Column:
    """Keys of a row of ``banded`` in its own band and in the one below."""
    n = F.length("rest")
    kind = "array<struct<key:bigint,start:int,size:int,t:int>>" if places else "array<bigint>"
    lower = F.when(F.col("below.low") < F.col("own.low"), _keys(F.col("prefix"), F.col("rest"), n, F.col("below"), places)).otherwise(F.array().cast(kind))
    return F.concat(_keys(F.col("prefix"), F.col("rest"), n, F.col("own"), places), lower)


def _near(x: Column, y: Column, threshold: int | None, apart: Column | None = None) -> Column:
    """Whether the lengths and letters of two signs allow the threshold; ``apart``: by how much further letters differ."""
    m, k = F.shiftright(x, 24).cast("int"), F.shiftright(y, 24).cast("int")
    limit = allowed(F.least(m, k)) if threshold is BY_LENGTH else F.lit(threshold)
    return (F.abs(m - k) <= limit) & ((_apart(x, y) if apart is None else _apart(x, y) + apart) <= 2 * limit)


def _split_on(split: DataFrame, hot: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, banded) of the lines of hot keys without the segments that they share there."""
    left_over = F.concat(F.expr("substring(rest, 1, start - 1)"), F.expr("substring(rest, start + size)"))
    on = split.join(hot, "key", "left_semi").join(state, ["prefix", "h", "r"])
    carried = [c for c in state.columns if c not in ("prefix", "r", "rest")]
    rest = cut(on.select(F.col("key").alias("prefix"), left_over.alias("rest"), *carried, "t").distinct().withColumn("r", F.xxhash64("rest")))
    n = F.length("rest")
    banded = rest.withColumn("own", _rest_band(n, F.col("t"))).withColumn("below", _rest_band(F.greatest(n - F.col("t"), F.lit(0)), F.col("t")))
    return rest.drop("t"), banded.drop("t")


def _pairs(state: DataFrame, banded: DataFrame, carried: list[str], near: Column) -> DataFrame:
    """Pairs (a, b) of lines that share a key and are ``near``, a condition on ``carried`` columns, of the second line with _b behind their names; hot keys are split on."""
    found = []
    while True:
        split = banded.where(F.col("below.t") <= REFINED).select("prefix", "h", "r", F.inline(_keys_of(True))).where((F.col("t") <= REFINED) & (F.col("size") > 0))
        hot = cut(split.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > HOT).select("key"))
        some = not hot.isEmpty()
        slim = banded.select(F.explode(_keys_of(False)).alias("key"), "h", *carried)
        if some:
            slim = slim.join(hot, "key", "left_anti")
        found.append(cut(_met(slim, carried, near)))
        if not some:
            break
        state, banded = _split_on(split, hot, state)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _met(slim: DataFrame, carried: list[str], near: Column) -> DataFrame:
    """Pairs (a, b), a < b, of rows of one key that are ``near``."""
    first, second = slim.select("key", F.col("h").alias("a"), *carried), slim.select("key", F.col("h").alias("b"), *[F.col(c).alias(f"{c}_b") for c in carried])
    return first.join(second, "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def candidates(lines: DataFrame, threshold: int | None) -> DataFrame:
    """Pairs (a, b), a < b, of hashes of distinct lines that share a key and whose lengths and letters allow the threshold; ``lines`` has h and line."""
    state = lines.select(*_whole(_sign(F.col("line")).alias("sign")))
    return _pairs(state, _banded(state, threshold), ["sign"], _near(F.col("sign"), F.col("sign_b"), threshold))


def _differing(a: Column, b: Column) -> Column:
    """(x, y): the strings without most of what they have in common at both ends, which leaves their distance as it is."""

    def stripped(n: Column, at_end: bool, x: Column, y: Column) -> Column:
        def part(s: Column, c: Column) -> Column:
            return F.substring(s, F.length(s) - c + 1, c) if at_end else F.substring(s, F.lit(1), c)

        cuts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: (n * i / 16).cast("int")))
        return F.array_max(F.filter(cuts, lambda c: part(x, c) == part(y, c)))

    def head(s: Column) -> Column:
        c = stripped(F.length(s["y"]), False, s["x"], s["y"])
        return let(c, lambda k: F.struct(F.substring(s["x"], k + 1, F.length(s["x"])).alias("x"), F.substring(s["y"], k + 1, F.length(s["y"])).alias("y")))

    def tail(s: Column) -> Column:
        c = stripped(F.length(s["y"]), True, s["x"], s["y"])
        return let(c, lambda k: F.struct(F.substring(s["x"], F.lit(1), F.length(s["x"]) - k).alias("x"), F.substring(s["y"], F.lit(1), F.length(s["y"]) - k).alias("y")))

    return let(let(F.struct(a.alias("x"), b.alias("y")), head), tail)


def _verified(pairs: DataFrame, distinct: DataFrame, threshold: int | None) -> DataFrame:
    """Those of the pairs (a, b) of hashes that are within the threshold, as structs of both hashes."""
    ends = cut(_sifted(distinct, _marks(pairs.select(F.explode(F.array("a", "b")).alias("h")))).where("hit").select("h", "g", "line"))
    x, y = (ends.select(F.col("h").alias(k), F.struct("h", "g").alias(f"node_{k}"), F.col("line").alias(f"line_{k}")) for k in "ab")
    longer = F.length("line_a") >= F.length("line_b")
    long, short = F.when(longer, F.col("line_a")).otherwise(F.col("line_b")), F.when(longer, F.col("line_b")).otherwise(F.col("line_a"))

    def apart(s: Column) -> Column:
        if threshold is BY_LENGTH:
            return F.call_function("levenshtein", s["x"], s["y"], s["limit"]) >= 0
        return edit_distance(s["x"], s["y"], threshold) <= threshold

    limit = allowed(F.length(short)) if threshold is BY_LENGTH else F.lit(threshold)
    close = let(_differing(long, short), lambda s: apart({"x": s["x"], "y": s["y"], "limit": limit}))
    return pairs.join(x, "a").join(y, "b").where(close).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def links(distinct: DataFrame, threshold: int | None) -> DataFrame:
    """Pairs (a, b) of the lines within the threshold, as structs of their hashes; ``distinct`` has h, g and line of each line once."""
    return _verified(cut(candidates(distinct, threshold)), distinct, threshold)


def signed(lines: DataFrame, threshold: int | None) -> DataFrame:
    """``lines`` (h, g, line, times) as ``classes`` takes them, which finds their keys itself."""
    return lines.select("h", "g", "line", "times")


def _profile(line: Column) -> list[Column]:
    """Numbers of the occurrences of some letters and of all other characters, as seven bytes of each word; each counts modulo 128."""
    counts = [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit(""))) for x in _PROFILE]
    rest = F.length(line) - sum(counts[1:], counts[0])
    fields = [c.bitwiseAND(F.lit(127)).cast("long") for c in [*counts, rest]]
    words = []
    for seven in (fields[at : at + 7] for at in range(0, len(fields), 7)):
        word = seven[0]
        for k, c in enumerate(seven[1:], 1):
            word = word.bitwiseOR(F.shiftleft(c, 8 * k))
        words.append(word)
    return words


#: Names of the words of a line's profile.
_WORDS = [f"p{k}" for k in range((len(_PROFILE) + 7) // 7)]


def _bytes(value: int) -> Column:
    """A word of seven bytes of that value."""
    return F.lit(sum(value << 8 * k for k in range(7))).cast("long")


def _gaps(x: Column, y: Column) -> Column:
    """The differences of the seven bytes of two words, without their signs, as sums of two in 16 bits each."""
    moved = x.bitwiseOR(_bytes(128)) - y
    below = F.shiftright(moved, 6).bitwiseAND(_bytes(1))
    gap = moved.bitwiseAND(_bytes(127)).bitwiseXOR(F.shiftleft(below, 7) - below) + below
    even = F.lit(0x00FF00FF00FF00FF).cast("long")
    return gap.bitwiseAND(even) + F.shiftright(gap, 8).bitwiseAND(even)


def _outer() -> Column:
    """How many segments stand between a key's and the end of the line that it is counted from."""
    return F.when(F.col("number") >= 0, F.col("number")).otherwise(-1 - F.col("number"))


def _meets(other: str) -> Column:
    """Whether two lines of a key may be within the threshold, by the lengths of what stands before its place in them and from there on.

    Of two lines within t edits, take the first segment of a side, number i from
    the line's end there, that is unchanged and has i edits at most between it
    and that end. Each one before it adds an edit at least, so these are i, and
    t - i at most are left for the other part. If no side had such a segment,
    there would be more than t edits. Lines whose first segments are equal
    meet for these, and those whose last ones are equal not for inner ones.
    """
    mine, its = F.col, lambda c: F.col(c + other)
    limit, outer = F.least(mine("t"), its("t")), _outer()
    sides = []
    for at_end in (False, True):
        moved = F.abs(mine("before") - its("before") if not at_end else mine("n") - mine("before") - its("n") + its("before"))
        sides.append(moved <= F.when((mine("number") < 0) == F.lit(at_end), outer).otherwise(limit - outer))
    again = (mine("number") != 0) & (mine("begin") == its("begin")) | (mine("number") < -1) & (mine("end") == its("end"))
    return (F.abs(mine("n") - its("n")) <= limit) & ~again & sides[0] & sides[1]


def _alike(other: str) -> Column:
    """Whether the letters of two lines allow the threshold; an edit changes two letters' numbers by one, or one of them and the length."""
    mine, its = F.col, lambda c: F.col(c + other)
    words = [_gaps(mine(c), its(c)) for c in _WORDS]
    apart = sum(words[1:], words[0]) % 65535  # the sum of the 16 bits
    return apart + F.abs(mine("n") - its("n")) <= 2 * F.least(mine("t"), its("t"))


def _beside(rows: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` dealt by ``key``, once, and the same with _b behind the other columns' names."""
    dealt = rows.repartition(*key)
    return dealt, dealt.select(*key, *[F.col(c).alias(f"{c}_b") for c in rows.columns if c not in key])


def _linked(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b), as structs of their hashes, between the lines of different classes that meet in ``rows`` (key, h, class and what ``_meets`` takes).

    The lines themselves are compared in the join, so that only links leave it.
    A key's lines are dealt to parts of some ``HOT``, and for every two parts there is a tile.
    """
    parts = F.ceil(F.col("size") / HOT).cast("int")
    tile = lambda k: F.struct((F.least("part", k) * F.col("parts") + F.greatest("part", k)).alias("tile"))
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("h"), "parts").cast("int"))
    dealt = dealt.select("*", F.inline(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), tile)))
    # two lines of one part meet in that part's own tile only, where they have -1
    dealt = dealt.withColumn("part", F.when(F.col("tile") == F.col("part") * (F.col("parts") + 1), -1).otherwise(F.col("part")))
    first, second = _beside(dealt.drop("size", "parts").join(texts, "h"), "key", "tile")
    once = (F.col("part") != F.col("part_b")) | (F.col("part") == -1)
    within = lambda x, y, limit: F.call_function("levenshtein", x, y, limit) >= 0
    end = lambda b: F.expr(f"if(number >= 0, substring(line{b}, 1, before{b}), substring(line{b}, before{b} + 1))")
    # what stands before the key's place, counted from its end, has as many edits as segments; this is short and leaves few lines
    near = F.when(_outer() == 0, F.lit(True)).otherwise(within(end(""), end("_b"), _outer()))
    longer = F.col("n") >= F.col("n_b")
    long, short = F.when(longer, F.col("line")).otherwise(F.col("line_b")), F.when(longer, F.col("line_b")).otherwise(F.col("line"))
    near = near & let(_differing(long, short), lambda s: within(s["x"], s["y"], F.least("t", "t_b")))
    met = first.join(second, ["key", "tile"]).where((F.col("h") < F.col("h_b")) & (F.col("class") != F.col("class_b")) & once & _meets("_b") & _alike("_b") & near)
    return met.select(F.struct("h", "g").alias("a"), F.struct(F.col("h_b").alias("h"), F.col("g_b").alias("g")).alias("b")).distinct()


def _places(lines: DataFrame, *more: str) -> DataFrame:
    """h, number, size, key, before: a row for each key of ``lines`` (h, line) by length, with the size of segments and how many characters stand before its place.

    The keys are those of ``_keys``, found in rows, which are compiled, instead of arrays.
    """
    banded = _banded(lines.select("h", *more, F.col("line").alias("rest")), BY_LENGTH).withColumn("n", F.length("rest"))
    bands = F.when(F.col("below.low") < F.col("own.low"), F.array("own", "below")).otherwise(F.array("own"))
    each = banded.select("h", *more, "rest", "n", F.inline(bands)).withColumn("size", (F.col("low") / (F.col("t") + 1)).cast("int"))
    each = each.withColumn("slack", F.least(F.lit(_SLACK), (F.col("size") / 4).cast("int")))
    each = each.select("*", F.explode(F.sequence(-1 - ((F.col("t") - 1) / 2).cast("int"), (F.col("t") / 2).cast("int"))).alias("number"))
    left = F.col("number") >= 0
    each = each.withColumn("i", F.when(left, F.col("number")).otherwise(-1 - F.col("number")))
    each = each.withColumn("first", F.when(left, F.col("i") * F.col("size") - F.col("i") + 1).otherwise(F.col("n") - (F.col("i") + 1) * F.col("size") - F.col("i") + 1))
    each = each.withColumn("s", F.expr("substring(rest, first, size + 2 * i)")).select("*", F.explode(F.sequence(F.lit(1), 2 * F.col("i") + 1)).alias("k"))
    # a place before a blank that the next place has too gives the same key
    each = each.where("k = 1 OR instr(substring(s, k - 1, slack + 1), ' ') <= 1")
    each = each.withColumn("start", F.expr("if(i = 0, 1, k + greatest(instr(substring(s, k, slack + 1), ' ') - 1, 0))"))
    text = F.expr("if(i = 0, s, substring(s, start, size - slack))")
    key = F.xxhash64(F.lit(0).cast("long"), "low", "number", text)
    return each.select("h", *more, "rest", "n", "number", "size", key.alias("key"), (F.col("first") + F.col("start") - 2).alias("before"))


def classes(distinct: DataFrame, threshold: int | None) -> DataFrame:
    """(node, component) of the lines that are linked by length, directly or through others; ``distinct`` has h, g, line and times of each line once.

    A family of versions of one line would meet in pairs under each key. So each
    line is first compared with the head of each of its keys, the line that
    stands most often, which is one row a line and key. Only keys whose lines
    aren't one class by then go on, and only lines of different classes meet in
    them, with their texts beside them where there are more than ``HOT``; see ``_linked``. Where more than ``HOT`` lines stand outside a key's largest class and
    the threshold is at most ``REFINED``, they are split on by what is left of them.
    """
    times = F.count(F.lit(1)).over(Window.partitionBy("key"))
    # lines that share a key, by one of their hashes: few, so all else is made of these only
    sharing = cut(_places(distinct, "g").select("key", "g").withColumn("n", times).where("n > 1").select(F.col("g").cast("long").alias("h")).distinct())
    named = distinct.select(F.col("g").cast("long").alias("h"), F.struct("h", "g", "line", "times").alias("row"))
    those = cut(_sifted(named, _marks(sharing)).where("hit").select("row.*"))
    ends = [F.xxhash64(F.expr(x)).alias(name) for name, x in (("begin", "substring(rest, 1, size)"), ("end", "substring(rest, n - size + 1, size)"))]
    shared = cut(_places(those, "times").select("key", "h", "times", "n", allowed(F.col("n")).alias("t"), "number", "before", *ends).withColumn("size", times).where("size > 1").drop("size"))
    profile = [word.alias(name) for name, word in zip(_WORDS, _profile(F.col("line")), strict=True)]
    distinct = cut(those.join(shared.select("h").distinct(), "h", "left_semi").select("h", "g", "line", *profile))
    words = distinct.select("h", *_WORDS)
    rank = F.shiftleft(F.least(F.col("times"), F.lit(32767)), 48).bitwiseOR(F.shiftrightunsigned("h", 16))
    carried = ["n", "t", "number", "before", "begin", "end"]
    heads = shared.groupBy("key").agg(*[F.max_by(c, rank).alias(f"{c}_head") for c in ("h", *carried)])
    stars = shared.join(heads, "key").where((F.col("h") != F.col("h_head")) & _meets("_head")).select("h", "n", "t", "h_head", "n_head", "t_head").distinct()
    head_words = words.select(*[F.col(c).alias(f"{c}_head") for c in words.columns])
    stars = cut(stars.join(words, "h").join(head_words, "h_head").where(_alike("_head")).select(F.col("h_head").alias("a"), F.col("h").alias("b")))
    known = cut(components(_verified(stars, distinct, threshold)))
    named = known.select(F.col("node.h").alias("h"), F.col("component.h").alias("class"))
    classed = cut(shared.drop("times").join(named, "h", "left").withColumn("class", F.coalesce("class", "h")))
    sizes = classed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("top")).where("n > top")
    still = cut(sizes.select("key", F.col("n").alias("size"), (F.col("n") - F.col("top") > HOT).alias("hot")))
    apart = F.col("class") != F.col("class_b")
    open_keys, hot = classed.join(still.drop("hot"), "key"), still.where("hot").select("key")
    pairs = None
    if not hot.isEmpty():
        # the lines of hot keys, with their classes, and where the keys stand in them
        members = cut(classed.join(hot, "key", "left_semi").select("h", "class").distinct())
        signs = (_sign(F.col("line")).alias("sign"), _letters(F.col("line"), _MORE).alias("letters"))
        whole = distinct.join(members, "h").select(*_whole(*signs, "class"))
        few = _banded(whole, threshold).where(F.col("below.t") <= REFINED)
        split = cut(few.select("prefix", "h", "r", F.inline(_keys_of(True))).where((F.col("t") <= REFINED) & (F.col("size") > 0)).join(hot, "key", "left_semi"))
        refined = split.select("key").distinct()
        open_keys = open_keys.join(refined, "key", "left_anti")
        if not split.isEmpty():
            near = _near(F.col("sign"), F.col("sign_b"), threshold, _apart(F.col("letters"), F.col("letters_b"), _MORE))
            pairs = _pairs(*_split_on(split, refined, whole), ["sign", "letters", "class"], near & apart)
    open_keys = cut(open_keys)
    first, second = _beside(open_keys.where(F.col("size") <= HOT).drop("size").join(words, "h"), "key")
    met = first.join(second, "key").where((F.col("h") < F.col("h_b")) & apart & _meets("_b") & _alike("_b")).select(F.col("h").alias("a"), F.col("h_b").alias("b")).distinct()
    more = _verified(cut(met if pairs is None else met.union(pairs).distinct()), distinct, threshold)
    large = open_keys.where(F.col("size") > HOT)
    if not large.isEmpty():
        more = more.union(_linked(large, distinct)).distinct()
    more = cut(more)
    for end in "ab":
        mine = known.select(F.col("node").alias(end), "component")
        more = more.join(mine, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    merged = cut(components(more)).select(F.col("node").alias("was"), F.col("component").alias("now"))
    members = known.union(merged.select("was", "was")).distinct()
    return members.join(merged, members["component"] == merged["was"], "left").select("node", F.coalesce("now", "component").alias("component"))


def _without(lines: Column, drop: Column) -> Column:
    """The elements of an array but for those at the sorted places ``drop`` (from 0): what stands between these, in one go."""
    ends = F.concat(F.array(F.lit(-1)), drop)
    runs = lambda x, d: F.transform(d, lambda at, i: F.slice(x, at + 2, F.coalesce(F.get(d, i + 1), F.size(x)) - at - 1))
    return let(F.struct(lines.alias("x"), ends.alias("d")), lambda s: F.flatten(runs(s["x"], s["d"])))


def dedup(docs: DataFrame, threshold: int | None = THRESHOLD, doc_id: str = "doc_id", text: str = "text", short: bool = True) -> DataFrame:
    """(row, text, n_lines, n_removed): each input row as a struct, its text without repeated lines, and counts of lines."""
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).withColumn("_t", F.xxhash64("_text"))
    lines = _lines(rows, short)
    nameless = F.min(F.when(F.col("_id").isNull(), F.col("_t")))  # stands for a document without an id
    counts = cut(lines.select("_id", "_t", *_known()).groupBy("h", "g").agg(F.min("_id").alias("keep"), nameless.alias("keep_t"), F.count(F.lit(1)).alias("times")))
    # lines that surely stand nowhere else needn't be shuffled to be distinct
    long = lines.where(F.length("line") >= MIN_CHARS).select(F.xxhash64("line").alias("h"), "line")
    told = _sifted(long, _marks(counts.where("times > 1").select("h")))
    once, often = told.where("NOT hit").select("line", F.lit(1).cast("long").alias("times")), told.where("hit").groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    each = once.union(often).select(*_known(), "line", "times")
    distinct = stored(signed(each, threshold) if threshold is BY_LENGTH else each.drop("times"))
    linked = classes(distinct, threshold) if threshold is BY_LENGTH else components(links(distinct, threshold))
    near = cut(linked.select("node.*", F.col("component").alias("class")))
    delete(distinct)
    known = counts.join(near, ["h", "g"], "left").where("times > 1 OR class IS NOT NULL").withColumn("class", F.coalesce("class", F.struct("h", "g")))
    first = known.groupBy("class").agg(F.min("keep").alias("keep"), F.min("keep_t").alias("keep_t"), F.sum("times").alias("times")).where("times > 1")
    repeated = cut(known.select("h", "g", "class").join(first.drop("times"), "class").withColumn("class", F.xxhash64("class")))
    at = _sifted(lines.select("_id", "_t", "at", *_known()), _marks(repeated.select("h"))).where("hit").join(repeated, ["h", "g"])
    own = F.when(F.col("keep").isNull(), F.col("_id").isNull() & (F.col("_t") == F.col("keep_t"))).otherwise(F.coalesce(F.col("_id") == F.col("keep"), F.lit(False)))
    groups = at.groupBy("_id", "_t", "class", own.alias("own")).agg(F.collect_set("at").alias("at"))
    gone = F.when(F.col("own"), F.array_remove("at", F.array_min("at"))).otherwise(F.col("at"))
    drop = groups.select("_id", "_t", gone.alias("at")).groupBy("_id", "_t").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("drop")).where(F.size("drop") > 0)
    merged = rows.join(drop, (rows["_id"].eqNullSafe(drop["_id"])) & (rows["_t"] == drop["_t"]), "left").select("row", "_text", "drop")
    return merged.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("_text")).otherwise(F.concat_ws("\n", _without(F.split("_text", "\n"), F.col("drop")))).alias("text"),
        F.coalesce(F.size(F.split("_text", "\n")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"),
    )
