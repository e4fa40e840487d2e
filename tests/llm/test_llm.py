import math
import random
import re
import sys
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from haploom.llm import bpe, licenses, line_dedup, mixing, ngram_join, preference, quality_classifier, quality_rules, sharding, topk  # noqa: E402
from haploom.llm.oracles import ORACLES  # noqa: E402
from haploom.llm.queries import QUERIES  # noqa: E402
from oracle import SF, same  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h string"
ODD = [(None, "x y", "en", None, None, "r", "h"), (1, None, None, "a", 0, "r", "h"), (2, "", "en", "a", 0, "r", "h"), (2, "", "en", "a", 0, "r", "h"), (3, "word " * 5000, "en", None, 1, None, "h"), (4, " \t\n\n é 日本", "xx", "b", 1, "r", None)]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def texts(spark, values):
    return spark.createDataFrame([(i, t) for i, t in enumerate(values)], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, rows):
    d = docs(spark, rows)
    n = len(rows)
    assert licenses.scan(d).count() == n
    assert bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == n
    assert quality_rules.clean(d).count() == n
    assert line_dedup.dedup(d).count() == n
    assert sharding.shard(d, limit=100).count() == n
    assert ngram_join.join(d).count() == n
    assert mixing.mix(d, max_repeats=4.0).select("row.doc_id").distinct().count() == len({r[0] for r in rows})
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.score(d, labels).count() == n


def test_bpe_equals_tiktoken():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ours = bpe.Codec(ranks, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    cases = ["", "a" * 3000, "aab" * 700, "\x1c a\x1eb", "  \n\n x ", "日本語 ½ Ⅷ don't I'LL", "naïve œuvre ’s", "".join(chr(rng.choice([32, 97, 98, 233, 0x4E2D, 0x1F600, 10])) for _ in range(4000))]
    for text in cases:
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def test_rank_queue_orders_entries():
    rng = random.Random(1)
    entries = [(rng.randrange(50_000), rng.randrange(100)) for _ in range(2000)]
    q = bpe.RankQueue()
    for e in entries:
        q.push(*e)
    assert [q.pop() for _ in entries] == sorted(entries) and q.pop() is None


def brute_components(values, size, percent):
    sets = []
    for t in values:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    low = list(range(len(sets)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            k = len(x & sets[j])
            if x and 100 * k >= percent * len(x | sets[j]):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return [(i, len(x), find(i)) for i, x in enumerate(sets)]


@pytest.mark.parametrize(("size", "percent", "tile"), [(3, 90, 1024), (5, 80, 4)])
def test_ngram_join(spark, monkeypatch, size, percent, tile):
    monkeypatch.setattr(ngram_join, "TILE_DOCS", tile)
    rng = random.Random(5)
    values = [None, "", "One two", "one TWO", "one"]
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["x", "yy"])
            values.append(" ".join(w))
    got = sorted(tuple(r) for r in ngram_join.join(texts(spark, values), size, percent).collect())
    assert got == brute_components(values, size, percent)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_links(spark, threshold):
    rng = random.Random(7)
    lines = set()
    for _ in range(25):
        base = "".join(rng.choice("abc é") for _ in range(rng.randint(24, 60)))
        for _ in range(6):
            s = list(base)
            for _ in range(rng.randint(0, 4)):
                k, p = rng.random(), rng.randrange(len(s))
                s[p : p + (k > 0.3)] = [rng.choice("xyz")] if k < 0.7 else []
            lines.add("".join(s).strip())
    lines = sorted(x for x in lines if len(x) >= 24)
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line")
    name = {(r["h"], r["g"]): r["line"] for r in df.collect()}
    got = {tuple(sorted((name[tuple(a)], name[tuple(b)]))) for a, b in line_dedup.links(df, threshold).collect()}
    assert got == {(x, y) for x in lines for y in lines if x < y and distance(x, y) <= threshold}


def test_line_links_by_length(spark):
    rng = random.Random(11)
    lines = set()
    for size in [24, 31, 33, 63, 79, 81, 121, 161, 199, 201, 260, 289, 300, 394, 520]:
        base = "".join(rng.choice("abc é") for _ in range(size))
        for most in (0, 1, 2, 3, 5, 7, 9):
            s = list(base)
            for _ in range(most):
                k, p = rng.random(), rng.randrange(len(s))
                s[p : p + (k > 0.3)] = [rng.choice("xyz")] if k < 0.7 else []
            lines.add("".join(s).strip())
    lines = sorted(x for x in lines if len(x) >= 24)
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line")
    name = {(r["h"], r["g"]): r["line"] for r in df.collect()}
    got = {tuple(sorted((name[tuple(a)], name[tuple(b)]))) for a, b in line_dedup.links(df, line_dedup.BY_LENGTH).collect()}
    most = lambda n: max(1, min(n // 40, math.isqrt(n // 8)))
    want = {(x, y) for x in lines for y in lines if x < y and abs(len(x) - len(y)) < 10 and distance(x, y) <= most(min(len(x), len(y)))}
    assert got == want and any(distance(x, y) > 4 for x, y in want)


def test_line_dedup_keeps_first(spark):
    a = "The quick brown fox jumps over the lazy dog number one."
    out = line_dedup.dedup(texts(spark, [a + "\nshort\n" + a, a.replace("lazy", "laxy") + "\nA wholly different line that stays.", " " + a + " \nshort", None]))
    assert [r[0] for r in out.orderBy("row.doc_id").select("text").collect()] == [a + "\nshort", "A wholly different line that stays.", "", None]


def test_line_dedup_without_ids(spark):
    a, b = "A line of twenty-four letters and more.", "Another line, of letters as many as that."
    rows = [(None, a + "\n" + b, 1), (None, a + "\n" + a, 2), (None, a + "\n" + b, 3), (7, b, 4), (7, b + "\n" + b, 5), (None, None, 6), (9, "", 7)]
    out = {r["row"]["text2"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, text2 int")).collect()}
    # a stands only without an id: in the text of the smaller hash, twice as rows 1 and 3 are alike; b stays in document 7, whose rows each keep it
    assert (out[4], out[5], out[6], out[7]) == (b, b, None, "")
    assert (out[1], out[2], out[3]) in ((a, "", a), ("", a, ""))


@pytest.mark.parametrize("threshold", [1, line_dedup.BY_LENGTH])
def test_line_links_of_a_family(spark, threshold):
    # all share the beginning; each is one edit away from few others
    n, rng = 6000, random.Random(5)
    tails = sorted({"".join(rng.choice("abcdefgh") for _ in range(24)) for _ in range(n)})
    near = [t[:5] + "x" + t[6:] for t in tails[:50]]
    lines = ["The same words at the head of every line: " + t for t in tails + near]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line")
    name = {(r["h"], r["g"]): r["line"] for r in df.collect()}
    began = time.time()
    got = {tuple(sorted((name[tuple(a)], name[tuple(b)]))) for a, b in line_dedup.links(df, threshold).collect()}
    head = lines[0][:42]
    assert got >= {tuple(sorted((head + a, head + b))) for a, b in zip(tails, near)} and len(got) < 60
    assert time.time() - began < 90


def test_line_classes_equal_those_of_all_links(spark, monkeypatch):
    # families around a line that stands often, templates that share most of their segments, and hot keys of few and of many edits
    from haploom.operators.components import components

    monkeypatch.setattr(line_dedup, "HOT", 20)
    rng, lines = random.Random(17), {}
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    for size in (8, 30, 60, 90):
        base = [word() for _ in range(size)]
        lines[" ".join(base)] = 30
        for _ in range(60):
            version = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(size)
                version[at] = rng.choice([word(), version[at] + "x", version[at][1:] or "y"])
            lines[" ".join(version)] = 1
    for _ in range(80):  # one beginning, unlike ends
        lines["The same words at the head of every line: " + word() + word() + word()] = 1
    rows = [(x, n) for x, n in lines.items() if len(x) >= 24]
    df = spark.createDataFrame(rows, "line string, times long").select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line", "times")
    signed = line_dedup.signed(df, line_dedup.BY_LENGTH)
    got = {tuple(r) for r in line_dedup.classes(signed, line_dedup.BY_LENGTH).collect()}
    want = {tuple(r) for r in components(line_dedup.links(df, line_dedup.BY_LENGTH)).collect()}
    assert got == want and len(want) > 40
    assert line_dedup.classes(signed.where("false"), line_dedup.BY_LENGTH).count() == 0


def test_line_versions_far_apart_are_not_paired(spark, monkeypatch):
    # versions of a line that differ in several words meet under the segments that they share, but no pair is near
    rng, seen, verified = random.Random(23), [], line_dedup._verified
    odd = lambda: "".join(rng.choice("bfgkmpw") for _ in range(6))
    base = ["".join(rng.choice("aeinorst") for _ in range(5)) for _ in range(60)]
    lines = []
    for _ in range(150):
        version = list(base)
        version[20:56:4] = [odd() for _ in range(9)]
        lines.append(" ".join(version))
    lines.append(lines[0].replace(base[30], base[30] + "x"))
    df = spark.createDataFrame([(x, 1) for x in lines], "line string, times long").select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line", "times")
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *more: seen.append(pairs.count()) or verified(pairs, *more))
    assert line_dedup.classes(line_dedup.signed(df, line_dedup.BY_LENGTH), line_dedup.BY_LENGTH).count() == 2
    assert 0 < sum(seen) < 2000 < 150 * 149 // 2


def test_line_versions_of_the_same_letters_are_not_paired(spark, monkeypatch):
    # letters don't tell these versions apart; where a key has many lines, they are compared where they meet, in tiles, and only links are kept
    rng, seen, verified = random.Random(29), [], line_dedup._verified
    base = ["".join(rng.sample("aeinorst", 6)) for _ in range(60)]
    lines = set()
    for _ in range(90):
        version = list(base)
        for at in rng.sample(range(10, 50), 4):
            version[at] = "".join(rng.sample(version[at], 6))
        lines.add(" ".join(version))
    alone = sorted(lines)
    near = [x.replace(" ", "  ", 1) for x in alone[:20]] + [x[:-3] + x[-1] for x in alone[30:40]]
    df = spark.createDataFrame([(x, 1) for x in alone + near], "line string, times long").select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line", "times")
    name = {(r["h"], r["g"]): r["line"] for r in df.collect()}
    monkeypatch.setattr(line_dedup, "HOT", 20)
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *more: seen.append(pairs.count()) or verified(pairs, *more))
    got = {name[tuple(r["node"])]: name[tuple(r["component"])] for r in line_dedup.classes(line_dedup.signed(df, line_dedup.BY_LENGTH), line_dedup.BY_LENGTH).collect()}
    assert all(got[x] == got[y] for x, y in zip(alone[:20] + alone[30:40], near))
    assert sum(seen) < 1000 < 90 * 89 // 2


def test_edges_without_lines():
    """Runs between the places that are dropped."""
    spark = SparkSession.getActiveSession()
    rows = [(list("abcdef"), []), (list("abcdef"), [0]), (list("abcdef"), [5]), (list("abcdef"), [1, 2, 4]), (list("a"), [0])]
    out = spark.createDataFrame(rows, "x array<string>, d array<int>").select(line_dedup._without(F.col("x"), F.col("d")).alias("y")).collect()
    assert ["".join(r["y"]) for r in out] == ["abcdef", "bcdef", "abcde", "adf", ""]


def test_line_dedup_of_short_lines(spark):
    from haploom.llm.queries import QUERIES as LLM

    values = ["All rights reserved.\n---\n这是一句完整的句子。\n\nOnce", " All rights reserved. \n---\n\nAll rights reserved!", "这是一句完整的句子。\nAll rights reserved.\n---"]
    out = line_dedup.dedup(texts(spark, values), threshold=line_dedup.BY_LENGTH, short=True).orderBy("row.doc_id").collect()
    assert [r["text"] for r in out] == [values[0], "---\n\nAll rights reserved!", "---"]
    docs, words = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect(), re.compile(r"[^\W_]")
    lines = [x.strip(" \t\n\x0b\f\r") for r in docs for x in (r[0] or "").split("\n")]
    short = [x for x in lines if len(x) < line_dedup.MIN_CHARS and words.search(x)]
    extra = LLM["op5_line_dedup"](spark, SF).agg(F.sum("n_removed")).first()[0]
    only_long = line_dedup.dedup(spark.read.parquet(f"{SF}/documents.parquet"), threshold=line_dedup.BY_LENGTH, short=False).agg(F.sum("n_removed")).first()[0]
    assert extra - only_long == len(short) - len(set(short)) > 0


def test_shards_fit_and_hold_all(spark):
    values = [f"document {i} " * (i % 50) for i in range(600)]
    out = sharding.shard(texts(spark, values), limit=8000).select("row.doc_id", "n_bytes", "shard", "part").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(600))
    sizes, names = {}, {r["shard"] for r in out}
    for r in out:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
    assert max(sizes.values()) <= 8000 and not any(x != y and y.startswith(x) for x in names for y in names)


def test_repeated_rows_are_cut_into_parts(spark):
    d = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string")
    out = sharding.shard(d, limit=1000).groupBy("shard", "part").agg(F.sum("n_bytes").alias("b")).collect()
    assert len(out) == 5 and sum(r["b"] for r in out) == 5000


def test_parts_of_alike_rows_fit(spark):
    d = spark.createDataFrame([(1, "x" * 600, k) for k in range(50)] + [(2, "y" * 2000, 0), (3, "", 0), (None, None, 0)], "doc_id long, text string, shard int")
    out = sharding.shard(d, limit=1300).select("row.shard", "row.doc_id", "n_bytes", F.col("shard").alias("s"), "part", "shard_bytes", "shard_rows").collect()
    assert sorted(r["row.shard"] if "row.shard" in r else r[0] for r in out if r["doc_id"] == 1) == list(range(50))
    parts = {}
    for r in out:
        parts.setdefault((r["s"], r["part"]), []).append(r)
    assert all(sum(x["n_bytes"] for x in rows) == rows[0]["shard_bytes"] and len(rows) == rows[0]["shard_rows"] for rows in parts.values())
    assert all(rows[0]["shard_bytes"] <= 1300 or len(rows) == 1 for rows in parts.values()) and len(parts) >= 26


def test_mix_of_sources_far_apart_in_size(spark):
    t = spark.createDataFrame([("big", 10**13), ("small", 1), ("mid", 10**6)], "source string, tokens long")
    plain = {r["source"]: r for r in mixing.weights(t, None, 2.0, None).collect()}
    assert all(r["budget"] >= r["tokens"] for r in plain.values()) and 1.9 < plain["small"]["budget"] / 1 <= 2.5
    given = {r["source"]: r["budget"] for r in mixing.weights(t, 10**6, 2.0, None).collect()}
    assert given["small"] == 1 and given["big"] > 900_000
    d = spark.createDataFrame([(1, "a " * 400, "big"), (2, "b", "small")], "doc_id long, text string, source string")
    assert {r[0] for r in mixing.mix(d, budget=100, max_repeats=1.0).select("row.doc_id").collect()} == {1, 2}


def test_mix_meets_target_entropy(spark):
    totals = [("a", 1000), ("b", 100), ("c", 10), ("d", 1)]
    for target in (0.5, 0.8, 0.95, 1.0):
        rows = mixing.weights(spark.createDataFrame(totals, "source string, tokens long"), 10_000, None, target).collect()
        w = [r["weight"] for r in rows]
        entropy = -sum(x * math.log(x) for x in w) / math.log(4)
        own = -sum(x / 1111 * math.log(x / 1111) for _, x in totals) / math.log(4)
        assert abs(sum(w) - 1) < 1e-9 and abs(entropy - max(target, own)) < 1e-6


def test_topk_of_odd_lengths_and_large_values(spark):
    rows = [(0, [2.0, 1.0]), (1, [1.0]), (2, [1.0, 1.0, 9.0]), (3, []), (4, [1e9, 1e9]), (4, [1e9, 1e9]), (5, [-1e9, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect()]
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows}
    want = sorted((-sum(a * b for a, b in zip(v[0], v[i])), i) for i, _ in rows if i)
    assert got == [(0, k + 1, i, -s) for k, (s, i) in enumerate(want)]
    huge = spark.createDataFrame([(0, [1e12 + 0.25, 1.0]), (1, [1e3, 1.0]), (2, [1e3, 2.0]), (3, [1e14, 1e14]), (20, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.search(huge, F.col("vec_id") % 20 == 0, k=20).collect()}
    big = math.floor(64 * (1e12 + 0.25))
    assert (got[0, 1], got[0, 2], got[0, 3], got[20, 3]) == (big * 64000 + 4096, big * 64000 + 8192, (1 << 63) - 1, 0)


def test_topk_eliminates_candidates_of_other_groups():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32)) * 100
    v = np.floor(np.repeat(centres, 50, 0) + rng.normal(size=(2000, 32)) * 3)
    radius2 = float((v * v).sum(1).max())
    c = np.hstack([v, np.sqrt(radius2 - (v * v).sum(1))[:, None]])
    p = topk.far_apart(c, topk.PIVOTS)
    q = np.hstack([v[::20], np.zeros((100, 1))])
    away = lambda x: np.sqrt(np.square(x[:, None] - p[None]).sum(2)).astype(np.float32)
    seen, ids = [], np.arange(2000)
    for i, found, scores in topk.best(ids[::20], v[::20], away(q), ids, v, away(c), radius2, 20, seen):
        s = v @ v[i]
        want = sorted((-s[j], j) for j in ids if j != i)[:20]
        assert list(zip(-scores, found)) == want
    assert sum(seen) < 0.5 * 100 * 2000


def test_swapped_replies_leave_no_conversation_out(spark):
    said = [(i, t, r, f"{r} {i % 7 if i % 3 else 'same'}") for i in range(0, 300, 2) for t, r in ((0, "user"), (1, "assistant"), (2, "user"))]
    said += [(1001, 0, "user", "no reply"), (None, 0, "assistant", "no id"), (1003, None, "system", "first"), (1003, 1, "assistant", "last"), (0, 1, "assistant", "assistant same")]
    c = spark.createDataFrame(said, "conv_id long, turn int, role string, text string").withColumn("extra", F.lit(1)).withColumn("reply", F.lit("x"))
    out = {r["pair_id"]: r for r in preference.pairs(*preference.swapped_replies(c)).collect()}
    assert sorted(out) == [*range(0, 300, 2), 1003]
    assert all(r["chosen"] != r["rejected"] for r in out.values())
    assert out[1003]["prompt"] == "<|system|>\nfirst<|end|>\n"
    empty = preference.pairs(*preference.swapped_replies(c.where("false")))
    assert empty.count() == 0
    alone = preference.pairs(*preference.swapped_replies(c.where("conv_id = 4")))
    assert alone.count() == 0


def test_quality_rules_keep_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, _f int, _f_ int")
    out = quality_rules.clean(d).collect()[0]
    assert (out["_f"], out["_f_"], out["n_words"]) == (7, 8, 2)


def test_ngram_join_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a), (None, a + " end"), (None, b), (5, a), (5, c), (7, c + " end"), (9, b + " end"), (5, c), (None, None)]
    out = [tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("x")).withColumn("class", F.lit(1))).collect()]
    assert sorted(map(str, out)) == sorted(map(str, [(None, 58, 5), (None, 59, 5), (None, 58, 9), (5, 58, 5), (5, 58, 5), (7, 59, 5), (9, 59, 9), (5, 58, 5), (None, 0, None)]))


def test_ngram_join_of_a_long_text(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    out = [tuple(r) for r in ngram_join.join(texts(spark, [long, long + " end", "x " * 700_000, "short one here"])).orderBy("doc_id").collect()]
    w = long.split(" ")
    n = len({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    assert len(long) > ngram_join.SPAN and out == [(0, n, 0), (1, n + 1, 0), (2, 1, 2), (3, 1, 3)]


def test_bpe_on_raw_documents(spark):
    import hashlib

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    long = (10**6, "ab cd ! " * 200_000), (10**6 + 1, None)
    want = []
    for i, t in [*((r[0], r[1]) for r in docs), *long]:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    both = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string"))
    assert sorted(tuple(r) for r in bpe.encode(both, path, public_tokenizers.PATTERN).collect()) == sorted(want)


ODD_DOCUMENTS = [(None, None, 1), (None, "", 2), (1, None, 3), (2, "word " * 80 + "end.", 4), (2, "word " * 80 + "end.", 4), (3, "\n\n \t", 5), (None, "One two three four five six seven.", 6), (None, "One two three four five six seven.", 7)]


@pytest.mark.parametrize("rows", [ODD_DOCUMENTS, []])
def test_pipeline_stages_take_odd_rows_and_names(spark, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    prose = [(10 + i, " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(90)) + ".", i) for i in range(4)] if rows else []
    names = ["kept", "n_words", "_new", "row", "_text", "_h", "h", "t", "class", "part", "at", "_f"]
    d = spark.createDataFrame(rows + prose, "doc_id long, text string, n int").withColumn("source", F.lit(None).cast("string"))
    d = d.select("*", *[F.lit(f"own {k}").alias(k) for k in names], F.lit("x").alias("lang"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        got = out.collect()
        assert all(r[k] == f"own {k}" for r in got for k in names)
        if name == "n-gram Jaccard join" and rows:
            # no words: all stay; a repeated row and copies without id: one each
            assert sorted((str(r["doc_id"]), r["n"]) for r in got) == sorted([("None", 1), ("None", 2), ("1", 3), ("2", 4), ("3", 5), ("None", 6), *((str(10 + i), i) for i in range(4))])
        elif rows:
            assert {r["doc_id"] for r in got} >= {10, 11, 12, 13}
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() == len(rows + prose)


def test_mix_meets_budget_and_repeats(spark):
    d = spark.createDataFrame([(i, "w " * (i % 30 + 1), "big" if i % 10 else "small") for i in range(500)], "doc_id long, text string, source string")
    out = mixing.mix(d, max_repeats=1.5, whole_budget=True).select("row.doc_id", "source", "epoch", "tokens").collect()
    total = sum(i % 30 + 2 for i in range(500))
    taken = sum(r["tokens"] for r in out)
    assert total - 2 <= taken <= total + 70
    small = sum(r["tokens"] for r in out if r["source"] == "small")
    own = sum(i % 30 + 2 for i in range(0, 500, 10))
    assert 1.4 < small / own < 1.6
    whole = mixing.mix(d, max_repeats=2.0).select("row.doc_id").distinct().count()
    assert whole == 500


def test_topk_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [-1.0, 0.0])]
    out = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in out] == [(0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 20, 2048), (20, 1, 0, 2048), (20, 2, 1, 2048), (20, 3, 2, 2048)]
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, i % 2, " ".join(rng.choice(words) + ("" if i % 2 else rng.choice(["***", " |", "$$"])) for _ in range(rng.randint(30, 200)))) for i in range(600)]
    d = spark.createDataFrame([(i, t) for i, _, t in rows] + [(9999, None)], "doc_id long, text string")
    out = quality_classifier.score(d, spark.createDataFrame([(i, q) for i, q, _ in rows], "doc_id long, quality int")).collect()
    assert len(out) == 601 and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: q for i, q, _ in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_preference(spark):
    schema = "pair_id long, turn long, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, None, None), (3, 0, "user", "x")], schema)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "bad!"), (2, 0, None, None)], schema)
    out = {r["pair_id"]: r for r in preference.pairs(a, b).collect()}
    assert out[1]["n_common"] == 1 and out[1]["prompt"] == "<|user|>\nhi<|end|>\n"
    assert (out[1]["chosen"], out[1]["chosen_mask"]) == ("<|assistant|>\ngood<|end|>\n", "14+12")
    assert (out[2]["n_common"], out[2]["chosen"], out[2]["rejected"]) == (1, "", "")
    assert (out[3]["n_common"], out[3]["rejected"], out[3]["chosen_mask"]) == (0, "", "18+0")


def test_licenses(spark):
    mit = "MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + licenses._MIT.upper().replace(",", " ,")
    out = licenses.scan(texts(spark, [mit, "Some words.\nReleased under the MIT License.", "Nothing."])).orderBy("doc_id").collect()
    assert [(r["whole"], r["licenses"]) for r in out] == [("MIT", "MIT"), (None, "MIT"), (None, "")]
    inside = ["A project\n\n" + mit, "Words.\n\n" + "\n".join(licenses._UNLICENSE.split(". ")) + "\n \nMore words.", licenses._ZLIB.replace("acknowledgment", "acknowledgement"), None, "", "Head\n\n" + licenses._MPL.replace(". If", ".\nIf") + "\n\nTail"]
    out = licenses.scan(texts(spark, inside)).orderBy("doc_id").collect()
    assert [(r["whole"], r["licenses"]) for r in out] == [(None, "MIT"), (None, "Unlicense"), ("Zlib", "Zlib"), (None, ""), (None, ""), (None, "MPL-2.0")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(len(?))) AS doc_id, unnest(?) AS text", [inside, inside])
    assert sorted(con.execute(ORACLES["op1_license_scan"]).fetchall()) == sorted((r["doc_id"], r["whole"], r["licenses"], r["n_licenses"]) for r in out)


def test_quality_rules_lines(spark):
    good = "This sentence has some plain words in it, as prose does. " * 10
    out = {r["doc_id"]: r for r in quality_rules.clean(texts(spark, [good, "\n".join(["Home | About | News | Help | Login | Terms"] * 3 + [" ".join(f"w{i}" for i in range(60)) + "."]), good + "\nHome | About | News"])).collect()}
    assert out[0]["base_failed"] and not out[1]["base_failed"]
    assert "|" not in out[1]["clean_text"] and "|" not in out[2]["clean_text"]
    links = "http://a.example/x and https://b.example/y"
    good = "This sentence has some plain words in it, as prose does."
    out = quality_rules.clean(texts(spark, [f"{good}\n{links}\nSee http://a.example for more of this.\nTous droits réservés par nous.\nTodos los derechos reservados."])).collect()[0]
    assert out["clean_text"] == f"{good}\nSee http://a.example for more of this."


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, state = d.columns, d
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        state = spark.createDataFrame(out.collect(), out.schema)
    kept = {r[0] for r in state.select("doc_id").collect()}
    assert kept and state.count() >= len(kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, state.collect()))


def _crowded(spark, monkeypatch, rng):
    """Texts of words that each stand in a few texts, under a table of counts that can't tell them from others; (docs, values)."""
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 6)
    monkeypatch.setattr(ngram_join, "_CHUNK_BITS", 4)
    shared = [f"a{k} b{k} c{k}" for k in range(600)]
    values = []
    for k in range(240):
        words = [w for t in range(40) for w in (rng.choice(shared), f"x{k}_{t}", f"y{k}_{t}")]
        values.append(" ".join(words))
        if k % 8 == 0:
            values.append(" ".join(words[:-1]))
    return texts(spark, values), values


def test_ngram_blocks_stay_small_in_a_full_table(spark, monkeypatch):
    # rare shingles can't be told from shared ones in a full table; unrelated texts must not become one block that is copied once a tile
    docs, values = _crowded(spark, monkeypatch, random.Random(5))
    seen = []
    links = ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda docs, blocks, *a: seen.append([r[0] for r in blocks.groupBy("cluster").count().select("count").collect()]) or links(docs, blocks, *a))
    out = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
    assert len(values) == 270 and len(set(out.values())) == 240
    assert max(seen[0]) <= 4 and sum(seen[0]) <= 120


@pytest.mark.parametrize(("paired", "alike", "held"), [(64, 8, 1 << 14), (2, 1, 3), (64, 1, 1), (1, 10**6, 1)])
def test_ngram_edges_lose_no_link(spark, monkeypatch, paired, alike, held):
    for name, value in (("PAIRED", paired), ("ALIKE", alike), ("_HELD", held)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(7)
    family = [f"w{k}" for k in range(60)]
    values = []
    for _ in range(150):
        words = list(family)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"v{rng.randrange(9)}"
        values.append(" ".join(words[: rng.randrange(50, 61)]))
    docs, crowd = _crowded(spark, monkeypatch, rng)
    values += crowd
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (v.split() for v in values)]
    least = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(x & sets[j])
                if least[i] != least[j] and 100 * both >= 90 * (len(x) + len(sets[j]) - both):
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    got = [r.component_id for r in ngram_join.join(texts(spark, values)).orderBy("doc_id").collect()]
    assert got == least


def test_ngram_postings_come_in_rounds(spark, monkeypatch):
    # only a part of the postings is dealt at once; all parts together have the edges of one
    rounds, chain = [], ngram_join._chain
    monkeypatch.setattr(ngram_join, "_chain", lambda p, up, down, part, parts: rounds.append((part, parts)) or chain(p, up, down, part, parts))
    long = " ".join(f"w{k}" for k in range(90))
    out = ngram_join.join(texts(spark, [long, long + " x", "one two three", f"{long} x y", "one two three"]), 5, 80)
    assert [r.component_id for r in out.orderBy("doc_id").collect()] == [0, 0, 2, 0, 2]
    assert rounds == [(k, ngram_join.ROUNDS) for k in range(ngram_join.ROUNDS)] and len(rounds) > 1


def test_ngram_blocks_of_long_texts_stay_small_in_a_full_table(spark, monkeypatch):
    # profiles of long texts are too full to tell them apart; a few shingles in common are not enough for a block
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 6)
    monkeypatch.setattr(ngram_join, "_CHUNK_BITS", 4)
    rng = random.Random(3)
    values = []
    for k in range(40):
        words = [w for t in range(600) for j in [rng.randrange(12000)] for w in (f"a{j} b{j} c{j}", f"x{k}_{t}", f"y{k}_{t}")]
        values.append(" ".join(words))
        if k % 8 == 0:
            values += [" ".join(words[: -4 * j]) for j in (1, 2)]
    seen, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda docs, blocks, *a: seen.append([r[0] for r in blocks.groupBy("cluster").count().select("count").collect()]) or links(docs, blocks, *a))
    out = [r.component_id for r in ngram_join.join(texts(spark, values)).orderBy("doc_id").collect()]
    heads = [k for k in range(50) if k == 0 or values[k][: values[k].index("y")] != values[k - 1][: values[k - 1].index("y")]]
    assert out == [max(h for h in heads if h <= k) for k in range(50)] and len(heads) == 40
    assert sorted(seen[0]) == [3] * 5


def test_ngram_blocks_are_cut_by_size(spark, monkeypatch):
    # in a large block a text goes only where texts of its size are; all that may be linked still meet
    monkeypatch.setattr(ngram_join, "TILE_DOCS", 8)
    rng = random.Random(4)
    sizes = [*(int(30 * 1.02**k) for k in range(300)), *[500] * 40]
    nodes = spark.createDataFrame([(k, k, rng.getrandbits(60), n, 7) for k, n in enumerate(sizes)] + [(k, k, k, 9, 8) for k in range(1000, 1005)], "rep long, t long, d long, n long, cluster long")
    for up, down in ((9, 10), (4, 5), (1, 1)):
        rows = ngram_join._blocks(nodes, up, down).collect()
        at = {}
        for r in rows:
            at.setdefault(r.rep, set()).add(r.cluster)
        assert all(at.get(i, set()) & at.get(j, set()) for i in range(340) for j in range(i) if down * min(sizes[i], sizes[j]) >= up * max(sizes[i], sizes[j]))
        assert {at[k] == {8} for k in range(1000, 1005)} == {True}
        assert sum(r.tiles for r in rows if r.rep < 1000) < 340 * 43 / 2  # copies to all tiles: 340 texts, 43 tiles


@pytest.mark.parametrize("share", [0.5, 0.02])
def test_ngram_tiles_come_in_rounds(spark, monkeypatch, share):
    # where documents go to many tiles, only a part of the copies is on disk at once
    monkeypatch.setattr(ngram_join, "TILE_DOCS", 4)
    monkeypatch.setattr(ngram_join, "ROUND_SHARE", share)
    rng = random.Random(6)
    family = [f"w{k}" for k in range(60)]
    values = [None, "one two three"]
    for _ in range(60):
        words = list(family)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"v{rng.randrange(9)}"
        values.append(" ".join(words[: rng.randrange(45, 61)]))
    n, cut = [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df: n.append(df.columns) or cut(df))
    got = sorted(tuple(r) for r in ngram_join.join(texts(spark, values), 3, 90).collect())
    assert got == brute_components(values, 3, 90)
    assert n.count(["a", "b"]) > (1 if share == 0.5 else 20)
