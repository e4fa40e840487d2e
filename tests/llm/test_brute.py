"""The pipeline against plain Python versions of its stages, and results that mustn't depend on sizes of parts."""

import hashlib
import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from haploom.llm import bpe, line_dedup, mixing, quality_classifier, quality_rules  # noqa: E402
from oracle import SF  # noqa: E402

BLANKS = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clean(text):
    """(kept, text) by the quality rules."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)})

    def bad(line):
        w = WORD.findall(line)
        if not w:
            return False
        n, of = len(w), lambda chars: sum(c in chars for c in line)
        return (
            (n <= 2 and line.rstrip(" ")[-1] not in quality_rules.ENDS)
            or 100 * of(quality_rules.SYMBOLS) > 40 * n
            or (of(quality_rules.BARS) >= 2 and 100 * of(quality_rules.BARS) > 30 * n)
            or 100 * of("!") > 60 * n
            or (repeated >= 10 and n >= 12 and 4 * len(set(w)) <= n)
            or line.count("://") * 2 >= n > 0 < line.count("://")
            or any(p in re.sub("[A-Z]", lambda m: m[0].lower(), line) for p in quality_rules.BOILERPLATE)
        )

    left = "\n".join(x for x in text.split("\n") if not bad(x))
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    return not failed and 100 * (len(words) - len(WORD.findall(left))) <= 30 * len(words), left


def close(a, b):
    """Whether one edit at most is between two strings."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k:] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def components(nodes, pairs):
    low = {n: n for n in nodes}

    def find(n):
        while low[n] != n:
            low[n] = low[low[n]]
            n = low[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def dedup(docs):
    """[(doc_id, text, n_removed)] without repeated lines; ``docs`` is [(doc_id, text)]."""
    line_of = lambda raw: raw.strip(BLANKS)
    seen, times = {}, Counter()
    for i, t in docs:
        for raw in t.split("\n"):
            x = line_of(raw)
            if len(x) >= line_dedup.MIN_CHARS or regex.search(r"[\p{L}\p{N}]", x):
                seen[x] = min(i, seen.get(x, i))
                times[x] += 1
    by_length = {}
    for x in (x for x in seen if len(x) >= line_dedup.MIN_CHARS):
        by_length.setdefault(len(x), []).append(x)
    pairs = [(x, y) for n, xs in by_length.items() for k, x in enumerate(xs) for y in xs[:k] + by_length.get(n + 1, []) if close(x, y)]
    group = components(seen, pairs)
    keep, total = {}, Counter()
    for x, g in group.items():
        keep[g] = min(seen[x], keep.get(g, seen[x]))
        total[g] += times[x]
    out = []
    for i, t in docs:
        left, had, removed = [], set(), 0
        for raw in t.split("\n"):
            g = group.get(line_of(raw))
            if g is not None and total[g] > 1 and (keep[g] != i or g in had):
                removed += 1
            else:
                left.append(raw)
            had.add(g)
        out.append((i, "\n".join(left), removed))
    return out


def near_copies(docs, size, percent):
    """Documents that are the first of their group."""
    sets = {}
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = components(ids, pairs)
    return [(i, t) for i, t in docs if group[i] == i]


def mix(docs, max_repeats):
    """Documents in their multiplicities; ``docs`` is [(doc_id, source, text)]."""
    tokens = {i: len(WORD.findall(t)) + 1 for i, _, t in docs}
    totals = Counter()
    for i, s, _ in docs:
        totals[s] += tokens[i]
    everything = sum(totals.values())
    p = {s: n / everything for s, n in totals.items()}

    def spread(a):
        powers = {s: x**a for s, x in p.items()}
        return {s: x / sum(powers.values()) for s, x in powers.items()}

    def too_flat(a):
        r = [spread(a)[s] / p[s] for s in p]
        return max(r) / min(r) > max_repeats

    lo, hi = 0.0, 1.0
    if too_flat(0.0):
        for _ in range(mixing.ROUNDS):
            lo, hi = ((lo + hi) / 2, hi) if too_flat((lo + hi) / 2) else (lo, (lo + hi) / 2)
    else:
        hi = 0.0
    weight = {s: round(w, 9) for s, w in spread(hi).items()}
    spend = max(totals[s] / weight[s] for s in totals)
    out = []
    for s, n in totals.items():
        budget, spent, epoch = max(math.floor(weight[s] * spend + 0.5), n), 0, 0
        own = [(i, t, hashlib.md5(t.encode()).hexdigest()) for i, x, t in docs if x == s]
        while spent < budget:
            for _, i, _, t in sorted((int(hashlib.md5(f"{epoch}|{i}|{d}".encode()).hexdigest()[:8], 16), i, d, t) for i, t, d in own):
                if spent < budget:
                    out.append((i, t))
                spent += tokens[i]
            epoch += 1
    return out


def test_pipeline_equals_plain_python(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    source = {r["doc_id"]: r["source"] or "" for r in rows}
    judged = [(r["doc_id"], *clean(r["text"])) for r in rows]
    kept = [(i, t) for i, ok, t in judged if ok]
    plain = [(i, t) for i, t, n in dedup(kept) if not n or WORD.search(t)]
    first = near_copies(plain, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    mixed = mix([(i, source[i], t) for i, t in first], corpus_pipeline.MAX_REPEATS)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in mixed:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(want) > 50 and len(first) <= len(plain) <= len(kept) < len(rows)
    assert sorted(got) == sorted(want)


def test_near_copies_stage_equals_plain_python(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = near_copies(rows, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    got = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    assert sorted(got) == sorted(want) and 50 < len(want) < len(rows)


def test_line_dedup_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i: (t, n) for i, t, n in dedup([(r["doc_id"], r["text"] or "") for r in docs.collect()])}
    got = {r["row"]["doc_id"]: (r["text"] or "", r["n_removed"]) for r in line_dedup.dedup(docs).collect()}
    assert got == want


def test_ranges_of_the_permutation_dont_matter(spark, monkeypatch):
    d = spark.createDataFrame([(i, "w " * (i % 30 + 1), "big" if i % 10 else "small") for i in range(400)], "doc_id long, text string, source string")
    taken = lambda: sorted(tuple(r) for r in mixing.mix(d, max_repeats=1.5, whole_budget=True).select("row.doc_id", "source", "epoch", "block").collect())
    few = taken()
    monkeypatch.setattr(mixing, "RANGE_TOKENS", 3)
    assert taken() == few


def test_classifier_with_more_labels_than_the_samples_take(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "DICT_ROWS", 40)
    monkeypatch.setattr(quality_classifier, "FIT_ROWS", 60)
    good, bad = ("The committee met again in the spring to weigh what had been learned. " * 6, "win $$$ now *** click || free || cash $$$ ### " * 8)
    rows = [(i, (good if i % 2 else bad) + f" number {i * 7919 % 1009}") for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(1, 1), (None, 0), (3, 7)], "doc_id long, quality int")
    out = quality_classifier.score(d, labels).where("held_out").collect()
    assert out and all(r["predicted"] == r["doc_id"] % 2 for r in out)
    # labels of texts that aren't there
    strangers = labels.select((F.col("doc_id") + 10_000).alias("doc_id"), "quality")
    assert {r["score"] for r in quality_classifier.score(d, strangers).collect()} == {0.5}


def test_classifier_with_few_bad_rows_among_many(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "DICT_ROWS", 40)
    monkeypatch.setattr(quality_classifier, "FIT_ROWS", 60)
    good, bad = ("The committee met again in the spring to weigh what had been learned. " * 6, "win $$$ now *** click || free || cash $$$ ### " * 8)
    rows = [(i, (good if i % 8 else bad) + f" number {i * 7919 % 1009}") for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i, _ in rows], "doc_id long, quality int")
    out = quality_classifier.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("held_out").collect()
    assert out and all(r["predicted"] == (r["doc_id"] % 8 > 0) for r in out)


def test_classifier_on_the_labels(spark):
    """Held-out accuracy on the larger table, and scores against a plain version of the method."""
    import zlib

    import zstandard

    big = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = {r["doc_id"]: r for r in quality_classifier.score(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in out.items())
    held = [(out[i]["predicted"], y) for i, y in truth.items() if out[i]["held_out"]]
    bad = [p for p, y in held if y == 0]
    assert bad.count(0) >= 0.75 * len(bad) > 50 and sum(p == y for p, y in held) >= 0.96 * len(held)

    model = quality_classifier.fit(docs, labels)
    bad_c, good_c = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.bad, model.good))
    for r in docs.where("doc_id % 400 = 0").collect():
        b = (r["text"] or "").encode()
        sizes = [(len(bad_c.compress(b[i : i + 256])), len(good_c.compress(b[i : i + 256]))) for i in range(0, len(b), 256)] or [(1, 1)]
        x, y = (sum(s) for s in zip(*sizes))
        each = sorted((p - q) / (p + q) for p, q in sizes)
        at = lambda q: (lambda k: each[int(k)] + (each[min(int(k) + 1, len(each) - 1)] - each[int(k)]) * (k - int(k)))(q * (len(each) - 1))
        z = [max(-4, min(4, (v - m) / s)) for v, m, s in zip([(x - y) / (x + y), at(0), at(0.25), at(0.5)], model.mean, model.scale)]
        total = sum(w * v for w, v in zip(model.weights, [1, *z, *(v * v for v in z), *(v**3 / 4 for v in z)]))
        assert abs(out[r["doc_id"]]["score"] - 1 / (1 + math.exp(-total))) < 1e-9
