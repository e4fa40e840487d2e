"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. A fixed-size table of counts of all shingles (one hash, 32 bits) gives
   every shingle a rank: rare ones first, by hash among equals. Counts don't
   saturate: where many shingles share a cell, frequent ones still stand out.
2. A document's set of n shingles is reduced to a digest and the first
   n - ceil(t n) + m shingles by rank, where m grows with n. Two sets of Jaccard
   similarity t or more share m of these, by the smaller m of both
   (size-derived bound), whatever the ranks are, so the table of counts affects
   the cost only.
3. Equal sets are one node from here on. Nodes that share such a shingle and
   whose sizes allow the similarity are chained: per shingle, sorted by size,
   neighbours belong to one run if the smaller is at least t times the larger,
   and every node of a run of more than ``PAIRED`` gets an edge to its first
   one. In a smaller run nodes are compared by their profiles, numbers of
   shingles in a few classes modulo 16: these differ by no more than the
   sets do, so a pair whose profiles are too far apart has no link, nor has one
   that shares fewer than m of the first shingles in all its runs. That keeps
   blocks small where the table is full and rare shingles can't be told from
   those that a few documents share. Connected components of the edges are
   the blocks of the matrix.
4. Only the documents in blocks are read again, found by a bitmap before they
   are dealt, and go to their blocks as texts. In each block the overlap
   counts are accumulated: shingles that few documents share by adding up
   their pairs, the others by products of dense column slices; pairs below
   the bound that their sizes give are discarded. Large blocks are cut by
   ranges of the size, of which neighbours meet, and these into tiles, and a
   tile pair is a task of its own. Where documents go to many tiles, tile pairs
   are dealt in rounds, so that only one round's texts are on disk.
5. Each task hands on a spanning forest of its links; components of these are
   the result.

Defined cases: null and empty texts have the empty set, which links with
nothing; a text of fewer words than a shingle has one shingle, the whole
sequence; texts may be of any length and are read in spans; links are between texts, so
rows with null or repeated ids keep a row each and are linked as their texts
are; a component of null ids only has a null id; an empty table gives no rows;
extra columns are left out. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploom.operators.components import components

from .common import cut, delete, release, shuffle_partitions, stored
from .line_dedup import _marks, _sifted

SKETCH_BITS = 24
_CHUNK_BITS = 18
_MOST = (1 << 32) - 1
#: Bytes of text hashed at once.
SPAN = 1 << 20
#: A tile holds at most so many documents and about so many shingles.
TILE_DOCS, TILE_SHINGLES = 1024, 1 << 21
#: Nodes of a run up to which their pairs are compared by profiles; of a task's nodes of equal shingle and size so many go on.
PAIRED, ALIKE = 64, 8
#: Sets share one more of their first shingles for each so many shingles they have, up to so many; what is linked without counting counts as SURE.
SHARED, MOST_SHARED, SURE = 256, 16, 1 << 20
#: A round of tile pairs has about this share of all shingles.
ROUND_SHARE = 0.5
#: Postings are dealt in so many rounds by their shingle, so that only a part of them is on disk at once.
ROUNDS = 4
#: Rows of one shingle that a task holds.
_HELD = 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers), 64), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte's place of each word in a span of UTF-8 bytes."""
    at = np.flatnonzero(~_BLANK[data])
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    lengths = np.diff(starts, append=len(at))
    within = np.arange(len(at)) - np.repeat(starts, lengths)
    values = _BYTE[_LOWER[data[at]]] * _power(int(lengths.max()))[within]
    return _mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64)), at[starts]


def _doc_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, however long: spans end at blanks."""
    parts, begin, n = [], 0, len(data)
    while begin < n:
        end = min(n, begin + SPAN)
        while end < n:
            blanks = np.flatnonzero(_BLANK[data[end : end + SPAN]])
            if len(blanks):
                end += int(blanks[0])
                break
            end = min(n, end + SPAN)
        parts.append(word_hashes(data[begin:end])[0])
        begin = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k])
    return np.unique(h)


def text_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow string column, in order."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = i + 1
        while j < len(column) and offsets[j + 1] - offsets[i] <= SPAN:
            j += 1
        if j == i + 1:
            yield shingle_set(_doc_words(data[offsets[i] : offsets[j]]), size)
        else:
            # words must not run on from one text into the next: a blank stands between them
            ends = offsets[i + 1 : j + 1] - offsets[i]
            joined = np.insert(data[offsets[i] : offsets[j]], ends[:-1], 32)
            hashes, at = word_hashes(joined)
            bounds = np.searchsorted(at, ends + np.arange(len(ends)))
            begin = 0
            for stop in bounds:
                yield shingle_set(hashes[begin:stop], size)
                begin = stop
        i = j


def _packed(z: zstandard.ZstdCompressor, table: np.ndarray) -> bytes:
    """A table of 32-bit numbers, compressed by planes of bytes: the higher ones are mostly zeros."""
    return z.compress(np.ascontiguousarray(table.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(d: zstandard.ZstdDecompressor, data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(d.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _sketch(texts: DataFrame, size: int) -> np.ndarray:
    """Counts of the distinct shingles of all texts, by the low bits of their hash, on a scale of logarithms.

    Each task sends its table in compressed chunks; chunks are added up in two
    rounds. The result has a fixed size (2^SKETCH_BITS numbers of 16 bits).
    """
    chunk, n_chunks = 1 << _CHUNK_BITS, 1 << SKETCH_BITS - _CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.uint32)
        pending, n, seen = [], 0, 0

        def flush() -> None:
            at, times = np.unique(np.concatenate(pending), return_counts=True)
            table[at] += times.astype(np.uint32)
            pending.clear()

        for batch in batches:
            for s in text_sets(batch.column(0), size):
                pending.append((s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64))
                n += len(s)
                seen = seen * 31 + len(s) & 0xFFFF
                if n >= 1 << 21:
                    flush()
                    n = 0
        if pending:
            flush()
        if table.any():
            z = zstandard.ZstdCompressor(level=1)
            parts = [(k, _packed(z, table[k * chunk : (k + 1) * chunk])) for k in range(n_chunks)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([seen % 64] * len(parts), pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["chunk", "part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = _unpacked(d, data)
                old = sums.get((k, part))
                sums[k, part] = table if old is None else np.minimum(old.astype(np.uint64) + table, _MOST).astype(np.uint32)
        z = zstandard.ZstdCompressor(level=1)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int32()), pa.array([_packed(z, sums[k]) for k in keys], pa.binary())], ["chunk", "part", "data"])

    schema = "chunk int, part int, data binary"
    parts = min(n_chunks, shuffle_partitions(texts.sparkSession))
    first = texts.mapInArrow(count, schema).repartition(parts, "chunk", "part").mapInArrow(add, schema)
    whole = first.withColumn("part", F.lit(0)).repartition(parts, "chunk").mapInArrow(add, schema)
    total = np.zeros(1 << SKETCH_BITS, np.uint16)
    d = zstandard.ZstdDecompressor()
    for k, _, data in whole.collect():  # n_chunks rows, 4 * 2^SKETCH_BITS bytes unpacked
        total[k * chunk : (k + 1) * chunk] = np.log2(1.0 + _unpacked(d, data)) * 2047
    return total


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digest(s: np.ndarray) -> int:
    """Hash of a sorted set: equal sets have equal digests."""
    h = _mix(s + np.uint64(0x632BE59BD9B4E019)) * (np.uint64(2) * np.arange(len(s), dtype=np.uint64) + np.uint64(1))
    return int(_signed(_mix(np.array([h.sum(dtype=np.uint64)]) + np.uint64(len(s))))[0])


def _words(up: int, down: int) -> int:
    """Words of a profile, of sixteen classes each; the more sets may differ, the more classes tell them apart."""
    return 3 if 10 * up >= 9 * down else 6


def _profile(s: np.ndarray, words: int) -> np.ndarray:
    """Numbers of a set's shingles in each class, modulo 16, sixteen to a word."""
    at = ((s >> np.uint64(32)) * np.uint64(16 * words)) >> np.uint64(32)
    nibbles = np.bincount(at.astype(np.int64), minlength=16 * words).astype(np.uint8) & 15
    return (nibbles[0::2] | nibbles[1::2] << 4).view(np.int64)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how many shingles the sets of profiles (rows of words) differ at least."""
    apart = np.zeros(len(x), np.int64)
    a, b = (np.ascontiguousarray(p).view(np.uint8) for p in (x, y))
    for shift in (0, 4):
        gap = (a >> shift & 15) - (b >> shift & 15) & 15
        apart += np.minimum(gap, 16 - gap).sum(1, dtype=np.int64)
    return apart


def _least_shared(n):
    """How many of their first shingles two linked sets share at least, if the smaller of both has ``n`` shingles."""
    return np.minimum(MOST_SHARED, 1 + n // SHARED)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(_signed(np.concatenate(parts)) if parts else np.empty(0, np.int64), pa.int64()))


def _signatures(docs: DataFrame, table, size: int, up: int, down: int) -> DataFrame:
    """doc_id, t, n, d (digest, null for the empty set), profile, prefix (the first shingles by rank); ``docs`` has doc_id, t and text."""

    words = _words(up, down)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(table.value, np.uint16)
        for batch in batches:
            n, d, profile, prefix = [], [], [], []
            for s in text_sets(batch.column(2), size):
                n.append(len(s))
                d.append(_digest(s) if len(s) else None)
                profile.append(_profile(s, words).tobytes())
                keep = len(s) - (up * len(s) + down - 1) // down + int(_least_shared(len(s))) if len(s) else 0
                rank = counts[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                prefix.append(s[np.argsort(rank, kind="stable")[:keep]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(profile, pa.binary()), _lists(prefix)], ["doc_id", "t", "n", "d", "profile", "prefix"])

    return docs.mapInArrow(run, "doc_id long, t long, n long, d long, profile binary, prefix array<bigint>")


def _chain(postings: DataFrame, up: int, down: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Edges (a, b, shared, need) between nodes that share postings' shingles and may be linked, if ``shared`` is ``need`` in all parts together, or that join such nodes.

    ``postings`` has d, n, profile, prefix; only shingles that leave ``part``
    by ``parts`` are taken. Of more than ``ALIKE`` nodes of
    equal shingle and size a task hands on one and joins the others to it, so a
    shingle that very many nodes share costs as many rows as there are tasks
    and sizes; such a node (of kind 2) stands for others, so nothing in its run
    is told by profiles.
    """
    words = _words(up, down)
    names = ["token", "n", "d", "e", "kind", *[f"p{k}" for k in range(words)]]

    def rows(token: np.ndarray, n: np.ndarray, d: np.ndarray, e: np.ndarray, kind: np.ndarray, profile: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n), pa.array(d), pa.array(e), pa.array(kind.astype(np.int8)), *[pa.array(np.ascontiguousarray(profile[:, k])) for k in range(words)]], names)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            profile = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(-1, words)
            lists = batch.column(3)
            at = np.repeat(np.arange(len(d)), np.diff(np.asarray(lists.offsets)))
            token = np.asarray(lists.flatten())
            mine = np.flatnonzero(token % parts == part)
            token, at = token[mine], at[mine]
            if not len(token):
                continue
            order = np.lexsort((d[at], n[at], token))
            token, at = token[order], at[order]
            n_at, d_at = n[at], d[at]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (n_at[1:] != n_at[:-1])
            other = new.copy()
            other[1:] |= d_at[1:] != d_at[:-1]
            token, at, n_at, d_at, new = token[other], at[other], n_at[other], d_at[other], new[other]
            starts = np.flatnonzero(new)
            sizes = np.diff(starts, append=len(token))
            head, crowd = np.repeat(starts, sizes), np.repeat(sizes > ALIKE, sizes)
            joined = crowd & ~new
            on = np.flatnonzero(~joined)
            yield rows(token[on], n_at[on], d_at[on], np.zeros(len(on), np.int64), np.where(crowd[on], 2, 0), profile[at[on]])
            pairs = np.unique(np.stack([d_at[head[joined]], d_at[joined]], 1), axis=0)
            if len(pairs):
                none = np.zeros(len(pairs), np.int64)
                yield rows(pairs[:, 0] ^ pairs[:, 1], none, pairs[:, 0], pairs[:, 1], none + 1, np.zeros((len(pairs), words), np.int64))

    def joined(token: np.ndarray, n: np.ndarray, d: np.ndarray, kind: np.ndarray, profile: np.ndarray, star: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ends of the edges of sorted rows, how many shared shingles each needs (0: it is sure), and the head of the last run; runs of the shingle ``star`` get edges to their first node whatever their length."""
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (down * n[:-1] < up * n[1:])
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(token))
        run, head = np.repeat(np.arange(len(starts)), sizes), np.repeat(starts, sizes)
        many = np.repeat((sizes > PAIRED) | np.logical_or.reduceat(kind == 2, starts), sizes)
        if star is not None:
            many |= token == star
        a, b = [d[head[many & ~new]]], [d[many & ~new]]
        need = [np.zeros(len(a[0]), np.int64)]
        few = np.flatnonzero(~many)
        for k in range(1, PAIRED):
            few = few[few + k < len(token)]
            few = few[run[few] == run[few + k]]
            if not len(few):
                break
            close = few[down * n[few] >= up * n[few + k]]
            close = close[(up + down) * _far(profile[close], profile[close + k]) <= (down - up) * (n[close] + n[close + k])]
            a.append(d[close])
            b.append(d[close + k])
            need.append(_least_shared(n[close]))  # rows are sorted by size
        return np.concatenate(a), np.concatenate(b), np.concatenate(need), int(head[-1])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, star = None, None

        def edges(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((high, low))
            order = order[low[order] != high[order]]
            low, high, need = low[order], high[order], need[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            starts = np.flatnonzero(new)
            shared = np.add.reduceat(np.where(need, 1, SURE), starts) if len(starts) else need
            most = np.maximum.reduceat(need, starts) if len(starts) else need
            return pa.RecordBatch.from_arrays([pa.array(low[new]), pa.array(high[new]), pa.array(shared), pa.array(most)], ["a", "b", "shared", "need"])

        for batch in batches:
            kind, token, n, d, e = (np.asarray(batch.column(k)) for k in ("kind", "token", "n", "d", "e"))
            made = kind == 1
            if made.any():
                yield edges(d[made], e[made], np.zeros(int(made.sum()), np.int64))
            profile = np.stack([np.asarray(batch.column(f"p{k}")) for k in range(words)], 1)
            part = tuple(c[~made] for c in (token, n, d, kind, profile))
            if held is not None:
                part = tuple(np.concatenate(x) for x in zip(held, part, strict=True))
            token, n, d, kind, profile = part
            if not len(token):
                continue
            other = np.ones(len(token), bool)
            other[1:] = (token[1:] != token[:-1]) | (d[1:] != d[:-1]) | (kind[1:] == 2)
            token, n, d, kind, profile = (c[other] for c in (token, n, d, kind, profile))
            # the last shingle may go on in the next batch; what is held of it is bounded
            before = np.flatnonzero(token != token[-1])
            last = int(before[-1]) + 1 if len(before) else 0
            if last:
                yield edges(*joined(token[:last], n[:last], d[:last], kind[:last], profile[:last], star)[:3])
            held = tuple(c[last:] for c in (token, n, d, kind, profile))
            if len(held[0]) > _HELD or star == token[-1]:
                star = token[-1]
                a, b, need, head = joined(*held, star)
                yield edges(a, b, need)
                # the head stands for its run, at the size that the run has reached
                held = held[0][-1:], held[1][-1:], *(c[head : head + 1] for c in held[2:])
        if held is not None and len(held[0]):
            yield edges(*joined(*held, star)[:3])

    dealt = postings.select("d", "n", "profile", "prefix").mapInArrow(within, "token long, n long, d long, e long, kind byte, " + ", ".join(f"p{k} long" for k in range(words)))
    dealt = dealt.repartition(shuffle_partitions(postings.sparkSession), "token").sortWithinPartitions("token", "n", "d")
    return _added(dealt.mapInArrow(across, "a long, b long, shared long, need long"))


def _added(edges: DataFrame) -> DataFrame:
    """One edge for each two ends, with what they share in all."""
    return edges.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Overlap counts of the first ``left`` sets with the others, or of all with all if ``left`` is 0.

    The incidence matrix is sparse: shingles in one set only are left out, those
    in a few sets add one to each of their pairs, those in many are multiplied
    as dense slices.
    """
    rows = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, rows = tokens[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    df = np.diff(first, append=len(tokens))
    split = left or len(sets)
    shape = (split, len(sets) - left)
    out = np.zeros(shape, np.int64)

    def add(i: np.ndarray, j: np.ndarray) -> None:
        if left:
            crossing = (i < left) & (j >= left)
            i, j = i[crossing], j[crossing] - left
        np.add(out.reshape(-1), np.bincount(i * shape[1] + j, minlength=out.size), out=out.reshape(-1))

    few, many = [], []
    for k in range(2, 9):
        starts = first[df == k]
        for x in range(k):
            for y in range(x + 1, k):
                few.append((rows[starts + x], rows[starts + y]))
    if few:
        add(np.concatenate([x for x, _ in few]), np.concatenate([y for _, y in few]))
    many = np.flatnonzero(df > 8)
    width = max(64, (1 << 22) // len(sets))
    for k in range(0, len(many), width):
        part = many[k : k + width]
        dense = np.zeros((len(sets), len(part)), np.float32)
        lengths = df[part]
        at = np.repeat(first[part] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        dense[rows[at], np.repeat(np.arange(len(part)), lengths)] = 1
        out += (dense[:split] @ dense[left:].T).astype(np.int64)
    if not left:
        out = np.triu(out, 1)
        out += out.T
    return out


def _forest(linked: np.ndarray, left: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of a boolean matrix (rows against columns; the same items if ``left`` is 0)."""
    rows, columns = linked.shape
    free_rows, free_columns = np.ones(rows, bool), np.ones(columns, bool)
    for root in range(rows):
        if not free_rows[root]:
            continue
        free_rows[root] = False
        if not left:
            free_columns[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(linked[i] & free_columns):
                free_columns[j] = False
                yield i, j + left
                if not left:
                    free_rows[j] = False
                    stack.append(j)
                else:
                    for i2 in np.flatnonzero(linked[:, j] & free_rows):
                        free_rows[i2] = False
                        yield i2, j + left
                        stack.append(i2)


def _tile_links(ids: list[int], sets: list[np.ndarray], left: int, up: int, down: int) -> tuple[list[int], list[int]]:
    """Ends of a spanning forest of the links in a tile (pair)."""
    if len(sets) < 2 or left in (0, len(sets)) and left:
        return [], []
    n = np.array([len(s) for s in sets], np.int64)
    both = overlaps(sets, left)
    total = (n[:left] if left else n)[:, None] + n[left:][None, :]
    linked = down * both >= up * (total - both)
    if not left:
        np.fill_diagonal(linked, False)
    pairs = list(_forest(linked, left))
    return [ids[i] for i, _ in pairs], [ids[j] for _, j in pairs]


def _blocks(nodes: DataFrame, up: int, down: int) -> DataFrame:
    """rep, t, d, n, cluster, own (its tile), tiles (number of tiles) of nodes (rep, t, d, n, cluster).

    Clusters of more than a tile are taken apart by ranges of the size: nodes
    that are linked are in the same range or in neighbouring ones, so that a
    node of these clusters is in two of the new ones, with the range before and
    with the one after its own.
    """
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_DOCS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles")
    step = F.floor(F.log("n") / (max(math.log(down / up), 1e-6) * 1.000001)).cast("long")
    ranges = F.when(F.col("tiles") > 1, F.array(step, step - 1)).otherwise(F.array(F.lit(None).cast("long")))
    some = nodes.join(nodes.groupBy("cluster").agg(tiles), "cluster").select("rep", "t", "d", "n", F.col("cluster").alias("whole"), step.alias("step"), F.explode(ranges).alias("range"))
    some = some.withColumn("cluster", F.when(F.col("range").isNull(), F.col("whole")).otherwise(F.xxhash64("whole", "range")))
    # without a node in the range itself, those in the next one meet there
    sizes = some.groupBy("cluster").agg(tiles, F.count(F.lit(1)).alias("members"), F.min(F.col("step") - F.col("range")).alias("gap")).where("members > 1 AND coalesce(gap, 0) = 0")
    return some.join(sizes, "cluster").select("rep", "t", "d", "n", "cluster", "tiles", F.pmod(F.xxhash64("d"), F.col("tiles")).cast("int").alias("own"))


def _links(docs: DataFrame, blocks: DataFrame, size: int, up: int, down: int, total: int) -> DataFrame:
    """Spanning forests (a, b) of the links inside each block, as digests.

    ``blocks`` has rep (id) and t of a row that has the set, d, n, cluster, own (its tile) and tiles (number of tiles); ``total`` is the number of shingles of all sets.
    """

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digests, found, sides = None, [], [], []

        def links() -> tuple[list[int], list[int]]:
            order = sorted(range(len(digests)), key=lambda k: sides[k])
            return _tile_links([digests[k] for k in order], [found[k] for k in order], sum(1 for s in sides if s == 0) if max(sides) else 0, up, down)

        for batch in batches:
            texts = text_sets(batch.column(batch.schema.get_field_index("text")), size)
            a, b = [], []
            for s, c, i, j, d, own in zip(texts, *(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("cluster", "i", "j", "d", "own")), strict=True):
                if not len(s) or _digest(s) != d:  # another text of the same hash
                    continue
                if (c, i, j) != key:
                    if len(digests) > 1:
                        x, y = links()
                        a += x
                        b += y
                    key, digests, found, sides = (c, i, j), [], [], []
                if not digests or digests[-1] != d:  # rows alike in id and text
                    digests.append(d)
                    found.append(s)
                    sides.append(int(own != i))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if len(digests) > 1:
            a, b = links()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    blocks = cut(blocks)
    copied = blocks.agg(F.sum(F.col("n") * F.col("tiles"))).first()[0] or 0
    rounds = max(1, math.ceil(copied / max(1.0, ROUND_SHARE * total)))
    some = _sifted(docs.withColumnRenamed("t", "h"), _marks(blocks.select(F.col("t").alias("h")))).where("hit")
    out = None
    for k in range(rounds):
        chosen = some.join(blocks, (some["h"] == blocks["t"]) & some["doc_id"].eqNullSafe(blocks["rep"])).select("text", "d", "cluster", "own", "tiles")
        tiled = chosen.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "d", "own", "text")
        mine = tiled if rounds == 1 else tiled.where(F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(rounds)) == k)
        dealt = mine.repartition(shuffle_partitions(docs.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "d")
        found = cut(dealt.mapInArrow(tiles, "a long, b long"))
        del chosen, tiled, mine, dealt
        release(docs.sparkSession)  # the texts of this round
        out = found if out is None else out.union(found)
    return out


def classes(docs: DataFrame, size: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (hash of the text), n (size of the set), class of every row: rows of one class are linked, directly or through others; null without words."""
    g = math.gcd(percent, 100)
    up, down = percent // g, 100 // g
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(_sketch(docs.select("text"), size).tobytes())
    prefixes = stored(_signatures(docs, table, size, up, down))
    edges = None
    for part in range(ROUNDS):
        found = cut(_chain(prefixes.where("n > 0"), up, down, part, ROUNDS))
        release(spark)  # the postings of this round
        edges = found if edges is None else edges.union(found)
    clusters = components(_added(edges).where("shared >= need")).select(F.col("node").alias("d"), F.col("component").alias("cluster"))
    signed = cut(prefixes.select("doc_id", "t", "n", "d"))
    delete(prefixes)
    del edges, found
    release(spark)
    some = signed.where("n > 0")
    # one row that has the set stands for it
    nodes = some.join(clusters, "d").groupBy("d", "cluster").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("r"), F.max("n").alias("n"))
    nodes = cut(nodes.select("d", "cluster", F.col("r.doc_id").alias("rep"), F.col("r.t").alias("t"), "n"))
    links = _links(docs, _blocks(nodes, up, down), size, up, down, some.agg(F.sum("n")).first()[0] or 0)
    reached = components(links).select(F.col("node").alias("d"), "component")
    return signed.select("doc_id", "t", "n", "d").join(reached, "d", "left").select("doc_id", "t", "n", F.coalesce("component", "d").alias("class"))


def join(docs: DataFrame, size: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row, by links of Jaccard similarity percent / 100 or more.

    ``component_id`` is the smallest id reachable by links, the document's own included.
    """
    found = cut(classes(docs, size, percent, doc_id, text))
    least = found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    return found.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
