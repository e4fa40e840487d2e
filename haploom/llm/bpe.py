"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. For each adjacent pair that is
in the vocabulary, the position of its left part goes into the bucket of the
pair's rank, and a three-level bitmap of 64-bit words marks the buckets that
are not empty. Find-first-set on the bitmap gives the lowest rank, its
bucket's smallest position the next merge; entries whose pair has changed are
stale and skipped. A pre-token of n bytes costs O(n log n) however long it is.

Distinct pre-tokens are encoded once per Python worker as long as they fit in
a bounded cache; a document's ids are then the concatenation of cached bytes.

Defined cases: a null text counts as empty, which gives no ids and the empty
string's digest; repeated ids are encoded row by row; extra columns are left
out of the result, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens that a worker keeps; about 150 bytes each.
CACHE_ENTRIES = 600_000
#: Longer texts are matched piece by piece instead of all at once.
WHOLE_CHARS = 2_000_000
_BITS = 6
_MASK = 63


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class RankQueue:
    """Min-queue of (rank, position): buckets per rank below a bitmap of three levels.

    Only words in use exist, as entries of dictionaries, so a new queue costs
    nothing however many ranks there are.
    """

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        i, j = rank >> _BITS, rank >> 2 * _BITS
        self.low[i] = self.low.get(i, 0) | 1 << (rank & _MASK)
        self.mid[j] = self.mid.get(j, 0) | 1 << (i & _MASK)
        self.top |= 1 << j

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank, or None."""
        if not self.top:
            return None
        j = (self.top & -self.top).bit_length() - 1
        word = self.mid[j]
        i = j << _BITS | (word & -word).bit_length() - 1
        bits = self.low[i]
        rank = i << _BITS | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[i] = bits = bits & (bits - 1)
            if not bits:
                self.mid[j] = word = word & (word - 1)
                if not word:
                    self.top &= self.top - 1
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: always the lowest-ranked pair first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts at i; 0: it was merged into another
    before = list(range(-1, n - 1))
    queue, get = RankQueue(), ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            queue.push(rank, i)
    while (entry := queue.pop()) is not None:
        rank, i = entry
        middle = end[i]
        if not middle or middle == n or get(piece[i : end[middle]]) != rank:
            continue  # stale
        end[i], end[middle] = end[middle], 0
        after = end[i]
        if after < n:
            before[after] = i
            new = get(piece[i : end[after]])
            if new is not None:
                queue.push(new, i)
        if i:
            new = get(piece[before[i] : after])
            if new is not None:
                queue.push(new, before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


#: Code points that count as white space in the split pattern.
_SPACE = r"\t-\r \x85\xa0  -     　"


def _narrow(pattern: str) -> re.Pattern | None:
    """``pattern`` for texts of code points under 256, with its classes written out, for the faster engine."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = r"\t-\r \x85\xa0"
    inner = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kinds['L']}{kinds['N']}]").replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]")
    inner = inner.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
    return None if r"\p" in inner else re.compile(inner)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        wide = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        self.wide, self.narrow = regex.compile(wide), _narrow(pattern)
        codec = self

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= CACHE_ENTRIES:
                    self.clear()
                ids = np.array(merge(piece.encode("utf-8", "replace"), codec.ranks), dtype="<u4").tobytes()
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.cache = Cache()

    def split(self, text: str) -> Callable[[], Iterator[str]]:
        engine = self.wide
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                engine = self.narrow
            except UnicodeEncodeError:
                pass
        if len(text) <= WHOLE_CHARS:
            return engine.findall(text)
        return (m.group() for m in engine.finditer(text))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary file, which every machine has under the same path."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``ids`` also the ids as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, hashes, back, lists = [], [], [], []
            for value in batch.column(1):
                coded = c.encode(value.as_py() or "")
                n.append(len(coded) // 4)
                hashes.append(hashlib.sha256(coded).hexdigest())
                back.append(hashlib.sha256(c.decode(coded)).hexdigest())
                if ids:
                    lists.append(np.frombuffer(coded, dtype="<i4"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
