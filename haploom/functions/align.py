"""Global alignment with its path, and the score of two consensus sequences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def align(a: str, b: str, band: int = 32) -> tuple[str, str, str]:
    """Gapped a, gapped b and a track (| match, . mismatch, - gap) of a cheapest alignment.

    The band around the diagonal doubles until the distance found is within it,
    which makes the result a cheapest one.
    """
    n, m = len(a), len(b)
    x, y = np.array(list(a)), np.array(list(b))
    while True:
        width = max(band, abs(n - m))
        cost = np.full((n + 1, m + 1), n + m + 1, np.int32)
        cost[0, : min(m, width) + 1] = np.arange(min(m, width) + 1)
        for i in range(1, n + 1):
            lo, hi = max(1, i - width), min(m, i + width)
            if i <= width:
                cost[i, 0] = i
            best = np.minimum(cost[i - 1, lo - 1 : hi] + (y[lo - 1 : hi] != x[i - 1]), cost[i - 1, lo : hi + 1] + 1)
            # steps along the row: a running minimum of cost minus column
            columns = np.arange(lo, hi + 1)
            run = np.minimum.accumulate(np.concatenate([[cost[i, lo - 1] - (lo - 1)], best - columns]))
            cost[i, lo : hi + 1] = run[1:] + columns
        if cost[n, m] <= width or width >= max(n, m):
            break
        band *= 2
    i, j, out = n, m, []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j], "|" if a[i] == b[j] else "."))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append((a[i], "-", "-"))
        else:
            j -= 1
            out.append(("-", b[j], "-"))
    q, t, track = ("".join(s) for s in zip(*reversed(out), strict=True)) if out else ("", "", "")
    return q, t, track


def lifted(gapped: str, k: int, gapped_own: str, gapped_ref: str, before: int = 0) -> int:
    """Reference position (from 1) of column ``k`` of an alignment, -1 if the sequence ends before.

    ``gapped`` is the sequence as it stands in that alignment, from its base number
    ``before``; ``gapped_own`` and ``gapped_ref`` are the same sequence and the reference aligned with each other.
    """
    wanted = k - gapped[:k].count("-") + before + 1
    seen = 0
    for i, c in enumerate(gapped_own):
        seen += c != "-"
        if seen == wanted:
            return i - gapped_ref[:i].count("-") + 1
    return -1


def masked(q: str, t: str, track: str, q_depth: Callable[[int], int], t_depth: Callable[[int], int], least: int) -> str:
    """``track`` with a match for every difference at which either sequence's depth is below ``least``."""
    out, i, j = [], 0, 0
    for a, b, c in zip(q, t, track, strict=True):
        out.append("|" if c != "|" and min(q_depth(i), t_depth(j)) < least else c)
        i += a != "-"
        j += b != "-"
    return "".join(out)


def score(q: str, t: str, track: str, start: int, sites: set[int], least_gap: int = 5) -> int:
    """Mismatches at ``sites`` (coordinates of q from ``start``) plus the lengths of inner gap runs of ``least_gap`` or more."""
    total, at, run, begin = 0, start, 0, 0
    for k, c in enumerate(track):
        if c == "-":
            begin = k if not run else begin
            run += 1
        else:
            if run >= least_gap and begin > 0:
                total += run
            run = 0
            total += c == "." and at in sites
        at += q[k] != "-"
    return total


def alignment_udf() -> Callable:
    """(a, b) -> struct<q, t, track>, in Arrow batches."""

    @F.pandas_udf("q string, t string, track string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(x, y) for x, y in zip(a, b, strict=True)], columns=["q", "t", "track"])

    return run


def distance_udf(least_gap: int = 5) -> Callable:
    """(a, b, start, sites) -> score of the alignment of a and b, whose first base is at ``start``, in Arrow batches."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series, start: pd.Series, sites: pd.Series) -> pd.Series:
        return pd.Series([score(*align(x, y), int(at), set(s), least_gap) for x, y, at, s in zip(a, b, start, sites, strict=True)])

    return run
