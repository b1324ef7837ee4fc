"""Similarity of strings: edit-based ratios on the JVM, and token ratios as vectorised functions.

ratio = 2 * LCS / (len a + len b): what insertions and deletions leave in common.  The
token set ratio compares the sorted common words, and these with either side's rest,
and takes the best.  The partial ratio is the best ratio of the shorter string with
a window of its length in the longer one.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return (~row & full).bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; of two empty strings 100."""
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100; 0 if a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([ratio(first, second), *([ratio(both, first), ratio(both, second)] if both else [])])


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """0 to 100: the best window of the longer string, also cut at its ends; 0 if that is below ``least``.

    Two strings share no longer subsequence than they have characters in common; these are
    counted as the window moves on, and it is only measured where they may beat the best so far.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    if a in b:
        return 100.0
    size, lacking, common, best = len(a), Counter(a), 0, 0.0
    for i in range(1 - size, len(b)):
        if i + size <= len(b):
            c = b[i + size - 1]
            common += lacking[c] > 0
            lacking[c] -= 1
        if i > 0:
            c = b[i - 1]
            lacking[c] += 1
            common -= lacking[c] > 0
        bound = 200 * common / (size + min(len(b), i + size) - max(0, i))
        if bound > best and bound >= least:
            best = max(best, ratio(a, b[max(0, i) : i + size]))
    return best if best >= least else 0.0


def divergence(name: str, forms: str) -> float:
    """1 less the best matching-blocks ratio of a name with any of the ``;``-separated canonical forms, to 4 digits."""
    return round(1 - max((difflib.SequenceMatcher(None, name, f.strip()).ratio() for f in forms.split(";") if f.strip()), default=0.0), 4)


def pairwise(f: Callable[[str, str], float], a: Column | str, b: Column | str) -> Column:
    """A function of two strings as a column, computed in Arrow batches; null if either is."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else f(u, v) for u, v in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


# Upper bounds of the bands, exclusive.
DIVERGENCE_BANDS = ((0.15, "near_canonical"), (0.35, "moderate"), (0.55, "distant"), (1.01, "outlier"))


def divergence_band(divergence: Column | str) -> Column:
    """The band of a divergence; null for null."""
    d = F.col(divergence) if isinstance(divergence, str) else divergence
    out = F.when(d.isNull(), None)
    for bound, name in DIVERGENCE_BANDS:
        out = out.when(d < bound, name)
    return out


def levenshtein_similarity(a: Column | str, b: Column | str) -> Column:
    """1 less edits over the longer length; of two empty strings 1."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
