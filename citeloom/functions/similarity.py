"""Similarity of normalised titles: the matching-blocks ratio and one-sided coverage.

Both follow CPython's difflib, whose choices of blocks depend on order, so they run there;
what can be decided by equality, containment or an upper bound stays in the JVM.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCEPT_RATIO = 0.85
MATCH_RATIO = 0.90
COVERAGE = 0.80
WRONG_WORK = 0.45


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def coverage(needle: str, hay: str) -> float:
    """The share of needle's characters in blocks that hay has in the same order."""
    if not needle:
        return 0.0
    blocks = difflib.SequenceMatcher(None, needle, hay, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(needle)


def _pairwise(function):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


_coverage = _pairwise(coverage)


def quick_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """At least the ratio of each pair, from the characters that both have in whatever order, as difflib's quick_ratio; by bytes of UTF-8, so 1 where a text isn't ASCII."""

    def counts(texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        return np.bincount(row * 256 + np.frombuffer(b"".join(raw), np.uint8), minlength=len(raw) * 256).reshape(-1, 256)

    x, y = counts(a), counts(b)
    total = x.sum(1) + y.sum(1)
    bound = 2.0 * np.minimum(x, y).sum(1) / np.maximum(total, 1)
    plain = np.array([s.isascii() and t.isascii() for s, t in zip(a, b, strict=True)], bool)
    return np.where(plain & (total > 0), bound, 1.0)


#: Pairs whose characters are counted at once.
_QUICK_ROWS = 1000


def _ratios(a: pd.Series, b: pd.Series, least: float) -> np.ndarray:
    """Ratios; 0 where characters alone say that it is below `least`, which takes no matching of blocks; null of null."""
    out = np.full(len(a), np.nan)
    ask = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    a, b = a.to_numpy(), b.to_numpy()
    for k in range(0, len(ask), _QUICK_ROWS):
        rows = ask[k : k + _QUICK_ROWS]
        bound = quick_ratios(list(a[rows]), list(b[rows])) if least > 0 else np.ones(len(rows))
        out[rows] = [ratio(a[i], b[i]) if q >= least else 0.0 for i, q in zip(rows, bound, strict=True)]
    return out


def _ratio_udf(least: float):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_ratios(a, b, least), dtype="float64")

    return run


_RATIO = {least: _ratio_udf(least) for least in (0.0, ACCEPT_RATIO)}


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the ratio, from lengths alone: 2 min / (a + b)."""
    return 2 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def ratio_col(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratio of two normalised titles; 0 where it is below `least` by a bound, of lengths or of characters. Two empty titles are 1."""
    same, out = a == b, ratio_bound(a, b) < least
    ask = ~same & ~out
    return F.when(same, 1.0).when(out, 0.0).otherwise(_RATIO.get(least, _RATIO[0.0])(F.when(ask, a), F.when(ask, b)))


def coverage_col(needle: Column, hay: Column) -> Column:
    """Coverage of squashed titles: how much of needle is in hay."""
    whole = F.contains(hay, needle)
    ask = (needle != "") & ~whole
    return F.when(needle == "", 0.0).when(whole, 1.0).otherwise(_coverage(F.when(ask, needle), F.when(ask, hay)))
