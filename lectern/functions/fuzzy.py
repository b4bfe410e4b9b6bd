"""Sliding-window character similarity: seeds as columns, exact counts as Arrow-batched functions.

A window that shares a given part of the needle's characters holds one of the needle's pieces
unchanged, if there is one piece more than characters may differ. :func:`may_reach` tests that inside
the JVM; :func:`fuzzy_reach` counts only at the places where a piece stands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lectern.functions.text import ColumnLike, col

GOOD_ENOUGH = 0.95
_CELLS = 4_000_000  # comparisons held in memory at once


def _codes(text: str) -> np.ndarray:
    """Code points; lone surrogates pass."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_similarity(needle: str | None, haystack: str | None) -> float | None:
    """Best share of equal characters over all windows of the needle's length.

    The search stops at the first window of at least 0.95, so that window's value is the
    result even if a later one is better.
    """
    if needle is None or haystack is None:
        return None
    if not needle or not haystack:
        return 0.0
    n, h = _codes(needle), _codes(haystack)
    if len(h) <= len(n):
        return float((h == n[: len(h)]).sum() / len(n))
    windows = np.lib.stride_tricks.sliding_window_view(h, len(n))
    step, best = max(1, _CELLS // len(n)), 0.0
    for start in range(0, len(windows), step):
        share = (windows[start : start + step] == n).sum(axis=1) / len(n)
        good = np.flatnonzero(share >= GOOD_ENOUGH)
        if len(good):
            return float(share[good[0]])
        best = max(best, float(share.max()))
    return best


def may_reach(needle: ColumnLike, haystack: ColumnLike, least: float) -> Column:
    """False only where no window can reach ``least``: none of the needle's pieces stands in the haystack."""
    needle, haystack, length = col(needle), col(haystack), F.length(col(needle))
    pieces = F.floor(length * (1 - least) + 1e-6).cast("int") + 1
    start = lambda i: F.floor(i * length / pieces).cast("int")
    return F.exists(
        F.sequence(F.lit(0), pieces - 1), lambda i: haystack.contains(F.substring(needle, start(i) + 1, start(i + 1) - start(i)))
    )


def reached_similarity(needle: str, haystack: str, least: float, codes: np.ndarray | None = None) -> float:
    """:func:`window_similarity` where that is at least ``least``, else 0.0; windows without a seed are passed over."""
    n = len(needle)
    if not n or not haystack:
        return 0.0
    if len(haystack) <= n:
        share = window_similarity(needle, haystack)
        return share if share >= least else 0.0
    pieces = int(n * (1 - least) + 1e-6) + 1
    starts: set[int] = set()
    for i in range(pieces):
        offset = i * n // pieces
        piece = needle[offset : (i + 1) * n // pieces]
        at = haystack.find(piece)
        while at >= 0:
            if 0 <= at - offset <= len(haystack) - n:
                starts.add(at - offset)
            at = haystack.find(piece, at + 1)
    wanted = _codes(needle)
    windows = np.lib.stride_tricks.sliding_window_view(_codes(haystack) if codes is None else codes, n)
    ordered, step, best = sorted(starts), max(1, _CELLS // n), 0.0
    for first in range(0, len(ordered), step):
        share = (windows[ordered[first : first + step]] == wanted).sum(axis=1) / n
        good = np.flatnonzero(share >= GOOD_ENOUGH)
        if len(good):
            return float(share[good[0]])
        best = max(best, float(share.max()))
    return best if best >= least else 0.0


@F.pandas_udf(DoubleType())
def fuzzy_reach(needle: pd.Series, haystack: pd.Series, least: pd.Series) -> pd.Series:
    """Null in, null out; a text that follows itself (the quotes of one item) is encoded once."""
    out, last, codes = [], None, None
    for n, h, bound in zip(needle, haystack, least):
        if n is None or h is None:
            out.append(None)
            continue
        if h != last:
            last, codes = h, _codes(h)
        out.append(reached_similarity(n, h, bound, codes))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(ArrayType(DoubleType()))
def fuzzy_reach_all(needles: pd.Series, haystack: pd.Series, least: pd.Series) -> pd.Series:
    """:func:`fuzzy_reach` of many needles in one text, which is encoded once."""
    out = []
    for many, h, bound in zip(needles, haystack, least):
        if many is None or h is None:
            out.append(None)
            continue
        codes = _codes(h)
        out.append([None if n is None else reached_similarity(n, h, bound, codes) for n in many])
    return pd.Series(out, dtype="object")


@F.pandas_udf(DoubleType())
def fuzzy_similarity(needle: pd.Series, haystack: pd.Series) -> pd.Series:
    """Null in, null out: callers null the rows that need no search."""
    return pd.Series(
        [window_similarity(n, h) for n, h in zip(needle, haystack)], dtype="float64"
    )
