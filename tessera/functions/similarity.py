"""Similarity of strings that built-in functions can't express, as Arrow-batched pandas functions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str | None, b: str | None) -> float | None:
    """Matching share of two strings in percent; null if either is null."""
    return None if a is None or b is None else 100.0 * SequenceMatcher(None, a, b, autojunk=False).ratio()


def token_set(a: str | None, b: str | None, least: float = 0.0) -> float | None:
    """The best ratio among the common words and each side's words in order; word order and repeats don't count.

    A ratio whose shared letters show that it is under ``least`` is not computed.
    """
    if a is None or b is None:
        return None
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (common, " ".join(sorted(s - (x & y)))))) for s in (x, y))
    best = max(ratio(common, left), ratio(common, right)) if common else 0.0
    if 200.0 * (Counter(left) & Counter(right)).total() < least * (len(left) + len(right)):
        return best
    return max(best, ratio(left, right))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_set_from(least: float) -> Callable[[Column | str, Column | str], Column]:
    """:func:`token_set` of columns, exact from ``least`` on; lower ones may come out lower."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set(x, y, least) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score
