"""Similarity of short normalised strings: 2 x longest common subsequence / summed lengths, as written or with words sorted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits for each letter."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def similar(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return max(ratio(a, b), ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
