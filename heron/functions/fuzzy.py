"""Likeness of names: insertion-deletion ratio, over sorted words and over sets of words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

_NOT_WORD = re.compile(r"\W|_")


def processed(text: str) -> str:
    """Lower case, all but letters and digits blank, no outer blanks."""
    return _NOT_WORD.sub(" ", text).lower().strip()


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times the share of characters that a shortest edit by insertions and deletions keeps."""
    whole = len(a) + len(b)
    return 100.0 * 2 * longest_common(a, b) / whole if whole else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words followed by either side's rest; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    rest_x, rest_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not rest_x or not rest_y):
        return 100.0
    left, right = f"{shared} {rest_x}".strip(), f"{shared} {rest_y}".strip()
    best = ratio(left, right)
    return max(best, ratio(shared, left), ratio(shared, right)) if shared else best


def score(value: str, candidate: str) -> int:
    """Whole points, 0 to 100."""
    a, b = processed(value), processed(candidate)
    if not a or not b:
        return 0
    return int(max(token_sort_ratio(a, b), token_set_ratio(a, b)))


@F.pandas_udf(IntegerType())
def fuzzy_score(value: pd.Series, candidate: pd.Series) -> pd.Series:
    """score() pair by pair, in batches; for candidates that a probe has narrowed down, as SQL lacks this likeness."""
    return pd.Series([0 if a is None or b is None else score(a, b) for a, b in zip(value, candidate, strict=True)])
