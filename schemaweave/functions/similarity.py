"""Symmetric similarities of names in [0, 1].

Token, edit and gram measures are Columns; Jaro, Jaro-Winkler and the gram cosine, for which there is no built-in,
are Arrow functions. Python walks code points, so characters beyond the basic plane count once.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def _degenerate(empty_a: Column, empty_b: Column, value: Column) -> Column:
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(value)


def dice(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return _degenerate(F.size(x) == 0, F.size(y) == 0, 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def dice_value(a: str, b: str) -> float:
    """The same for two texts on the driver."""
    x, y = set(a.split()), set(b.split())
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else float(not x and not y)


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return _degenerate(F.size(x) == 0, F.size(y) == 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def grams(text: Column, n: int = 3) -> Column:
    """All n-grams of ``^text$``; a text not longer than n is its own gram."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    last = F.greatest(F.length(padded) - (n - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(padded, i, F.lit(n)))


def trigram_dice(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(grams(a)), F.array_distinct(grams(b))
    return _degenerate(a == "", b == "", 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def jaro_value(a: str, b: str) -> float:
    """Transpositions are half the number of matched characters out of order, not rounded down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    half = sum(x != y for x, y in zip(left, right, strict=True)) / 2.0
    return (m / len(a) + m / len(b) + (m - half) / m) / 3.0


def jaro_winkler_value(a: str, b: str) -> float:
    base = jaro_value(a, b)
    if base < 0.7:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1.0 - base)


def _gram_counts(text: str, n: int = 3) -> Counter:
    padded = f"^{text}$"
    return Counter([padded] if len(padded) <= n else [padded[i : i + n] for i in range(len(padded) - n + 1)])


def cosine_value(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = _gram_counts(a), _gram_counts(b)
    dot = sum(v * y[k] for k, v in x.items())
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return min(1.0, max(0.0, dot / norm)) if norm else 0.0


def _pairwise(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def jaro(a: Column, b: Column) -> Column:
    return _pairwise(jaro_value)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler_value)(a, b)


def trigram_cosine(a: Column, b: Column) -> Column:
    return _pairwise(cosine_value)(a, b)


def lexical(comparable_a: Column, compact_a: Column, comparable_b: Column, compact_b: Column) -> Column:
    """Token, edit and gram subscores, weighed 0.40, 0.35 and 0.25."""
    token = (2 * dice(comparable_a, comparable_b) + jaccard(comparable_a, comparable_b)) / 3.0
    edit = (levenshtein(compact_a, compact_b) + jaro(compact_a, compact_b) + jaro_winkler(compact_a, compact_b)) / 3.0
    gram = (trigram_dice(compact_a, compact_b) + trigram_cosine(compact_a, compact_b)) / 2.0
    return 0.40 * token + 0.35 * edit + 0.25 * gram
