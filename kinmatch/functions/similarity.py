"""Similarities of token sets, numbers and strings; all symmetric and within [0, 1]."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions.text import col, text


def tokens(norm: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(text(norm), r"\s+"), lambda t: t != ""))


def numeric_tokens(value: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(value), F.lit(r"([0-9]+)"), F.lit(1)))


def _empties(a: Column, b: Column, both: float, otherwise: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(otherwise)


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    common = F.size(F.array_intersect(a, b))
    return _empties(a, b, 1.0, common / (F.size(a) + F.size(b) - common))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Common share of the smaller set; 0 if either set is empty."""
    a, b = col(a), col(b)
    return _empties(a, b, 0.0, F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def containment(a: Column | str, b: Column | str) -> Column:
    """The larger of both contained shares; 1 if both sets are empty."""
    a, b = col(a), col(b)
    return _empties(a, b, 1.0, F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def length_ratio(a: Column | str, b: Column | str) -> Column:
    la, lb = F.length(text(a)), F.length(text(b))
    return F.when((la == 0) & (lb == 0), F.lit(1.0)).when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(F.least(la, lb) / F.greatest(la, lb))


def exact_present(a: Column | str, b: Column | str) -> Column:
    """1 if both texts are equal and not empty."""
    return ((text(a) != "") & (text(a) == text(b))).cast("int")


def exact_normalized(a: Column | str, b: Column | str) -> Column:
    """1 if both texts are equal, empty ones included."""
    return (text(a) == text(b)).cast("int")


def exact_raw(a: Column | str, b: Column | str) -> Column:
    return (F.trim(text(a)) == F.trim(text(b))).cast("int")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _by_pair(measure: Callable[[str, str], float], a: pd.Series, b: pd.Series) -> pd.Series:
    """``measure`` of every pair of an Arrow batch, computed once for each different pair; null where the pair is settled without it."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None:
            out.append(None)
            continue
        value = known.get(pair)
        if value is None:
            value = known[pair] = measure(*pair)
        out.append(value)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _subsequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _by_pair(lambda x, y: 2.0 * common_subsequence(x, y) / (len(x) + len(y)), a, b)


def _unsettled(a: Column, b: Column) -> tuple[Column, Column]:
    settled = (a == "") | (b == "") | (a == b)
    return F.when(~settled, a), F.when(~settled, b)


def lcs_ratio(a: Column | str, b: Column | str, both_empty: float = 1.0) -> Column:
    """2 LCS / (|a| + |b|); ``both_empty`` for two empty texts, 0 for one. Equal and empty texts are settled here and sent to Python as nulls."""
    a, b = text(a), text(b)
    value = _subsequence_ratio(*_unsettled(a, b))
    return F.when((a == "") & (b == ""), F.lit(both_empty)).when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(value)


def jaro_winkler_pair(a: str, b: str, weight: float = 0.1, most: int = 4) -> float:
    """Jaro similarity raised by the common prefix (of at most 4) where it is above 0.7.

    The places of each character of ``b`` are the bits of a number, so the first free one within reach is found at once.
    """
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    free = (1 << len(b)) - 1
    width = (1 << (2 * reach + 1)) - 1
    taken = 0
    mine = []
    for i, c in enumerate(a):
        within = width << (i - reach) if i >= reach else width >> (reach - i)
        if here := places.get(c, 0) & free & within:
            here &= -here
            free ^= here
            taken |= here
            mine.append(c)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for j, c in enumerate(b) if taken >> j & 1]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:most], b[:most], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _by_pair(jaro_winkler_pair, a, b)


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """0 if either text is empty. Equal and empty texts are settled here and sent to Python as nulls."""
    a, b = text(a), text(b)
    value = _jaro_winkler(*_unsettled(a, b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(value)
