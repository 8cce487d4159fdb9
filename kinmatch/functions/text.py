"""Normalization profiles, blocking keys, id lists and script detection.

Missing text is the empty string everywhere. One ``profile`` is shared by
training and inference: "ascii" stays in the JVM and keeps ASCII letters and
digits; "unicode" adds compatibility normalization and case folding through
one Arrow UDF and keeps every letter and digit.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scripts that are told apart, in order of name.
SCRIPTS = ("Arabic", "Bengali", "Devanagari", "Gujarati", "Gurmukhi", "Kannada", "Latin", "Malayalam", "Tamil", "Telugu")

#: Key name to (text column, length of its prefix; 0 for the whole text).
BLOCK_KEYS = {"name_exact_key": ("name_norm", 0), "address_exact_key": ("address_norm", 0), "name4": ("name_norm", 4), "name6": ("name_norm", 6), "address8": ("address_norm", 8), "address10": ("address_norm", 10)}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def normalize(c: Column | str, profile: str = "ascii") -> Column:
    """Lower case, runs of anything but letters, digits and underscores to one blank, trimmed; "unicode" also spells out ``&``."""
    if profile == "ascii":
        kept, other = F.lower(text(c)), r"[^a-z0-9_]+"
    elif profile == "unicode":
        kept, other = F.replace(_compatible(text(c)), F.lit("&"), F.lit(" and ")), r"(?U)[^\p{L}\p{N}_]+"
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return F.trim(F.regexp_replace(kept, other, " "))


def country_key(c: Column | str) -> Column:
    return F.lower(F.trim(text(c)))


def alnum_prefix(norm: Column | str, n: int, keep_underscore: bool = False) -> Column:
    """The first ``n`` letters and digits of a normalized text, blanks left out."""
    other = r"[^\p{L}\p{N}_]" if keep_underscore else r"[^\p{L}\p{N}]"
    return F.substring(F.regexp_replace(text(norm), other, ""), 1, n)


def compact_block(country: Column | str, norm: Column | str, n: int, delimiter: str = "|", include_blank: bool = False) -> Column:
    """Training-style key ``country|prefix``; blank fields have no key unless asked for."""
    key = F.concat(col(country), F.lit(delimiter), alnum_prefix(norm, n))
    return key if include_blank else F.when(text(norm) != "", key).otherwise(F.lit(""))


def prefix_key(country: Column | str, norm: Column | str, n: int) -> Column:
    """Inference-style key over the spaced text; empty for an empty text."""
    part = col(norm) if n == 0 else F.substring(col(norm), 1, n)
    return F.when(text(norm) != "", F.concat(col(country), F.lit("|"), part)).otherwise(F.lit(""))


def id_list(c: Column | str) -> Column:
    """A comma list as an array of trimmed, non-blank ids."""
    return F.filter(F.transform(F.split(text(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def source_of(c: Column | str) -> Column:
    """S1, S2 or S3 by the id's prefix; null for any other id."""
    return F.when(col(c).rlike(r"^S[123]-"), F.substring(col(c), 1, 2))


def count_from(ids: Column | str, source: str) -> Column:
    return F.size(F.filter(col(ids), lambda x: x.startswith(f"{source}-")))


def scripts(c: Column | str) -> Column:
    """Scripts of the letters, sorted and joined by ``+``; ``None`` without letters, ``Other`` for further scripts."""
    t = text(c)
    known = "".join(rf"\p{{Is{s}}}" for s in SCRIPTS)
    marks = [F.when(t.rlike(rf"[\p{{Is{s}}}&&\p{{L}}]"), F.lit(s)) for s in SCRIPTS]
    other = F.when(t.rlike(rf"[\p{{L}}&&[^{known}]]"), F.lit("Other"))
    found = F.array_sort(F.array_compact(F.array(*marks, other)))
    return F.when(F.size(found) == 0, F.lit("None")).otherwise(F.array_join(found, "+"))
