"""Scores: the weighted ranker, the linear model as a column, and F-beta."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.text import col

#: Weights of the training ranker.
RANK_WEIGHTS = {"name_similarity": 0.60, "address_similarity": 0.30, "numeric_overlap": 0.10}


def ranking_score() -> Column:
    return reduce(lambda x, y: x + y, (F.lit(w) * F.col(c) for c, w in RANK_WEIGHTS.items()))


def logit(features: dict[str, Column], mean: dict[str, float], scale: dict[str, float], coefficient: dict[str, float], intercept: float) -> Column:
    """intercept + sum of coefficient * (x - mean) / scale, in the order of ``features``."""
    terms = (F.lit(coefficient[f]) * ((x.cast("double") - F.lit(mean[f])) / F.lit(scale[f])) for f, x in features.items())
    return reduce(lambda x, y: x + y, terms, F.lit(intercept))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole``, 0 for an empty whole."""
    return F.when(col(whole) == 0, F.lit(0.0)).otherwise(col(part) / col(whole))


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise((1 + b) * precision * recall / (b * precision + recall))
