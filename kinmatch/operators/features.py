"""Pair features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.scoring import RANK_WEIGHTS, ranking_score
from kinmatch.functions.similarity import containment, exact_present, jaccard, jaro_winkler, lcs_ratio, length_ratio, numeric_tokens, token_overlap, tokens
from kinmatch.functions.text import text

#: The model's features in order.
FEATURES = (
    "name_similarity", "name_jaccard", "name_token_overlap", "name_containment", "name_exact", "name_length_ratio",
    "address_similarity", "address_jaccard", "address_token_overlap", "address_containment", "address_exact", "address_length_ratio",
    "numeric_overlap", "country_same", "name_missing_s1", "name_missing_target", "address_missing_s1", "address_missing_target",
)
#: Features that the cheap first ranking computes; the others stand at their training mean.
FAST = ("name_similarity", "name_exact", "name_length_ratio", "address_similarity", "address_exact", "address_length_ratio", "numeric_overlap", "country_same")


def attach(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with the normalized texts of both records; pairs without both records are dropped."""
    left = s1.select(F.col("entity_id").alias("source1_entity_id"), *(F.col(c).alias(f"s_{c}") for c in ("name_norm", "address_norm", "country_norm")))
    right = targets.select(F.col("entity_id").alias("target_entity_id"), *(F.col(c).alias(f"t_{c}") for c in ("name_norm", "address_norm", "country_norm")))
    return pairs.join(left, "source1_entity_id").join(right, "target_entity_id")


def same_country() -> Column:
    return exact_present("s_country_norm", "t_country_norm")


def _field(field: str) -> dict[str, Column]:
    s, t, short = f"s_{field}_norm", f"t_{field}_norm", field
    a, b = tokens(s), tokens(t)
    return {
        f"{short}_similarity": lcs_ratio(s, t),
        f"{short}_jaccard": jaccard(a, b),
        f"{short}_token_overlap": token_overlap(a, b),
        f"{short}_containment": containment(a, b),
        f"{short}_exact": exact_present(s, t),
        f"{short}_length_ratio": length_ratio(s, t),
    }


def numeric_overlap() -> Column:
    return jaccard(numeric_tokens("s_address_norm"), numeric_tokens("t_address_norm"))


def exact_features() -> dict[str, Column]:
    """All 18 features of an attached pair."""
    missing = lambda c: (text(c) == "").cast("int")
    return {
        **_field("name"),
        **_field("address"),
        "numeric_overlap": numeric_overlap(),
        "country_same": same_country(),
        "name_missing_s1": missing("s_name_norm"),
        "name_missing_target": missing("t_name_norm"),
        "address_missing_s1": missing("s_address_norm"),
        "address_missing_target": missing("t_address_norm"),
    }


def fast_features() -> dict[str, Column]:
    """The features of the first ranking, with Jaro-Winkler in place of the subsequence ratio."""
    return {
        "name_similarity": jaro_winkler("s_name_norm", "t_name_norm"),
        "name_exact": exact_present("s_name_norm", "t_name_norm"),
        "name_length_ratio": length_ratio("s_name_norm", "t_name_norm"),
        "address_similarity": jaro_winkler("s_address_norm", "t_address_norm"),
        "address_exact": exact_present("s_address_norm", "t_address_norm"),
        "address_length_ratio": length_ratio("s_address_norm", "t_address_norm"),
        "numeric_overlap": numeric_overlap(),
        "country_same": same_country(),
    }


def feature_table(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """``pairs`` with the 18 features."""
    return attach(pairs, s1, targets).select(*pairs.columns, *(c.alias(n) for n, c in exact_features().items()))


#: The measures of the ranking diagnostics.
RANKING = ("name_similarity", "name_jaccard", "address_similarity", "address_jaccard", "numeric_overlap", "country_same", "ranking_score")


def ranking_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, diagnostics: bool = True) -> DataFrame:
    """``pairs`` with the weighted score and the three similarities it is made of; with ``diagnostics`` all seven measures."""
    made = exact_features()
    wanted = [f for f in RANKING[:-1] if diagnostics or f in RANK_WEIGHTS]
    out = attach(pairs, s1, targets).select(*pairs.columns, *(made[f].alias(f) for f in wanted))
    return out.withColumn("ranking_score", ranking_score())
