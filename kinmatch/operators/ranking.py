"""Top-k per record, recall at k, hard negatives, and the lists that are written out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S1, TARGET = "source1_entity_id", "target_entity_id"
#: Ranks at which recall is reported.
TOP_K = (5, 10, 20, 30, 50)


def ranked(pairs: DataFrame, by: Sequence[Column], within: Sequence[str] = (S1,)) -> DataFrame:
    """Adds ``rank``; ties end with the target's id, so ranks never depend on the order of arrival."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by, F.asc(TARGET))))


def top_k(pairs: DataFrame, k: int, by: Sequence[Column], within: Sequence[str] = (S1,)) -> DataFrame:
    """The filter on the rank lets Spark keep only k rows a group before the shuffle."""
    return ranked(pairs, by, within).filter(F.col("rank") <= k)


def by_rank_score() -> list[Column]:
    return [F.desc("ranking_score"), F.desc("name_similarity"), F.desc("address_similarity"), F.desc("numeric_overlap")]


def recall_at_k(candidates: DataFrame, truth: DataFrame, ks: Sequence[int] = TOP_K) -> DataFrame:
    """Recall of ranked candidates at each k, over the records that have candidates."""
    spark = candidates.sparkSession
    ks_df = F.broadcast(spark.createDataFrame([(k,) for k in ks], "top_k int"))
    s1 = candidates.select(S1).distinct()
    total = truth.join(s1, S1, "left_semi").agg(F.count("*").alias("true_pairs"))
    marked = candidates.join(truth.withColumn("is_true", F.lit(1)), [S1, TARGET], "left")
    hits = marked.join(ks_df, F.col("rank") <= F.col("top_k")).groupBy("top_k").agg(F.sum(F.coalesce("is_true", F.lit(0))).alias("recovered_true_pairs"), F.count("*").alias("candidate_pairs"))
    n = s1.agg(F.count("*").alias("n_s1"))
    out = hits.join(F.broadcast(total)).join(F.broadcast(n))
    return out.select(
        "top_k",
        "true_pairs",
        "recovered_true_pairs",
        F.when(F.col("true_pairs") > 0, F.col("recovered_true_pairs") / F.col("true_pairs")).otherwise(F.lit(0.0)).alias("recall"),
        "candidate_pairs",
        (F.col("candidate_pairs") / F.col("n_s1")).alias("average_candidates_per_s1"),
    )


def recall_by_rank(ranks: DataFrame, ks: Sequence[int] = TOP_K) -> DataFrame:
    """:func:`recall_at_k` from (rank, n, hits, listed): pairs of a rank, true ones, and all true pairs of their records."""
    ks_df = F.broadcast(ranks.sparkSession.createDataFrame([(k,) for k in ks], "top_k int"))
    first = lambda c: F.sum(F.when(F.col("rank") == 1, F.col(c)))
    by_rank = ranks.filter("rank > 0").groupBy("rank").agg(*(F.sum(c).alias(c) for c in ("n", "hits", "listed")))
    sums = by_rank.join(ks_df, F.col("rank") <= F.col("top_k")).groupBy("top_k").agg(
        first("listed").alias("true_pairs"), F.sum("hits").alias("recovered_true_pairs"), F.sum("n").alias("candidate_pairs"), first("n").alias("n_s1")
    )
    return sums.select(
        "top_k",
        "true_pairs",
        "recovered_true_pairs",
        F.when(F.col("true_pairs") > 0, F.col("recovered_true_pairs") / F.col("true_pairs")).otherwise(F.lit(0.0)).alias("recall"),
        "candidate_pairs",
        (F.col("candidate_pairs") / F.col("n_s1")).alias("average_candidates_per_s1"),
    )


def capped_blocks(targets: DataFrame, key: str, cap: int = 500) -> DataFrame:
    """At most ``cap`` targets of a block, those that come first by hash of their id: a sample, for diagnostics."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.md5("entity_id"), "entity_id"))
    return targets.filter(F.col(key) != "").withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_rank")


def hard_negatives(scored: DataFrame, truth: DataFrame, k: int = 5, least_name: float = 0.45) -> DataFrame:
    """The best scored pairs that are not true, per record and source, with similar enough names."""
    wrong = scored.filter(F.col("name_similarity") >= least_name).join(truth, [S1, TARGET], "left_anti")
    return top_k(wrong, k, by_rank_score(), (S1, "target_source"))


def training_pairs(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates with y = 0 and all true pairs with y = 1; of a pair in both the label 1 counts."""
    both = candidates.select(S1, TARGET, "target_source", F.lit(0).alias("y")).unionByName(truth.select(S1, TARGET, "target_source", F.lit(1).alias("y")))
    return both.groupBy(S1, TARGET, "target_source").agg(F.max("y").alias("y"))


def id_lists(s1: DataFrame, pairs: DataFrame, score: str, name: str) -> DataFrame:
    """Every record with the comma list of its targets, best first; empty without targets."""
    best = pairs.groupBy(S1, TARGET).agg(F.max(score).alias("_p"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("_p")).alias("p"), F.col(TARGET).alias("id"))))
    lists = best.groupBy(S1).agg(F.array_join(F.transform(order, lambda x: x["id"]), ",").alias(name))
    return s1.select(F.col("entity_id").alias(S1)).join(lists, S1, "left").select(S1, F.coalesce(name, F.lit("")).alias(name))
