"""Pairs measured block by block against the pair join."""

import random

import pytest
from pyspark.sql import functions as F

from kinmatch.operators import blocking, blockwise, features, model, ranking, records
from kinmatch.plans import catalogue

S1, TARGET = "source1_entity_id", "target_entity_id"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Records with equal, blank, long and repetitive texts; (raw S1, raw targets, truth)."""
    rng = random.Random(3)
    word = lambda: rng.choice(["acme", "Ácme", "x_y", "12", "12 34", "zeta", "&", " ", "road " * 20, "lane 7 " * 40])
    row = lambda i: (i, "acme " + word() + word() if rng.random() < 0.7 else rng.choice(["", None, "_", "zeta 1"]), rng.choice(["12345678 ", "12345678", ""]) + word() + word(), rng.choice(["IN", "in ", "US", None]))
    schema = "entity_id string, business_name string, business_address string, country string"
    s1 = [row(f"S1-{i}") for i in range(25)]
    t = [row(f"S{2 + i % 2}-{i}") for i in range(300)] + [(None, "acme", "12345678", "IN")]
    truth = [(f"S1-{rng.randrange(28)}", f"S{2 + i % 2}-{i}") for i in range(0, 320, 3)]
    return spark.createDataFrame(s1, schema), spark.createDataFrame(t, schema), spark.createDataFrame(truth, f"{S1} string, {TARGET} string")


@pytest.fixture(scope="module")
def plain(odd):
    """The same by the pair join, rounded as the queries' SQL is."""
    a, t = (records.with_training_keys(records.normalized(d)).persist() for d in odd[:2])
    met = features.ranking_features(blocking.name_or_address(a, t).withColumn("target_source", F.substring(TARGET, 1, 2)), a, t, diagnostics=False)
    six = [F.round(c, 6).alias(c) for c in ("name_similarity", "address_similarity", "numeric_overlap")]
    scored = met.select(S1, TARGET, "target_source", *six).withColumn("ranking_score", F.round(catalogue.ranking_score(), 7)).persist()
    return a, t, scored


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("together", [500, 3])
def test_best_pairs_are_those_of_the_pair_join(odd, plain, together, monkeypatch):
    monkeypatch.setattr(blockwise, "TOGETHER", together)
    a, t = map(blockwise.records, odd[:2])
    scored, truth = plain[2], odd[2]
    within = (S1, "target_source")
    for k in (3, 50):
        assert rows(blockwise.best_pairs(a, t, k)) == rows(ranking.top_k(scored, k, ranking.by_rank_score(), within))
    assert rows(blockwise.best_pairs(a, t, 5, truth, least_name=0.45, without_true=True)) == rows(ranking.hard_negatives(scored, truth))
    best = ranking.top_k(scored, 7, ranking.by_rank_score(), within)
    labelled = ranking.training_pairs(best, truth.withColumn("target_source", F.substring(TARGET, 1, 2)))
    assert rows(blockwise.best_pairs(a, t, 7, truth, output="labels")) == rows(labelled)
    ten = ranking.top_k(scored, 10, ranking.by_rank_score())
    assert rows(ranking.recall_by_rank(blockwise.best_pairs(a, t, 10, truth, each_source=False, output="recall"), (1, 5, 10))) == rows(ranking.recall_at_k(ten, truth, (1, 5, 10)))


def test_counted_features_fit_the_same_model(odd, plain):
    a, t, scored = plain
    truth = odd[2]
    pairs = blocking.name_or_address(a, t).join(truth.withColumn("y", F.lit(1)), [S1, TARGET], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    table = features.feature_table(pairs, a, t)
    counts = blockwise.feature_counts(*map(blockwise.records, odd[:2]), truth)
    key = [F.round(F.col(f).cast("double"), 9).alias(f) for f in features.FEATURES]
    want = table.select(*key, "y").groupBy(*features.FEATURES, "y").agg(F.count("*").alias("n"))
    assert rows(counts.select(*key, "y", "n")) == rows(want)
    one, two = model.linear_parts(model.fit(table)), model.fit_counts(counts)
    for part in ("mean", "scale", "coefficient"):
        assert [two[part][f] for f in features.FEATURES] == pytest.approx([one[part][f] for f in features.FEATURES], abs=1e-4)
    assert two["intercept"] == pytest.approx(one["intercept"], abs=1e-4)


@pytest.mark.parametrize("name", ["q_weighted_rank_topk", "q_recall_at_k", "q_hard_negatives", "q_training_pairs"])
def test_no_query_joins_all_pairs(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_repeated_keys_are_seen(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    assert blockwise.repeated({"k": ids(1, 2, 2)}) and not blockwise.repeated({"k": ids(1, 2, None, None)})
