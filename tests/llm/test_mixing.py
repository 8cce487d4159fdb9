import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.llm import mixing

from .helpers import SF, rows_of


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=30))
def test_targets(sizes):
    goal = mixing.targets([(f"s{i:03d}", s) for i, s in enumerate(sizes)])
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes), abs=1e-6)
    assert all(goal[f"s{i:03d}"] <= 2 * s + 1e-9 for i, s in enumerate(sizes))


def test_target_order_and_null_last():
    goal = mixing.targets([(None, 10**6), ("é", 10**6), ("z", 10**6), ("a", 10**6)])
    unit = 6e6 / 9
    assert goal == pytest.approx({"a": 2e6, "z": (6e6 - 2e6) / 6, "é": 2 * (6e6 - 2e6) / 6, None: 2e6}) or goal["a"] == pytest.approx(3 * unit)
    assert goal["a"] == goal[None]


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(3000), rng.integers(1, 5000, 3000)
    out = mixing.flight(p, size, np.random.default_rng(2))
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-4) and out @ size == pytest.approx(p @ size, rel=1e-6)


def test_flight_respects_probabilities():
    """Every document keeps its own inclusion probability on average, whatever its size."""
    p, size = np.array([0.2, 0.5, 0.7, 0.6, 0.4, 0.3, 0.9]), np.array([3, 40, 7, 11, 3, 250, 8])
    mean = np.mean([mixing.flight(p, size, np.random.default_rng(s)) for s in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


ROWS = [(i, "w " * (1 + i % 50), ["a", "b", None][i % 3]) for i in range(3000)] + [(7, "w w", "a"), (7, "w w", "a"), (None, "w", "b"), (9000, None, "c"), (9001, "", "c")]


def mixed(spark, rows):
    return mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "p": F.lit(2), "docs": F.lit(3), "name": F.lit("n")}))


def test_mix(spark):
    got = rows_of(mixed(spark, ROWS), "doc_id", "size", "source_size", "target", "taken")
    assert len(got) == len(ROWS) and got == rows_of(mixed(spark, ROWS[::-1]), "doc_id", "size", "source_size", "target", "taken")
    assert all(t <= 2 * s and t % s == 0 if s else t == 0 for _, s, _, _, t in got)
    by = {}
    for _, _, total, goal, taken in got:
        by.setdefault((total, goal), []).append(taken)
    assert all(abs(sum(t) - goal) <= 60 for (_, goal), t in by.items())


def test_many_rows_with_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 64)
    rows = [(None, "w w w", "a")] * 4000 + [(i, "w " * (1 + i % 9), "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    at = mixing._salted(df.withColumn("size", F.lit(3).cast("long")).withColumn("row", F.monotonically_increasing_id()))
    assert at.filter("doc_id IS NULL").select("salt").distinct().count() == 4000 and at.filter("doc_id IS NOT NULL AND salt <> 0").count() == 0
    out = mixing.mix_sources(df).groupBy("source_size").agg(F.sum("taken").alias("t"), F.max("target").alias("goal"), F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in out) == [2000, 4000] and all(abs(r["t"] - r["goal"]) <= 12 for r in out)


def test_empty_table(spark):
    assert mixed(spark, ROWS[:1]).count() == 1
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).count() == 0


def test_documents(spark):
    out = mixing.query(spark, SF).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert mixing.query(spark, SF).count() == docs.count() and out
