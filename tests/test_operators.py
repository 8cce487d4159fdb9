import pytest
from pyspark.sql import functions as F

from kinmatch.operators import blocking, features, metrics, ranking, records, truth


def people(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")


@pytest.fixture(scope="module")
def small(spark):
    s1 = people(spark, [("S1-1", "Acme Co", "1 Road", "IN"), ("S1-2", "Beta", "", "IN"), ("S1-3", "", "", "IN"), ("S1-4", "Other", "9 Lane", "US")])
    t = people(spark, [("S2-1", "ACME co", "1 Road", "in"), ("S2-2", "Acme Ltd", "2 Road", "in "), ("S3-1", "beta", "", "IN"), ("S3-2", None, None, "IN")])
    make = lambda d: records.with_training_keys(records.with_keys(records.normalized(d)))
    return make(s1).persist(), make(t).persist()


def pairs(df):
    return {(r[0], r[1]) for r in df.select("source1_entity_id", "target_entity_id").collect()}


def test_routes_and_their_union(small):
    found = {r.name: pairs(blocking.route(*small, r)) for r in blocking.ROUTES}
    assert found["exact_name"] == {("S1-1", "S2-1"), ("S1-2", "S3-1")}
    assert found["name4"] == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S3-1")}
    assert found["exact_name"] <= found["name4"] and found["exact_address"] <= found["addr8"]
    assert pairs(blocking.candidates(*small)) == set().union(*found.values())
    assert pairs(blocking.candidates(*small, with_routes=True)) == set().union(*found.values())


def test_guard_closes_large_blocks(spark, small):
    s1, t = small
    tight = blocking.Route("name4", ("name4",), "name4", 1)
    assert pairs(blocking.route(s1, t, tight)) == {("S1-2", "S3-1")}


def test_blank_keys_do_not_block(small):
    assert not any("S1-3" == a for a, _ in pairs(blocking.name_or_address(*small)))


def test_recall_parts_add_up(spark, small):
    true = spark.createDataFrame([("S1-1", "S2-1", "S2"), ("S1-1", "S2-2", "S2"), ("S1-2", "S3-1", "S3"), ("S1-4", "S3-9", "S3")], "source1_entity_id string, target_entity_id string, target_source string")
    for r in blocking.blocking_recall(true, *small).collect():
        assert r["both"] + r["name_only"] + r["address_only"] + r["neither"] + r["missing_target"] == r["total_pairs"]
        assert r["union_recovered"] == r["both"] + r["name_only"] + r["address_only"]


def test_feature_table_drops_pairs_without_records(spark, small):
    wanted = spark.createDataFrame([("S1-1", "S2-1", 1), ("S1-1", "S9-9", 0)], "source1_entity_id string, target_entity_id string, y int")
    rows = features.feature_table(wanted, *small).collect()
    assert len(rows) == 1 and [rows[0][f] for f in features.FEATURES] == [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0]


def test_top_k_is_a_prefix_and_ties_follow_the_id(spark):
    df = spark.createDataFrame([("a", f"t{i}", 0.5 if i % 2 else 0.7) for i in range(8)], "source1_entity_id string, target_entity_id string, p double")
    five = [r["target_entity_id"] for r in ranking.top_k(df, 5, [F.desc("p")]).orderBy("rank").collect()]
    assert five == ["t0", "t2", "t4", "t6", "t1"]
    assert [r["target_entity_id"] for r in ranking.top_k(df, 3, [F.desc("p")]).orderBy("rank").collect()] == five[:3]


def test_lists_keep_every_record(spark, small):
    scored = spark.createDataFrame([("S1-1", "S2-2", 0.3), ("S1-1", "S2-1", 0.9), ("S1-1", "S2-1", 0.8)], "source1_entity_id string, target_entity_id string, p double")
    got = {r[0]: r[1] for r in ranking.id_lists(small[0], scored, "p", "ids").collect()}
    assert got == {"S1-1": "S2-1,S2-2", "S1-2": "", "S1-3": "", "S1-4": ""}


def test_training_labels(spark):
    c = spark.createDataFrame([("a", "x", "S2"), ("a", "y", "S2")], "source1_entity_id string, target_entity_id string, target_source string")
    t = spark.createDataFrame([("a", "x", "S2"), ("a", "z", "S3")], "source1_entity_id string, target_entity_id string, target_source string")
    assert {(r[1], r[3]) for r in ranking.training_pairs(c, t).collect()} == {("x", 1), ("y", 0), ("z", 1)}


def f05(spark, predicted, true):
    make = lambda d: spark.createDataFrame([(k, list(v)) for k, v in d.items()], "source1_entity_id string, ids array<string>")
    return metrics.macro_f05(make(predicted), make(true)).first()["macro_f05"]


@pytest.mark.parametrize(
    ("predicted", "true", "want"),
    [
        ({"a": ["S2-001"]}, {"a": ["S2-001"]}, 1.0),
        ({"a": []}, {"a": []}, 1.0),
        ({"a": ["S2-001"]}, {"a": []}, 0.0),
        ({"a": ["S2-001", "S2-002"]}, {"a": ["S2-001"]}, 1.25 * 0.5 / (0.25 * 0.5 + 1)),
        ({"a": ["S2-001"]}, {"a": ["S2-001"], "b": []}, 1.0),
        ({"x": ["S2-001"]}, {"a": ["S2-001"]}, 0.0),
    ],
)
def test_macro_f05(spark, predicted, true, want):
    assert f05(spark, predicted, true) == pytest.approx(want)


def test_rank_measures(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "probability double, y int")
    won = sum((p > q) + 0.5 * (p == q) for p, y in rows if y for q, z in rows if not z)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(won / 6)
    assert metrics.average_precision(df).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_sweep_agrees_with_single_thresholds(spark):
    df = spark.createDataFrame([(i / 20, int(i % 3 == 0)) for i in range(21)], "probability double, y int")
    sweep = {r["threshold"]: r for r in metrics.threshold_sweep(df).collect()}
    for t, row in sweep.items():
        one = metrics.confusion(df, t).first()
        assert [row[c] for c in ("tp", "fp", "fn", "tn", "f1")] == [one[c] for c in ("tp", "fp", "fn", "tn", "f1")]
    assert metrics.best_f1(metrics.threshold_sweep(df)).count() == 1


def test_split_sizes_are_exact(spark):
    df = spark.createDataFrame([(f"p{i}", int(i % 4 == 0)) for i in range(1000)], "pair_id string, y int")
    split = truth.stratified_split(df, "y").groupBy("y").agg(F.sum(F.col("is_train").cast("int")).alias("n")).collect()
    assert {r["y"]: r["n"] for r in split} == {0: 600, 1: 200}


def test_samples_repeat(spark):
    df = spark.createDataFrame([(f"S1-{i}",) for i in range(50)], "source1_entity_id string")
    assert truth.sample(df, 5).collect() == truth.sample(df.repartition(7), 5).collect()


def test_empty_tables(spark, small):
    s1, t = small
    none = t.limit(0)
    assert blocking.candidates(s1, none).count() == 0
    assert metrics.roc_auc(spark.createDataFrame([], "probability double, y int")).first()[0] is None


def test_rank_measures_on_piled_up_scores(spark):
    """Nearly all scores lie next to 0 and 1; ranges follow them, and the measures are those of plain Python."""
    import random

    from kinmatch.operators import metrics

    rng = random.Random(5)
    rows = [(rng.random() ** 12 if rng.random() < 0.7 else 1 - rng.random() ** 12, int(rng.random() < 0.3)) for _ in range(4000)]
    rows = [(round(p, 9), y) for p, y in rows] + [(None, 1)]
    df = spark.createDataFrame(rows, "probability double, y int")
    levels = metrics.score_levels(df)
    assert metrics._running(levels, False).count() == len({p for p, _ in rows if p is not None})
    known = [r for r in rows if r[0] is not None]
    pos, neg = [p for p, y in known if y], [p for p, y in known if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc, abs=1e-9)
    total = hit = 0
    gain = 0.0
    by = {}
    for p, y in known:
        by.setdefault(p, [0, 0])[y] += 1
    for p in sorted(by, reverse=True):
        total += sum(by[p])
        hit += by[p][1]
        gain += by[p][1] * hit / total
    assert metrics.average_precision(df).first()[0] == pytest.approx(gain / len(pos), abs=1e-9)
    assert metrics.roc_auc(df.limit(0)).first()[0] is None and metrics.average_precision(df.limit(0)).first()[0] == 0.0


def test_closed_training_blocks_need_longer_keys(spark):
    from kinmatch.operators import blocking, records

    make = lambda tag, n: records.with_training_keys(records.normalized(spark.createDataFrame([(f"{tag}-{i}", name, "", "IN") for i, name in enumerate(["acme trading 1", "acme trading 2", "acme trust", "acme", "zebra"] * n)], "entity_id string, business_name string, business_address string, country string")))
    s1, target = make("S1", 1), make("S2", 2)
    pairs = lambda limit: {tuple(r) for r in blocking.name_or_address(s1, target, limit).collect()}
    every = pairs(None)
    assert len(every) == 4 * 8 + 2 and pairs(1000) == every
    eight = {(a, b) for a, b in every if (int(a[3:]) < 2) == (int(b[3:]) % 5 < 2) and (int(a[3:]) < 2 or int(a[3:]) == int(b[3:]) % 5)}
    assert pairs(10) == eight
    assert pairs(1) == {(a, b) for a, b in every if int(a[3:]) == int(b[3:]) % 5}


def test_shape_and_shown(spark):
    from kinmatch.operators import diagnostics

    df = spark.createDataFrame([(1, "a", 0.5), (2, " ", None), (None, None, 1.0)], "i long, s string, d double")
    assert [tuple(r) for r in diagnostics.shape(df).collect()] == [(0, "i", "bigint", 3, 1), (1, "s", "string", 3, 2), (2, "d", "double", 3, 1)]
    assert diagnostics.shown(df).splitlines()[:2] == ["i  s  d", "1  a  0.500000"]


def test_lookups_and_ranking_features(spark):
    truth_lists = spark.createDataFrame([("S1-1", "S3-1,S2-2,S2-1"), ("S1-2", ""), ("S1-3", "S3-9")], "source1_entity_id string, matched_entity_ids string")
    assert sorted(r[0] for r in truth.matched_sample(truth_lists, 10).collect()) == ["S1-1", "S1-3"]
    assert {tuple(r) for r in truth.first_match(truth_lists).collect()} == {("S1-1", "S2-2"), ("S1-2", None), ("S1-3", None)}
    raw = people(spark, [("S1-1", "Acme Ltd", "1 Main Road", "IN"), ("S1-2", "", "", "IN")])
    assert records.point(raw, "S1-2").count() == 1 and records.point(raw, "S1-9").count() == 0
    wanted = spark.createDataFrame([("S1-1",), ("S1-7",)], "entity_id string")
    found, missing = records.retrieve_reported(raw, wanted)
    assert [r["entity_id"] for r in found.collect()] == ["S1-1"] and missing == 1
    assert records.retrieve_reported(raw, wanted.limit(0))[0].columns == raw.columns
    target = people(spark, [("S2-1", "ACME ltd", "1 Main", "in")])
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, target_entity_id string")
    sides = [records.normalized(d) for d in (raw, target)]
    row = features.ranking_features(pairs, *sides).first()
    assert row.asDict().keys() == {"source1_entity_id", "target_entity_id", *features.RANKING}
    assert row["name_similarity"] == 1.0 and row["ranking_score"] == pytest.approx(0.6 + 0.3 * row["address_similarity"] + 0.1)
    assert "name_jaccard" not in features.ranking_features(pairs, *sides, diagnostics=False).columns


def test_first_header_and_bad_bytes(spark, tmp_path):
    from kinmatch.sources import tables

    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}").write_text(f"a\tb\nx{i}\t1\n")
    problem, body = tables.list_lines(spark, str(folder), ["a", "b"])
    assert problem is None and sorted(r[0] for r in body.collect()) == ["x0\t1", "x1\t1", "x2\t1"]
    (folder / "part-3").write_bytes(b"a\tb\ny\t\xff\n")
    assert "UTF-8" in tables.list_lines(spark, str(folder), ["a", "b"])[0]
    (tmp_path / "empty.tsv").write_text("")
    assert "empty" in tables.list_lines(spark, str(tmp_path / "empty.tsv"), ["a", "b"])[0]


def test_routes_of_all_candidates_come_from_one_join(spark):
    from kinmatch.plans import catalogue

    a, t = catalogue.keyed(spark, "/root/testdata/sf0.001")
    met = blocking.candidates(a, t, with_routes=True)
    plain = {}
    for r in blocking.ROUTES:
        for pair in blocking.route(a, t, r).collect():
            plain.setdefault(tuple(pair), set()).add(r.name)
    assert {(x[0], x[1]): x["routes"] for x in met.collect()} == {k: sorted(v) for k, v in plain.items()}
    # each side is read to be counted and to be joined, not anew for every route
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 20
