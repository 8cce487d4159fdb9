import json

import pytest

from kinmatch.__main__ import main
from kinmatch.operators import model, validate
from kinmatch.plans import linkage
from kinmatch.sources import tables


def lines(path, rows):
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def test_tsv_keeps_quotes_and_na(spark, tmp_path):
    p = lines(tmp_path / "s.tsv", ["entity_id\tbusiness_name\tbusiness_address\tcountry", 'S1-1\t"q ""x"" y"\t\tNA', "S1-2\tNA\tx\tIN"])
    rows = [tuple(r) for r in tables.read_tsv(spark, p).orderBy("entity_id").collect()]
    assert rows == [("S1-1", 'q "x" y', "", "NA"), ("S1-2", "NA", "x", "IN")]
    assert sorted(r[0] for r in tables.ids_of(spark, p).collect()) == ["S1-1", "S1-2"]


def test_rules(spark, tmp_path):
    body = ["S1-1\tS2-1,S2-1", "S1-1\tS1-5,X-1", "no tab here", "S1-9\tS2-404", "S1-2\t"]
    p = lines(tmp_path / "m.tsv", ["source1_entity_id\tmatched_entity_ids", *body])
    problem, body_lines = tables.list_lines(spark, p, ["source1_entity_id", "matched_entity_ids"])
    assert problem is None
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    found = {(r["rule"], r["offender"]) for r in validate.offenders(validate.parse_lines(body_lines), required, known).collect()}
    assert found == {("malformed_row", "no tab here"), ("duplicate_row", "S1-1"), ("repeated_id", "S1-1"), ("self_match", "S1-5"), ("wrong_prefix", "X-1"), ("unknown_id", "S2-404"), ("missing_entity", "S1-3"), ("extra_entity", "S1-9")}
    assert tables.list_lines(spark, lines(tmp_path / "c.tsv", ["a,b"]), ["a", "b"])[0]
    assert tables.list_lines(spark, str(tmp_path / "none.tsv"), ["a", "b"])[0]


@pytest.fixture(scope="module")
def trained(spark):
    def make(tag, change):
        return spark.createDataFrame([(f"{tag}-{i}", change(f"Name{i:03d} Trading"), change(f"{i} Long Road"), "IN") for i in range(60)], linkage.tables.RECORD_SCHEMA)

    s1, s2, s3 = make("S1", str), make("S2", str.upper), make("S3", lambda t: t.replace("Trading", "Traders").replace("Long", "Lng"))
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i},S3-{i}") for i in range(60)], linkage.tables.TRUTH_SCHEMA)
    settings = linkage.Settings(threshold=0.9, sample=60)
    return (s1, s2, s3), settings, linkage.train(s1, s2, s3, truth, settings)


def test_training_separates(trained):
    made = trained[2]
    assert made.metrics["roc_auc"] > 0.95 and made.metrics["average_precision"] > 0.9
    parts = model.linear_parts(made.model)
    assert set(parts["mean"]) == set(model.FEATURES)


def test_metrics_document(trained):
    made = trained[2]
    m = made.metrics
    assert list(m) == ["model", "random_state", "test_size", "training_rows", "testing_rows", "feature_count", "positive_training", "negative_training", "positive_testing", "negative_testing", "accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "confusion_matrix"]
    (tn, fp), (fn, tp) = m["confusion_matrix"]
    assert tn + fp == m["negative_testing"] and fn + tp == m["positive_testing"] and m["testing_rows"] == made.held.count()
    assert m["training_rows"] + m["testing_rows"] == made.pairs.count() == made.features.count() and m["feature_count"] == 18
    assert m["positive_training"] + m["positive_testing"] == 120 and (m["test_size"], m["random_state"]) == (0.2, 42)


def test_fitted_weights_equal_a_plain_optimum(trained):
    """The balanced, standardized, L2-penalised logistic optimum, by Newton steps in numpy."""
    import numpy as np

    from kinmatch.operators.features import FEATURES

    made = trained[2]
    rows = made.features.toPandas()
    fitted = model.fit(made.features)
    x, y = rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float)
    mean, scale = x.mean(0), x.std(0, ddof=1)
    z = np.column_stack([(x - mean) / np.where(scale > 0, scale, 1.0), np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, penalty = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - y)) + penalty * beta
        beta = beta - np.linalg.solve((z.T * (w * p * (1 - p))) @ z + np.diag(penalty + 1e-12), grad)
    parts = model.linear_parts(fitted)
    assert np.allclose([parts["coefficient"][f] for f in FEATURES], beta[:-1], atol=2e-3)
    assert parts["intercept"] == pytest.approx(beta[-1], abs=2e-3)


def test_column_score_equals_the_model(trained):
    fitted, held = trained[2].model, trained[2].held
    from pyspark.sql import functions as F

    parts = model.linear_parts(fitted)
    p = model.linear_probability(parts, {f: F.col(f) for f in model.FEATURES})
    assert held.select(F.max(F.abs(p - F.col("probability")))).first()[0] < 1e-9


def test_inference_writes_lists_that_validate(spark, trained, tmp_path):
    (s1, s2, s3), settings, made = trained
    fitted = made.model
    tables.save_bundle(fitted, model.FEATURES, str(tmp_path / "bundle"))
    for n, df in (("test_source1", s1), ("test_source2", s2), ("test_source3", s3)):
        tables.write_tsv(df, str(tmp_path / f"{n}.tsv"))
    linkage.run_inference(spark, str(tmp_path), str(tmp_path / "bundle"), str(tmp_path / "out"), settings)
    matched = {r[0]: r[1] for r in tables.read_tsv(spark, str(tmp_path / "out/matching_results.tsv"), tables.TRUTH_SCHEMA).collect()}
    assert len(matched) == 60 and sum(f"S2-{k[3:]}" in v.split(",") for k, v in matched.items()) >= 55
    lists = [str(tmp_path / "out/matching_results.tsv"), str(tmp_path / "out/candidate_pairs.tsv"), str(tmp_path)]
    body = (tmp_path / "out/matching_results.tsv").read_text().splitlines()
    assert body[0] == "source1_entity_id\tmatched_entity_ids" and body[1:] == sorted(body[1:]) and len(body) == 61
    assert main(["validate", *lists]) == 0
    lines(tmp_path / "again.tsv", [*body, body[0]])
    assert main(["validate", str(tmp_path / "again.tsv"), *lists[1:]]) == 1  # a second header is a row with an unknown id
    (tmp_path / "latin.tsv").write_bytes("\n".join(body).encode() + "\nS1-é\tS2-1\n".encode("latin-1"))
    assert main(["validate", str(tmp_path / "latin.tsv"), *lists[1:]]) == 1
    assert main(["validate", *lists[:2], str(tmp_path / "nowhere")]) == 1
    assert main(["infer", str(tmp_path), str(tmp_path / "no-bundle"), str(tmp_path / "out2")]) == 1


def test_training_from_files(spark, trained, tmp_path, capsys):
    (s1, s2, s3), settings, _ = trained
    for n, df in (("train_source1", s1), ("train_source2", s2), ("train_source3", s3)):
        tables.write_tsv(df, str(tmp_path / f"{n}.tsv"))
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i},S3-{i}") for i in range(60)], tables.TRUTH_SCHEMA)
    tables.write_tsv(truth, str(tmp_path / "train_ground_truth.tsv"))
    capsys.readouterr()
    assert main(["train", str(tmp_path), str(tmp_path / "bundle"), str(tmp_path / "out"), "--sample", "60"]) == 0
    assert "roc_auc" in capsys.readouterr().out
    values = json.loads(spark.read.text(str(tmp_path / "out/metrics")).first()[0])
    fitted, names = tables.load_bundle(spark, str(tmp_path / "bundle"))
    assert values["recall"] > 0.8 and tuple(names) == model.FEATURES and len(fitted.stages) == 3
    out = tmp_path / "out"
    assert spark.read.csv(str(out / "threshold_results"), sep="\t", header=True).count() == 11
    pairs = tables.read_pairs(spark, str(out / "training_pairs"))
    assert pairs.count() == values["training_rows"] + values["testing_rows"] and pairs.filter("y = 1").count() == 120
    assert tables.sampled_ids(spark, str(out / "training_pairs")).count() == 60
    table = spark.read.csv(str(out / "training_features"), sep="\t", header=True)
    assert table.columns == ["source1_entity_id", "target_entity_id", "target_source", "y", *model.FEATURES]
    summary = spark.read.csv(str(out / "top_k_summary"), sep="\t", header=True, inferSchema=True)
    assert summary.count() == 10 and summary.columns[:2] == ["source", "top_k"] and summary.filter("recall > 0.9").count() == 10
    assert tables.load_top_k(spark, str(out / "candidates"), "S2", 1).count() == 60
    assert main(["sweep", str(out / "training_features"), str(tmp_path / "bundle"), str(tmp_path / "sweep")]) == 0
    assert "threshold" in capsys.readouterr().out and spark.read.csv(str(tmp_path / "sweep"), sep="\t", header=True).count() == 11
    assert main(["diagnose", str(tmp_path), str(tmp_path / "look")]) == 0
    both = spark.read.csv(str(tmp_path / "look/true_vs_hard_negative"), header=True)
    assert both.filter("label = '1'").count() == 120 and both.filter("label = '0'").count() > 0
    assert spark.read.csv(str(tmp_path / "look/true_match_pairs"), header=True).count() == 120
    assert {"s1_name", "target_address", "ranking_score"} <= set(spark.read.csv(str(tmp_path / "look/hard_negative_pairs"), header=True).columns)
    capsys.readouterr()
    assert main(["compare", str(tmp_path), "S1-3", "S2-3"]) == 0
    shown = capsys.readouterr().out
    assert "name_block" in shown and "address8" in shown
    assert main(["compare", str(tmp_path), "S1-3", "S2-none"]) == 1


def test_streamed_batches(spark, trained, tmp_path):
    from kinmatch.streaming import candidates_of_stream

    (s1, s2, _), _, _ = trained
    s2.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(s2.schema).parquet(str(tmp_path / "in"))
    q = candidates_of_stream(arriving, s1, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 60
