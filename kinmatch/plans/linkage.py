"""Training and inference from records to written lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions.scoring import ranking_score
from kinmatch.operators import features as feats
from kinmatch.operators import diagnostics, metrics, model, ranking, records, truth
from kinmatch.operators.blocking import candidates, name_or_address
from kinmatch.sources import tables


@dataclass(frozen=True)
class Settings:
    """Fixed values of the published run; the profile is shared by training and inference."""

    profile: str = "unicode"
    k: int = 10
    threshold: float = 0.99
    sample: int = 10_000
    seed: int = 42
    train_share: float = 0.8
    train_k: int = 50
    #: Most pairs of a training block that meet as a whole; larger ones need a longer common prefix.
    block_limit: int | None = 20_000_000
    features: tuple[str, ...] = field(default=feats.FEATURES)


def scored_pairs(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Training candidates with the three ranked similarities and their weighted score."""
    met = feats.attach(pairs, s1, targets)
    measured = met.select(
        "source1_entity_id",
        "target_entity_id",
        F.substring("target_entity_id", 1, 2).alias("target_source"),
        feats.lcs_ratio("s_name_norm", "t_name_norm").alias("name_similarity"),
        feats.lcs_ratio("s_address_norm", "t_address_norm").alias("address_similarity"),
        feats.numeric_overlap().alias("numeric_overlap"),
    )
    return measured.withColumn("ranking_score", ranking_score())


@dataclass
class Trained:
    """What training made: the model, the scored held-out pairs, the metrics, and the tables of its stages."""

    model: PipelineModel
    held: DataFrame
    metrics: dict
    ranked: DataFrame
    pairs: DataFrame
    features: DataFrame
    summary: DataFrame


def metrics_document(held: DataFrame, split: DataFrame, settings: Settings, at: float = 0.5) -> dict:
    """All that is reported of a trained model: its settings, row and class counts, measures and confusion matrix."""
    counts = {(r["is_train"], r["y"]): r["n"] for r in split.groupBy("is_train", "y").agg(F.count("*").alias("n")).collect()}  # four rows at most
    at_most = lambda part: [counts.get((part, y), 0) for y in (0, 1)]
    (neg_train, pos_train), (neg_test, pos_test) = at_most(True), at_most(False)
    row = metrics.confusion(held, at).crossJoin(metrics.roc_auc(held)).crossJoin(metrics.average_precision(held)).first()
    measures = {m: None if row[m] is None else float(row[m]) for m in ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")}
    return {
        "model": "logistic_regression",
        "random_state": settings.seed,
        "test_size": round(1 - settings.train_share, 6),
        "training_rows": neg_train + pos_train,
        "testing_rows": neg_test + pos_test,
        "feature_count": len(settings.features),
        "positive_training": pos_train,
        "negative_training": neg_train,
        "positive_testing": pos_test,
        "negative_testing": neg_test,
        **measures,
        "confusion_matrix": [[int(row["tn"]), int(row["fp"])], [int(row["fn"]), int(row["tp"])]],
    }


def top_k_summary(ranked: DataFrame, truth_pairs: DataFrame, ks=ranking.TOP_K) -> DataFrame:
    """Recall at each k for either source and for both together."""
    parts = []
    for source in ("S2", "S3"):
        mine = ranked.filter(F.col("target_source") == source)
        true = truth_pairs.filter(F.col("target_source") == source).select("source1_entity_id", "target_entity_id")
        parts.append(ranking.recall_at_k(mine, true, ks).select(F.lit(source).alias("source"), "*"))
    return parts[0].unionByName(parts[1])


def train(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth_lists: DataFrame, settings: Settings = Settings()) -> Trained:
    """A model from raw records and truth lists; the tables are persisted until the caller releases them."""
    n1 = records.with_training_keys(records.normalized(s1, settings.profile)).persist()
    targets = records.with_training_keys(records.normalized(s2.unionByName(s3), settings.profile)).persist()
    chosen = truth.sample(truth_lists, settings.sample, settings.seed).select(F.col("source1_entity_id").alias("entity_id"))
    mine = n1.join(chosen, "entity_id", "left_semi")
    scored = scored_pairs(name_or_address(mine, targets, settings.block_limit), mine, targets)
    best = ranking.top_k(scored, settings.train_k, ranking.by_rank_score(), ("source1_entity_id", "target_source")).persist()
    true = truth.explode_truth(truth_lists).dropDuplicates(["source1_entity_id", "target_entity_id"])
    true = true.join(chosen.withColumnRenamed("entity_id", "source1_entity_id"), "source1_entity_id", "left_semi").filter(F.col("target_source").isNotNull())
    pairs = ranking.training_pairs(best, true)
    table = feats.feature_table(pairs, mine, targets).withColumn("pair_id", F.concat_ws("|", "source1_entity_id", "target_entity_id"))
    split = truth.stratified_split(table, "y", settings.train_share, settings.seed).persist()
    fitted = model.fit(split.filter("is_train"), settings.features)
    held = model.predict(fitted, split.filter(~F.col("is_train")), settings.features).persist()
    values = metrics_document(held, split, settings)
    keys = ["source1_entity_id", "target_entity_id", "target_source", "y"]
    features = split.select(*keys, *settings.features)
    return Trained(fitted, held, values, best, features.select(*keys), features, top_k_summary(best, true))


def run_training(spark: SparkSession, train_dir: str, bundle: str, out_dir: str, settings: Settings = Settings()) -> dict:
    """Read the training tables; write the model bundle, its metrics and threshold sweep, and the tables of every stage.

    ``candidates`` holds the ranked candidates (any k by its rank), ``top_k_summary`` their recall,
    ``training_pairs`` and ``training_features`` what the model was fitted on: a later run can start from any of them.
    """
    s1, s2, s3 = (tables.read_tsv(spark, f"{train_dir}/train_source{i}.tsv") for i in (1, 2, 3))
    lists = tables.read_tsv(spark, f"{train_dir}/train_ground_truth.tsv", tables.TRUTH_SCHEMA)
    made = train(s1, s2, s3, lists, settings)
    order = ["source1_entity_id", "target_source", "target_entity_id"]
    tables.save_bundle(made.model, settings.features, bundle)
    tables.write_metrics(spark, made.metrics, f"{out_dir}/metrics")
    tables.save_top_k(made.ranked, f"{out_dir}/candidates")
    tables.write_tsv(made.summary, f"{out_dir}/top_k_summary", ["source", "top_k"])
    tables.write_tsv(made.pairs, f"{out_dir}/training_pairs", order)
    tables.write_tsv(made.features, f"{out_dir}/training_features", order)
    tables.write_tsv(metrics.threshold_sweep(made.held), f"{out_dir}/threshold_results", ["threshold"])
    tables.write_tsv(metrics.classification_report(made.held, settings.threshold), f"{out_dir}/classification_report", ["label"])
    return made.metrics


def run_sweep(spark: SparkSession, features: str, bundle: str, out: str) -> DataFrame:
    """Score a written feature table with a bundle; write and return the threshold sweep."""
    fitted, names = tables.load_bundle(spark, bundle)
    schema = T.StructType([*tables.PAIR_SCHEMA.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    table = spark.read.schema(schema).csv(features, sep="\t", header=True, enforceSchema=False)
    sweep = metrics.threshold_sweep(model.predict(fitted, table, names))
    tables.write_tsv(sweep, out, ["threshold"])
    return sweep


def run_diagnostics(spark: SparkSession, train_dir: str, out_dir: str, settings: Settings = Settings()) -> None:
    """Write what true pairs and hard negatives look like: ``hard_negative_pairs``, ``true_vs_hard_negative`` and ``true_match_pairs``."""
    s1, s2, s3 = (tables.read_tsv(spark, f"{train_dir}/train_source{i}.tsv") for i in (1, 2, 3))
    lists = tables.read_tsv(spark, f"{train_dir}/train_ground_truth.tsv", tables.TRUTH_SCHEMA)
    raw = s2.unionByName(s3)
    n1, targets = (records.with_training_keys(records.normalized(d, settings.profile)).persist() for d in (s1, raw))
    chosen = truth.sample(lists, settings.sample, settings.seed).select("source1_entity_id")
    mine = n1.join(chosen.withColumnRenamed("source1_entity_id", "entity_id"), "entity_id", "left_semi")
    true = truth.explode_truth(lists).join(chosen, "source1_entity_id", "left_semi").filter(F.col("target_source").isNotNull()).dropDuplicates(["source1_entity_id", "target_entity_id"]).persist()
    negatives = diagnostics.block_negatives(mine, targets, true.select("source1_entity_id", "target_entity_id")).drop("rank").persist()
    order = ["source1_entity_id", "target_source", "target_entity_id"]
    tables.write_csv(diagnostics.with_texts(negatives, s1, raw), f"{out_dir}/hard_negative_pairs", order)
    tables.write_csv(diagnostics.true_and_negative(true, negatives, mine, targets), f"{out_dir}/true_vs_hard_negative", [*order, "label"])
    tables.write_csv(diagnostics.match_diagnostics(true, mine, targets), f"{out_dir}/true_match_pairs", order)
    for df in (n1, targets, true, negatives):
        df.unpersist()


def infer(s1: DataFrame, s2: DataFrame, s3: DataFrame, fitted: PipelineModel, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(candidate lists, match lists) for every S1 record.

    A cheap linear score in the JVM ranks the blocked candidates; the 18
    features are computed only for the k kept of each record. The kept pairs
    are persisted: both lists start from them.
    """
    parts = model.linear_parts(fitted, settings.features)
    n1 = records.with_keys(records.normalized(s1, settings.profile)).persist()
    targets = records.with_keys(records.normalized(s2.unionByName(s3), settings.profile)).persist()
    quick = feats.attach(candidates(n1, targets), n1, targets)
    quick = quick.select("source1_entity_id", "target_entity_id", model.linear_probability(parts, feats.fast_features()).alias("approx"))
    kept = ranking.top_k(quick, settings.k, [F.desc("approx")]).persist()
    exact = feats.attach(kept, n1, targets).select("source1_entity_id", "target_entity_id", model.linear_probability(parts, feats.exact_features()).alias("probability"))
    matched = exact.filter(F.col("probability") >= settings.threshold)
    return ranking.id_lists(n1, kept, "approx", "candidate_entity_ids"), ranking.id_lists(n1, matched, "probability", "matched_entity_ids")


def run_inference(spark: SparkSession, test_dir: str, bundle: str, out_dir: str, settings: Settings = Settings()) -> None:
    """Read the three test tables, write candidate_pairs.tsv and matching_results.tsv, and check them."""
    from kinmatch.operators.validate import validate

    fitted, names = tables.load_bundle(spark, bundle)
    settings = Settings(**{**settings.__dict__, "features": tuple(names)})
    s1, s2, s3 = (tables.read_tsv(spark, f"{test_dir}/test_source{i}.tsv") for i in (1, 2, 3))
    listed, matched = infer(s1, s2, s3, fitted, settings)
    tables.write_single_tsv(listed, f"{out_dir}/candidate_pairs.tsv", ["source1_entity_id"])
    tables.write_single_tsv(matched, f"{out_dir}/matching_results.tsv", ["source1_entity_id"])
    errors, _ = validate(spark, f"{out_dir}/matching_results.tsv", f"{out_dir}/candidate_pairs.tsv", test_dir, strict=True)
    if errors:
        raise ValueError("; ".join(errors))
