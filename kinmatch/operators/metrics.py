"""Pair-level and entity-level quality measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.scoring import f_beta, ratio

#: Thresholds of the sweep.
THRESHOLDS = (0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99)


#: Ranges of scores that the rank measures are summed over.
RANGES = 1024


def confusion(scored: DataFrame, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and the derived measures, 0 where a denominator is 0."""
    p, y = F.col("probability") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    counts = scored.groupBy(*by).agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    counts = counts.withColumns({"_pp": F.col("tp") + F.col("fp"), "_ap": F.col("tp") + F.col("fn"), "_n": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")})
    counts = counts.withColumns({"precision": ratio("tp", "_pp"), "recall": ratio("tp", "_ap"), "accuracy": ratio(F.col("tp") + F.col("tn"), "_n")})
    return counts.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0)).drop("_pp", "_ap", "_n")


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One pass over the pairs for all thresholds: pairs are first counted by the number of thresholds they reach."""
    spark = scored.sparkSession
    reached = sum((F.col("probability") >= t).cast("int") for t in thresholds)
    levels = scored.groupBy(reached.alias("level"), "y").agg(F.count("*").alias("n"))
    order = sorted(thresholds)
    grid = spark.createDataFrame([(t, i + 1) for i, t in enumerate(order)], "threshold double, position int")
    met = levels.join(F.broadcast(grid))  # both sides have a dozen rows
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    p, y = F.col("level") >= F.col("position"), F.col("y") == 1
    out = met.groupBy("threshold").agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    out = out.withColumns({"predicted_positive": F.col("tp") + F.col("fp"), "_ap": F.col("tp") + F.col("fn"), "_an": F.col("fp") + F.col("tn"), "_n": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")})
    out = out.withColumns(
        {
            "precision": ratio("tp", "predicted_positive"),
            "recall": ratio("tp", "_ap"),
            "accuracy": ratio(F.col("tp") + F.col("tn"), "_n"),
            "false_positive_rate": ratio("fp", "_an"),
            "candidates_per_true_match": ratio("predicted_positive", "tp"),
        }
    )
    out = out.withColumns({"f1": f_beta(F.col("precision"), F.col("recall"), 1.0), "f05": f_beta(F.col("precision"), F.col("recall"), 0.5)})
    return out.select("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "f05", "accuracy", "false_positive_rate", "predicted_positive", "candidates_per_true_match")


def best_f1(sweep: DataFrame) -> DataFrame:
    """The row of the best F1, of equal ones that with the lowest threshold."""
    return sweep.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def score_levels(scored: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score: all that the rank measures need."""
    return scored.groupBy("probability").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))


def _running(levels: DataFrame, descending: bool) -> DataFrame:
    """Running totals over the scores in two steps: within ranges of scores, then over the ranges.

    Ranges are cut at quantiles of the distinct scores, so they hold about equally many wherever the
    scores pile up, and no single task sorts all of them.
    """
    levels = levels.filter(F.col("probability").isNotNull()).persist()
    cuts = levels.approxQuantile("probability", [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES) or [0.0]
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    levels = Bucketizer(splits=edges, inputCol="probability", outputCol="_b", handleInvalid="keep").transform(levels)
    order = (F.desc if descending else F.asc)("probability")
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = levels.groupBy("_b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    over = Window.orderBy((F.desc if descending else F.asc)("_b")).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    base = sums.select("_b", F.coalesce(F.sum("p").over(over), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"))
    return levels.join(F.broadcast(base), "_b").select("probability", "pos", "neg", (F.sum("pos").over(inside) + F.col("p0")).alias("cum_pos"), (F.sum("neg").over(inside) + F.col("n0")).alias("cum_neg"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Mann-Whitney form: each positive counts the negatives below it, and half of those beside it."""
    run = _running(score_levels(scored), descending=False)
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0))
    return run.agg(F.when((F.sum("pos") == 0) | (F.sum("neg") == 0), F.lit(None)).otherwise(won / F.sum("pos") / F.sum("neg")).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Step sum over the distinct scores, best first."""
    run = _running(score_levels(scored), descending=True)
    gain = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return run.agg(F.when(F.coalesce(F.sum("pos"), F.lit(0)) == 0, F.lit(0.0)).otherwise(gain / F.sum("pos")).alias("average_precision"))


def classification_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    p, y = (F.col("probability") >= threshold).cast("int"), F.col("y").cast("int")
    cells = scored.groupBy(p.alias("p"), y.alias("y")).agg(F.count("*").alias("n"))
    classes = F.broadcast(scored.sparkSession.createDataFrame([(0,), (1,)], "label int"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    met = cells.join(classes, (F.col("label") == F.col("p")) | (F.col("label") == F.col("y")))
    sums = met.groupBy("label").agg(n((F.col("p") == F.col("label")) & (F.col("y") == F.col("label"))).alias("_hit"), n(F.col("p") == F.col("label")).alias("_said"), n(F.col("y") == F.col("label")).alias("support"))
    out = sums.withColumns({"precision": ratio("_hit", "_said"), "recall": ratio("_hit", "support")})
    return out.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0)).select("label", "precision", "recall", "f1", "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted means of a classification report."""
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    one = report.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *((F.sum(F.col(c) * F.col("support")) / total).alias(f"w_{c}") for c in names), total.alias("support"))
    rows = [F.struct(F.lit(label).alias("average"), *(F.col(f"{tag}_{c}").alias(c) for c in names), F.col("support")) for label, tag in (("macro", "m"), ("weighted", "w"))]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def entity_f05(predictions: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """F-beta of each truth record; both are (source1_entity_id, ids array).

    Without true matches a record scores 1 if nothing is predicted and 0
    otherwise; a record without prediction counts as predicting nothing.
    """
    met = truth.select("source1_entity_id", F.array_distinct("ids").alias("t")).join(predictions.select("source1_entity_id", F.array_distinct("ids").alias("p")), "source1_entity_id", "left")
    p = F.coalesce("p", F.array().cast("array<string>"))
    met = met.withColumns({"_hit": F.size(F.array_intersect("t", p)), "_said": F.size(p), "_true": F.size("t")})
    score = f_beta(ratio("_hit", "_said"), ratio("_hit", "_true"), beta)
    return met.select("source1_entity_id", F.when(F.col("_true") == 0, (F.col("_said") == 0).cast("double")).otherwise(score).alias("f05"))


def macro_f05(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return entity_f05(predictions, truth).agg(F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"), F.count("*").alias("entities"))
