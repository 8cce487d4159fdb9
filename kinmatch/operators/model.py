"""The matching model: balanced logistic regression on standardized features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.scoring import logit, sigmoid
from kinmatch.operators.features import FEATURES


def fit(table: DataFrame, features: Sequence[str] = FEATURES) -> PipelineModel:
    """Classes weigh the same; the penalty is that of an L2 objective with C = 1."""
    rows = table.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features), F.col("y").cast("double").alias("y")).persist()
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0.0, 1.0}:
        raise ValueError("both classes are needed")
    total = sum(counts.values())
    weight = F.when(F.col("y") == 1.0, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        _regression(total),
    ]
    model = Pipeline(stages=stages).fit(rows.withColumn("weight", weight))
    rows.unpersist()
    return model


def fit_counts(counts: DataFrame, features: Sequence[str] = FEATURES) -> dict:
    """:func:`linear_parts` of :func:`fit` on a table whose equal rows stand once, with their number ``n``."""
    rows = counts.persist()
    labels = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if set(labels) != {0, 1}:
        raise ValueError("both classes are needed")
    total = sum(labels.values())
    mean = rows.agg(*((F.sum(F.col("n") * F.col(f)) / total).alias(f) for f in features)).first()
    squares = rows.agg(*(F.sum(F.col("n") * (F.col(f) - mean[f]) ** 2).alias(f) for f in features)).first()
    std = {f: (squares[f] / max(1, total - 1)) ** 0.5 for f in features}
    weight = F.col("n") * F.when(F.col("y") == 1, total / (2 * labels[1])).otherwise(total / (2 * labels[0]))
    scaled = rows.select(*(((F.col(f) - mean[f]) * (1 / std[f] if std[f] else 0.0)).alias(f) for f in features), F.col("y").cast("double").alias("y"), weight.alias("weight"))
    table = VectorAssembler(inputCols=list(features), outputCol="features").transform(scaled).select("features", "y", "weight")
    lr = _regression(total).fit(table)
    rows.unpersist()
    return {"mean": mean.asDict(), "scale": {f: std[f] or 1.0 for f in features}, "coefficient": dict(zip(features, map(float, lr.coefficients), strict=True)), "intercept": float(lr.intercept)}


def _regression(total: int) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=1000, tol=1e-10, regParam=1.0 / total, elasticNetParam=0.0, standardization=False)


def predict(model: PipelineModel, table: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Adds ``probability`` of a match."""
    filled = table.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return model.transform(filled).withColumn("probability", vector_to_array("probability")[1]).drop("raw_features", "features", "rawPrediction", "prediction")


def linear_parts(model: PipelineModel, features: Sequence[str] = FEATURES) -> dict:
    """mean, scale and coefficient by feature, and the intercept."""
    scaler = next(s for s in model.stages if isinstance(s, StandardScalerModel))
    lr = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    scale = [float(x) or 1.0 for x in scaler.std]
    zip_ = lambda values: dict(zip(features, map(float, values), strict=True))
    return {"mean": zip_(scaler.mean), "scale": zip_(scale), "coefficient": zip_(lr.coefficients), "intercept": float(lr.intercept)}


def linear_probability(parts: dict, columns: dict[str, Column]) -> Column:
    """Probability as a column, so that scoring stays in the JVM; a feature without column stands at its mean."""
    return sigmoid(logit(columns, parts["mean"], parts["scale"], parts["coefficient"], parts["intercept"]))
