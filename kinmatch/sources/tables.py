"""Tab-separated tables with explicit schemas, id lists, model bundles and metrics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.operators.records import COLUMNS

RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
TRUTH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
PAIR_SCHEMA = T.StructType([*(T.StructField(c, T.StringType()) for c in ("source1_entity_id", "target_entity_id", "target_source")), T.StructField("y", T.IntegerType())])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """All columns as declared; a missing text is empty, and a literal NA stays what it is."""
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', enforceSchema=False, nullValue="\x00")
    return df.select(*(F.coalesce(f.name, F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields))


def read_candidates(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Candidate pairs of one source, the source named by the caller and not by the file."""
    df = spark.read.csv(path, sep="\t", header=True)
    if missing := {"source1_entity_id", "target_entity_id"} - set(df.columns):
        raise ValueError(f"{path}: columns are missing: {sorted(missing)}")
    return df.select("source1_entity_id", "target_entity_id").withColumn("target_source", F.lit(source))


def ids_of(spark: SparkSession, path: str) -> DataFrame:
    """First column of the raw lines, without header and blank lines."""
    lines = spark.read.text(path)
    first = F.trim(F.substring_index("value", "\t", 1))
    return lines.select(first.alias("entity_id")).filter((F.col("entity_id") != "") & (F.col("entity_id") != "entity_id"))


def list_lines(spark: SparkSession, path: str, header: Sequence[str]) -> tuple[str | None, DataFrame | None]:
    """(problem, body lines) of a written list; a problem means that it cannot be read further.

    The header is the first line of the first part by name. A list that Spark wrote has one at the top of each
    part; any further line that looks like it is a body line, so that it is reported.
    """
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
        tops = lines.groupBy("_file").agg(F.min("_at").alias("_first"), F.min_by("value", "_at").alias("_top"))
        first = tops.orderBy("_file").first()
    except AnalysisException:
        return f"{path}: not found", None
    if first is None:
        return f"{path}: empty", None
    top = first["_top"]
    if "\t" not in top and "," in top:
        return f"{path}: separated by commas, not tabs", None
    if [c.strip().lower() for c in top.split("\t")] != list(header):
        return f"{path}: unexpected header {top!r}", None
    if bad := undecodable(spark, path):
        return f"{path}: {bad} lines are no UTF-8", None
    heads = F.broadcast(tops.filter(F.col("_top") == top).select("_file", "_first"))  # one row a file
    return None, lines.join(heads, (lines["_file"] == heads["_file"]) & (lines["_at"] == heads["_first"]), "left_anti").select("value")


def undecodable(spark: SparkSession, path: str) -> int:
    """Lines that hold bytes which are no UTF-8."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).count()


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One header per part, bare empty fields; sorted output is range-partitioned, so parts follow each other."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", nullValue="", quote="\x00", escape="\x00")


def write_single_tsv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One sorted file with one header: sorted parts are written by all tasks and then copied together, byte by byte."""
    spark = df.sparkSession
    parts = f"{path}.parts"
    df.orderBy(*order).select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value")).write.mode("overwrite").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    fs.delete(target, True)
    out = fs.create(target, True)
    try:
        out.write(bytearray(("\t".join(df.columns) + "\n").encode()))
        for status in sorted(fs.listStatus(folder), key=lambda f: f.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                part = fs.open(status.getPath())
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
    finally:
        out.close()
    fs.delete(folder, True)


def save_top_k(ranked: DataFrame, path: str) -> None:
    """Ranked candidates once, in parts by source; ``rank <= k`` gives the list of any k."""
    ranked.write.mode("overwrite").partitionBy("target_source").parquet(path)


def load_top_k(spark: SparkSession, path: str, source: str, k: int) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("target_source") == source) & (F.col("rank") <= k))


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Comma-separated with quoting, for diagnostics."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs as :func:`write_tsv` writes them, typed; the label must be there."""
    return spark.read.schema(PAIR_SCHEMA).csv(path, sep="\t", header=True, enforceSchema=False)


def sampled_ids(spark: SparkSession, path: str, column: str = "source1_entity_id") -> DataFrame:
    """The different ids that a written table names in ``column``."""
    return spark.read.csv(path, sep="\t", header=True).select(column).distinct()


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """A small JSON document, through Spark's file systems."""
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_bundle(model, features: Sequence[str], path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    write_metrics(SparkSession.active(), {"feature_columns": list(features)}, f"{path}/features")


def load_bundle(spark: SparkSession, path: str):
    """(pipeline model, feature columns); a bundle without a feature list has the standard ones."""
    from pyspark.errors import AnalysisException
    from pyspark.ml import PipelineModel

    from kinmatch.operators.features import FEATURES

    try:
        features = json.loads(spark.read.text(f"{path}/features").first()["value"])["feature_columns"]
    except AnalysisException:
        features = list(FEATURES)
    return PipelineModel.load(f"{path}/model"), features
