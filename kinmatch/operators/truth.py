"""Ground truth: expansion of id lists, source resolution, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.text import count_from, id_list, source_of


def explode_truth(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) to one row a pair, with the target's source; repeated ids stay."""
    pairs = truth.select("source1_entity_id", F.explode(id_list("matched_entity_ids")).alias("target_entity_id"))
    return pairs.withColumn("target_source", source_of("target_entity_id"))


def true_pairs(truth: DataFrame) -> DataFrame:
    return explode_truth(truth).select("source1_entity_id", "target_entity_id").distinct()


def match_counts(truth: DataFrame) -> DataFrame:
    ids = id_list("matched_entity_ids")
    return truth.select("source1_entity_id", F.size(ids).alias("n_matches"), count_from(ids, "S2").alias("n_s2"), count_from(ids, "S3").alias("n_s3"))


def resolve_source(ids: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """The source that really holds an id (S2 before S3); ids of neither are dropped."""
    held = s2.select("entity_id", F.lit("S2").alias("target_source")).unionByName(s3.select("entity_id", F.lit("S3").alias("target_source")))
    held = held.groupBy("entity_id").agg(F.min("target_source").alias("target_source"))
    return ids.join(held.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id")


def draw(column: str, seed: int) -> Column:
    """The same pseudo-random text for an id on every engine and run; samples are taken in its order."""
    return F.md5(F.concat(F.col(column), F.lit(f":{seed}")))


def sample(df: DataFrame, n: int, seed: int = 42, key: str = "source1_entity_id") -> DataFrame:
    return df.orderBy(draw(key, seed), key).limit(n)


def matched_sample(truth: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """:func:`sample` among the records that have a match."""
    return sample(match_counts(truth).filter("n_matches > 0").select("source1_entity_id"), n, seed)


def first_match(truth: DataFrame, source: str = "S2") -> DataFrame:
    """Every record with its first listed target of ``source``, null without one."""
    ids = F.filter(id_list("matched_entity_ids"), lambda x: x.startswith(f"{source}-"))
    return truth.select("source1_entity_id", F.try_element_at(ids, F.lit(1)).alias("target_entity_id"))


def stratified_sample(df: DataFrame, stratum: str, n: int, seed: int = 42, key: str = "source1_entity_id") -> DataFrame:
    """At most ``n`` rows of each stratum."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(key, seed), key))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def stratified_split(df: DataFrame, stratum: str, share: float = 0.8, seed: int = 42, key: str = "pair_id") -> DataFrame:
    """Adds ``is_train``: true for the first ``share`` of each stratum, sizes exact.

    The draw is cut at each stratum's quantile bucket by a windowed count over
    4096 hash buckets, so a stratum of any size is ranked inside buckets only.
    """
    bucket = F.conv(F.substring(draw(key, seed), 1, 3), 16, 10).cast("int")
    df = df.withColumn("_bucket", bucket).withColumn("_draw", draw(key, seed))
    sizes = df.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(stratum))})
    inside = F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy("_draw", key))
    ranked = df.join(sizes, [stratum, "_bucket"]).withColumn("_rank", F.col("_before") + inside)
    return ranked.withColumn("is_train", F.col("_rank") <= F.floor(F.col("_all") * share)).drop("_bucket", "_draw", "_n", "_before", "_all", "_rank")
