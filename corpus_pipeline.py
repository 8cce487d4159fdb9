"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, and the final mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's ``docs``. All but the last return
the columns of ``docs`` unchanged; extra columns, whatever their names, pass
through. Rows with a null doc_id are judged by their text in every filtering
stage but that of near copies, where they stay. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from kinmatch.llm.common import fresh, match_nulls, materialize, small, table, text_key
from kinmatch.shipping import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (score of 0.7 or more)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "quality_score")
    return quality.score(docs, model, docs.columns, name).filter(F.col(name) >= quality.THRESHOLD).drop(name)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id (null being an id like others) is in ``ids`` (_id), a written narrow table."""
    gone = small(ids)
    return docs.join(gone, match_nulls(docs, gone, {"doc_id": "_id"}), "left_anti")


def keep_first_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the row with the smallest doc_id.

    Only ids travel: those of the rows that go. Rows that share their id are told apart by their texts, and they alone are shuffled.
    """
    found = materialize(exact_dedup.exact_dedup(docs).select("doc_id", "kept", "text_sha256"), "found")
    per = materialize(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("n > 1 OR NOT kept"), "per")
    shared = per.filter("n > 1").select("_id")
    out = _without(docs, per.select("_id"))
    if shared.isEmpty():
        return out
    sha, rank = fresh(docs, "text_sha"), fresh(docs, "copy_rank")
    some = docs.join(shared, match_nulls(docs, shared, {"doc_id": "_id"}), "left_semi").withColumn(sha, F.sha2(exact_dedup.normalized(), 256))
    first = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    some = some.join(first, match_nulls(some, first, {"doc_id": "_id", sha: "_sha"}), "left_semi")
    one = Window.partitionBy(sha, "doc_id").orderBy("doc_id")
    return out.unionByName(some.withColumn(rank, F.row_number().over(one)).filter(F.col(rank) == 1).select(*docs.columns))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that with the smallest id, then text hash.

    Only the hashes of the rows that go travel. Texts without words and rows without id have no group and stay.
    """
    found = materialize(near_dedup.near_rows(docs).filter("root IS NOT NULL").select("doc_id", "t0", "t1", "root"), "found")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "t0", "t1")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    goes = found.join(first, "root").filter(F.struct("doc_id", "t0", "t1") != F.col("first"))
    gone = small(materialize(goes.select(F.col("doc_id").alias("_id"), F.col("t0").alias("_t0"), F.col("t1").alias("_t1")).distinct(), "gone"))
    names = [fresh(docs, "t0"), fresh(docs, "t1")]
    marked = docs.withColumns({n: c for n, c in zip(names, text_key(), strict=True)})
    return marked.join(gone, match_nulls(marked, gone, {"doc_id": "_id", names[0]: "_t0", names[1]: "_t1"}), "left_anti").drop(*names)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each remaining document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_first_copy),
    ("near_dedup", keep_one_of_near),
    ("decontaminate", drop_leaks),
    ("mix", mix),
]

#: SQL can express neither the trained classifier nor the sampling; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
