"""Exact deduplication against immutable snapshots screened by binary fuse filters.

A store is a list of snapshots. Each holds the groups that one batch added
(digest, keeper, size) and, per digest shard, a static binary fuse filter over
its digests. A new batch is grouped by digest on its own first, so a text with
any number of copies is one row from then on. Its digests are screened by the
filters, shard beside shard: what is negative in all of them is new and final;
only positives meet the exact buckets, and only a group found there joins an
older one. Nothing else merges groups of different batches.

Every group of more than one row is then compared byte by byte: the smallest
and the largest of its normalised texts, combined before the shuffle, are one
and the same. Rows of a digest for which they are not (a collision) are
grouped by their bytes instead.

Defined results: null text is the empty text; empty texts are equal to each
other; rows that repeat a doc_id are counted each; a null doc_id is never
preferred as keeper unless the whole group has none; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import SPACE_CLASS, materialize, small, table
from kinmatch.llm.fuse import BinaryFuse8

#: Digests in a filter shard: what one task builds and holds at a time.
SHARD_KEYS = 200_000
MIN_SHARDS = 512


def normalized(column: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), SPACE_CLASS, " ")


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """One narrow row per document: no text goes through a shuffle unless asked for by ``more``."""
    return docs.select("doc_id", normalized().alias("norm")).select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("second"),
        *more,
    )


KEY = ["digest", "n_bytes", "second"]


def grouped(rows: DataFrame) -> DataFrame:
    """The groups of one batch: keeper and size, combined before the shuffle."""
    return rows.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _keys(digest: pd.Series) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "little") for d in digest], np.uint64)


@dataclass
class Snapshot:
    """Groups of one ingested batch and the filters over their digests, as tables that never change."""

    groups: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def freeze(groups: DataFrame, shards: int | None = None) -> Snapshot:
        groups = materialize(groups, "snapshot")
        if shards is None:
            shards = max(MIN_SHARDS, -(-groups.count() // SHARD_KEYS))

        def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [key[0]], "filter": [BinaryFuse8.build(_keys(pdf["digest"])).to_bytes()]})

        filters = groups.select(_shard(shards).alias("shard"), "digest").groupBy("shard").applyInPandas(build, "shard int, filter binary")
        return Snapshot(groups, materialize(filters, "fuse"), shards)

    def screen(self, groups: DataFrame) -> DataFrame:
        """``groups`` with ``maybe``: false means that no digest of this snapshot is equal."""

        def probe(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            hit = BinaryFuse8.from_bytes(right["filter"].iloc[0]).probe(_keys(left["digest"])) if len(right) and len(left) else np.zeros(len(left), bool)
            return left.drop(columns="shard").assign(maybe=hit)

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema) + ", maybe boolean"
        return groups.withColumn("shard", _shard(self.shards)).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, schema)


def ingest(batch: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """``batch`` (from :func:`grouped`) with ``home``: the number of the snapshot that holds an equal digest, null for new ones."""
    found = None
    for number, snapshot in enumerate(snapshots):
        positive = snapshot.screen(batch).filter("maybe").select(*KEY)
        hit = positive.join(snapshot.groups.select(*KEY), KEY).withColumn("home", F.lit(number))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return batch.withColumn("home", F.lit(None).cast("int"))
    # snapshots hold new digests only, so a digest is found in one of them at most
    return batch.join(found, KEY, "left")


def collided(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the ``wanted`` keys those that stand for texts of different bytes.

    The scan keeps only texts of wanted keys, as long as these are few enough to broadcast their second digests.
    """
    seconds = small(materialize(wanted.select("second").distinct(), "seconds"))
    texts = digests(docs, "norm").join(seconds, "second", "left_semi")
    return texts.groupBy(*KEY).agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select(*KEY)


def by_bytes(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, digest) of the rows of ``keys``, grouped by their whole normalised texts."""
    rows = materialize(digests(docs, "norm").join(keys, KEY), "collided")
    groups = rows.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, "norm").select("doc_id", "keep_id", "group_size", "digest")


def exact_dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """Deduplicate ``docs`` (doc_id, text) in ``batches`` ingestions; the batch comes from the id alone.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input
    row. Of rows that repeat the keeper's own id, each has ``kept`` true.
    """
    rows = materialize(digests(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "digests")
    snapshots: list[Snapshot] = []
    members = None
    for b in range(batches):
        placed = ingest(materialize(grouped(rows.filter(F.col("batch") == b)), "batch"), snapshots)
        placed = materialize(placed.withColumn("batch", F.lit(b)), "placed")
        members = placed if members is None else members.unionByName(placed)
        if b + 1 < batches:
            snapshots.append(Snapshot.freeze(placed.filter("home IS NULL").select(*KEY, "keep_id", "group_size")))
    members = members.withColumn("home", F.coalesce("home", "batch"))
    groups = members.groupBy("home", *KEY).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = materialize(groups.filter("group_size > 1"), "groups")
    wrong = materialize(collided(docs, groups.select(*KEY).distinct()), "wrong")
    joint = members.select("batch", "home", *KEY).join(groups, ["home", *KEY]).drop("home")
    joint = materialize(joint, "joint")
    held = rows
    regrouped = None
    if not wrong.isEmpty():
        held, regrouped = rows.join(wrong, KEY, "left_anti"), by_bytes(docs, wrong)
    whole = held.join(joint, ["batch", *KEY], "left").select("doc_id", "keep_id", "group_size", "digest")
    whole = whole.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    if regrouped is not None:
        whole = whole.unionByName(regrouped)
    return whole.select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
