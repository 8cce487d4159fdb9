"""Record tables: normalized columns, keys, and retrieval by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.similarity import numeric_tokens
from kinmatch.functions.text import BLOCK_KEYS, compact_block, country_key, normalize, prefix_key

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def normalized(records: DataFrame, profile: str = "ascii") -> DataFrame:
    """Adds name_norm, address_norm, country_norm, computed once per record and before any join."""
    return records.select(
        *COLUMNS,
        normalize("business_name", profile).alias("name_norm"),
        normalize("business_address", profile).alias("address_norm"),
        country_key("country").alias("country_norm"),
    )


def with_keys(records: DataFrame) -> DataFrame:
    """Adds the six inference keys; a key is empty where its text is."""
    return records.withColumns({k: prefix_key("country_norm", c, n) for k, (c, n) in BLOCK_KEYS.items()})


def with_training_keys(records: DataFrame, include_blank: bool = False) -> DataFrame:
    """Adds name_block (4 characters), address_block (8) and the numbers of the address."""
    return records.withColumns(
        {
            "name_block": compact_block("country_norm", "name_norm", 4, include_blank=include_blank),
            "address_block": compact_block("country_norm", "address_norm", 8, include_blank=include_blank),
            "numeric_tokens": numeric_tokens("address_norm"),
        }
    )


def retrieve(records: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    """Records whose id is in ``ids``."""
    return records.join(ids.select(F.col(column).alias("entity_id")).distinct(), "entity_id", "left_semi")


def not_found(records: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    """Wanted ids without a record."""
    return ids.select(F.col(column).alias("entity_id")).distinct().join(records.select("entity_id"), "entity_id", "left_anti")


def point(records: DataFrame, entity_id: str) -> DataFrame:
    """The record of one id; the filter reaches the scan."""
    return records.filter(F.col("entity_id") == entity_id).limit(1)


def retrieve_reported(records: DataFrame, ids: DataFrame, column: str = "entity_id") -> tuple[DataFrame, int]:
    """(records, number of wanted ids without one); without any hit the records are empty with the same columns."""
    return retrieve(records, ids, column), not_found(records, ids, column).count()
