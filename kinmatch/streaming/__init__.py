"""Records that arrive over time are linked batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from kinmatch.operators import records
from kinmatch.operators.blocking import candidates


def candidates_of_stream(arriving: DataFrame, s1: DataFrame, path: str, profile: str = "ascii") -> DataStreamWriter:
    """Write the blocked pairs of each arriving batch of target records below ``path``.

    The batch number is part of the folder, so a batch that is run again
    after a failure replaces its own output.
    """
    keyed = records.with_keys(records.normalized(s1, profile))

    def link(batch: DataFrame, number: int) -> None:
        targets = records.with_keys(records.normalized(batch, profile))
        candidates(keyed, targets).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(link)
