"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import materialize, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) to ``(node, component)``, the component being its smallest node.

    Each round is two aggregations (combined before the shuffle) and two
    equi-joins on tables reread from the shared folder, where adaptive
    execution can split a node with many links. Loops and repeated links are
    ignored; nodes without a link to another node are not returned. The
    rounds end when the edge set stands still.
    """
    forward = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialize(forward, "cc"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour moves to the smallest one of the neighbourhood
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        # small star: the smaller neighbours and the node itself move to the smallest
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        release(now, low, large, low2)
        now = after
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
