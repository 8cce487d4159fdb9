"""Candidate generation by size-guarded equi-joins on several keys, and its recall."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most pairs that a block may form, for short and for long prefixes.
MAX_SHORT, MAX_LONG = 750, 300


@dataclass(frozen=True)
class Route:
    """Join keys, and the key whose block sizes are multiplied and compared with the guard."""

    name: str
    on: tuple[str, ...]
    guard: str | None = None
    limit: int = 0


ROUTES = (
    Route("exact_name", ("name_exact_key",), "name4", MAX_SHORT),
    Route("exact_address", ("address_exact_key",), "address8", MAX_SHORT),
    Route("name_addr8", ("name_exact_key", "address8")),
    Route("addr_name4", ("address_exact_key", "name4")),
    Route("name4", ("name4",), "name4", MAX_SHORT),
    Route("addr8", ("address8",), "address8", MAX_SHORT),
    Route("name6", ("name6",), "name6", MAX_LONG),
    Route("addr10", ("address10",), "address10", MAX_LONG),
)
BY_NAME = {r.name: r for r in ROUTES}
#: An exact key under the guard of its own prefix is contained in the prefix route.
IMPLIED = {"exact_name", "exact_address"}
#: The prefix route to the exact route that it contains: same guard, same limit.
NARROWER = {"name4": "exact_name", "addr8": "exact_address"}


def block_counts(records: DataFrame, key: str) -> DataFrame:
    return records.filter(F.col(key) != "").groupBy(F.col(key).alias("block")).agg(F.count("*").alias("n"))


def open_blocks(s1: DataFrame, target: DataFrame, key: str, limit: int) -> DataFrame:
    """Blocks of both sides whose number of pairs is within the guard."""
    left = block_counts(s1, key).withColumnRenamed("n", "n1")
    right = block_counts(target, key).withColumnRenamed("n", "n2")
    return left.join(right, "block").filter(F.col("n1") * F.col("n2") <= limit)


def route(s1: DataFrame, target: DataFrame, r: Route) -> DataFrame:
    """Pairs (source1_entity_id, target_entity_id) of one route. Closed blocks leave both sides before the pair join."""
    keys = list(dict.fromkeys([*r.on, *([r.guard] if r.guard else [])]))
    present = reduce(lambda x, y: x & y, (F.col(k) != "" for k in r.on))
    left = s1.filter(present).select(F.col("entity_id").alias("source1_entity_id"), *keys)
    right = target.filter(present).select(F.col("entity_id").alias("target_entity_id"), *(F.col(k).alias(f"t_{k}") for k in keys))
    if r.guard:
        if r.guard in r.on:
            blocks = open_blocks(s1, target, r.guard, r.limit).select("block")
            left = left.join(blocks, left[r.guard] == blocks["block"], "left_semi")
        else:
            n1, n2 = block_counts(s1, r.guard), block_counts(target, r.guard)
            left = left.join(n1.withColumnRenamed("n", "n1"), left[r.guard] == n1["block"]).drop("block")
            right = right.join(n2.withColumnRenamed("n", "n2"), right[f"t_{r.guard}"] == n2["block"]).drop("block")
    pairs = left.join(right, reduce(lambda x, y: x & y, (left[k] == right[f"t_{k}"] for k in r.on)))
    if r.guard and r.guard not in r.on:
        pairs = pairs.filter(F.col("n1") * F.col("n2") <= r.limit)
    return pairs.select("source1_entity_id", "target_entity_id")


def _posts(records: DataFrame, routes: list[Route]) -> DataFrame:
    """(entity_id, route, key, exact): one row a record and route whose keys are all present; ``exact`` is the key of the route that it implies."""
    present = lambda r: reduce(lambda x, y: x & y, (F.col(k) != "" for k in r.on))
    exact = lambda r: F.col(BY_NAME[NARROWER[r.name]].on[0]) if r.name in NARROWER else F.lit(None).cast("string")
    each = [F.when(present(r), F.struct(F.lit(i).alias("route"), F.concat_ws("\x1f", *r.on).alias("key"), exact(r).alias("exact"))) for i, r in enumerate(routes)]
    return records.select("entity_id", F.explode(F.array_compact(F.array(*each))).alias("p")).select("entity_id", "p.*")


def candidates(s1: DataFrame, target: DataFrame, with_routes: bool = False) -> DataFrame:
    """Distinct pairs of all routes; ``with_routes`` adds the sorted names of the routes that found each.

    All routes are one join: the routes that remain are guarded by their own
    key or not at all, so each record is posted once a route, closed blocks
    leave both sides, and (route, key) is joined once. A pair of a prefix
    route was found by the exact route too if the exact keys are equal.
    """
    routes = [r for r in ROUTES if r.name not in IMPLIED]
    left, right = _posts(s1, routes), _posts(target, routes)
    count = lambda d, n: d.groupBy("route", "key").agg(F.count("*").alias(n))
    limits = F.create_map(*[x for i, r in enumerate(routes) if r.guard for x in (F.lit(i), F.lit(r.limit))])
    blocks = count(left, "n1").join(count(right, "n2"), ["route", "key"])
    blocks = blocks.filter(limits[F.col("route")].isNull() | (F.col("n1") * F.col("n2") <= limits[F.col("route")])).select("route", "key")
    right = right.withColumnRenamed("entity_id", "target_entity_id").withColumnRenamed("exact", "t_exact")
    met = left.join(blocks, ["route", "key"]).withColumnRenamed("entity_id", "source1_entity_id").join(right, ["route", "key"])
    if not with_routes:
        return met.select("source1_entity_id", "target_entity_id").distinct()
    bit = {r.name: 1 << i for i, r in enumerate(sorted(ROUTES, key=lambda r: r.name))}
    own = F.element_at(F.array(*(F.lit(bit[r.name]) for r in routes)), F.col("route") + 1)
    also = F.element_at(F.array(*(F.lit(bit.get(NARROWER.get(r.name), 0)) for r in routes)), F.col("route") + 1)
    mask = own.bitwiseOR(F.when(F.col("exact") == F.col("t_exact"), also).otherwise(F.lit(0)))
    found = met.groupBy("source1_entity_id", "target_entity_id").agg(F.bit_or(mask).alias("mask"))
    names = F.array_compact(F.array(*(F.when(F.col("mask").bitwiseAND(b) != 0, F.lit(n)) for n, b in bit.items())))
    return found.select("source1_entity_id", "target_entity_id", names.alias("routes"))


def name_or_address(s1: DataFrame, target: DataFrame, limit: int | None = None) -> DataFrame:
    """Training candidates: name block or address block; two equi-joins instead of a disjunction.

    With ``limit``, a block of more pairs does not meet as a whole: its records then share twice the
    prefix too, and where even that has too many pairs, the whole normalized text.
    """

    def one(key: str, field: str, n: int) -> DataFrame:
        longer = [] if limit is None else [F.substring(field, 1, 2 * n).alias("k1"), F.col(field).alias("k2")]
        left = s1.filter(F.col(key) != "").select(F.col("entity_id").alias("source1_entity_id"), F.col(key).alias("k0"), *longer)
        right = target.filter(F.col(key) != "").select(F.col("entity_id").alias("target_entity_id"), F.col(key).alias("k0"), *longer)
        on, found = ["k0"], None
        while True:
            last = limit is None or len(on) == 3
            blocks = None if last else _pair_counts(left, right, on)
            kept = [side if last else side.join(blocks.filter(F.col("pairs") <= limit).select(*on), on, "left_semi") for side in (left, right)]
            part = kept[0].join(kept[1].select("target_entity_id", *on), on).select("source1_entity_id", "target_entity_id")
            found = part if found is None else found.unionByName(part)
            if last:
                return found
            left, right = (side.join(blocks.filter(F.col("pairs") > limit).select(*on), on, "left_semi") for side in (left, right))
            on = [*on, f"k{len(on)}"]

    return one("name_block", "name_norm", 4).unionByName(one("address_block", "address_norm", 8)).distinct()


def _pair_counts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    n1, n2 = left.groupBy(*on).agg(F.count("*").alias("n1")), right.groupBy(*on).agg(F.count("*").alias("n2"))
    return n1.join(n2, on).withColumn("pairs", F.col("n1") * F.col("n2"))


def blocking_recall(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source how many true pairs share the name block, the address block, either, both."""
    left = s1.select(F.col("entity_id").alias("source1_entity_id"), F.col("name_block").alias("n1"), F.col("address_block").alias("a1"))
    right = targets.select(F.col("entity_id").alias("target_entity_id"), F.col("name_block").alias("n2"), F.col("address_block").alias("a2"))
    met = pairs.join(left, "source1_entity_id").join(right, "target_entity_id", "left")
    by_name = F.coalesce((F.col("n1") == F.col("n2")) & (F.col("n1") != ""), F.lit(False))
    by_address = F.coalesce((F.col("a1") == F.col("a2")) & (F.col("a1") != ""), F.lit(False))
    missing = F.col("n2").isNull()
    total = lambda c: F.sum(c.cast("long"))
    return met.groupBy("target_source").agg(
        F.count("*").alias("total_pairs"),
        total(missing).alias("missing_target"),
        total(by_name).alias("name_recovered"),
        total(by_address).alias("address_recovered"),
        total(by_name | by_address).alias("union_recovered"),
        total(by_name & by_address).alias("both"),
        total(by_name & ~by_address).alias("name_only"),
        total(~by_name & by_address).alias("address_only"),
        total(~by_name & ~by_address & ~missing).alias("neither"),
    )
