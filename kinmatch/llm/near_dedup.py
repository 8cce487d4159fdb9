"""Near-duplicate detection by an inverted join over MinHash signature coordinates.

1. Each text becomes its set of word shingles and a signature of 64 minima.
   Texts with equal sets (copies among them) collapse into one class by an
   aggregation; classes, not ids, are the nodes from here on.
2. A class is posted under every (coordinate, value) pair. Values that no
   other class has cannot collide and go first.
3. A pair above the match threshold agrees in at least T coordinates, so a
   class with fewer than T shared values has no partner, and one with n of
   them need only be posted under its n - T + 1 rarest (prefix filter). The
   longer lists, those of lines that many texts share, are skipped, and what
   a pair has in common in them is looked up in the signatures.
4. Members of a list are first held against two of its members, the smallest
   and the largest, then those outside the list's main component against a
   few of that component. Confirmed links are contracted each time. What is
   still outside the main component of a list is compared with all of the
   list inside a join on it, under the first common posting of a pair only,
   and dropped there if sketches of 4096 bits show that it is too far below
   the threshold, so that of a group whose members resemble each other just
   too little few pairs leave the join.
5. Pairs with T agreeing coordinates are confirmed on the full shingle sets.

Guarantee: the confirmation is exact; a link of similarity 0.8 is missed as a
candidate with probability below 1e-5 (tails of the binomial distribution:
fewer than 36 of 64 coordinates agree in 4.2e-6 of such links, and more than
500 of 4096 bits, or 92 of the first 512, differ in 2.2e-6).

Defined results: null and empty texts, and texts without words, have an empty
set, are linked with nothing and are their own component; fewer words than a
shingle count as one shingle; equal rows get equal results; rows with one id
and several texts are linked each by their own text; null doc_ids are returned
as their own component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import WORD_BYTES, encoded, materialize, mix, release, shingles, table, text_key, text_slices, word_hashes
from kinmatch.llm.components import connected_components

COORDINATES = 64
#: Bits (a power of two) that stand for wanted ids before texts are shuffled.
SCREEN_BITS = 27
#: Coordinates that are posted at a time.
POSTED = 16
#: Coordinates that must agree before a pair is confirmed on full sets.
MATCHES = 36
#: Members of a list's main component that its other members are held against before the exhaustive pass.
PIVOTS = 3

_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOW = np.uint64(COORDINATES - 1)


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima of every non-empty set of a concatenation, one row a set; the low bits name the coordinate."""
    out = np.empty((starts.size, COORDINATES), np.uint64)
    for i, seed in enumerate(_SEEDS):
        h = sets * seed
        h ^= h >> np.uint64(29)
        out[:, i] = (np.minimum.reduceat(h, starts) & ~_LOW) | np.uint64(i)
    return out


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for lo, hi in text_slices(texts):
        h, bounds = word_hashes(texts[lo:hi], WORD_BYTES)
        yield lo, [shingles(h[bounds[i] : bounds[i + 1]], width) for i in range(hi - lo)]


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two hashes (n, 2) of each set, zeros for an empty one."""
    key = np.zeros((len(sets), 2), np.uint64)
    sizes = np.array([s.size for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if full.size:
        joined = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        key[full, 0] = np.add.reduceat(mix(joined), starts)
        key[full, 1] = np.bitwise_xor.reduceat(mix(joined + np.uint64(7)), starts)
    return key


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(encoded(batch.column(3).to_pylist()), width):
                sizes = np.array([s.size for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                sig = np.zeros((len(sets), COORDINATES), np.uint64)
                if full.size:
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    sig[full] = signatures(np.concatenate([sets[i] for i in full]), starts)
                key = set_keys(sets).view(np.int64)
                flat = pa.array(sig[full].ravel().view(np.int64))
                at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, COORDINATES, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, len(sets)) for c in range(3)),
                        pa.array(sizes),
                        pa.array(key[:, 0].copy()),
                        pa.array(key[:, 1].copy()),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat),
                    ],
                    ["doc_id", "t0", "t1", "n_shingles", "k0", "k1", "sig"],
                )

    return run


def sketches(docs: DataFrame, width: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    return rows.mapInArrow(_sketcher(width), "doc_id long, t0 long, t1 long, n_shingles long, k0 long, k1 long, sig array<long>")


def _set_builder(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1).view(np.uint64).reshape(-1, 2)
            for lo, sets in shingle_sets(encoded(batch.column(3).to_pylist()), width):
                mine = np.flatnonzero((set_keys(sets) == wanted[lo : lo + len(sets)]).all(1))  # of an id with several texts, the class's own
                at = np.concatenate([[0], np.cumsum([sets[i].size for i in mine])]).astype(np.int32)
                flat = pa.array(np.concatenate([sets[i] for i in mine]).view(np.int64) if mine.size else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mine + lo)), pa.ListArray.from_arrays(pa.array(at), flat)], ["node", "words"])

    return run


#: Bits of the fine sketch, and how many may differ: at similarity 0.8 a tenth of them is expected to,
#: and more than this limit with probability 2.2e-6.
FINE_BITS = 4096
FINE_APART = 500
#: The same for the first words of the sketch, which are compared first.
FIRST_WORDS, FIRST_APART = 8, 92
_FINE_SEEDS = mix(np.arange(1001, 1001 + FINE_BITS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def fine_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One bit of each of ``FINE_BITS`` further minima, packed into words of 64."""
    bits = np.empty((len(sets), FINE_BITS), bool)
    starts = np.concatenate([[0], np.cumsum([s.size for s in sets])[:-1]])
    joined = np.concatenate(sets)
    for i, seed in enumerate(_FINE_SEEDS):
        h = joined * seed
        h ^= h >> np.uint64(29)
        bits[:, i] = (mix(np.minimum.reduceat(h, starts)) & np.uint64(1)).astype(bool)
    return np.packbits(bits, axis=1).view(np.int64)


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            words = part.column(1)
            sets = [np.asarray(w.values).view(np.uint64) for w in words]
            flat = fine_sketches(sets).ravel()
            ends = pa.array(np.arange(0, flat.size + 1, FINE_BITS // 64, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "fine"])


def bits_apart(left: str, right: str, words: int = FINE_BITS // 64):
    """How many bits of two sketches differ, the words being columns: short code, which the JVM compiles."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))) for i in range(words)))


def collisions(left: str, right: str):
    """In how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def prefix_posts(reps: DataFrame, matches: int) -> DataFrame:
    """(node, n, key): each class under its rarest shared values, as many as the threshold needs.

    Few values are shared, so a quarter of the coordinates is shuffled at a time and only its shared values stay on disk.
    """
    parts = []
    for at in range(0, COORDINATES, POSTED):
        posts = reps.select("node", "n", F.explode(F.slice("sig", at + 1, POSTED)).alias("key"))
        shared = materialize(posts.groupBy("key").agg(F.count("*").alias("listed")).filter("listed > 1"), "lists")
        parts.append(materialize(posts.join(shared, "key"), "held"))
        release(shared)
    held = reduce(DataFrame.unionByName, parts)
    ranked = (
        held.groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("listed", "key"))).alias("by"))
        .filter(F.size("by") >= matches)
        .select("node", "n", F.explode(F.slice("by", F.lit(1), F.size("by") - (matches - 1))).alias("p"))
    )
    out = materialize(ranked.select("node", "n", F.col("p.key").alias("key")), "posts")
    release(*parts)
    return out


def _colliding(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough coordinates."""
    sig = reps.select("node", "sig")
    return (
        pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        .filter(collisions("sa", "sb") >= matches)
        .select("a", "b")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, matches: int | None = None) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; with ``matches`` the signatures in ``sets`` must agree in so many coordinates first."""
    likely = materialize(pairs, "likely")
    side = lambda p: sets.select(F.col("node").alias(p), F.col("words").alias(f"w{p}"), *([F.col("sig").alias(f"s{p}")] if matches else []))
    both = likely.join(side("a"), "a").join(side("b"), "b")
    if matches:
        both = both.filter(collisions("sa", "sb") >= matches)
    both = both.withColumn("common", F.size(F.array_intersect("wa", "wb")))
    links = both.filter(100 * F.col("common") >= percent * (F.size("wa") + F.size("wb") - F.col("common"))).select("a", "b")
    out = materialize(links, "links")
    release(likely)
    return out


def screened(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``: bits of hashes, broadcast in pieces of 4 KB, at most 16 MB in all.

    None that is wanted is lost; the join that follows drops what else the bits let through.
    """
    h = F.xxhash64(key).bitwiseAND(F.lit((1 << SCREEN_BITS) - 1))
    piece, bit = F.shiftright(h, 15), h.bitwiseAND(F.lit(32767))
    bits = F.broadcast(wanted.select(piece.alias("_piece"), bit.alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(bits, piece == F.col("_piece"))
    return met.filter(F.lit(0) < byte.bitwiseAND(F.pow(F.lit(2), bit.bitwiseAND(F.lit(7))).cast("int"))).select(*rows.columns)


def class_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, words): the full shingle set of each class, from the text of its smallest id; one row a class."""
    texts = screened(docs.select(F.col("doc_id").cast("long").alias("low"), "text"), classes, "low").join(classes.select("low", "node", "k0", "k1"), "low")
    sets = materialize(texts.select("node", "k0", "k1", "text").mapInArrow(_set_builder(width), "node long, words array<long>"), "sets")
    if sets.count() == classes.count():
        return sets
    out = materialize(sets.dropDuplicates(["node"]), "sets")
    release(sets)
    return out


def _met(posts: DataFrame, pivots: DataFrame, close) -> DataFrame:
    """Pairs (a, b) of the members of each list with its pivots (key, end)."""
    return (
        posts.select("key", F.col("node").alias("x"), F.col("n").alias("na"))
        .join(pivots.select("key", F.col("end.node").alias("y"), F.col("end.n").alias("nb")), "key")
        .filter(F.col("x") != F.col("y"))
        .filter(close)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def _open_lists(posts: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, n, component, main) of the lists whose members lie in several components; ``main`` is the component with the most of them."""
    comps = materialize(connected_components(found), "comps")
    placed = materialize(posts.join(comps, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component")), "placed")
    release(comps)
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("members"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    main = materialize(main, "main")
    out = materialize(placed.join(main, "key"), "open")
    release(placed, main)
    return out


def links(docs: DataFrame, reps: DataFrame, width: int, matches: int, percent: int) -> DataFrame:
    """Components (node, component) of the classes that have a link, from confirmed links that span each."""
    posts = prefix_posts(reps, matches)
    close = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    wanted = reps.select("node", "low", "k0", "k1").join(posts.select("node").distinct(), "node", "left_semi")
    sets = class_sets(docs, materialize(wanted, "wanted"), width)
    member = F.struct("node", "n")
    ends = posts.groupBy("key").agg(F.min_by(member, "node").alias("lo"), F.max_by(member, "node").alias("hi"), F.count("*").alias("listed")).filter("listed > 1")
    ends = materialize(ends.select("key", F.explode(F.array("lo", "hi")).alias("end")), "ends")
    found = _confirmed(_colliding(_met(posts, ends, close), reps, matches), sets, percent)
    held = _open_lists(posts, found)
    picked = held.filter(F.col("component") == F.col("main")).groupBy("key").agg(*(F.min_by(member, F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)))
    pivots = materialize(picked.select("key", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("end")), "pivots")
    apart = held.filter(F.col("component") != F.col("main"))
    found = materialize(found.unionByName(_confirmed(_colliding(_met(apart, pivots, close), reps, matches), sets, percent)), "found")
    release(held)
    # What is left: the members outside the main component of a list against all of the list. Each pair meets once,
    # under the first of its common postings, and only if its fine sketches are near enough.
    held = _open_lists(posts, found)
    nodes = held.select("node").distinct()
    fine = materialize(sets.join(nodes, "node", "left_semi").mapInArrow(_fine, "node long, fine array<long>"), "fine")
    keys = materialize(posts.join(nodes, "node", "left_semi").groupBy("node").agg(F.collect_list("key").alias("keys")), "keys")
    words = range(FINE_BITS // 64)
    rest = held.join(fine.select("node", *(F.col("fine")[i].alias(f"f{i}") for i in words)), "node").join(keys, "node")
    rest = materialize(rest, "rest")
    release(fine, keys)
    left = rest.filter("component <> main").select("key", "main", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("keys").alias("ka"), *(F.col(f"f{i}").alias(f"fa{i}") for i in words))
    right = rest.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("keys").alias("kb"), *(F.col(f"f{i}").alias(f"fb{i}") for i in words))
    other = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & close
    near = (bits_apart("fa", "fb", FIRST_WORDS) <= FIRST_APART) & (bits_apart("fa", "fb") <= FINE_APART)
    once = F.array_min(F.array_intersect("ka", "kb")) == left["key"]
    cross = left.join(right, (left["key"] == right["key"]) & other & near & once)
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # few pairs are left: their signatures and sets are looked up in one step
    both = materialize(sets.join(nodes, "node", "left_semi").join(reps.select("node", "sig"), "node"), "both")
    more = _confirmed(cross, both, percent, matches)
    release(rest, both, sets, posts)
    return materialize(connected_components(materialize(found.unionByName(more), "every")), "comps")


def near_rows(docs: DataFrame, width: int = 5, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """One row per input row: doc_id, t0 and t1 (hashes of the text), n_shingles, component_id, kept, and ``root``, which names the component."""
    sketched = materialize(sketches(docs, width), "sketch")
    by = ["k0", "k1", "n_shingles"]
    classes = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*by).agg(F.min("doc_id").alias("low"), F.any_value("sig").alias("sig"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = materialize(sketched.drop("sig"), "rows")  # the signatures, most of the table, need not wait for the end
    release(sketched)
    comps = links(docs, classes.withColumnRenamed("n_shingles", "n"), width, matches, percent)
    placed = materialize(classes.select(*by, "low", "node").join(comps, "node", "left").select(*by, "low", F.coalesce("component", "node").alias("root")), "placed")
    release(classes)
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = materialize(placed.join(lowest, "root").select(*by, "root", "component_id"), "placed")
    out = rows.join(placed, by, "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("component_id", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))).withColumn("root", F.when(linked, F.col("root")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "t0", "t1", "root")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    return near_rows(docs, width, percent, matches).drop("t0", "t1", "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=4)
