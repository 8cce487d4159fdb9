"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target share of all words. A document enters the mix a
whole number of times plus, with its fractional inclusion probability, once
more; the fractions are decided by the cube method: three undecided documents
at a time are moved along the null space of two balancing constraints (words
taken and documents taken), so that each step decides at least one of them
and keeps both totals. A source is dealt into blocks by id; each block ends
with at most two undecided documents, which meet the leftovers of the other
blocks in the next level, until one block per source is left. Its last two
documents and ten kept back, of all sizes, are the landing problem: of all
choices the one whose words come nearest to the expected ones.

Defined results: null texts have size 0; a null source is a source of its own
and comes last; sources without words have target 0; equal rows are decided
each, and many rows with one id (or none) and one size are dealt out by their
place in the table; a document is taken at most twice; an empty table gives an
empty mix.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import WORD_CLASS, match_nulls, materialize, small, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents that one task decides at a time; at most two of them go on to the next level.
BLOCK_DOCS = 1024
#: Documents of a source that are kept for the landing problem, besides at most two that the flight leaves.
RESERVE = 10
#: Sources are listed on the driver (name and total only); more than this many is an error, not a cut.
MAX_SOURCES = 1_000_000


def targets(totals: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Water-filling: targets in proportion to the weights, none above ``most`` times its source."""
    named = sorted((s for s, _ in totals if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass"))
    order = named + [None] * any(s is None for s, _ in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(totals)
    rest, out, free = share * sum(size.values()), {}, list(order)
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * size[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = most * size[s]
            rest -= out[s]
        free = [s for s in free if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube-method flight on one block: inclusion probabilities with at most two fractions left."""
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    draws = iter(rng.random(len(p) + 3).tolist())
    window: list[int] = []
    for nxt in [i for i, x in enumerate(p) if 0.0 < x < 1.0]:
        window.append(nxt)
        if len(window) < 3:
            continue
        i, j, k = window
        # null vector of [[1, 1, 1], [size_i, size_j, size_k]]
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        scale = max(map(abs, u))
        up = down = np.inf
        for at, d in zip(window, u, strict=True):
            d /= scale
            if d > 0:
                up, down = min(up, (1 - p[at]) / d), min(down, p[at] / d)
            elif d < 0:
                up, down = min(up, p[at] / -d), min(down, (1 - p[at]) / -d)
        step = up if next(draws) * (up + down) < down else -down
        for at, d in zip(window, u, strict=True):
            x = p[at] + step * d / scale
            p[at] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        window = [at for at in window if 0.0 < p[at] < 1.0]
        if len(window) == 3:  # rounding left all three open: the nearest bound is taken
            at = min(window, key=lambda w: min(p[w], 1 - p[w]))
            p[at] = float(round(p[at]))
            window.remove(at)
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last open documents: the choice whose words, then documents, come nearest to the expected ones."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not open_.size:
        return p
    choices = (np.arange(1 << open_.size)[:, None] >> np.arange(open_.size)) & 1
    words = np.abs(choices @ size[open_] - (p[open_] * size[open_]).sum())
    docs = np.abs(choices.sum(1) - p[open_].sum())
    out = p.copy()
    out[open_] = choices[np.lexsort((docs, words))[0]]
    return out


def _decide(last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents first: those left undecided are among the smallest
        pdf = pdf.sort_values(["size", "doc_id", "p"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        seed = hashlib.blake2b(repr(key).encode(), digest_size=8).digest()
        p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy()
        fly = np.ones(p.size, bool)
        if last:  # documents of every size wait for the landing, which then has room to meet the totals
            open_ = np.flatnonzero((p > 0) & (p < 1))
            fly[open_[np.linspace(0, open_.size - 1, min(RESERVE, open_.size)).astype(int)]] = False
        p = p.copy()
        p[fly] = flight(p[fly], size[fly], np.random.default_rng(int.from_bytes(seed, "little")))
        return pdf.assign(p=landing(p, size) if last else p)

    return run


def _salted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``salt``: 0, but for more rows of one source, id and size than a block holds, which it spreads over blocks."""
    same = ["source", "doc_id", "size"]
    hot = materialize(rows.groupBy(*same).agg(F.count("*").alias("copies")).filter(F.col("copies") > BLOCK_DOCS // 4), "hot")
    if hot.isEmpty():
        return rows.withColumn("salt", F.lit(0).cast("long"))
    hot = small(hot.select(*(F.col(c).alias(f"_{c}") for c in same)))
    met = rows.join(hot, match_nulls(rows, hot, {c: f"_{c}" for c in same}), "left")
    return met.select(*rows.columns, F.when(F.col("_size").isNotNull(), F.col("row") + 1).otherwise(0).cast("long").alias("salt"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken; one row per input row."""
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_CLASS)).cast("long")
    rows = materialize(docs.select("doc_id", "source", size.alias("size")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    rows = _salted(rows)
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets([(r["source"], r["source_size"]) for r in per], weights, share, most)
    listed = [(r["source"], r["source_size"], float(goal[r["source"]]), r["docs"]) for r in per]
    known = spark.createDataFrame(listed, "name string, source_size long, target double, docs long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = rows.join(F.broadcast(known) if len(listed) <= 10_000 else known, F.col("source").eqNullSafe(F.col("name"))).withColumn("rate", rate)
    at = at.withColumn("base", F.floor("rate")).withColumn("p", F.col("rate") - F.col("base"))
    columns = "doc_id long, source string, size long, source_size long, target double, base long, p double, docs long, salt long, block long"
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("docs") / BLOCK_DOCS))
    todo = at.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "salt"), blocks)).select(*[c.split()[0] for c in columns.split(", ")])
    most_docs, done = max((r["docs"] for r in per), default=0), []
    while True:
        last = most_docs <= BLOCK_DOCS
        todo = materialize(todo.groupBy("source", "block").applyInPandas(_decide(last), columns), "flight")
        if last:
            done.append(todo)
            break
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(todo.filter(~undecided))
        # at most two go on from each block, so each level is smaller by about BLOCK_DOCS / 2
        todo = todo.filter(undecided).withColumn("docs", F.ceil(F.col("docs") / BLOCK_DOCS) * 2)
        todo = todo.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "salt", F.lit(len(done))), blocks))
        most_docs = 2 * -(-most_docs // BLOCK_DOCS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    taken = F.col("size") * (F.col("base") + F.round("p").cast("long"))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
