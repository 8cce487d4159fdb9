import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import exact_dedup, near_dedup
from kinmatch.llm.components import connected_components
from kinmatch.llm.fuse import BinaryFuse8

from .helpers import SF, documents, prose, rows_of


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 5000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    f = BinaryFuse8.from_bytes(BinaryFuse8.build(np.concatenate([keys, keys])).to_bytes())
    assert f.probe(keys).all()
    assert f.probe(rng.integers(0, 1 << 63, 20000).astype(np.uint64)).mean() < 0.02 or n < 3


def plain_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm, strict=True):
        ids = [e for (e, _), m in zip(rows, norm, strict=True) if m == n]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (4, " "), (5, "a  b"), (None, "a b"), (None, "only null"), (7, "é" * 70000), (8, "é" * 70000), (10, "x\x0by")]


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_rows(spark, batches):
    out = exact_dedup.exact_dedup(documents(spark, ROWS), batches)
    assert rows_of(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain_exact(ROWS)


def exact_result(spark):
    return rows_of(exact_dedup.exact_dedup(documents(spark, ROWS), 2), "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_groups_join_through_the_filters_only(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.Snapshot, "screen", lambda self, groups: groups.withColumn("maybe", F.lit(False)))
    assert exact_result(spark) != plain_exact(ROWS)


@pytest.mark.parametrize("every", [True, False])
def test_exact_collisions_are_told_apart_by_bytes(spark, monkeypatch, every):
    plain = exact_dedup.digests

    def weak(docs, *more):
        same = {"second": F.lit(0).cast("long"), "n_bytes": F.lit(1)}
        if every:
            same["digest"] = F.unhex(F.lit("00" * 32))
        return plain(docs, *more).withColumns(same)

    monkeypatch.setattr(exact_dedup, "digests", weak)
    assert [r[:4] for r in exact_result(spark)] == [r[:4] for r in plain_exact(ROWS)]


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(documents(spark, ROWS).limit(0)).count() == 0


def plain_near(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    low = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return sorted(((d, len(sets[d]), low[d], low[d] == d) for d in sets), key=str)


def near_rows():
    rows = [(i, prose(i)) for i in range(20)]
    base = prose(99, 80).split()
    for k in range(30):  # a chain of edits and a cloud around one text
        edited = list(base)
        for j in range(k % 6):
            edited[(7 * k + 13 * j) % 80] = f"edit{k}x{j}"
        rows.append((100 + k, " ".join(edited)))
    chain = list(base)
    for k in range(12):
        chain[5 * k] = f"chain{k}"
        rows.append((200 + k, " ".join(chain).upper()))
    shared = prose(7, 12)
    rows += [(300 + k, f"{shared} {prose(500 + k, 8)}") for k in range(25)]
    return rows + [(400, ""), (401, None), (402, "one two"), (403, "One  two"), (404, "one"), (405, "word " * 30000), (406, "word " * 29000)]


@pytest.mark.parametrize("width", [4, 5])
def test_near_rows(spark, width):
    rows = near_rows()
    out = near_dedup.near_dedup(documents(spark, rows), width)
    assert rows_of(out, "doc_id", "n_shingles", "component_id", "kept") == plain_near(rows, width)


def test_near_repeated_and_null_ids(spark):
    rows = [(1, prose(1)), (1, prose(1)), (2, prose(1)), (None, prose(1)), (None, None)]
    got = rows_of(near_dedup.near_dedup(documents(spark, rows), 4), "doc_id", "component_id", "kept")
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True)], key=str)


def test_near_ids_with_several_texts(spark):
    """Each row is linked by its own text: ids are not nodes."""
    changed = lambda i: prose(i, 80) + " end"
    rows = [(1, prose(1, 80)), (1, prose(2, 80)), (5, changed(1)), (6, changed(2)), (7, prose(3, 80)), (7, changed(1)), (8, changed(3))]
    got = rows_of(near_dedup.near_dedup(documents(spark, rows), 4), "doc_id", "component_id", "kept")
    assert got == sorted([(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (7, 7, True), (7, 1, False), (8, 7, False)], key=str)


def test_bounds_of_missed_links():
    """The tails that the module states, at a similarity of exactly 0.8."""
    below = sum(math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(near_dedup.MATCHES))

    def above(n, most):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.1) + (n - i) * math.log(0.9)) for i in range(most + 1, n + 1))

    whole, first = above(near_dedup.FINE_BITS, near_dedup.FINE_APART), above(64 * near_dedup.FIRST_WORDS, near_dedup.FIRST_APART)
    assert below < 4.3e-6 and whole + first < 2.2e-6 and below + whole + first < 1e-5


def test_near_blurred_group(spark):
    """Many texts that resemble each other just below or just above the threshold: every link is found, whatever the list."""
    rng = random.Random(3)
    base = prose("blur", 120).split()
    rows = []
    for k in range(700):
        words = list(base)
        for at in rng.sample(range(120), 3 + k % 4):
            words[at] = f"own{k}x{at}"
        rows.append((k, " ".join(words)))
    want = plain_near(rows, 4)
    assert len({r[2] for r in want}) > 20  # several components among look-alikes
    assert rows_of(near_dedup.near_dedup(documents(spark, rows), 4), "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_empty(spark):
    assert near_dedup.near_dedup(documents(spark, near_rows()).limit(0)).count() == 0


def test_near_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(near_dedup.query(spark, SF), "doc_id", "n_shingles", "component_id", "kept") == plain_near(rows, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(3, 1), (2, 3), (2, 2), (1, 3), (50, 60), (50, 61), (50, 62)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {**{i: 10 for i in range(10, 41)}, 1: 1, 2: 1, 3: 1, 50: 50, 60: 50, 61: 50, 62: 50}


def test_shuffle_files_go_with_a_write(spark):
    from kinmatch.llm.common import CLEANUP, materialize

    jvm = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: jvm.getAllFiles().size()
    before = held()
    out = materialize(spark.range(10000).selectExpr("id * 7 AS z").repartition(5, "z").groupBy("z").count(), "probe")
    assert held() <= before
    assert out.count() == 10000
    assert spark.conf.get(CLEANUP) == "false"


def test_screen_loses_no_wanted_row_and_few_others_pass(spark):
    from kinmatch.llm.near_dedup import screened

    rows = spark.range(20000).selectExpr("id * 982451653 - 9000000000000 AS low", "id")
    kept = {r["id"] for r in screened(rows, rows.filter("id % 10 = 0").select("low"), "low").collect()}
    assert kept >= set(range(0, 20000, 10)) and len(kept) < 2100
    assert screened(rows, rows.filter("id < 0"), "low").count() == 0
