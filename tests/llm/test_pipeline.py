import re

import corpus_pipeline as pipeline
from kinmatch.llm import quality

from .helpers import SF, documents, prose, rows_of
from .test_dedup import plain_near


def test_each_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = sorted(d for d, t in texts.items() if model.scores([t.encode()])[0] >= 0.7)
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns
        left = sorted(r[0] for r in docs.select("doc_id").collect())
        if name == "quality":
            assert left == good
        elif name == "exact_dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[d]), d)
            assert left == sorted(first.values())
        elif name == "near_dedup":
            assert left == [r[0] for r in sorted(plain_near(list(before.items()), 5)) if r[3]]
        else:
            assert set(left) < set(before)
    out = pipeline.mix(spark, docs, SF)
    assert out.count() == docs.count() and {"doc_id", "size", "target", "taken"} <= set(out.columns)


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_odd_rows(spark):
    docs = documents(spark, [(1, prose(1)), (1, prose(1)), (2, prose(1)), (None, prose(5)), (3, None), (4, ""), (5, prose(9))])
    for _, stage in pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
        assert rows_of(docs, "doc_id") == [(1,), (3,), (5,), (None,)]


def test_rows_with_one_id_and_several_texts(spark):
    docs = documents(spark, [(1, prose(1, 80)), (1, prose(2, 80)), (1, prose(2, 80)), (2, prose(2, 80)), (3, prose(1, 80) + " end"), (None, prose(4)), (None, prose(4)), (None, prose(1, 80))])
    exact = pipeline.keep_first_copy(spark, docs, SF)
    assert rows_of(exact, "doc_id", "text") == sorted([(1, prose(1, 80)), (1, prose(2, 80)), (3, prose(1, 80) + " end"), (None, prose(4))], key=str)
    near = pipeline.keep_one_of_near(spark, exact, SF)
    assert rows_of(near, "doc_id", "text") == sorted([(1, prose(1, 80)), (1, prose(2, 80)), (None, prose(4))], key=str)


def test_mix_keeps_to_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes, by = {}, {}
    for r in docs.collect():
        sizes[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        by.setdefault(r["source"], []).append(r["doc_id"])
    rows = {r["doc_id"]: r for r in pipeline.mix(spark, docs, SF).collect()}
    named = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(sizes[d] for d in by[s]) for s in named}
    weight, rest, goal = {s: (3, 1, 2)[i % 3] for i, s in enumerate(named)}, 1.5 * sum(total.values()), {}
    while len(goal) < len(named):  # sources at twice their size leave, what they cannot take is shared again
        free = [s for s in named if s not in goal]
        unit = (rest - sum(goal.values())) / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > 2 * total[s]]
        goal.update({s: 2.0 * total[s] if full else unit * weight[s] for s in full or free})
    assert {d: r["size"] for d, r in rows.items()} == sizes
    for s in named:
        taken = [rows[d]["taken"] for d in by[s]]
        assert all(t in (0, sizes[d], 2 * sizes[d]) for d, t in zip(by[s], taken, strict=True))
        assert all(abs(rows[d]["target"] - goal[s]) < 1e-6 * max(1, goal[s]) for d in by[s])
        assert abs(sum(taken) - goal[s]) <= max(0.02 * goal[s], max(sizes[d] for d in by[s]) if len(by[s]) < 12 else 0)


def test_empty_table(spark):
    docs = documents(spark, [(1, "x")]).limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
