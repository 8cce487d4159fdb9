import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import language_id, quality, toxicity

from .helpers import SF, documents, prose

SF01 = "/root/testdata/sf0.01"


def held_out_accuracy(spark, query, column, threshold):
    out = query(spark, SF01)
    assert out.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out.limit(100).collect())
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = out.filter("held_out").join(labels, "doc_id").select((F.col("score") >= threshold).cast("int").alias("p"), "predicted", column).collect()
    assert all(r["p"] == r["predicted"] for r in rows)
    return sum(r["p"] == r[column] for r in rows) / len(rows)


def test_quality_on_held_out(spark):
    assert held_out_accuracy(spark, quality.query, "quality", 0.7) > 0.9


def test_toxicity_on_held_out(spark):
    assert held_out_accuracy(spark, toxicity.query, "toxic", 0.3) > 0.85


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = language_id.query(spark, SF01).filter("held_out").join(docs, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.93


EDGES = [(1, None), (2, ""), (3, "1234 ---"), (4, prose(1)), (4, prose(1)), (None, prose(2)), (5, prose(3, 30000)), (6, "x"), (7, "² ½ Ⅷ 7")]


@pytest.fixture(scope="module")
def labelled():
    return [(prose(i, 80), 0) for i in range(40)] + [(prose(i, 40) + " vilexo " + prose(i + 900, 40) + " vilexar", 1) for i in range(40)]


def test_toxicity_edges(spark, labelled):
    model = toxicity.fit(labelled)
    rows = toxicity.score(documents(spark, EDGES), model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({round(r["score"], 9) for r in rows if r["doc_id"] == 4}) == 1
    texts = toxicity.folded([prose(5, 20000) + " vilexo vilexar " + prose(6, 20000), prose(7, 40000)])
    bad, good = model.scores(texts)
    assert bad > good  # a short passage anywhere in a long text counts
    assert toxicity.score(documents(spark, EDGES).limit(0), model).count() == 0


def test_toxicity_without_labels():
    assert list(toxicity.fit([]).scores([b"a"])) == [0.0]
    assert list(toxicity.fit([("a", 1), ("b", 1)]).scores([b"a"])) == [1.0]


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(5)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x = rng.normal(0, 1, (3, 12, toxicity.SIZE + 1))
    x[:, :, -1] = 1
    x[0, :3] = 0
    x[2, 8:] = 0
    pool = x[:, :, -1] * (np.arange(12) >= 2)
    y = np.array([0.0, 1.0, 1.0])
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.forward(x, pool)[0]))))
    logit, cache = net.forward(x, pool, keep=True)
    grads, dx = net.gradients((1 / (1 + np.exp(-logit)) - y) / 3, cache)

    def slope(p, at):
        old = p[at]
        p[at] = old + 1e-4
        up = loss()
        p[at] = old - 1e-4
        down = loss()
        p[at] = old
        return (up - down) / 2e-4

    for k, g in grads.items():
        for at in {tuple(0 for _ in g.shape), tuple(n - 1 for n in g.shape)}:
            assert g[at] == pytest.approx(slope(net.params[k], at), rel=1e-3, abs=1e-7), k
    assert dx[1, 4, 2] == pytest.approx(slope(x, (1, 4, 2)), rel=1e-3, abs=1e-7)


def test_every_overlapping_window_is_scored(labelled):
    """The sliding sums give what the network gives for each window of a text on its own, one from each word on."""
    model = toxicity.fit(labelled)
    words = toxicity.Words.split(toxicity.folded([prose(1, 50) + " vilexo " + prose(2, 20), "", prose(3, 5), prose(4, 32)]))
    x = model.vectors(words)
    logit, first = model.network.text_windows(x, words.bounds)
    assert np.diff(first).tolist() == [71 - 31, 1, 1, 1]
    pad, p = toxicity.MARGIN, model.network.params
    piece = np.concatenate([np.zeros((pad, x.shape[1]), x.dtype), x[:71], np.zeros((toxicity.PIECE - 71 + pad, x.shape[1]), x.dtype)])
    for s in (0, 1, 17, 39):
        pool = np.zeros((1, len(piece)))
        pool[0, pad + s : pad + s + toxicity.WINDOW] = 1
        assert model.network.forward(piece[None], pool)[0][0] == pytest.approx(logit[s], abs=1e-4)
    assert logit[first[1]] == pytest.approx(float(p["z"][0]), abs=1e-6)


def test_words_and_characters_both_reach_the_network(labelled, monkeypatch):
    texts = [prose(70, 30) + word + prose(71, 30) for word in (" vilexo ", " vilexum ", " ")]

    def scores():
        return toxicity.fit(labelled).scores(toxicity.folded(texts)).tolist()

    known, unseen, clean = scores()
    assert min(known, unseen) > 0.5 > clean
    monkeypatch.setattr(toxicity, "WORD_DROPOUT", 1.0)  # no word vectors are learned: the characters carry both
    known, unseen, clean = scores()
    assert min(known, unseen) > 0.5 > clean
    monkeypatch.setattr(toxicity, "WORD_DROPOUT", 0.0)
    plain = toxicity.Words.split

    def words_only(texts):
        w = plain(texts)
        own = w.starts[:-1]
        return toxicity.Words(w.bounds, w.of, w.inputs[own], np.arange(own.size + 1), w.weight[own])

    monkeypatch.setattr(toxicity.Words, "split", staticmethod(words_only))
    known, unseen, clean = scores()
    assert known > 0.5 > max(unseen, clean)


def test_long_labelled_texts_are_learned_from(spark):
    """Labels on long texts alone give trained models."""
    junk = lambda i: prose(i, 9000).upper().replace(" ", " $$$ ")
    rows = [(i, prose(i, 9000)) for i in range(20)] + [(100 + i, junk(i)) for i in range(20)]
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 100, "aa").otherwise("bb"))
    labels = spark.createDataFrame([(i, int(i < 100), int(i >= 100)) for i, _ in rows], "doc_id long, quality int, toxic int")
    assert all(len(t) > 50_000 for _, t in rows)
    assert quality.train(docs, labels).good
    assert toxicity.train(docs, labels).network is not None
    model = language_id.train(docs)
    assert model.languages == ["aa", "bb"]


def test_quality_edges(spark):
    good = [(prose(i), 1) for i in range(30)]
    bad = [("### " + prose(i).upper().replace(" ", " $$$ "), 0) for i in range(30)]
    model = quality.fit(good + bad)
    rows = quality.score(documents(spark, EDGES), model, ["doc_id"]).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    a, b = model.scores([prose(77).encode(), prose(78).upper().replace(" ", " $$$ ").encode()])
    assert a > 0.7 > b
    assert quality.score(documents(spark, EDGES).limit(0), model, ["doc_id"]).count() == 0
    assert quality.fit([]).scores([b"x"])[0] == 0.5


def test_language_edges(spark):
    model = language_id.fit([(prose(i), "xx") for i in range(20)] + [("éàü " * 30 + str(i), "yy") for i in range(20)], steps=150)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(documents(spark, EDGES), model).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 1.0)
    assert got[4][0] == got[5][0] == "xx"
    assert language_id.predict(documents(spark, EDGES), None).filter("lang_pred <> 'und'").count() == 0


def test_folded_tables_equal_the_convolution():
    model = language_id.fit([("abc def ghi " * 20, "a"), ("xyz uvw rst " * 20, "b")], steps=20)
    w = np.frombuffer((b"abc xyz \xc3\xa9 " * 40)[:256], np.uint8)[None]
    _, _, h = language_id._responses(w, model)
    z = h @ model.out + model.out_bias
    p = np.exp(z - z.max())
    assert np.allclose(p / p.sum(), model.window_probabilities(w, model.tables()), atol=1e-4)


def test_sf_smoke(spark):
    assert quality.query(spark, SF).count() == 200
