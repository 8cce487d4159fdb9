"""Language identification with a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter's
largest response in a window is kept, and a softmax over those responses
gives the language. Texts are cut into windows of fixed length that cover all
their bytes; the probabilities of the windows are averaged by their share of
letters. For scoring, the filters are folded into tables over single bytes
and byte pairs, which give the same responses as the convolution.

Defined results: null texts and texts without a letter are ``und`` with score
1; ties go to the language first in code-point order; without labelled texts
every text is ``und`` with score 0; equal texts get equal results; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import crc_bucket, encoded, table
from kinmatch.llm.labelled import sampled_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: About so many texts of each language are learned from, picked by hash; twice as many in all is the bound where ids repeat.
PER_LANGUAGE = 600
MAX_LANGUAGES = 500
TRAIN_STEPS = 700
BUCKETS, HELD_OUT = 5, 0

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text))


#: Bytes to 1 where they belong to a letter (ASCII letters, and all of UTF-8 beyond ASCII).
_LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)], np.float32)


@dataclass
class ByteCnn:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the tables whose rows sum to a filter response: pairs first, then a single byte."""
        made = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            f = f.reshape(w, EMBEDDING, -1)
            single = [self.embedding @ f[k] for k in range(w)]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(65536, -1) for k in range(0, w - 1, 2)]
            made.append([np.ascontiguousarray(t, np.float32) for t in pairs + ([single[-1]] if w % 2 else [])])
        return made

    def window_probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """``windows`` (n, WINDOW) of bytes to (n, languages)."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), 128):
            x = windows[at : at + 128].astype(np.int32)
            n, size = x.shape
            pair = (x[:, :-1] << 8) | x[:, 1:]
            pooled = []
            for w, t, b in zip(WIDTHS, tables, self.bias, strict=True):
                m = size - w + 1
                r = t[0].take(pair[:, :m].ravel(), axis=0)
                for k, more in enumerate(t[1:], 1):
                    r += more.take((pair if more.shape[0] > 256 else x)[:, 2 * k : 2 * k + m].ravel(), axis=0)
                pooled.append(np.maximum(r.reshape(n, m, -1).max(1) + b, 0))
            z = np.concatenate(pooled, 1) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 128] = z / z.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[bytes], tables: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities of the languages for every text, (texts, languages)."""
        counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
        ends = np.cumsum(counts)
        total = np.zeros((len(texts), len(self.languages)))
        flat = np.zeros((int(ends[-1]), WINDOW), np.uint8)
        for t, end, c in zip(texts, ends.tolist(), counts.tolist(), strict=True):
            flat[end - c : end].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        weight = _LETTERS[flat].sum(1) + 1e-3
        p = self.window_probabilities(flat, tables) * weight[:, None]
        total = np.add.reduceat(p, np.concatenate([[0], ends[:-1]]), axis=0)
        return total / total.sum(1, keepdims=True)


def _responses(x: np.ndarray, model: ByteCnn) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    e = model.embedding[x]
    pooled, where = [], []
    for w, f, b in zip(WIDTHS, model.filters, model.bias, strict=True):
        m = x.shape[1] - w + 1
        cols = np.concatenate([e[:, k : k + m] for k in range(w)], 2)
        r = cols @ f + b
        where.append(r.argmax(1))
        pooled.append(np.maximum(r.max(1), 0))
    return pooled, where, np.concatenate(pooled, 1)


def fit(rows: list[tuple[str, str]], steps: int = TRAIN_STEPS, seed: int = 7) -> ByteCnn:
    """Train on (text, language) by Adam on random crops of many lengths."""
    languages = sorted({y for _, y in rows}, key=lambda s: s.encode("utf-8", "surrogatepass"))
    rng = np.random.default_rng(seed)
    by = [[t.encode("utf-8", "surrogatepass") for t, y in rows if y == lang and has_letter(t)] for lang in languages]
    by = [b or [b""] for b in by]
    k = len(languages)
    model = ByteCnn(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)).astype(np.float32),
        np.zeros(k, np.float32),
    )
    model.embedding[0] = 0  # padding
    params = [model.embedding, *model.filters, *model.bias, model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    crop, batch = 128, 64
    for step in range(1, steps + 1):
        y = rng.integers(0, k, batch)
        x = np.zeros((batch, crop), np.uint8)
        for i, c in enumerate(y):
            t = by[c][rng.integers(len(by[c]))]
            n = int(rng.integers(16, crop + 1))
            s = int(rng.integers(0, max(1, len(t) - n + 1)))
            piece = t[s : s + n]
            x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        pooled, where, h = _responses(x, model)
        z = h @ model.out + model.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        dh = p @ model.out.T * (h > 0)
        grads = [np.zeros_like(q) for q in params]
        grads[-2], grads[-1] = h.T @ p, p.sum(0)
        rows_ = np.arange(batch)[:, None]
        for j, w in enumerate(WIDTHS):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            grads[1 + len(WIDTHS) + j] = d.sum(0)
            for a in range(w):
                bytes_ = x[rows_, where[j] + a]
                e = model.embedding[bytes_]
                part = slice(a * EMBEDDING, (a + 1) * EMBEDDING)
                grads[1 + j][part] = np.einsum("bfe,bf->ef", e, d)
                np.add.at(grads[0], bytes_.ravel(), (d[:, :, None] * model.filters[j][part].T[None]).reshape(-1, EMBEDDING))
        grads[0][0] = 0
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, m1, m2 in zip(params, grads, first, second, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            q -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteCnn | None:
    """Fit on about ``per_language`` texts of each language outside the held-out bucket, picked by hash."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket("doc_id", BUCKETS) != HELD_OUT))
    counts = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000.0
    rows = known.filter(draw < share[F.col("lang")]).orderBy(F.xxhash64("doc_id", "text")).limit(2 * per_language * len(counts)).select(sampled_text().alias("text"), "lang").collect()
    return fit([(r["text"], r["lang"]) for r in rows]) if rows else None


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(1).to_pylist()
                letters = [has_letter(t) for t in texts]
                names, scores = ["und"] * len(texts), [0.0 if x and not model else 1.0 for x in letters]
                some = [i for i, x in enumerate(letters) if x]
                if some and model:
                    p = model.predict(encoded(texts[i] for i in some), tables)
                    for i, row in zip(some, p, strict=True):
                        names[i], scores[i] = model.languages[int(row.argmax())], min(1.0, float(row.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred, score for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predictor(shared), "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", (crc_bucket("doc_id", BUCKETS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
