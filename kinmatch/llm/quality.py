"""Quality scores from compression against dictionaries of good and bad text.

Two zstandard dictionaries are trained, one on texts labelled good and one on
texts labelled bad. A text that the good dictionary compresses further is
closer to good text: the difference of the two compressed sizes, divided by
the text's size, and the better size itself are turned into a probability by
a logistic fit on labelled texts that the dictionaries have not seen.

Every byte of a text counts: it is compressed in blocks of ``BLOCK`` bytes, so
that the dictionary and not the text's own beginning decides, and the sizes
are summed. Scores depend on the text alone.

Defined results: null and empty texts get the score of an empty block; equal
texts get equal scores; without labels of both classes every score is the
share of label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.llm.common import crc_bucket, encoded, table
from kinmatch.llm.labelled import fit_logistic, labelled_sample, logistic

BLOCK = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Labelled texts of each class that the model is fitted on; two thirds train the dictionaries, a third the score.
PER_CLASS = 2000
THRESHOLD = 0.7
BUCKETS, HELD_OUT = 4, 2


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


def _dictionary(samples: list[bytes]) -> bytes:
    parts = [b for s in samples for b in blocks(s)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: their plain content serves
        return b"".join(parts)[:DICTIONARY_BYTES] or b"\n" * 8


def _without_shared_lines(good: list[bytes], bad: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Lines that stand in texts of both classes say nothing about either."""
    shared = {x for t in good for x in t.split(b"\n")} & {x for t in bad for x in t.split(b"\n")}
    keep = lambda t: b"\n".join(x for x in t.split(b"\n") if x not in shared)
    return [keep(t) for t in good], [keep(t) for t in bad]


class Sizer:
    """Compressed sizes of whole texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float]:
        parts = blocks(text)
        good, bad = (sum(len(c.compress(b)) for b in parts) for c in self.compressors)
        total = len(text) + len(parts)
        return (bad - good) / total, good / total


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    coefficients: list[float]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.coefficients[0])
        sizer = Sizer(self.good, self.bad)
        x = np.array([sizer.features(t) for t in texts]).reshape(-1, 2)
        return logistic(x @ np.array(self.coefficients[:2]) + self.coefficients[2])


def fit(rows: list[tuple[str, int]], prior: float | None = None) -> CompressionModel:
    """``rows`` are (text, label); ``prior`` is the share of label 1 that the score is calibrated to."""
    good = [t.encode("utf-8", "surrogatepass") for t, y in rows if y == 1]
    bad = [t.encode("utf-8", "surrogatepass") for t, y in rows if y == 0]
    prior = len(good) / len(rows) if rows and prior is None else prior
    if min(len(good), len(bad)) < 3:
        return CompressionModel(b"", b"", [0.5 if prior is None else prior])
    dictionaries = [_dictionary(p) for p in _without_shared_lines([t for i, t in enumerate(good) if i % 3], [t for i, t in enumerate(bad) if i % 3])]
    held = [(t, 1) for t in good[::3]] + [(t, 0) for t in bad[::3]]
    sizer = Sizer(*dictionaries)
    x, y = np.array([sizer.features(t) for t, _ in held]), np.array([c for _, c in held])
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    beta = fit_logistic((x - mean) / spread, y, weight)
    slope = beta[:2] / spread
    return CompressionModel(*dictionaries, [*slope.tolist(), float(beta[2] - slope @ mean)])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> CompressionModel:
    known = labels.filter(F.col("quality").isin(0, 1) & (crc_bucket("doc_id", BUCKETS) != HELD_OUT))
    prior = known.agg(F.avg("quality")).first()[0]
    return fit(labelled_sample(docs, labels, "quality", per_class, BUCKETS, HELD_OUT), prior)


def _scorer(shared, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                score = model.scores(encoded(part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], [*part.schema.names[:-1], into])

    return run


def score(docs: DataFrame, model: CompressionModel, columns: list[str], into: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and the score as ``into``, in one pass over the whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(into, T.DoubleType())])
    name = "_scored"
    while name in columns:
        name += "_"
    return docs.select(*columns, F.col("text").alias(name)).mapInArrow(_scorer(shared, into), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_bucket("doc_id", BUCKETS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
