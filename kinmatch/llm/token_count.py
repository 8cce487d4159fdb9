"""Token counts by a count-only Viterbi over a unigram vocabulary.

The pieces and scores of a public vocabulary file are read as a unigram
model: the best segmentation of a text is the one whose scores sum highest.
An Aho-Corasick automaton finds all pieces that end at each character, and
the dynamic program carries, per end, only the best score and its number of
pieces; no segmentation is kept.

Rules of the tokenizer that are followed exactly (those of the public
``tokenizers`` library for unigram models, in double precision): a blank goes
before a text that begins with none, and blanks become U+2581; of equal scores the candidate with the earliest
start wins; a character that is no piece on its own costs the lowest score
less 10, and counts as its UTF-8 bytes (byte fallback). No piece goes on with
a blank after another character (the loader checks it), so the program splits
before every run of blanks and remembers the results of words. Scores in the
file are whole numbers and a word's sums stay below 2^53, so splitting changes
no comparison.

Defined results: null and empty texts have 0 tokens and score 0; equal texts
get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import table

#: The vocabulary of the query; another file of the same format may be given.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_COST = 10.0
#: Words remembered by a task; the memory is emptied when it is full.
REMEMBERED = 300_000


_WORD = re.compile(f"{BLANK}+[^{BLANK}]*")


@dataclass
class Vocabulary:
    """Pieces that may occur in a segmentation, with their scores, and the score of an unknown character."""

    pieces: list[tuple[str, float]]
    unknown: float

    @staticmethod
    def of(pieces: list[tuple[str, float]]) -> Vocabulary:
        for piece, _ in pieces:
            if BLANK in piece[1:] and piece.strip(BLANK):
                raise ValueError(f"a piece goes on after a blank: {piece!r}")
        return Vocabulary(pieces, min(s for _, s in pieces) - UNKNOWN_COST)

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return Vocabulary.of([(p.piece, float(p.score)) for p in model.pieces if p.type == 1])


class Counter(dict):
    """From words (each with its leading blank) to (tokens, score), computed when first asked."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.unknown = vocabulary.unknown
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.viterbi(word)
        return found

    def viterbi(self, text: str) -> tuple[int, float]:
        n = len(text)
        # best[e]: score and tokens of the best way to the end e; None until some piece reaches it
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        at = 0
        for end, (length, gain) in self.automaton.iter(text):
            end += 1
            while at < end - 1:  # characters that no piece ended at
                at += 1
                self._unknown(text, at, score, count)
            # matches of one end come longest first, so an equal later one has a later start
            total = score[end - length] + gain
            if score[end] is None or total > score[end]:
                score[end], count[end] = total, count[end - length] + 1
            if length == 1:
                at = end
        while at < n:
            at += 1
            self._unknown(text, at, score, count)
        return count[n], score[n]

    def _unknown(self, text: str, end: int, score: list, count: list) -> None:
        total = score[end - 1] + self.unknown
        if score[end] is None or total > score[end]:
            score[end], count[end] = total, count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))

    def of(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", BLANK)
        if text[0] != BLANK:
            text = BLANK + text
        words = _WORD.findall(text) if BLANK * 2 in text or text.endswith(BLANK) else [BLANK + w for w in text[1:].split(BLANK)]
        found = [self[w] for w in words]
        return sum(f[0] for f in found), sum(f[1] for f in found)


#: The counter of the last vocabulary that this worker process has seen.
_LAST: list[tuple[list, Counter]] = []


def _remembered(vocabulary: Vocabulary) -> Counter:
    if not _LAST or _LAST[0][0] != vocabulary.pieces:
        _LAST[:] = [(vocabulary.pieces, Counter(vocabulary))]
    return _LAST[0][1]


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _remembered(shared.value)
        for batch in batches:
            found = [counter.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens and the best segmentation's score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counter(shared), "doc_id long, n_tokens long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), Vocabulary.load(VOCABULARY))
