"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a run of words: the hash of the words at its 1s
ignores those at its 0s, so a substituted word there does not break the hit.
Benchmark items are hashed under every mask at every position into a table of
(seed, item, position). Training texts are hashed the same way, and the two
are joined on the seed. A bit table over the benchmark's seeds, of bounded
size, screens the texts' seeds first, so that hardly any but true hits leave
the scan; what it lets through wrongly finds no partner in the join. Around
each hit the two texts are aligned on the hit's diagonal and the best segment
is taken (+1 for an equal word, -3 for a substituted one); it counts if it is
long enough and mostly equal. If it does not, the longest segment that is long
enough and mostly equal is taken. The same is done with what lies before and
behind it, until nothing more counts.

The masks miss no such segment. One of 24 words or more can be cut in two of
12 or more, of which one is as equal as the whole; and every way to place
n // 5 substitutions on n = 12 to 23 words leaves room for one of the masks
(all 30,715 are tried in the tests). Items of 6 to 11 words must be there as a
whole, with the same share of equal words: their words are cut into parts, one
or two more than may be touched, and the masks are all pairs of parts.

Defined results: null and empty texts and items match nothing; items of fewer
than ``SHORTEST`` words match only texts that are nothing else, word for word;
each character of a script without blanks between words is a word; equal rows
and repeated ids are each searched; a null doc_id or item_id is reported as
null; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import ALNUM_BYTES, fresh, match_nulls, materialize, mix, small, table, text_key, text_slices, word_hashes

#: Seven masks of weight 7 over 8 to 14 words, chosen together.
MASKS = ("11101111", "111010001011", "11000110111", "110111011", "111001000111", "10000001111011", "10011101011")
#: Items of fewer words are searched whole.
SPAN = 12
SHORTEST = 6
MIN_OVERLAP = 12
MIN_SHARE = 0.8
PENALTY = 3
#: Equal words that make up for a substituted one at ``MIN_SHARE``.
MAKE_UP = 4
#: Bits of the screen: so many for each seed of the benchmark, within these powers of two (the larger is 32 MB).
BITS_PER_SEED = 1024
LEAST_BITS, MOST_BITS = 16, 28

_FACTORS = mix(np.arange(1, 129, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
#: Thai, Lao, Myanmar, Khmer, Chinese and Japanese; the first byte of their characters is 0xE0 or more.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_CHARACTER = re.compile(f"[{_UNSPACED}]")


def _folded(values) -> list[bytes]:
    return [b"" if t is None else _apart(t.lower()) for t in values]


def _apart(text: str) -> bytes:
    """UTF-8 of a text with blanks around the characters of unspaced scripts."""
    out = text.encode("utf-8", "surrogatepass")
    if text.isascii() or np.frombuffer(out, np.uint8).max() < 0xE0:
        return out
    return _CHARACTER.sub(r" \g<0> ", text).encode("utf-8", "surrogatepass")


def short_masks(n: int) -> list[str]:
    """Masks over the whole of an item of ``n`` words: every pair of its parts, of which n // 5 at most are touched."""
    parts = n // 5 + 2
    edges = [round(i * n / parts) for i in range(parts + 1)]
    return ["".join("1" if any(edges[k] <= i < edges[k + 1] for k in pair) else "0" for i in range(n)) for pair in itertools.combinations(range(parts), 2)]


def masks_of(n: int) -> list[tuple[str, int]]:
    """(mask, number) for items of ``n`` words; numbers tell apart the seeds of different masks."""
    if n >= SPAN:
        return [(m, i) for i, m in enumerate(MASKS)]
    if n < SHORTEST:
        return [("1" * n, 120 + n)]
    return [(m, 8 * (n - SHORTEST + 1) + i) for i, m in enumerate(short_masks(n))]


def seed_hashes(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the words under a mask at every position where it fits."""
    n = h.size - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, _FACTORS[127 - number], np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            acc += h[k : k + n] * _FACTORS[k]
    return mix(acc)


def item_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of one item and the positions they stand at."""
    made = [seed_hashes(words, mask, number) for mask, number in masks_of(words.size)] if words.size else []
    if not made:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(made), np.concatenate([np.arange(s.size) for s in made])


def text_seeds(h: np.ndarray, bounds: np.ndarray, shorts: list[int], screen: Screen | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, position in it) of all texts of a batch; ``shorts`` are the item lengths below ``SPAN`` that occur."""
    size = np.diff(bounds)
    found = []
    for mask, number, whole in [*((m, i, False) for m, i in masks_of(SPAN)), *((m, i, n < SHORTEST) for n in shorts for m, i in masks_of(n))]:
        s = seed_hashes(h, mask, number)
        at = screen.hits(s) if screen else np.arange(s.size)
        text = np.searchsorted(bounds, at, "right") - 1
        fits = at + len(mask) <= bounds[text + 1]
        if whole:
            fits &= size[text] == len(mask)
        at, text = at[fits], text[fits]
        found.append((s[at], text, at - bounds[text]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Screen:
    """Two bits for each seed in a table of 2^bits; a seed without both is in no item."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def _set(self, place: np.ndarray) -> np.ndarray:
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0

    def hits(self, seeds: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self._set(seeds >> np.uint64(64 - self.bits)))
        return at[self._set(seeds[at] & np.uint64((1 << self.bits) - 1))]

    @staticmethod
    def of(seeds: DataFrame, bits: int) -> Screen:
        """Built by an aggregation, whose rows are words of the table that hold a bit: 2^bits / 64 at most."""
        high, low = F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
        places = seeds.select(F.explode(F.array(high, low)).alias("place"))
        rows = places.groupBy(F.shiftrightunsigned("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("word"))
        words = np.zeros(1 << (bits - 6), np.uint64)
        got = rows.toArrow()
        words[got["at"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
        return Screen(bits, words)


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([v.size for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if kind == pa.int64() else flat.astype(np.int32), kind))


def _item_hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            h, bounds = word_hashes(_folded(part.column(1).to_pylist()), ALNUM_BYTES)
            words = [h[bounds[i] : bounds[i + 1]] for i in range(part.num_rows)]
            seeds = [item_seeds(w) for w in words]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(words, pa.int64()), _lists([s for s, _ in seeds], pa.int64()), _lists([p for _, p in seeds], pa.int32())], ["item_id", "words", "seeds", "ats"])


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorts, bits, words = shared.value
        screen = Screen(bits, words)
        for batch in batches:
            texts = _folded(batch.column(3).to_pylist())
            for lo, hi in text_slices(texts, 1 << 18):
                h, bounds = word_hashes(texts[lo:hi], ALNUM_BYTES)
                seeds, text, at = text_seeds(h, bounds, shorts, screen)
                if not seeds.size:
                    continue
                order = np.argsort(text, kind="stable")
                seeds, text, at = seeds[order], text[order], at[order]
                those, first = np.unique(text, return_index=True)
                cuts = [slice(a, b) for a, b in itertools.pairwise([*first.tolist(), text.size])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(those + lo)) for c in range(3)),
                        _lists([h[bounds[t] : bounds[t + 1]] for t in those], pa.int64()),
                        _lists([seeds[c] for c in cuts], pa.int64()),
                        _lists([at[c] for c in cuts], pa.int32()),
                    ],
                    ["doc_id", "t0", "t1", "words", "seeds", "ats"],
                )

    return run


def segments(same: np.ndarray, doc_words: int, item_words: int) -> list[tuple[int, int]]:
    """(start, end) of every segment that counts, of the places where a text and an item lie side by side; no two share a word."""
    if item_words < SHORTEST:
        return [(0, same.size)] if same.size == doc_words == item_words and same.all() else []
    if item_words < SPAN:
        return [(0, same.size)] if same.size == item_words and (1 + MAKE_UP) * int(same.sum()) >= MAKE_UP * item_words else []
    out, open_parts = [], [(0, same.size)]
    while open_parts:
        lo, hi = open_parts.pop()
        span = best_segment(same[lo:hi]) if hi - lo >= MIN_OVERLAP else None
        if span is not None:
            start, end = lo + span[0], lo + span[1]
            out.append((start, end))
            open_parts += [(lo, start), (end, hi)]
    return out


def best_segment(same: np.ndarray) -> tuple[int, int] | None:
    """Bounds of the best-scoring segment, or else the longest, with enough words and a large enough share of equal ones."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    end = int(np.argmax(total - np.minimum.accumulate(total)))
    start = int(np.argmin(total[: end + 1]))
    apart = end - start - int(same[start:end].sum())
    if end - start >= MIN_OVERLAP and end - start - apart >= MAKE_UP * apart:
        return start, end
    # the earliest start on an equal word from which the share up to each end is large enough
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MAKE_UP))])
    ends = np.flatnonzero(same) + 1
    if ends.size == 0:
        return None
    low = np.minimum.accumulate(np.where(same, total[:-1], np.iinfo(np.int64).max))
    starts = np.searchsorted(-low, -total[ends], "left")
    k = int(np.argmax(ends - starts))
    return (int(starts[k]), int(ends[k])) if ends[k] - starts[k] >= MIN_OVERLAP else None


FOUND = "doc_id long, t0 long, t1 long, item_id long, doc_start long, item_start long, overlap long, matched long"


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        ids = [batch.column(i).to_pylist() for i in range(8)]
        for k, (mine, theirs) in enumerate(zip(batch.column(8), batch.column(9), strict=True)):
            doc_id, t0, t1, item_id, doc_words, item_words, doc_from, item_from = (c[k] for c in ids)
            same = np.asarray(mine.values) == np.asarray(theirs.values)
            for start, end in segments(same, doc_words, item_words):
                rows.append((doc_id, t0, t1, item_id, doc_from + start, item_from + start, end - start, int(same[start:end].sum())))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in FOUND.split(", ")])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every verified overlap of a text with a benchmark item, one row a segment; t0 and t1 name the text of the row."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    items = items.mapInArrow(_item_hasher, "item_id long, words array<long>, seeds array<long>, ats array<int>").filter(F.size("words") > 0)
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = items.select("item", F.explode(F.arrays_zip("seeds", "ats")).alias("s")).select(F.col("s.seeds").alias("seed"), "item", F.col("s.ats").alias("item_at"))
    seeds = materialize(seeds, "seeds")
    shorts = sorted(r[0] for r in items.select(F.size("words").alias("n")).filter(F.col("n") < SPAN).distinct().collect())
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, seeds.count()) * BITS_PER_SEED))))
    screen = Screen.of(seeds, bits)
    shared = spark.sparkContext.broadcast((shorts, screen.bits, screen.words))
    scan = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    hits = scan.mapInArrow(_scanner(shared), "doc_id long, t0 long, t1 long, words array<long>, seeds array<long>, ats array<int>")
    hits = materialize(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    met = hits.select("row", F.explode(F.arrays_zip("seeds", "ats")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.ats").alias("at"))
    lines = met.join(seeds, "seed").select("row", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    lines = materialize(lines, "lines")
    sides = lines.join(items.select("item", "item_id", F.col("words").alias("theirs")), "item").join(hits.select("row", "doc_id", "t0", "t1", F.col("words").alias("mine")), "row")
    doc_from, item_from = F.greatest(F.lit(0), F.col("diagonal")), F.greatest(F.lit(0), -F.col("diagonal"))
    length = F.least(F.size("mine") - doc_from, F.size("theirs") - item_from)
    aligned = sides.select(
        "doc_id",
        "t0",
        "t1",
        "item_id",
        F.size("mine").cast("long").alias("doc_words"),
        F.size("theirs").cast("long").alias("item_words"),
        doc_from.cast("long").alias("doc_from"),
        item_from.cast("long").alias("item_from"),
        F.slice("mine", doc_from + 1, length).alias("mine"),
        F.slice("theirs", item_from + 1, length).alias("theirs"),
    )
    return aligned.mapInArrow(_verifier, FOUND)


def best_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each leaking (doc_id, item_id) the overlap with the most equal words, of equal ones the longest, and all of them by position as ``passages``."""
    rank = F.struct("matched", "overlap", -F.col("doc_start"), -F.col("item_start"))
    passage = F.struct("doc_start", "item_start", "overlap", "matched")
    best = overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(rank).alias("r"), F.array_sort(F.collect_set(passage)).alias("passages"))
    chosen = [(-F.col("r.col3")).alias("doc_start"), (-F.col("r.col4")).alias("item_start"), F.col("r.overlap").alias("overlap"), F.col("r.matched").alias("matched")]
    return best.select("doc_id", "item_id", *chosen, "passages")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage; of rows with one id, or none, each is judged by its own text."""
    leaks = small(materialize(overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("t0").alias("_t0"), F.col("t1").alias("_t1")).distinct(), "leaks"))
    names = [fresh(docs, "t0"), fresh(docs, "t1")]
    marked = docs.withColumns({n: c for n, c in zip(names, text_key(), strict=True)})
    return marked.join(leaks, match_nulls(marked, leaks, {"doc_id": "_id", names[0]: "_t0", names[1]: "_t1"}), "left_anti").drop(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leaking (doc_id, item_id): where the passage with the most equal words lies in either text, how much of it agrees, and all passages."""
    return best_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
