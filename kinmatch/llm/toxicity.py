"""Toxicity scores from a bidirectional gated recurrent network over word and character inputs.

Every word enters the network as the sum of learned vectors: one of the word
itself, those of its leading characters, and the mean of those of its character
n-grams. A bidirectional GRU runs over the words of the whole text, in pieces
that overlap so that each word has its context on both sides, and attention
pools its states over windows of ``WINDOW`` words. All overlapping windows are
scored, one from each word on; the strongest window and the number of windows
give the calibrated document score.

Vectors, GRU, attention and the window's logistic unit are trained together in
numpy, from windows of labelled texts. Which window of a toxic text is the
toxic one is not labelled: training takes the one whose words occur most in
toxic texts, and from the third round on also the one that the network itself
finds strongest. That is all that counts of words in labelled texts serve.
The score is calibrated on labelled texts that the network has not seen.

Defined results: null and empty texts, and texts without words, get the score
of a text whose strongest window is empty; equal texts get equal scores;
without labels of both classes every score is the share of label 1 (0
without labels); other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import ALNUM_BYTES, crc_bucket, mix, table, text_slices, word_hashes
from kinmatch.llm.labelled import fit_logistic, labelled_sample, logistic

WINDOW = 32
#: Words of context that a state has on either side at least, and words of a piece between them.
MARGIN, PIECE = 16, 128
SIZE, HIDDEN, ATTENTION = 12, 8, 8
#: Labelled texts of each class that the model is fitted on.
PER_CLASS = 1200
THRESHOLD = 0.3
BUCKETS, HELD_OUT = 4, 2
EPOCHS, LEAST_STEPS, BATCH = 12, 150, 128
#: One in so many labelled texts is kept for the calibration.
CALIBRATE = 4
#: Share of word vectors that a training step leaves out, so that the characters carry unseen words too.
WORD_DROPOUT = 0.5
#: Share of the squared gradient of all vectors that scales the step of each.
VECTOR_SCALE = 0.02

#: Character inputs in bytes: leading characters of a word, and n-grams anywhere in it.
LEADS = (3, 4, 5, 6, 7, 8)
GRAM = 4
#: Labelled texts that an input must occur in to get a vector.
LEAST_TEXTS = 3
_CELLS = 20
_U = np.uint64


def folded(values) -> list[bytes]:
    return [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in values]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if ends.size else 0)


@dataclass
class Words:
    """The words of a batch of texts: which distinct word each is, and the inputs of each distinct one."""

    bounds: np.ndarray
    of: np.ndarray  # distinct word of every word
    inputs: np.ndarray  # hashes, those of a distinct word together: the word, its leads, its n-grams
    starts: np.ndarray  # where the inputs of each distinct word begin, one more at the end
    weight: np.ndarray

    @staticmethod
    def split(texts: list[bytes]) -> Words:
        hashes, bounds = word_hashes(texts, ALNUM_BYTES)
        buffer = ALNUM_BYTES[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)].astype(_U)
        edge = np.flatnonzero(np.diff((buffer != 0).view(np.int8), prepend=0, append=0))
        begin, length = edge[::2], edge[1::2] - edge[::2]
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        begin, length = begin[first], length[first]
        rolled, parts = np.zeros(buffer.size, _U), [(np.arange(distinct.size), distinct, np.ones(distinct.size))]
        for n in range(1, max(*LEADS, GRAM) + 1):
            step = np.zeros(buffer.size, _U)
            step[: max(0, buffer.size - n + 1)] = buffer[n - 1 :]
            rolled = rolled * _U(0x100000001B3) + step + _U(n)
            if n in LEADS:
                has = np.flatnonzero(length >= n)
                parts.append((has, mix(rolled[begin[has]] ^ _U(0x5EAD << 32)), np.ones(has.size)))
            if n == GRAM:
                has = np.flatnonzero(length >= n)
                count = length[has] - n + 1
                parts.append((np.repeat(has, count), mix(rolled[_ranges(begin[has], count)]), np.repeat(1.0 / np.maximum(count, 1), count)))
        word, inputs, weight = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=distinct.size))])
        return Words(bounds, of.astype(np.int64), inputs[order], starts.astype(np.int64), weight[order].astype(np.float32))


class Lexicon:
    """The inputs that have a vector, found by one look into a table of cells."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.cells = np.full(1 << _CELLS, -1, np.int32)
        self.cells[(keys >> _U(64 - _CELLS)).astype(np.int64)] = np.arange(keys.size)

    def __getstate__(self):
        return self.keys

    def __setstate__(self, keys):
        self.__init__(keys)

    @staticmethod
    def learn(texts: list[Words]) -> tuple[Lexicon, np.ndarray]:
        """Inputs of enough texts, and in how many each occurs; of two inputs in one cell the more frequent stays."""
        every = np.concatenate([np.unique(w.inputs) for w in texts] or [np.empty(0, _U)])
        keys, count = np.unique(every, return_counts=True)
        often = count >= LEAST_TEXTS
        keys, count = keys[often], count[often]
        order = np.lexsort((keys, -count))
        cell = (keys[order] >> _U(64 - _CELLS)).astype(np.int64)
        stay = np.sort(order[np.unique(cell, return_index=True)[1]])
        return Lexicon(keys[stay]), count[stay]

    def find(self, inputs: np.ndarray) -> np.ndarray:
        """The number of each input's vector, ``len(keys)`` without one."""
        n = self.keys.size
        if not n:
            return np.zeros(inputs.size, np.int64)
        at = self.cells[(inputs >> _U(64 - _CELLS)).astype(np.int64)].astype(np.int64)
        return np.where((at >= 0) & (self.keys[at] == inputs), at, n)


def word_sums(values: np.ndarray, words: Words) -> np.ndarray:
    """Sums of the rows of ``values`` that belong to each distinct word."""
    if not values.size:
        return np.zeros((0, values.shape[1]), np.float32)
    return np.add.reduceat(values, words.starts[:-1], axis=0)  # every word has an input, itself


def scattered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


def placed(bounds: np.ndarray, text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Word numbers (n, length) from word ``start`` of each text on, the last number of all where the text has none."""
    at = start[:, None] + np.arange(length)
    inside = (at >= 0) & (at < np.diff(bounds)[text][:, None])
    return np.where(inside, bounds[text][:, None] + at, bounds[-1])


@dataclass
class Network:
    """Vectors of the inputs, weights of the two GRU directions, the attention, and the window's logistic unit."""

    params: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(inputs: int, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": np.zeros((inputs + 1, SIZE), np.float32)}  # the last row, of what has no vector, stays zero
        for d in "fb":
            p[f"W{d}"], p[f"U{d}"] = draw(SIZE + 1, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN)
            p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
        p["A"], p["v"] = draw(2 * HIDDEN, ATTENTION), draw(ATTENTION)
        p["o"], p["z"] = draw(2 * HIDDEN), np.zeros(1, np.float32)
        return Network(p)

    def _direction(self, x: np.ndarray, d: str, keep: bool):
        """States (n, length, HIDDEN); the last input is 1 for a word and 0 for padding, which leaves the state as it is."""
        p, n, length = self.params, HIDDEN, x.shape[1]
        xt = np.ascontiguousarray(x.transpose(1, 0, 2))  # word by word, so that each step reads and writes one run of memory
        gates = (xt.reshape(-1, xt.shape[2]) @ p[f"W{d}"] + p[f"c{d}"]).reshape(length, len(x), 3 * n)
        real = xt[:, :, -1:]
        h = np.zeros((len(x), n), x.dtype)
        states, tape = np.empty((length, len(x), n), x.dtype), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            r = h @ p[f"U{d}"]
            zr = gates[t, :, : 2 * n] + r[:, : 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            update, reset = zr[:, :n], zr[:, n:]
            new = reset * r[:, 2 * n :]
            new += gates[t, :, 2 * n :]
            np.tanh(new, out=new)
            if keep:
                tape.append((t, h, update, reset, new, r[:, 2 * n :]))
            move = new - h
            move *= update
            move *= real[t]
            h = np.add(h, move, out=states[t])
        return states.transpose(1, 0, 2), tape

    def states(self, x: np.ndarray, keep: bool = False):
        (sf, tf), (sb, tb) = self._direction(x, "f", keep), self._direction(x, "b", keep)
        return np.concatenate([sf, sb], 2), tf, tb

    def forward(self, x: np.ndarray, pool: np.ndarray, keep: bool = False):
        """Logits of windows: ``x`` (n, length, SIZE + 1) with context, ``pool`` (n, length) 1 for the words of the window."""
        p = self.params
        s, tf, tb = self.states(x, keep)
        a = np.tanh(s @ p["A"])
        w = np.exp(a @ p["v"]) * pool
        w = w / np.maximum(w.sum(1, keepdims=True), 1e-12)
        pooled = np.einsum("nt,nth->nh", w, s)
        return pooled @ p["o"] + p["z"][0], (x, s, a, w, tf, tb, pooled)

    def gradients(self, dlogit: np.ndarray, cache) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of all weights but the vectors, and of ``x``."""
        p, n = self.params, HIDDEN
        x, s, a, w, tf, tb, pooled = cache
        g = {"o": pooled.T @ dlogit, "z": np.array([dlogit.sum()])}
        dpool = dlogit[:, None] * p["o"]
        dw = np.einsum("nh,nth->nt", dpool, s)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", de, a)
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = np.einsum("nth,nta->ha", s, da)
        ds = w[:, :, None] * dpool[:, None] + da @ p["A"].T
        dx = np.zeros_like(x)
        real = x[:, :, -1:]
        for d, tape, part in (("f", tf, ds[:, :, :n]), ("b", tb, ds[:, :, n:])):
            gu, dh = np.zeros_like(p[f"U{d}"]), np.zeros((len(x), n), x.dtype)
            dgates = np.empty((*x.shape[:2], 3 * n), x.dtype)
            for t, h, update, reset, new, rn in reversed(tape):
                dh = dh + part[:, t]
                m = real[:, t]
                dnew = dh * m * update * (1 - new * new)
                dupdate = dh * m * (new - h) * update * (1 - update)
                dreset = dnew * rn * reset * (1 - reset)
                dgates[:, t] = np.concatenate([dupdate, dreset, dnew], 1)
                drec = np.concatenate([dupdate, dreset, dnew * reset], 1)
                gu += h.T @ drec
                dh = dh * (1 - m * update) + drec @ p[f"U{d}"].T
            flat = dgates.reshape(-1, 3 * n)
            g[f"W{d}"], g[f"U{d}"], g[f"c{d}"] = x.reshape(-1, x.shape[2]).T @ flat, gu, flat.sum(0)
            dx += dgates @ p[f"W{d}"].T
        return g, dx

    def text_windows(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all overlapping windows of the texts, and where each text's begin; a text has one at least.

        ``x`` has a row for each word and a last one of zeros.
        """
        count = np.diff(bounds)
        pieces = -(-count // PIECE)
        text = np.repeat(np.arange(count.size), pieces)
        start = _ranges(np.zeros(count.size, np.int64), pieces) * PIECE
        weight, value = np.zeros(len(x)), np.zeros(len(x))
        p = self.params
        for i in range(0, text.size, 512):
            at = placed(bounds, text[i : i + 512], start[i : i + 512] - MARGIN, PIECE + 2 * MARGIN)
            s = self.states(x[at])[0][:, MARGIN:-MARGIN]
            at = at[:, MARGIN:-MARGIN]
            weight[at] = np.exp(np.tanh(s @ p["A"]) @ p["v"])
            value[at] = s @ p["o"]
        weight[-1] = 0.0
        # texts side by side, short ones filled up to a window; sums of 1, 2, 4 ... 32 neighbours without cancellation
        room = np.maximum(count, WINDOW)
        at = placed_flat(bounds, room)
        w, v = weight[at], (weight * value)[at]
        step = 1
        while step < WINDOW:
            w, v = w[:-step] + w[step:], v[:-step] + v[step:]
            step *= 2
        begins = np.concatenate([[0], np.cumsum(room)])
        per = room - WINDOW + 1
        those = _ranges(begins[:-1], per)
        return v[those] / np.maximum(w[those], 1e-12) + p["z"][0], np.concatenate([[0], np.cumsum(per)])


def placed_flat(bounds: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Word numbers of all texts side by side, ``room`` of each, the last number of all where a text has none."""
    inner = _ranges(np.zeros(room.size, np.int64), room)
    text = np.repeat(np.arange(room.size), room)
    return np.where(inner < np.diff(bounds)[text], bounds[text] + inner, bounds[-1])


@dataclass
class ToxicityModel:
    lexicon: Lexicon | None
    network: Network | None
    calibration: np.ndarray
    prior: float

    def vectors(self, words: Words) -> np.ndarray:
        """The input of every word with a last 1, and a row of zeros at the end."""
        found = self.lexicon.find(words.inputs)
        x = word_sums(self.network.params["E"][found] * words.weight[:, None], words)[words.of]
        return np.concatenate([np.column_stack([x, np.ones(len(x), np.float32)]), np.zeros((1, SIZE + 1), np.float32)])

    def features(self, words: Words) -> np.ndarray:
        logit, first = self.network.text_windows(self.vectors(words), words.bounds)
        return np.column_stack([np.maximum.reduceat(logit, first[:-1]), np.log(np.diff(first))])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.prior)
        f = self.features(Words.split(texts))
        # rounded, as the last digits depend on what else is in the batch
        return np.round(logistic(f @ self.calibration[:-1] + self.calibration[-1]), 6)


def evidence(lexicon: Lexicon, count: np.ndarray, texts: list[Words], labels: np.ndarray) -> np.ndarray:
    """Shrunken log-odds of each input's texts to be toxic; it only picks the windows of the first training rounds."""
    positive = np.zeros(count.size + 1)
    for w, y in zip(texts, labels, strict=True):
        if y:
            positive[np.unique(lexicon.find(w.inputs))] += 1
    prior = float(np.clip(labels.mean(), 0.02, 0.98))
    share = (positive[:-1] + 4 * prior) / (count + 4)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.append(np.maximum(np.log(share / (1 - share)) - np.log(prior / (1 - prior)), 0), 0).astype(np.float32)


def train_network(texts: list[Words], labels: np.ndarray, lexicon: Lexicon, count: np.ndarray, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    network = Network.fresh(lexicon.keys.size)
    model = ToxicityModel(lexicon, network, np.zeros(3), 0.5)
    strength = evidence(lexicon, count, texts, labels)
    found = [lexicon.find(w.inputs) for w in texts]
    likely = np.array([_strongest(w, strength[f]) for w, f in zip(texts, found, strict=True)])
    best = likely
    m1 = {k: np.zeros_like(v) for k, v in network.params.items()}
    m2 = {k: np.zeros_like(v) for k, v in network.params.items()}
    step = 0
    span = WINDOW + 2 * MARGIN
    pool = np.zeros((1, span), np.float32)
    pool[:, MARGIN:-MARGIN] = 1
    epochs = max(EPOCHS, LEAST_STEPS // -(-2 * len(texts) // BATCH))
    for epoch in range(epochs):
        if epoch >= 2 and epoch % 3 == 2:
            best = np.array([b for i in range(0, len(texts), 64) for b in _best_windows(model, texts[i : i + 64])])
        room = np.array([max(1, int(w.bounds[-1]) - WINDOW + 1) for w in texts])
        # of every text a second window: the likely one of a toxic text, any one of a clean text
        start = np.concatenate([best, np.where(labels == 1, likely, rng.integers(0, room))])
        text = np.tile(np.arange(len(texts)), 2)
        y = labels[text].astype(np.float32)
        cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        order = rng.permutation(text.size)
        rate = 0.02 * (1 - epoch / (epochs + 1))
        for at in range(0, order.size, BATCH):
            pick = order[at : at + BATCH]
            x, real, batch = _crops([texts[t] for t in text[pick]], [found[t] for t in text[pick]], start[pick], network, rng, span)
            logit, cache = network.forward(x, pool * real, keep=True)
            d = ((logistic(logit) - y[pick]) * cost[pick] / pick.size).astype(np.float32)
            grads, dx = network.gradients(d, cache)
            grads["E"] = _vector_gradients(dx, batch, network.params["E"].shape[0])
            step += 1
            for k, g in grads.items():
                m1[k] += 0.1 * (g - m1[k])
                # one scale for all vectors, not one for each: inputs that few windows hold move little
                m2[k] += 0.01 * ((g * g if k != "E" else VECTOR_SCALE * np.square(g).sum(0, keepdims=True)) - m2[k])
                network.params[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def _strongest(words: Words, strength: np.ndarray) -> int:
    """The first word of the window whose words have the most evidence."""
    n = int(words.bounds[-1])
    if n <= WINDOW:
        return 0
    per = np.maximum.reduceat(strength, words.starts[:-1])[words.of]
    total = np.concatenate([[0], np.cumsum(per, dtype=np.float64)])
    return int(np.argmax(np.round(total[WINDOW:] - total[:-WINDOW], 6)))


def _best_windows(model: ToxicityModel, texts: list[Words]) -> list[int]:
    """The first word of each text's strongest window."""
    x = [model.vectors(w)[:-1] for w in texts]
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in x])])
    logit, first = model.network.text_windows(np.concatenate([*x, np.zeros((1, SIZE + 1), np.float32)]), bounds)
    return [int(logit[a:b].argmax()) for a, b in itertools.pairwise(first.tolist())]


def _crops(texts: list[Words], found: list[np.ndarray], start: np.ndarray, network: Network, rng, span: int):
    """Inputs (n, span, SIZE + 1) of the windows with their context, which places are words, and what the gradients need."""
    rows, weight, word, places = [], [], [], np.full((len(texts), span), -1)
    n = 0
    for i, (w, f, s) in enumerate(zip(texts, found, start.tolist(), strict=True)):
        lo, hi = max(0, s - MARGIN), min(int(w.bounds[-1]), s - MARGIN + span)
        if hi <= lo:
            continue
        of = w.of[lo:hi]
        sizes = w.starts[of + 1] - w.starts[of]
        at = _ranges(w.starts[of], sizes)
        keep = w.weight[at].copy()
        keep[np.cumsum(sizes) - sizes] *= rng.random(of.size) >= WORD_DROPOUT
        rows.append(f[at])
        weight.append(keep)
        word.append(np.repeat(np.arange(n, n + of.size), sizes))
        places[i, lo - (s - MARGIN) : hi - (s - MARGIN)] = np.arange(n, n + of.size)
        n += of.size
    x = np.zeros((n + 1, SIZE + 1), np.float32)
    rows, weight, word = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (rows, weight, word))
    if n:
        first = np.flatnonzero(np.diff(word, prepend=-1))
        x[:n, :SIZE] = np.add.reduceat(network.params["E"][rows] * weight[:, None], first, axis=0)
    x[:n, SIZE] = 1
    real = (places >= 0).astype(np.float32)
    return x[places], real, (rows, weight, word, places)


def _vector_gradients(dx: np.ndarray, batch, n: int) -> np.ndarray:
    rows, weight, word, places = batch
    g = np.zeros((n, SIZE), np.float32)
    if rows.size:
        flat = np.empty((int(word[-1]) + 1, SIZE), np.float32)
        here = places >= 0
        flat[places[here]] = dx[here][:, :SIZE]
        g = scattered(rows, flat[word] * weight[:, None], n)
        g[-1] = 0
    return g


def fit(rows: list[tuple[str, int]], prior: float | None = None) -> ToxicityModel:
    """``rows`` are (text, label); ``prior`` is the share of label 1 that the score is calibrated to."""
    labels = np.array([y for _, y in rows], np.int64)
    share = float(labels.mean()) if rows else 0.0
    prior = share if prior is None else prior
    if min((labels == 0).sum(), (labels == 1).sum()) < 3:
        return ToxicityModel(None, None, np.zeros(3), prior)
    order = np.concatenate([np.flatnonzero(labels == c) for c in (0, 1)])
    held = np.zeros(labels.size, bool)
    for c in (0, 1):
        held[np.flatnonzero(labels == c)[::CALIBRATE]] = True
    if min(held[labels == 1].sum(), held[labels == 0].sum()) < 5:
        held[:] = False  # too few to spare: the calibration then uses the texts of the training
    texts = [Words.split([t]) for t in folded([t for t, _ in rows])]
    mine = [texts[i] for i in order if not held[i]]
    own = np.array([labels[i] for i in order if not held[i]])
    lexicon, count = Lexicon.learn(mine)
    network = train_network(mine, own, lexicon, count)
    model = ToxicityModel(lexicon, network, np.zeros(3), prior)
    told = [i for i in order if held[i] or not held.any()]
    f, y = np.concatenate([model.features(texts[i]) for i in told]), labels[told]
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.calibration = fit_logistic(f, y, weight, ridge=0.5)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    known = labels.filter(F.col("toxic").isin(0, 1) & (crc_bucket("doc_id", BUCKETS) != HELD_OUT))
    prior = known.agg(F.avg("toxic")).first()[0]
    return fit(labelled_sample(docs, labels, "toxic", per_class, BUCKETS, HELD_OUT), prior)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = folded(batch.column(1).to_pylist())
            for lo, hi in text_slices(texts, 1 << 18):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.scores(texts[lo:hi]), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(shared), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_bucket("doc_id", BUCKETS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
