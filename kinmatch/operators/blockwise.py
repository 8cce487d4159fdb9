"""Training pairs measured block by block: every pair counts, each pair of different texts is measured once.

The rows of a block meet in one task, where numpy measures its different texts
against each other and then looks every pair of records up. A pair of an
address block whose name block is the same is left to the name block, so no
distinct of pairs is needed. Ranked pairs of the address blocks travel to the
name block of their record, which makes the final rank.

Measures are whole millionths, rounded half up, so scores and ties are exact.
Ids must be unique (:func:`repeated`). A block of more than ``TOGETHER`` S1
records is divided by them; the targets of one block fit into a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.similarity import common_subsequence
from kinmatch.functions.text import country_key, text
from kinmatch.operators.features import FEATURES

S1, TARGET = "source1_entity_id", "target_entity_id"
MILLION = 1_000_000
#: S1 records of a division of a block; rows that are gathered before blocks are measured; pairs, and pairs of texts, in hand at once.
TOGETHER, GATHER, SLAB, STRIP = 500, 60_000, 1_000_000, 1 << 15
#: Longest text held in one machine word, longest text that meets it, most tokens compared by position; beyond them plain Python.
WORD, LONGEST, MOST_TOKENS = 64, 192, 12

RANKED = f"{S1} string, {TARGET} string, target_source string, name_similarity double, address_similarity double, numeric_overlap double, ranking_score double, rank int"
_ROWS = "route string, chunk int, side int, id string, other string, name string, address string, country string, true_ids array<string>, n int, a int, o int, home string, home_chunk int"
_EXTRA = "route string, chunk int, id string, other string, n int, a int, o int"


# --- texts ---------------------------------------------------------------------


class _Texts:
    """Different texts of a gathered part: characters, lengths, tokens and numbers as arrays by code."""

    def __init__(self, texts: pa.Array, tokens: bool, numbers: bool):
        self.texts = texts
        self.n = len(texts)
        self.length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ascii_ = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
        self.short, self.fits = ascii_ & (self.length <= WORD), ascii_ & (self.length <= LONGEST)
        size = np.where(self.fits, self.length, 0)
        flat = np.frombuffer("".join(t for t, ok in zip(texts.to_pylist(), self.fits, strict=True) if ok).encode(), np.uint8)
        used = np.zeros(256, bool)
        used[flat] = True
        places = np.cumsum(used) * used  # 0 is no character
        self.symbols = int(used.sum()) + 1
        self.chars = np.zeros((max(1, int(size.max(initial=0))), self.n), np.uint8)
        row = np.repeat(np.arange(self.n), size)
        self.chars[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), row] = places[flat]
        self._masks = None
        strings = texts.to_pylist() if tokens or numbers else []
        self.tokens = _Sets([t.split() for t in strings]) if tokens else None
        self.numbers = _Sets([re.findall("[0-9]+", t) for t in strings]) if numbers else None

    def masks(self) -> np.ndarray:
        """Places of every symbol in every short text, as bits."""
        if self._masks is None:
            out = np.zeros((self.n, self.symbols), np.uint64)
            size = np.where(self.short, self.length, 0)
            for j in range(int(size.max(initial=0))):
                rows = np.flatnonzero(size > j)
                out[rows, self.chars[j, rows]] |= np.uint64(1 << j)
            self._masks = out.ravel()
        return self._masks

    def common(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Longest common subsequence of each pair of codes, by bit-parallel rows of many pairs at once."""
        out = np.empty(len(s), np.int64)
        for i in range(0, len(s), STRIP):
            out[i : i + STRIP] = self._strip(s[i : i + STRIP], t[i : i + STRIP])
        for i in np.flatnonzero(~(self.short[s] & self.fits[t])):
            out[i] = common_subsequence(self.texts[int(s[i])].as_py(), self.texts[int(t[i])].as_py())
        return out

    def _strip(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        masks, base = self.masks(), s * self.symbols
        row = np.full(len(s), ~np.uint64(0))
        met, more = np.empty_like(row), np.empty_like(row)
        for j in range(int(np.where(self.fits[t], self.length[t], 0).max(initial=0))):
            np.bitwise_and(row, masks.take(base + self.chars[j].take(t)), out=met)
            np.add(row, met, out=more)
            np.subtract(row, met, out=row)
            np.bitwise_or(row, more, out=row)
        return 64 - np.bitwise_count(row).astype(np.int64)


class _Sets:
    """Sets of tokens by code; common tokens of many pairs at once."""

    def __init__(self, lists: list[list[str]]):
        self.lists = [list(dict.fromkeys(x)) for x in lists]
        self.size = np.array([len(x) for x in self.lists], np.int64)
        known: dict[str, int] = {}
        most = min(MOST_TOKENS, int(self.size.max(initial=0)))
        self.codes = np.full((most, len(lists)), -1, np.int32)
        for i, x in enumerate(self.lists):
            for j, token in enumerate(x[:most]):
                self.codes[j, i] = known.setdefault(token, len(known))

    def common(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        for i in range(0, len(s), STRIP):
            left, right = s[i : i + STRIP], t[i : i + STRIP]
            theirs = [self.codes[j].take(right) for j in range(min(len(self.codes), int(self.size[right].max(initial=0))))]
            for j in range(min(len(self.codes), int(self.size[left].max(initial=0)))):
                mine = self.codes[j].take(left)
                for other in theirs:
                    out[i : i + STRIP] += (mine == other) & (mine >= 0)
        for i in np.flatnonzero((self.size[s] > MOST_TOKENS) | (self.size[t] > MOST_TOKENS)):
            out[i] = len(set(self.lists[s[i]]) & set(self.lists[t[i]]))
        return out


def _millionths(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """part / whole rounded half up to millionths; whole is not 0."""
    return (2 * MILLION * part + whole) // (2 * whole)


def _ratio(texts: _Texts, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    whole = texts.length[s] + texts.length[t]
    return np.where(whole == 0, MILLION, _millionths(2 * texts.common(s, t), np.maximum(whole, 1)))


def _overlap(sets: _Sets, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    met = sets.common(s, t)
    whole = sets.size[s] + sets.size[t] - met
    return np.where(whole == 0, MILLION, _millionths(met, np.maximum(whole, 1)))


# --- blocks --------------------------------------------------------------------


class _Field:
    """One text column of a part: different texts by block on both sides, and the place of every record's text among them."""

    def __init__(self, s: pa.ChunkedArray, t: pa.ChunkedArray, s_block: np.ndarray, t_block: np.ndarray, blocks: int, tokens: bool, numbers: bool):
        both = pa.chunked_array([*s.chunks, *t.chunks], pa.string()).combine_chunks().dictionary_encode()
        codes = both.indices.to_numpy().astype(np.int64)
        self.texts = _Texts(both.dictionary, tokens, numbers)
        n = max(1, self.texts.n)
        self.s_unique, self.s_place = np.unique(s_block * n + codes[: len(s)], return_inverse=True)
        t_unique, t_place = np.unique(t_block * n + codes[len(s) :], return_inverse=True)
        self.s_code, self.s_of = self.s_unique % n, self.s_unique // n
        self.t_code = t_unique % n
        self.start = np.searchsorted(t_unique // n, np.arange(blocks + 1))
        self.t_local = t_place - self.start[t_block]

    def cross(self, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, codes, first place of each record): all different texts of the records against those of their blocks' targets."""
        used, mine = np.unique(self.s_place[rows], return_inverse=True)
        first = self.start[self.s_of[used]]
        n = self.start[self.s_of[used] + 1] - first
        offset = np.cumsum(n) - n
        t = np.arange(n.sum()) + np.repeat(first - offset, n)
        return np.repeat(self.s_code[used], n), self.t_code[t], offset[mine]


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The same number for the same text on both sides; blank texts equal nothing."""
    both = pa.chunked_array([*left.chunks, *right.chunks], pa.string()).combine_chunks()
    codes = both.dictionary_encode().indices.to_numpy().astype(np.int64)
    blank = pc.equal(both, "").to_numpy(zero_copy_only=False)
    a, b = codes[: len(left)].copy(), codes[len(left) :].copy()
    a[blank[: len(left)]], b[blank[len(left) :]] = -1, -2
    return a, b


class _Part:
    """Whole blocks of a stream that is sorted by (route, chunk, side, id): S1 records, targets, and ranked pairs brought along."""

    def __init__(self, table: pa.Table, by_name: bool, fitting: bool):
        side = table["side"].to_numpy()
        block = _starts(table).cumsum() - 1
        blocks = int(block[-1]) + 1
        at = [np.flatnonzero(side == i) for i in range(3)]
        self.s, self.t, self.extra = (table.take(pa.array(x)) for x in at)
        self.s_block, t_block = block[at[0]], block[at[1]]
        self.t_block = t_block
        self.first = np.searchsorted(t_block, np.arange(blocks + 1))
        self.names = _Field(self.s["name"], self.t["name"], self.s_block, t_block, blocks, fitting, False)
        self.addresses = _Field(self.s["address"], self.t["address"], self.s_block, t_block, blocks, fitting, True)
        self.elsewhere = None if by_name else _codes(self.s["other"], self.t["other"])
        self.n2 = self.first[self.s_block + 1] - self.first[self.s_block]
        ids = pa.chunked_array([*self.t["id"].chunks, *self.extra["other"].chunks], pa.string()).combine_chunks()
        coded = ids.dictionary_encode()
        self.ids, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        place = np.empty(len(self.ids), np.int64)
        place[pc.array_sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        self.place, self.t_id, self.extra_id = place, codes[: len(self.t)], codes[len(self.t) :]
        self.source = pc.utf8_slice_codeunits(self.ids, 0, 2).dictionary_encode()
        self.t_source = self.source.indices.to_numpy()[self.t_id].astype(np.int64)
        self._extras(block, at)
        self._truth()

    def _extras(self, block: np.ndarray, at: list[np.ndarray]) -> None:
        """The S1 row of each pair brought along: same block, same id."""
        both = pa.chunked_array([*self.s["id"].chunks, *self.extra["id"].chunks], pa.string()).combine_chunks().dictionary_encode()
        codes, n = both.indices.to_numpy().astype(np.int64), max(1, len(both.dictionary))
        mine = self.s_block * n + codes[: len(self.s)]
        order = np.argsort(mine)
        self.extra_row = order[np.searchsorted(mine, block[at[2]] * n + codes[len(self.s) :], sorter=order)] if len(self.extra) else np.zeros(0, np.int64)
        self.extra_order = np.argsort(self.extra_row, kind="stable")
        self.extra_measures = tuple(self.extra[c].to_numpy().astype(np.int64) for c in "nao")

    def _truth(self) -> None:
        """Listed true targets: their S1 rows, ids, and codes among the targets here (-1: not here)."""
        lists = self.s["true_ids"].combine_chunks()
        self.true_row = np.repeat(np.arange(len(self.s)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        self.true_ids = lists.flatten()
        self.true_id = pc.fill_null(pc.index_in(self.true_ids, self.ids), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(self.true_ids) else np.zeros(0, np.int64)

    def true_columns(self) -> tuple[np.ndarray, np.ndarray]:
        """(S1 row, target row) of the true pairs whose two records are in one block here."""
        n = max(1, len(self.ids))
        known = self.true_id >= 0
        row, wanted = self.true_row[known], self.s_block[self.true_row[known]] * n + self.true_id[known]
        have = self.t_block * n + self.t_id
        order = np.argsort(have)
        if not len(have):
            return row[:0], row[:0]
        at = order[np.minimum(np.searchsorted(have, wanted, sorter=order), len(have) - 1)]
        hit = have[at] == wanted
        return row[hit], at[hit]

    def slabs(self) -> Iterator[slice]:
        """Ranges of S1 rows of about ``SLAB`` pairs; a row is never divided."""
        done, total = 0, np.cumsum(self.n2)
        while done < len(total):
            before = total[done - 1] if done else 0
            end = max(done + 1, int(np.searchsorted(total, before + SLAB, "right")))
            yield slice(done, end)
            done = end

    def pairs(self, rows: slice, true: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n of each row, target of each pair, whether the pair counts here, whether it is true), row by row."""
        n = self.n2[rows]
        start = np.cumsum(n) - n
        col = np.arange(n.sum()) + np.repeat(self.first[self.s_block[rows]] - start, n)
        counts = np.ones(len(col), bool) if self.elsewhere is None else np.repeat(self.elsewhere[0][rows], n) != self.elsewhere[1][col]
        mark = np.zeros(len(col), bool)
        here = (true[0] >= rows.start) & (true[0] < rows.stop)
        r, c = true[0][here] - rows.start, true[1][here]
        mark[start[r] + c - self.first[self.s_block[rows]][r]] = True
        return n, col, counts, mark


def _starts(table: pa.Table) -> np.ndarray:
    route = table["route"].combine_chunks().dictionary_encode().indices.to_numpy()
    chunk = table["chunk"].to_numpy()
    out = np.ones(len(route), np.int64)
    out[1:] = (route[1:] != route[:-1]) | (chunk[1:] != chunk[:-1])
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The stream in tables of whole blocks."""
    held: list[pa.Table] = []
    rows, wanted = 0, GATHER
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= wanted:
            table = pa.concat_tables(held)
            last = int(np.flatnonzero(_starts(table))[-1])
            if last:
                yield table.slice(0, last)
            held, rows = [table.slice(last)], table.num_rows - last
            wanted = max(GATHER, 2 * rows)
    if rows:
        yield pa.concat_tables(held)


# --- ranking -------------------------------------------------------------------


def _key(n: np.ndarray, a: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two parts whose sum orders pairs by score, name, address (the overlap follows); 0 is kept for no pair."""
    return ((6 * n << 40) + (n << 20) + 1).astype(np.uint64), ((3 * a + o << 40) + a).astype(np.uint64)


def _ranked(part: _Part, k: int, each: bool, least: int, without_true: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(S1 row, target id code, n, a, o, rank) of the best k pairs of each S1 row, or of each row and source."""
    true = part.true_columns() if without_true else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sources = max(1, len(part.source.dictionary))
    id_source = part.source.indices.to_numpy().astype(np.int64)
    for rows in part.slabs():
        width, col, counts, mark = part.pairs(rows, true)
        s, t, first = part.names.cross(rows)
        names = _ratio(part.names.texts, s, t)
        at_name = np.repeat(first, width) + part.names.t_local[col]
        s, t, first = part.addresses.cross(rows)
        addresses, numbers = _ratio(part.addresses.texts, s, t), _overlap(part.addresses.texts.numbers, s, t)
        at_address = np.repeat(first, width) + part.addresses.t_local[col]
        left, right = _key(names, addresses[:0], numbers[:0])[0], _key(names[:0], addresses, numbers)[1]
        left[names < least] = 0
        key = left[at_name]
        keep = counts & ~mark & (key > 0)
        key += right[at_address]
        key[~keep] = 0
        _screen(part, rows, width, key, keep, k, each)
        kept = np.flatnonzero(keep)
        row = np.repeat(np.arange(rows.start, rows.stop), width)[kept]
        n, a, o, tid = names[at_name[kept]], addresses[at_address[kept]], numbers[at_address[kept]], part.t_id[col[kept]]
        key = key[kept]
        if len(part.extra):
            lo, hi = np.searchsorted(part.extra_row[part.extra_order], [rows.start, rows.stop])
            more = part.extra_order[lo:hi]
            en, ea, eo = (x[more] for x in part.extra_measures)
            x, y = _key(en, ea, eo)
            row, tid, key = np.append(row, part.extra_row[more]), np.append(tid, part.extra_id[more]), np.append(key, x + y)
            n, a, o = np.append(n, en), np.append(a, ea), np.append(o, eo)
        group = row * sources + id_source[tid] if each else row
        order = np.lexsort((part.place[tid], ~key, group))
        group = group[order]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        starts = np.flatnonzero(new)
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group)))) + 1
        order, rank = order[rank <= k], rank[rank <= k]
        yield row[order], tid[order], n[order], a[order], o[order], rank


def _screen(part: _Part, rows: slice, width: np.ndarray, key: np.ndarray, keep: np.ndarray, k: int, each: bool) -> None:
    """In wide blocks, drop pairs below the k-th best key of their row (and source); ties with it stay."""
    blocks = part.s_block[rows]
    edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    start = np.cumsum(width) - width
    for i, j in zip(edges, np.append(edges[1:], len(blocks)), strict=True):
        n = int(width[i])
        if n <= 2 * k:
            continue
        here = slice(int(start[i]), int(start[i]) + (j - i) * n)
        keys, kept = key[here].reshape(j - i, n), keep[here].reshape(j - i, n)
        first = part.first[blocks[i]]
        source = part.t_source[first : first + n]
        cuts = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1), n] if each else [0, n]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y - x > 2 * k:
                kth = np.partition(keys[:, x:y], y - x - k, axis=1)[:, y - x - k]
                kept[:, x:y] &= keys[:, x:y] >= kth[:, None]


def _best(each: bool, k: int, least: int, without_true: bool, by_name: bool, output: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _parts(batches):
            part = _Part(table, by_name, False)
            for row, tid, n, a, o, rank in _ranked(part, k, each, least, without_true):
                yield from _OUTPUT[output](part, row, tid, n, a, o, rank)
            if output == "labels":
                yield from _unranked_truth(part)

    return run


def _out_extra(part, row, tid, n, a, o, rank):
    take = pa.array(row)
    columns = [part.s[c].combine_chunks().take(take) for c in ("home", "home_chunk", "id")]
    yield pa.RecordBatch.from_arrays([*columns, part.ids.take(pa.array(tid)), *(pa.array(x.astype(np.int32)) for x in (n, a, o))], ["route", "chunk", "id", "other", "n", "a", "o"])


def _names(part: _Part, row: np.ndarray, tid: np.ndarray) -> list[pa.Array]:
    source = part.source.dictionary.take(part.source.indices.take(pa.array(tid)))
    return [part.s["id"].combine_chunks().take(pa.array(row)), part.ids.take(pa.array(tid)), source]


def _out_ranked(part, row, tid, n, a, o, rank):
    values = [n / MILLION, a / MILLION, o / MILLION, (6 * n + 3 * a + o) / (10 * MILLION)]
    yield pa.RecordBatch.from_arrays([*_names(part, row, tid), *map(pa.array, values), pa.array(rank.astype(np.int32))], [c.split()[0] for c in RANKED.split(", ")])


def _is_true(part: _Part, row: np.ndarray, tid: np.ndarray) -> np.ndarray:
    n = len(part.ids) + 1
    return np.isin(row * n + tid, part.true_row * n + part.true_id)


def _out_labels(part, row, tid, n, a, o, rank):
    true = _is_true(part, row, tid)
    part.seen = [*getattr(part, "seen", []), np.stack([row[true], tid[true]])]
    yield pa.RecordBatch.from_arrays([*_names(part, row, tid), pa.array(true.astype(np.int32))], [S1, TARGET, "target_source", "y"])


def _unranked_truth(part: _Part) -> Iterator[pa.RecordBatch]:
    """True pairs that are not among the best ones."""
    n = len(part.ids) + 1
    row, tid = np.concatenate(part.seen, axis=1) if getattr(part, "seen", None) else np.zeros((2, 0), np.int64)
    left = np.flatnonzero(~np.isin(part.true_row * n + part.true_id, row * n + tid))
    ids = part.true_ids.take(pa.array(left))
    columns = [part.s["id"].combine_chunks().take(pa.array(part.true_row[left])), ids, pc.utf8_slice_codeunits(ids, 0, 2), pa.array(np.ones(len(left), np.int32))]
    yield pa.RecordBatch.from_arrays(columns, [S1, TARGET, "target_source", "y"])


def _out_recall(part, row, tid, n, a, o, rank):
    """By rank: pairs, true ones among them, and all true pairs of their records."""
    size = int(rank.max(initial=0)) + 1
    listed = np.bincount(part.true_row, minlength=len(part.s))
    sums = [np.bincount(rank, w, minlength=size).astype(np.int64) for w in (None, _is_true(part, row, tid), listed[row])]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *map(pa.array, sums)], ["rank", "n", "hits", "listed"])


_OUTPUT = {"extra": _out_extra, "ranked": _out_ranked, "labels": _out_labels, "recall": _out_recall}
_SCHEMA = {"ranked": RANKED, "labels": f"{S1} string, {TARGET} string, target_source string, y int", "recall": "rank int, n long, hits long, listed long"}


# --- feature counts --------------------------------------------------------------


def _field_features(field: _Field, s: np.ndarray, t: np.ndarray, numbers: bool) -> np.ndarray:
    """The whole numbers that the features of a field follow from, one row a pair of texts."""
    texts = field.texts
    known = [texts.common(s, t), texts.length[s], texts.length[t], texts.tokens.common(s, t), texts.tokens.size[s], texts.tokens.size[t], _same(s, t)]
    if numbers:
        known += [texts.numbers.common(s, t), texts.numbers.size[s], texts.numbers.size[t]]
    return np.stack(known, axis=1)


def _same(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (s == t).astype(np.int64)


def _values(x: np.ndarray, field: str) -> dict[str, np.ndarray]:
    lcs, ls, lt, met, ns, nt, same = x.T[:7]
    empty, one = (ls == 0) & (lt == 0), (ls == 0) | (lt == 0)
    divide = lambda p, q: p / np.maximum(q, 1)
    sets = lambda both, value: np.where((ns == 0) & (nt == 0), both, np.where((ns == 0) | (nt == 0), 0.0, value))
    least = divide(met, np.minimum(ns, nt))
    return {
        f"{field}_similarity": np.where(empty, 1.0, np.where(one, 0.0, divide(2.0 * lcs, ls + lt))),
        f"{field}_jaccard": sets(1.0, divide(met, ns + nt - met)),
        f"{field}_token_overlap": sets(0.0, least),
        f"{field}_containment": sets(1.0, least),
        f"{field}_exact": ((same == 1) & (ls > 0)).astype(float),
        f"{field}_length_ratio": np.where(empty, 1.0, np.where(one, 0.0, divide(np.minimum(ls, lt), np.maximum(ls, lt)))),
        f"{field}_missing_s1": (ls == 0).astype(float),
        f"{field}_missing_target": (lt == 0).astype(float),
    }


class _Vectors:
    """Numbers of different vectors, the same throughout a task."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []

    def codes(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int32)
        packed, room = np.zeros(len(x), np.int64), 1
        for column in x.T:
            span = int(column.max(initial=0)) + 1
            packed, room = packed * span + column, room * span
        if room >= 1 << 62:
            packed = np.ascontiguousarray(x).view([("", np.int32)] * x.shape[1]).ravel()
        _, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
        out = np.empty(len(first), np.int64)
        for i, v in enumerate(x[first]):
            b = v.tobytes()
            if b not in self.known:
                self.known[b] = len(self.rows)
                self.rows.append(v)
            out[i] = self.known[b]
        return out[inverse]


def _counted(by_name: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, addresses = _Vectors(), _Vectors()
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for table in _parts(batches):
            part = _Part(table, by_name, True)
            true = part.true_columns()
            country = (pc.not_equal(part.s["country"], "")).to_numpy().astype(np.int64)
            for rows in part.slabs():
                width, col, valid, y = part.pairs(rows, true)
                if not len(col):
                    continue
                s, t, first = part.names.cross(rows)
                left = names.codes(_field_features(part.names, s, t, False))[np.repeat(first, width) + part.names.t_local[col]]
                s, t, first = part.addresses.cross(rows)
                right = addresses.codes(_field_features(part.addresses, s, t, True))[np.repeat(first, width) + part.addresses.t_local[col]]
                code = (left << 33) + (right << 2) + 2 * np.repeat(country[rows], width) + y
                new, n = np.unique(code[valid], return_counts=True)
                codes, counts = np.append(codes, new), np.append(counts, n)
                if len(codes) > 4 * SLAB:
                    codes, counts = _merged(codes, counts)
        codes, counts = _merged(codes, counts)
        for i in range(0, len(codes), GATHER):
            code, n = codes[i : i + GATHER], counts[i : i + GATHER]
            x, z = np.stack([names.rows[c] for c in code >> 33]), np.stack([addresses.rows[c] for c in (code >> 2) & ((1 << 31) - 1)])
            met, ns, nt = z.T[7:]
            values = _values(x, "name") | _values(z, "address")
            values["numeric_overlap"] = np.where((ns == 0) & (nt == 0), 1.0, np.where((ns == 0) | (nt == 0), 0.0, met / np.maximum(ns + nt - met, 1)))
            values["country_same"] = ((code >> 1) & 1).astype(float)
            yield pa.RecordBatch.from_arrays([*(pa.array(values[f]) for f in FEATURES), pa.array((code & 1).astype(np.int32)), pa.array(n)], [*FEATURES, "y", "n"])

    return run


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new, at = np.unique(codes, return_inverse=True)
    return new, np.bincount(at, counts, len(new)).astype(np.int64)


# --- operators -------------------------------------------------------------------


def repeated(tables: dict[str, DataFrame]) -> bool:
    """Whether a table (by the name of its key) has a key more than once; such records are for the pair join."""
    keys = [d.select(F.lit(c).alias("key"), F.col(c).cast("long").alias("value")) for c, d in tables.items()]
    return not reduce(DataFrame.unionByName, keys).filter("value IS NOT NULL").groupBy("key", "value").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def records(raw: DataFrame) -> DataFrame:
    """Normalized texts ("ascii") and block keys of raw records, as in :mod:`kinmatch.operators.records` but by Arrow, which reads a text once."""
    low = raw.select("entity_id", F.lower(text("business_name")).alias("name"), F.lower(text("business_address")).alias("address"), country_key("country").alias("country_norm"))
    return low.filter("entity_id IS NOT NULL").mapInArrow(_normalized, "entity_id string, name_norm string, address_norm string, country_norm string, name_block string, address_block string")


def _normalized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norm = [pc.utf8_trim(pc.replace_substring_regex(batch[c], "[^a-z0-9_]+", " "), " ") for c in ("name", "address")]
        prefix = [pc.utf8_slice_codeunits(pc.replace_substring_regex(x, "[ _]+", ""), 0, n) for x, n in zip(norm, (4, 8), strict=True)]
        blocks = [pc.if_else(pc.equal(x, ""), "", pc.binary_join_element_wise(batch["country_norm"], p, "|")) for x, p in zip(norm, prefix, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["entity_id"], *norm, batch["country_norm"], *blocks], ["entity_id", "name_norm", "address_norm", "country_norm", "name_block", "address_block"])


def _streams(s1: DataFrame, targets: DataFrame, truth: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(by address, by name): the rows of the blocks, each record with its block's division."""
    def of(c: str) -> DataFrame:
        blocks = s1.filter(F.col(f"{c}_block") != "").groupBy(f"{c}_block").agg(F.count("*").alias("n"))
        return blocks.select(f"{c}_block", F.ceil(F.col("n") / TOGETHER).cast("int").alias(f"{c}_chunks"))

    dealt = lambda c: F.pmod(F.hash("id"), F.col(f"{c}_chunks"))
    mine = s1.join(of("name"), "name_block", "left").join(of("address"), "address_block", "left").withColumnRenamed("entity_id", "id")
    lists = None if truth is None else truth.groupBy(F.col(S1).alias("id")).agg(F.collect_set(TARGET).alias("true_ids"))
    mine = mine.withColumn("true_ids", F.array().cast("array<string>")) if lists is None else mine.join(lists, "id", "full")
    home = F.when(F.col("name_chunks").isNotNull(), F.col("name_block")).otherwise(F.concat(F.lit("\x00"), "id"))
    mine = mine.select("*", home.alias("home"), F.coalesce(dealt("name"), F.lit(0)).alias("home_chunk"))
    nothing = {"other": "string", "name": "string", "address": "string", "country": "string", "true_ids": "array<string>", "n": "int", "a": "int", "o": "int", "home": "string", "home_chunk": "int"}
    columns = [c.split()[0] for c in _ROWS.split(", ")]

    def rows(d: DataFrame, side: int, **given) -> DataFrame:
        given = {"side": F.lit(side), "id": F.col("id"), **given}
        return d.select(*(given.get(c, F.lit(None).cast(nothing.get(c, "string"))).alias(c) for c in columns))

    texts = {"name": F.coalesce("name_norm", F.lit("")), "address": F.coalesce("address_norm", F.lit("")), "country": F.coalesce("country_norm", F.lit(""))}

    def stream(c: str, other: str) -> DataFrame:
        route, chunk = (F.col("home"), F.col("home_chunk")) if c == "name" else (F.col("address_block"), dealt("address"))
        own = mine if c == "name" else mine.filter("address_chunks IS NOT NULL")
        left = rows(own, 0, route=route, chunk=chunk, other=F.coalesce(f"{other}_block", F.lit("")), true_ids=F.coalesce("true_ids", F.array().cast("array<string>")), home=F.col("home"), home_chunk=F.col("home_chunk"), **texts)
        met = targets.join(of(c), f"{c}_block").select("*", F.explode(F.sequence(F.lit(0), F.col(f"{c}_chunks") - 1)).alias("chunk")).withColumnRenamed("entity_id", "id")
        return left.unionByName(rows(met, 1, route=F.col(f"{c}_block"), chunk=F.col("chunk"), other=F.col(f"{other}_block"), **texts))

    return stream("address", "name"), stream("name", "address")


def _sorted(d: DataFrame) -> DataFrame:
    return d.repartition("route", "chunk").sortWithinPartitions("route", "chunk", "side", "id")


def best_pairs(s1: DataFrame, targets: DataFrame, k: int, truth: DataFrame | None = None, each_source: bool = True, least_name: float = 0.0, without_true: bool = False, output: str = "ranked") -> DataFrame:
    """The best ``k`` training pairs of each S1 record (and source) by weighted score, ties by the target's id.

    ``output``: "ranked" has the measures and the rank; "labels" the label of each kept pair, with all other
    true pairs; "recall" by rank the number of pairs, of true ones, and of all true pairs of their records.
    """
    by_address, by_name = _streams(s1, targets, truth)
    least = round(least_name * MILLION)
    extra = _sorted(by_address).mapInArrow(_best(each_source, k, least, without_true, False, "extra"), _EXTRA)
    kinds = {"n": "int", "a": "int", "o": "int"}
    given = {"side": F.lit(2), **{c: F.col(c) for c in extra.columns}}
    brought = extra.select(*(given.get(f.name, F.lit(None).cast(kinds.get(f.name, f.dataType.simpleString()))).alias(f.name) for f in by_name.schema.fields))
    return _sorted(by_name.unionByName(brought)).mapInArrow(_best(each_source, k, least, without_true, True, output), _SCHEMA[output])


def feature_counts(s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """Every training pair's 18 features and label, equal rows once with their number ``n``."""
    schema = ", ".join([*(f"{f} double" for f in FEATURES), "y int", "n long"])
    by_address, by_name = (_sorted(d).mapInArrow(_counted(named), schema) for d, named in zip(_streams(s1, targets, truth), (False, True), strict=True))
    return by_address.unionByName(by_name).groupBy(*FEATURES, "y").agg(F.sum("n").alias("n"))
