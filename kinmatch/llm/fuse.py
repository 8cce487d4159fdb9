"""Static 3-wise binary fuse filters over 64-bit keys, built and probed in numpy."""

from __future__ import annotations

import math

import numpy as np

from kinmatch.llm.common import mix

_U = np.uint64


class BinaryFuse8:
    """Membership filter of about 9 bits a key; no false negatives, about 1/256 false positives."""

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def _places(h: np.ndarray, segment: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = ((h >> _U(32)) * _U(count)) >> _U(32)
        base = (first * _U(segment)).astype(np.int64)
        inner = _U(segment - 1)
        return (
            base + (h & inner).astype(np.int64),
            base + segment + ((h >> _U(18)) & inner).astype(np.int64),
            base + 2 * segment + ((mix(h) >> _U(7)) & inner).astype(np.int64),
        )

    @staticmethod
    def _mark(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _U(32))) & _U(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = keys.size
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        count = max(1, math.ceil(n * factor / segment) - 2)
        for seed in range(200):
            h = mix(keys ^ _U((seed * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1)))
            size = (count + 2) * segment
            places = np.stack(cls._places(h, segment, count))
            order = cls._peel(places, size)
            if order is not None:
                cells = np.zeros(size, np.uint8)
                mark = cls._mark(h)
                for who, slot in reversed(order):
                    p = places[:, who]
                    others = cells[p[0]] ^ cells[p[1]] ^ cells[p[2]]  # the slot itself still holds 0
                    cells[slot] = mark[who] ^ others
                return cls(seed, segment, count, cells)
            if seed % 10 == 9:
                count += max(1, count // 10)
        raise RuntimeError("no seed gave a filter")

    @staticmethod
    def _peel(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, slots) where each slot holds that key alone, or None if some keys stay."""
        n = places.shape[1]
        load = np.bincount(places.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        ids = np.arange(n)
        for row in places:
            np.add.at(held, row, ids)
        left, order = n, []
        fresh = np.flatnonzero(load == 1)
        while fresh.size:
            who, pick = np.unique(held[fresh], return_index=True)
            slot = fresh[pick]
            order.append((who, slot))
            left -= who.size
            touched = places[:, who].ravel()
            np.subtract.at(load, touched, 1)
            np.subtract.at(held, touched, np.tile(who, 3))
            fresh = np.unique(touched)
            fresh = fresh[load[fresh] == 1]
        return None if left else order

    def __contains__(self, keys) -> bool:
        return bool(self.probe(np.asarray([keys], np.uint64))[0])

    def probe(self, keys: np.ndarray) -> np.ndarray:
        h = mix(np.asarray(keys, np.uint64) ^ _U((self.seed * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1)))
        a, b, c = self._places(h, self.segment, self.count)
        return self.cells[a] ^ self.cells[b] ^ self.cells[c] == self._mark(h)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], "<i8").tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse8:
        seed, segment, count = np.frombuffer(data, "<i8", 3)
        return cls(int(seed), int(segment), int(count), np.frombuffer(data, np.uint8, offset=24))
