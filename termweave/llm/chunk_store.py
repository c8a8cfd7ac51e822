"""Ids of text chunks, each distinct chunk encoded once by a Python worker while there is room."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and how many each list has."""
    return np.fromiter(itertools.chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))


def merged(kind: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes in the order of the keys; ``kind`` has each key's place in ``parts``, which hold theirs."""
    sizes = np.zeros(len(kind), np.int64)
    for k, (_, own) in enumerate(parts):
        sizes[kind == k] = own
    ids = np.zeros(int(sizes.sum()), np.int32)
    of = np.repeat(kind, sizes)
    for k, (some, _) in enumerate(parts):
        ids[of == k] = some
    return ids, sizes


def ranges(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of ``sizes`` numbers from ``start``, one range after the other."""
    index = np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
    index += np.arange(len(index))
    return index


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n values; grows by halves, so that it's seldom copied."""
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, len(x) + len(x) // 2) - len(x), x.dtype)])


class ChunkStore:
    """Keys are words that stand after one blank, or a blank and a chunk to be taken literally.

    ``encode`` gets keys that are not known and returns all their ids one after the other, and for each key how many it
    has and a flag. Up to ``limit`` keys
    are kept, the earliest ones, which in running text are the frequent ones; later ones are encoded once a batch.
    """

    STEP = 4096

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, list[bool]]], limit: int = 650_000):
        self.encode, self.limit = encode, limit
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.flags = np.zeros(0, bool)

    def lookup(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after the other, the number of ids of each text (a list of keys), and whether all its flags hold."""
        every = list(itertools.chain.from_iterable(cut))
        number = np.fromiter(map(self.known.get, every, itertools.repeat(-1)), np.int64, len(every))
        miss = np.flatnonzero(number < 0)
        if len(miss):
            fresh: dict[str, int] = {}
            base = len(self.known)
            number[miss] = [base + fresh.setdefault(every[i], len(fresh)) for i in miss.tolist()]
            keys, used = list(fresh), int(self.at[base])
            self.at, self.flags = _grown(self.at, base + len(keys) + 1), _grown(self.flags, base + len(keys))
            for i in range(0, len(keys), self.STEP):  # the library's own results are large
                ids, own, good = self.encode(keys[i : i + self.STEP])
                low, high = base + i, base + i + len(own)
                self.at[low + 1 : high + 1], self.flags[low:high] = used + np.cumsum(own), good
                self.flat = _grown(self.flat, used + len(ids))
                self.flat[used : used + len(ids)] = ids
                used += len(ids)
            if base < self.limit:  # else the next ones take their place
                for key, k in fresh.items():
                    self.known[key] = base + k
        start = self.at[number]
        sizes = self.at[number + 1] - start
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        until = np.concatenate([[0], np.cumsum(sizes)])
        wrong = np.concatenate([[0], np.cumsum(~self.flags[number])])
        return self.flat[ranges(start, sizes)], np.diff(until[bounds]), np.diff(wrong[bounds]) == 0
