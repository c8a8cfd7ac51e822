"""Vectorised words and fingerprints over the byte buffer of many texts at once.

A word is a maximal run of bytes other than space and tab..carriage return, which for UTF-8 equals the code
point pattern ``[^\\x20\\x09-\\x0D]+``. A word's fingerprint is a polynomial over random byte values modulo
2^64, finished by a mixing step; equal words always get equal fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240611)
BYTE_VALUES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * U64(2) + U64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: Also all ASCII punctuation: what stays are letters, digits and every character beyond ASCII.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    base = BASES[which]
    if inverse:
        base = pow(base, -1, 1 << 64)
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


#: The longest powers made so far, one array of each kind; those of very long texts are not kept.
_kept: dict[tuple[int, bool], np.ndarray] = {}
KEPT = 5 << 18


def powers(which: int, inverse: bool, n: int) -> np.ndarray:
    if n > KEPT:
        return _powers(which, inverse, n)
    found = _kept.get((which, inverse))
    if found is None or len(found) < n:
        found = _kept[which, inverse] = _powers(which, inverse, min(KEPT, max(1 << 16, n + n // 4)))
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """P with P[j] - P[i] = sum of value(byte k) * base^k over i <= k < j."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUES[which][data] * powers(which, False, max(1, len(data)))[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    shift = powers(which, True, len(sums))[starts]
    return mix((sums[ends] - sums[starts]) * shift + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, one after the other, and the bounds of each (null: empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each text; words never cross a bound."""
    word = ~separators[data]
    before = np.empty_like(word)
    after = np.empty_like(word)
    if len(word):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = word[:-1], word[1:]
        before[bounds[:-1][bounds[:-1] < len(word)]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def words_of(column: pa.Array, lower: bool = True, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a column in order, and the number of words of each text.

    Memory is about 60 bytes for each byte of text in ``column``; callers cut columns by shared.steps.
    """
    data, bounds = joined(column)
    starts, ends, counts = word_spans(data, bounds, separators)
    return span_hashes(prefix_sums(ASCII_LOWER[data] if lower else data), starts, ends), counts


def windows(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first word's number and text's number of every window of ``n`` words inside one text."""
    text = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = len(hashes) - n + 1
    at = np.flatnonzero(text[:last] == text[n - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * U64(0x9FB21C651E98DF25) + hashes[at + k]
    return mix(out), at, text[at]
