"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Text that compresses far better than prose of its length repeats itself; text that compresses far worse is
random or encoded. What prose reaches depends on the length, so the limits do too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termweave.llm import shared, wordhash

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunk_min double, chunk_max double"
)
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size. ``whole``: (up to so many bytes, least, most); chunks are cut every
    ``chunk`` bytes, and a last one under half that size is judged with the whole text only."""

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.50, 1.10),
        (256, 0.45, 1.05),
        (512, 0.40, 0.88),
        (1024, 0.33, 0.80),
        (4096, 0.28, 0.70),
        (16384, 0.25, 0.62),
        (float("inf"), 0.22, 0.58),
    )
    chunk: int = 4096
    chunk_least: float = 0.22
    chunk_most: float = 0.66
    bad_chunks: float = 0.25
    level: int = 3


def verdicts(ratio: float, chunks: list[float], size: int, bands: Bands) -> bool:
    """True if the whole ratio lies in the band of its length and under ``bad_chunks`` of the chunks miss theirs."""
    least, most = next((low, high) for top, low, high in bands.whole if size <= top)
    if not least <= ratio <= most:
        return False
    bad = sum(not bands.chunk_least <= c <= bands.chunk_most for c in chunks)
    return bad <= bands.bad_chunks * len(chunks)


def _repeat_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text in windows of WINDOW words that the text holds twice or more."""
    keys, at, text = wordhash.windows(hashes, counts, WINDOW)
    if not len(keys):
        return np.zeros(len(counts), np.int64)
    keys = wordhash.mix(keys + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def score(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
    size_of = lambda b: len(packer.compress(b)) / len(b)
    for batch in shared.steps(batches, 1):
        hashes, counts = wordhash.words_of(batch.column(1), lower=False)
        repeats = _repeat_words(hashes, counts)
        rows = []
        for doc, value, n, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), counts.tolist(), repeats.tolist(), strict=True):
            data = (value or "").encode()
            blanks = len(data) - len(data.translate(None, BLANKS))
            lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
            failed = n < 20 or 100 * again > 30 * n
            whole = size_of(data) if data else 0.0
            chunks = [size_of(data[i : i + bands.chunk]) for i in range(0, len(data), bands.chunk) if len(data) - i >= bands.chunk // 2] if len(data) > bands.chunk else []
            kept = not failed and verdicts(whole, chunks, len(data), bands)
            rows.append((doc, n, len(value or "") - blanks, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), again, failed, kept, whole, min(chunks, default=whole), max(chunks, default=whole)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 3, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def compression_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Base counts and the compression verdict of every whole text; one row for each row of ``docs``.

    Null and empty texts count no words and fail; repeated rows give repeated results; extra columns are ignored.
    A narrow map without any shuffle, so skewed sources or ids cost nothing; memory follows the longest text.
    """
    return shared.texts(docs, id_col, text_col).mapInArrow(lambda it: score(it, bands), SCHEMA)
