"""Language identification with a blended-spectrum string kernel.

A text is the set of its hashed character n-grams of several lengths (presence, not counts). The kernel of two
texts is the size of the intersection of these sets over the geometric mean of their sizes. Nyström landmarks
turn the kernel into a finite feature map, kernel ridge regression fits one regressor for each language against
the rest, and texts are scored in batches by two matrix products: presence x landmarks, kernel x weights.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm import shared

UNDETERMINED = "und"


@dataclass(frozen=True)
class KernelParams:
    """``bits``: buckets of the n-grams of length 1, 2, 3 as powers of two. ``per_language`` bounds the training sample."""

    bits: tuple[int, ...] = (10, 12, 14)
    per_language: int = 400
    landmarks: int = 128
    ridge: float = 1e-3
    step_chars: int = 1 << 20
    batch: int = 64


@dataclass(frozen=True)
class KernelModel:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # buckets x landmarks, 0 or 1
    sizes: np.ndarray  # of each landmark's set
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    params: KernelParams


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def presence(text: str | None, params: KernelParams, out: np.ndarray) -> bool:
    """Sets out's buckets of the text's n-grams to 1; False if the text has no letter. Works in steps of
    ``step_chars`` characters that overlap by n - 1, so memory is bounded and no n-gram is lost."""
    if not text:
        return False
    any_letter = False
    overlap = len(params.bits) - 1
    for at in range(0, len(text), params.step_chars):
        part = text[max(0, at - overlap) : at + params.step_chars].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[code]
        any_letter |= bool(letter.any())
        code = np.where(letter, code, np.uint32(32))
        code = code[np.concatenate([[True], letter[1:] | letter[:-1]])]  # one blank between words
        gram = np.zeros(len(code), np.uint32)
        base = 0
        for n, bits in enumerate(params.bits, start=1):
            gram = gram[: len(code) - n + 1] * np.uint32(0x01000193) + (code[n - 1 :] + np.uint32(0x9E37)) * np.uint32(0x85EBCA6B)
            key = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out[base + (key >> np.uint32(32 - bits))] = 1
            base += 1 << bits
    return any_letter


def buckets(params: KernelParams) -> int:
    return sum(1 << b for b in params.bits)


def kernel(x: np.ndarray, sizes: np.ndarray, landmarks: np.ndarray, landmark_sizes: np.ndarray) -> np.ndarray:
    return (x @ landmarks) / np.sqrt(np.maximum(1, np.outer(sizes, landmark_sizes)))


def fit(rows: list[tuple[str, bytes]], params: KernelParams) -> KernelModel:
    """``rows``: language and packed presence bits, in a fixed order."""
    names = tuple(sorted({lang for lang, _ in rows}))
    x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8))[: buckets(params)] for _, b in rows]).astype(np.float32)
    sizes = x.sum(1)
    number = np.array([names.index(lang) for lang, _ in rows])
    turn = np.zeros(len(rows), int)  # landmarks take turns between the languages
    for k in range(len(names)):
        turn[number == k] = np.arange((number == k).sum())
    chosen = np.lexsort((number, turn))[: params.landmarks]
    marks = np.ascontiguousarray(x[chosen].T)
    inner = kernel(x[chosen], sizes[chosen], marks, sizes[chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel(x, sizes, marks, sizes[chosen]).astype(np.float64) @ root
    y = np.where(number[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = np.array([(number == k).mean() for k in range(len(names))])
    weight = (1 / (len(names) * share))[number]  # every language weighs the same
    mean_z, mean_y = np.average(z, 0, weight), np.average(y, 0, weight)
    zc, yc = z - mean_z, y - mean_y
    w = np.linalg.solve((zc * weight[:, None]).T @ zc + params.ridge * len(rows) * np.eye(z.shape[1]), (zc * weight[:, None]).T @ yc)
    return KernelModel(names, marks, sizes[chosen], (root @ w).astype(np.float32), (mean_y - mean_z @ w).astype(np.float32), params)


def train(labelled: DataFrame, params: KernelParams = KernelParams(), text_col: str = "text", lang_col: str = "lang") -> KernelModel:
    """Learns from a bounded sample of ``labelled``: of each language the different texts whose hash comes first.

    Rows with null language, or text without letters, teach nothing. A text of very many copies counts once a language,
    and each language is cut to ``per_language`` texts on the executors, so only that many packed n-gram sets of a language
    reach the driver (a few KB each), never texts.
    """
    data = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    spread = 1 << 40
    place = F.xxhash64("text").bitwiseAND(spread - 1)
    data = data.withColumn("place", place)
    counts = data.groupBy("lang").agg(F.approx_count_distinct("place").alias("count")).collect()  # one row a language
    # twice the texts wanted on average, then exactly the first per_language of them
    limit = F.lit(0).cast("long")
    for rows in itertools.batched(counts, 64):
        found = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(spread, int(spread * 2 * params.per_language / max(1, r["count"])) + 1))) for r in rows])
        limit = F.coalesce(found, limit)
    few = data.where(F.col("place") < limit).groupBy("lang", "place").agg(F.first("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    sample = few.withColumn("turn", first).where(F.col("turn") <= params.per_language).select("text", "lang", "place")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.steps(batches, 0):
            rows = []
            for text, lang, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out = np.zeros(buckets(params), np.uint8)
                if presence(text, params, out):
                    rows.append((lang, at, np.packbits(out).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["lang", "place", "bits"])

    packed = sample.mapInArrow(pack, "lang string, place long, bits binary")
    found = sorted(((r["lang"], r["place"], bytes(r["bits"])) for r in packed.toLocalIterator()))
    rows = [(lang, bits) for lang, _, bits in found]
    return fit(rows, params) if rows else KernelModel((), np.zeros((buckets(params), 0), np.float32), np.zeros(0), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), params)


def predict(docs: DataFrame, model: KernelModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added; every row is kept, in a narrow map that moves no text between tasks.

    A null text or one without any letter is ``und`` with score 0, and so is every text if nothing was learned.
    score is the winning regressor's value mapped from [-1, 1] to [0, 1]. Ties go to the first language by name.
    Columns of ``docs`` called lang_pred or score are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    own = text_col in keep and dict(docs.dtypes)[text_col] == "string"  # then the kept column is the text, which crosses once
    place = keep.index(text_col) if own else len(keep)
    data = docs.select(*[docs[c] for c in keep], *([] if own else [F.col(text_col).cast("string").alias("__text")]))
    params = model.params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros((params.batch, buckets(params)), np.float32)
        for batch in shared.steps(batches, place):
            values = batch.column(place).to_pylist()
            names: list[str] = []
            scores: list[float] = []
            for at in range(0, len(values), params.batch):
                part = values[at : at + params.batch]
                x[:] = 0
                known = [presence(v, params, x[i]) for i, v in enumerate(part)]
                if model.languages:
                    k = kernel(x[: len(part)], x[: len(part)].sum(1), model.landmarks, model.sizes).astype(np.float32)
                    s = k @ model.weights + model.bias
                    best = s.argmax(1)
                    top = np.clip((s[np.arange(len(part)), best] + 1) / 2, 0, 1)
                for i, ok in enumerate(known):
                    ok = ok and bool(model.languages)
                    names.append(model.languages[best[i]] if ok else UNDETERMINED)
                    scores.append(round(float(top[i]), 6) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[docs[c] for c in keep]).schema.fields)
    return data.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """The rows that a model may not learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
