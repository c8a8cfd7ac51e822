"""Benchmark decontamination by latent semantic retrieval.

Passages (overlapping word windows of documents) and benchmark items are TF-IDF vectors over hashed words. A
randomised SVD of all passages and items, computed in partial sums on the executors, gives a latent basis; passages whose latent cosine to an
item reaches a threshold are candidates, and so are all passages that hold as many of an item's words as a leak
needs, found exactly by the item's rarest words, however frequent those are. A candidate counts as a leak if the longest
common subsequence of words covers most of the item, or a good part of it and the item's most telling words (the
answer) as well. So no leak by that rule is lost to the threshold or the basis.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import shared, wordhash


@dataclass(frozen=True)
class Leaks:
    """``half``: words of a half passage; passages are two halves and start at every half. The basis is fitted on all
    documents and items, added up in ``sketch_rows`` rows of each (twice ``rank`` and ``oversample``); the items' Gram matrix
    weighs ``item_weight`` times the documents'. Items of under ``least_words`` words are looked for as whole word sequences, those
    of under ``line_words`` as whole lines."""

    bits: int = 15
    half: int = 32
    rank: int = 256
    oversample: int = 16
    block_items: int = 1024
    cosine: float = 0.45
    verbatim: float = 0.7
    paraphrase: float = 0.55
    answer_words: int = 5
    answer_share: float = 0.4
    least_words: int = 8
    scan_blocks: int = 8
    line_words: int = 4
    item_weight: float = 16.0

    @property
    def sketch_rows(self) -> int:
        return 2 * (self.rank + self.oversample)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return wordhash.words_of(column, separators=wordhash.PUNCTUATION)


def _halves(counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every half passage, and the first half passage of every text (one more at the end)."""
    per = -(-counts // half)
    first = np.concatenate([[0], np.cumsum(per)])
    ends = np.cumsum(counts)
    starts = np.repeat(ends - counts - first[:-1] * half, per) + np.arange(first[-1]) * half
    return starts, first


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


#: Buckets of the frequencies that are added up together.
CHUNK = 1024


def _signs(hashes: np.ndarray, starts: np.ndarray, first: np.ndarray, names: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and sign of every passage, by its words, its text's id and its place, so however the table is partitioned."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = wordhash.mix(names[text].view(np.uint64)) + (np.arange(len(starts)) - first[text]).astype(np.uint64)
    key = wordhash.mix(np.add.reduceat(hashes, starts) + wordhash.mix(place))
    return ((key >> np.uint64(8)) % np.uint64(rows)).astype(np.int64), 1 - 2 * (key & np.uint64(1)).astype(np.int32)


def statistics(data: DataFrame, p: Leaks) -> tuple[np.ndarray, int, np.ndarray]:
    """In how many passages (of two halves, side by side) each bucket occurs, the passages, and their sketch, over all texts.

    The sketch S C (rows x buckets) adds every passage's word counts C to one of ``sketch_rows`` rows, with a sign of its
    own; on average its Gram matrix is that of all passages. Whole numbers, so the order of the sums does not matter.
    """
    size, rows, index = 1 << p.bits, p.sketch_rows, np.dtype("<u2" if p.bits <= 16 else "<u4")
    schema = "part long, at binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sketch, passages = np.zeros(size, np.int64), np.zeros((rows, size), np.int32), 0
        for batch in shared.steps(batches, 1):
            hashes, counts = _words(batch.column(1))
            starts, first = _halves(counts, 2 * p.half)
            if len(starts):
                number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
                both = (number << p.bits) + _bucket(hashes, p.bits)
                both, times = np.unique(both.astype(np.int32) if len(starts) < 1 << (31 - p.bits) else both, return_counts=True)
                bucket, number = both & (size - 1), both >> p.bits
                total += np.bincount(bucket, minlength=size)
                row, sign = _signs(hashes, starts, first, batch.column(0).fill_null(0).to_numpy(), rows)
                np.add.at(sketch.reshape(-1), (row[number] << p.bits) + bucket, sign[number] * times.astype(np.int32))
                passages += len(starts)
        if not passages:
            return
        parts = [(-1, [0], [passages])]
        parts += [(-2 - c // CHUNK, at, total[c + at]) for c in range(0, size, CHUNK) if len(at := np.flatnonzero(total[c : c + CHUNK]))]
        parts += [(r, at, sketch[r, at]) for r in range(rows) if len(at := np.flatnonzero(sketch[r]))]
        for k in range(0, len(parts), 64):
            some = [(r, np.asarray(at, index).tobytes(), np.asarray(n, "<i4").tobytes()) for r, at, n in parts[k : k + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), [pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["part", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            total[np.frombuffer(at, index)] += np.frombuffer(n, "<i4")
        at = np.flatnonzero(total)
        return pa.table({"part": table.column("part")[:1], "at": pa.array([at.astype(index).tobytes()]), "n": pa.array([total[at].tobytes()])})

    df, n, sketch = np.zeros(size, np.int64), 0, np.zeros((rows, size), np.float32)
    for r in data.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).toLocalIterator():
        at, values = np.frombuffer(r["at"], index).astype(np.int64), np.frombuffer(r["n"], np.int64)
        if r["part"] == -1:
            n = int(values[0])
        elif r["part"] < 0:
            df[at + (-2 - r["part"]) * CHUNK] = values
        else:
            sketch[r["part"], at] = values
    return df, n, sketch


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """IDF of each bucket: frequent buckets weigh little, but none weighs nothing."""
    return (np.log((n + 1) / (df + 1)) + 1e-6).astype(np.float32)


def _sums(hashes: np.ndarray, starts: np.ndarray, told: np.ndarray, table: np.ndarray, bits: int, rows: int = 256) -> np.ndarray:
    """Sums over each half passage of ``table``'s rows (each times its bucket's weight already, and a row of zeros at the
    end) of the buckets in ``told``. Words are put side by side, so that one addition serves ``rows`` half passages."""
    out = np.zeros((len(starts), table.shape[1]), np.float32)
    bounds = np.append(starts, len(hashes))
    bucket = _bucket(hashes, bits)
    cell = np.where(told[bucket], bucket, 1 << bits)
    for at in range(0, len(starts), rows):
        edge = bounds[at : at + rows + 1]
        lengths = np.diff(edge)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        grid = np.full((len(lengths), int(lengths.max())), 1 << bits)
        grid[owner, np.arange(edge[0], edge[-1]) - edge[owner]] = cell[edge[0] : edge[-1]]
        grid.sort(axis=1)
        for k in range(int((grid < 1 << bits).sum(1).max())):
            out[at : at + rows] += table[grid[:, k]]
    return out


def _with_zeros(table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(table) + 1, table.shape[1]), np.float32)
    out[:-1] = table
    return out


def _passages(halves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of neighbouring halves of one text, and the number of each passage's first half."""
    n = len(halves)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = np.zeros(n, bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    alone = last & np.append(True, last[:-1])[:n] if n else last
    out = halves.copy()
    with_next = np.flatnonzero(~last)
    out[with_next] += halves[with_next + 1]
    keep = np.flatnonzero(~last | alone)  # a last half is inside the passage before it
    del text
    return out[keep], keep


def fit_basis(docs: np.ndarray, items: np.ndarray, idf: np.ndarray, p: Leaks) -> np.ndarray:
    """Right singular vectors (buckets x rank) of all passages and items, of their sketches (see ``statistics``).

    Items weigh ``item_weight`` times as much as the documents, so that the latent space tells them apart. Directions that are none become zeros.
    """
    rows, cols = len(docs) + len(items), docs.shape[1]
    both = lambda k: np.concatenate([docs[:, k : k + 4096], items[:, k : k + 4096]]) * idf[k : k + 4096]
    gram = np.zeros((rows, rows))
    for k in range(0, cols, 4096):
        part = both(k)
        gram += part @ part.T
    size, own = (float(np.linalg.norm(g)) for g in (gram[: len(docs), : len(docs)], gram[len(docs) :, len(docs) :]))
    weight = np.ones(rows)
    weight[len(docs) :] = np.sqrt(p.item_weight * size / own) if size and own else 1.0
    values, vectors = np.linalg.eigh(gram * np.outer(weight, weight))
    values, vectors = values[::-1][: p.rank], vectors[:, ::-1][:, : p.rank]
    turn = np.where(values > 1e-6 * max(values.max(), 1e-30), vectors / np.sqrt(np.maximum(values, 1e-30)), 0) * weight[:, None]
    out, turn = np.empty((cols, p.rank), np.float32), turn.astype(np.float32)
    for k in range(0, cols, 4096):
        out[k : k + 4096] = both(k).T @ turn
    del part
    shared.release()
    return out


def common_words(item: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``item`` maps a word to the bits of its places (bit-parallel)."""
    row = full = (1 << size) - 1
    for w in words:
        if (mask := item.get(w)) is not None:
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


#: Rare words of an item that a passage must hold before it is looked at (fewer if a leak needs no more words).
TOGETHER = 5


@dataclass(frozen=True)
class Rare:
    """Words of a block of items, and for each word the items that it gives candidates for (``items`` from ``first``)."""

    words: np.ndarray  # sorted hashes
    first: np.ndarray
    items: np.ndarray
    holds: np.ndarray  # items x words, and a column of False for all other words
    least: np.ndarray  # different words that a leak of the item shares with it at least
    together: np.ndarray  # of them, those among the words that give candidates
    reach: np.ndarray  # words around a passage that are looked at


def rare_words(items: list[np.ndarray], idf: np.ndarray, p: Leaks) -> Rare:
    """A leak shares at least m of an item's u different words, so t of any u - m + t of them; the rarest are taken."""
    vocabulary = np.unique(np.concatenate(items))
    holds = np.zeros((len(items), len(vocabulary) + 1), bool)
    least, together, pairs = [], [], []
    for i, places in enumerate(items):
        words = np.unique(places)
        m = int(np.ceil(min(p.paraphrase, p.verbatim) * len(places) - 1e-9)) - (len(places) - len(words))  # repeats may all be shared
        least.append(max(1, m))
        together.append(min(TOGETHER, least[i]))
        cell = np.searchsorted(vocabulary, words)
        holds[i, cell] = True
        rarest = cell[np.argsort(-idf[_bucket(words, p.bits)], kind="stable")[: len(words) - least[i] + together[i]]]
        pairs.append(np.stack([rarest, np.full(len(rarest), i)]))
    cell, item = np.concatenate(pairs, axis=1)
    order = np.argsort(cell, kind="stable")
    first = np.searchsorted(cell[order], np.arange(len(vocabulary) + 2))  # the column of other words has no items
    return Rare(vocabulary, first, item[order], holds, np.array(least), np.array(together), np.maximum(p.half, [len(x) for x in items]))


def shared_words(hashes: np.ndarray, counts: np.ndarray, starts: np.ndarray, first: np.ndarray, rare: Rare, p: Leaks) -> tuple[np.ndarray, np.ndarray]:
    """(half passage, item) of all passages that, with the words around them, hold ``least`` different words of the item."""
    cell = np.searchsorted(rare.words, hashes)
    cell[rare.words[np.minimum(cell, len(rare.words) - 1)] != hashes] = len(rare.words)
    many = rare.first[cell + 1] - rare.first[cell]
    ends = np.cumsum(counts)
    places = np.flatnonzero(many)
    total = np.cumsum(many)
    cuts = np.arange(1 << 18, int(total[-1]) if len(total) else 0, 1 << 18)
    cuts = np.unique(ends[np.searchsorted(ends, np.searchsorted(total, cuts), "right")]) if len(cuts) else cuts  # between texts
    keys = [np.zeros(0, np.int64)]

    def enough(item: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.zeros(len(item), bool)
        width = int((stop - begin).max(initial=1))
        size = max(1, (1 << 20) // width)
        for k in range(0, len(item), size):
            i, a, b = item[k : k + size], begin[k : k + size], stop[k : k + size]
            grid = a[:, None] + np.arange(width)
            own = cell[np.minimum(grid, len(cell) - 1)]
            own[~rare.holds[i[:, None], own] | (grid >= b[:, None])] = -1
            own.sort(axis=1)
            out[k : k + size] = (np.diff(own, axis=1, prepend=-1) > 0).sum(1) >= rare.least[i]
        return out

    for some in np.split(places, np.searchsorted(places, cuts)):
        n = many[some]
        at = np.repeat(some, n)
        item = rare.items[np.repeat(rare.first[cell[some]] - np.cumsum(n) + n, n) + np.arange(len(at))]
        doc = np.searchsorted(ends, at, "right")
        reach = rare.reach[item]
        order = np.lexsort((at, doc, item))
        at, item, doc, reach = at[order], item[order], doc[order], reach[order]
        close = np.zeros(len(at) + 1, np.int64)  # +1 and -1 where a row of close places of one item begins and ends
        t = rare.together[item]
        other = np.arange(len(at)) + t - 1
        begin = np.flatnonzero(other < len(at))
        other = other[begin]
        k = (item[other] == item[begin]) & (doc[other] == doc[begin]) & (at[other] - at[begin] < 2 * (p.half + reach[begin]))
        begin, other = begin[k], other[k]
        np.add.at(close, begin, 1)
        np.add.at(close, other + 1, -1)
        wide = np.cumsum(close)[:-1] > 0
        at, item, doc, reach = at[wide], item[wide], doc[wide], reach[wide]
        at -= (ends - counts)[doc]
        low = first[doc] + np.maximum(0, (at - 2 * p.half - reach) // p.half + 1)
        last = np.maximum(first[doc], first[doc + 1] - 2)  # a last half is inside the passage before it
        span = np.maximum(np.minimum(last, first[doc] + (at + reach) // p.half) - low + 1, 0)
        h = np.repeat(low - np.cumsum(span) + span, span) + np.arange(int(span.sum()))
        keys.append(np.unique(h * len(rare.least) + np.repeat(item, span)))
    key = np.unique(np.concatenate(keys))
    h, item = key // len(rare.least), key % len(rare.least)
    doc = np.searchsorted(first, h, "right") - 1
    good = enough(item, np.maximum((ends - counts)[doc], starts[h] - rare.reach[item]), np.minimum(ends[doc], starts[h] + 2 * p.half + rare.reach[item]))
    return h[good], item[good]


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: Leaks = Leaks(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words), answer (share of its telling words), kind.

    One row for each document and item found in it, the best passage's values; repeated rows of a document repeat.
    Null or empty texts hold nothing. Items of under ``least_words`` words leak where their whole word sequence stands
    in a text (kind ``short``; of under ``line_words`` words: where it is all of a line's words). An item without words is
    in no text. One basis, fitted on all documents and items, serves all items. They go out in blocks of ``block_items``, ``scan_blocks`` of them for each
    scan of the corpus, so what is sent to the executors is bounded whatever the benchmark's size; documents are scored
    in a narrow map, without any shuffle of texts. Extra columns are ignored.
    """
    spark = docs.sparkSession
    data = shared.texts(docs, id_col, text_col).where("text is not null")
    df, n, sketch = statistics(data, p)
    idf = weights(df, n)
    out: DataFrame | None = None
    source = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    long, short, ready = [], [], []
    basis = None

    def scan() -> DataFrame:
        held = spark.sparkContext.broadcast((basis, idf > 0, list(ready), Short.of(short, p)))
        ready.clear()
        short.clear()
        return data.mapInArrow(lambda it: _scan(it, held.value, p), FOUND)

    def close() -> None:
        nonlocal basis, sketch
        if basis is None:
            basis = fit_basis(sketch, statistics(shared.texts(source, "item_id"), p)[2], idf, p)
            sketch = None  # the driver's largest array
            basis *= idf[:, None]
            basis = _with_zeros(basis)
        ready.append(Block.of(long, basis, idf, p))
        long.clear()

    for row in source.toLocalIterator():  # one block at a time
        words = _words(pa.array([row["text"]]))[0]
        if len(words):
            (long if len(words) >= p.least_words else short).append((row["item_id"], words))
        if len(long) == p.block_items:
            close()
        if len(ready) == p.scan_blocks or len(short) == p.scan_blocks * p.block_items:
            out = scan() if out is None else out.unionByName(scan())
    if long:
        close()
    if ready or short:
        out = scan() if out is None else out.unionByName(scan())
    return spark.createDataFrame([], FOUND) if out is None else out


FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double, kind string"


@dataclass(frozen=True)
class Block:
    """A block of items as the executors need it."""

    names: list[int]
    vectors: np.ndarray
    masks: list[dict[int, int]]
    answers: list[frozenset[int]]
    sizes: list[int]
    rare: Rare

    @staticmethod
    def of(rows: list[tuple[int, np.ndarray]], basis: np.ndarray, idf: np.ndarray, p: Leaks) -> Block:
        items = [w for _, w in rows]
        vectors = np.stack([basis[_bucket(words, p.bits)].sum(0) for words in items])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        masks, answers = [], []
        for words in items:
            where: dict[int, int] = {}
            for k, w in enumerate(words.tolist()):
                where[w] = where.get(w, 0) | 1 << k
            masks.append(where)
            telling = sorted(set(words.tolist()), key=lambda w: (-float(idf[w >> (64 - p.bits)]), w))
            answers.append(frozenset(telling[: p.answer_words]))
        return Block([i for i, _ in rows], vectors, masks, answers, [len(x) for x in items], rare_words(items, idf, p))


@dataclass(frozen=True)
class Short:
    """Fingerprints of short items by their number of words: sorted, with the items' ids."""

    keys: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int, np.ndarray]], p: Leaks) -> Short:
        out = {}
        for n in sorted({len(w) for _, w in rows}):
            some = [(int(wordhash.windows(w, np.array([n]), n)[0][0]), i) for i, w in rows if len(w) == n]
            keys, ids = np.array([k for k, _ in some], np.uint64), np.array([-(1 << 63) if i is None else i for _, i in some], np.int64)
            order = np.argsort(keys, kind="stable")
            out[n] = keys[order], ids[order]
        return Short(out)

    def found(self, column: pa.Array, p: Leaks) -> set[tuple[int, int]]:
        """(text's number, item) of all short items in the texts of a column."""
        hits: set[tuple[int, int]] = set()
        if not self.keys:
            return hits
        data, bounds = wordhash.joined(column)
        starts, _, counts = wordhash.word_spans(data, bounds, wordhash.PUNCTUATION)
        hashes, _ = _words(column)
        text = np.repeat(np.arange(len(counts)), counts)
        line = np.searchsorted(np.flatnonzero(data == 10), starts) + text  # words of one line share a number
        line = np.concatenate([[-1], line, [-1]])
        for n, (keys, ids) in self.keys.items():
            windows, at, text = wordhash.windows(hashes, counts, n)
            if not len(windows):
                continue
            low, high = np.searchsorted(keys, windows, "left"), np.searchsorted(keys, windows, "right")
            good = high > low
            if n < p.line_words:  # at is the number of the first word, which is place at + 1 of line
                good &= (line[at + 1] == line[at + n]) & (line[at] != line[at + 1]) & (line[at + n + 1] != line[at + n])
            for k in np.flatnonzero(good).tolist():
                hits |= {(int(text[k]), i) for i in ids[low[k] : high[k]].tolist()}
        return hits


def _scan(batches: Iterator[pa.RecordBatch], held: tuple, p: Leaks) -> Iterator[pa.RecordBatch]:
    basis, told, blocks, short = held
    for batch in shared.steps(batches, 1):
        hits = sorted(short.found(batch.column(1), p))
        ids = batch.column(0)
        if hits:
            names = [None if i == -(1 << 63) else i for _, i in hits]
            ones = pa.array([1.0] * len(hits))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([d for d, _ in hits])), pa.array(names, pa.int64()), ones, ones, ones, pa.array(["short"] * len(hits))], names=[x.split()[0] for x in FOUND.split(", ")])
        hashes, counts = _words(batch.column(1))
        starts, first = _halves(counts, p.half)
        if not len(starts) or not blocks:
            continue
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), np.diff(first))
        sure = [shared_words(hashes, counts, starts, first, x.rare, p) for x in blocks]
        best: dict[tuple[int, int, int], tuple] = {}
        looked: dict[tuple[int, int, int], int] = {}
        for low in range(0, len(starts), 4096):  # halves at a time, one more for the overlap
            high = min(low + 4096, len(starts))
            reach = min(high + 1, len(starts))
            stop = starts[reach] if reach < len(starts) else len(hashes)
            part = _sums(hashes[starts[low] : stop], starts[low:reach] - starts[low], told, basis, p.bits)
            inside = np.clip(first - low, 0, reach - low)
            inside = np.unique(np.concatenate([[0], inside, [reach - low]]))
            passages, at = _passages(part, inside)
            good = at < high - low
            passages, at = passages[good], at[good]
            passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-9)
            for b, (block, (half, item)) in enumerate(zip(blocks, sure, strict=True)):
                cosines = passages @ block.vectors.T
                exact = np.zeros(cosines.shape, bool)
                mine = slice(*np.searchsorted(half, [low, high]))
                exact[np.searchsorted(at, half[mine] - low), item[mine]] = True
                for r, i in zip(*np.nonzero(exact | (cosines >= p.cosine)), strict=True):
                    h = low + int(at[r])
                    doc = int(owner[h])
                    key = doc, b, int(i)
                    old = best.get(key)
                    # words around a passage are looked at as well, so of two neighbours one is enough if neither must be looked at
                    if not exact[r, i] and looked.get(key) == h - 1 or old and old[1] >= 1.0:
                        continue
                    looked[key] = h
                    size = block.sizes[i]
                    begin = max(int(ends[doc] - counts[doc]), int(starts[h]) - max(p.half, size))
                    end = min(int(ends[doc]), int(starts[h]) + 2 * p.half + max(p.half, size))
                    words = hashes[begin:end].tolist()
                    lcs = common_words(block.masks[i], size, words) / size
                    if lcs < p.paraphrase or old and old[1] >= lcs:
                        continue
                    answer = len(block.answers[i].intersection(words)) / len(block.answers[i])
                    if lcs >= p.verbatim or answer >= p.answer_share:
                        best[key] = (float(cosines[r, i]), lcs, answer, "verbatim" if lcs >= p.verbatim else "paraphrase")
        if best:
            docs = ids.to_pylist()
            rows = [(docs[d], blocks[b].names[i], round(c, 6), x, t, kind) for (d, b, i), (c, x, t, kind) in sorted(best.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.string()], strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])
