"""Suffix-array dedup by prefix-free parsing: removes every byte of long strings that occur more than once.

Parsing. A rolling hash of TRIGGER bytes is taken at every byte; the smallest of any ``reach`` neighbouring hashes is
a cut. Cuts depend on nearby bytes only, so equal strings are cut alike away from their ends, and phrases (from cut to
cut) never are longer than ``reach``. Every window of ``length`` bytes has as its anchor the first cut at least
``reach`` bytes after its start: equal windows have equal anchors at equal distances.

Order. A window is a suffix of the phrases before its anchor followed by a prefix of the parse after it. Two windows
are equal when both parts are, so the suffix arrays of the dictionary and of the parse are needed only to a depth of
``length`` bytes, and only as classes of equal rank: fingerprints name the classes. What follows is done on the
parse, not on bytes:
1. each cut gets the class of the bytes that all windows with this anchor share (``core``) and of all that any of them
   can hold (``full``); cuts whose core occurs once are done with: no window there is repeated;
2. cuts whose full string occurs again are covered at once;
3. of the rest, the borders of repeated strings, each window's own class decides.

Classes are counted first inside a task. Of a class that a task holds several times only one entry leaves it, so a
passage or copy of a third of all documents puts one entry for each task, not each document, into its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import shared, wordhash

TRIGGER = 8
U64 = np.uint64
COVERED, WINDOWS = 0, 1  # what a mark says about a cut
PLAIN, SEVERAL, MIXED = 0, 1, 2  # what an entry stands for: one cut; equal cuts; cuts of one core in unlike places
CUT = np.dtype([("core", "<u8"), ("full", "<u8"), ("doc", "<i8"), ("own", "<i4"), ("pos", "<i4"), ("gap", "u1"), ("kind", "u1")])
MARKS = "bucket int, doc long, own int, start int, extra int, kind int, entries binary"
MARK_NAMES = [x.split()[0] for x in MARKS.split(", ")]


@dataclass(frozen=True)
class Repeats:
    length: int = 400
    reach: int = 96

    def __post_init__(self):
        if 3 * self.reach > self.length - TRIGGER + 2 or self.reach > 255 or self.reach < 2:
            raise ValueError("reach must be at most a third of length and 255")


def cuts(data: np.ndarray, reach: int) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of any ``reach`` neighbours, in ascending order."""
    n = len(data) - TRIGGER + 1
    if n < reach:
        return np.zeros(0, np.int64)
    data = np.ascontiguousarray(data)
    word = np.ndarray((n,), "<u8", data.data, 0, (1,))
    key = (word * U64(0x9E3779B97F4A7C15)) & U64(0xFFFFFFFF00000000)
    key |= U64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if reach > span:
        key = np.minimum(key[: len(key) - (reach - span)], key[reach - span :])
    key &= U64(0xFFFFFFFF)
    return (U64(0xFFFFFFFF) - key[np.concatenate([[True], key[1:] != key[:-1]])]).astype(np.int64)


def parse(column: pa.Array, docs: np.ndarray, own: np.ndarray, p: Repeats, serial: int = 0) -> np.ndarray:
    """An entry for every cut that is the anchor of a window. ``serial``: number of the first text, other for every text."""
    data, bounds = wordhash.joined(column)
    at = cuts(data, p.reach)
    doc = np.searchsorted(bounds, at, "right") - 1
    low, high = bounds[doc], bounds[doc + 1]
    before = np.concatenate([[-(1 << 40)], at[:-1]]) if len(at) else at
    gap = np.minimum(np.minimum(at - before, at - p.reach - low + 1), p.reach)
    good = (gap > 0) & (at - p.reach - gap + 1 + p.length <= high)
    at, doc, low, high, gap = (x[good] for x in (at, doc, low, high, gap))
    out = np.zeros(len(at), CUT)
    if not len(at):
        return out
    sums = wordhash.prefix_sums(data)
    out["core"] = wordhash.span_hashes(sums, at - p.reach, at + p.length - 2 * p.reach + 1)
    left, right = at - 2 * p.reach + 1, at + p.length - p.reach
    whole = (left >= low) & (right <= high)
    second = wordhash.prefix_sums(data, 1)
    out["full"][whole] = wordhash.span_hashes(second, left[whole], right[whole], 1)
    out["doc"], out["own"], out["pos"], out["gap"] = docs[doc], own[doc], at - low, gap
    # a cut near a text's end has no full string: its own place stands for it, equal to nothing else, not even in a row's copy
    out["full"][~whole] = wordhash.mix(wordhash.mix((serial + doc[~whole]).astype(np.uint64) ^ U64(0x5851F42D4C957F2D)) + (at - low)[~whole].astype(np.uint64))
    return out


def _classes(core: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (core, full), and the class numbers of core and of (core, full) in that order."""
    order = np.lexsort((full, core))
    core, full = core[order], full[order]
    new = np.concatenate([[True], core[1:] != core[:-1]]) if len(core) else np.zeros(0, bool)
    newer = new | np.concatenate([[True], full[1:] != full[:-1]]) if len(core) else new
    return order, np.cumsum(new) - 1, np.cumsum(newer) - 1


def _local(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a task's cuts: those covered, those to look at by windows, and the entries that leave the task."""
    order, core, full = _classes(entries["core"], entries["full"])
    e = entries[order]
    if not len(e):
        return e, e, e
    members = np.bincount(full)
    first = np.concatenate([[True], full[1:] != full[:-1]])
    kinds = np.bincount(core[first])  # unlike full strings of each core
    mixed, many = kinds[core] > 1, members[full] > 1
    covered = e[many]
    windows = e[mixed & (~many | first)]
    leave = e[np.concatenate([[True], core[1:] != core[:-1]])]
    lead = np.concatenate([[True], core[1:] != core[:-1]])
    leave["kind"] = np.where(mixed[lead], MIXED, np.where(many[lead], SEVERAL, PLAIN))
    return covered, windows, leave


def _met(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's entries: cuts covered, and cuts to look at by windows."""
    order, core, full = _classes(e["core"], np.where(e["kind"] == MIXED, wordhash.mix(e["doc"].view(np.uint64) ^ U64(99)) + e["own"].astype(np.uint64) + (e["pos"].astype(np.uint64) << U64(32)), e["full"]))
    e = e[order]
    if not len(e):
        return e, e
    mixed = e["kind"] == MIXED
    size = np.bincount(core)[core]
    weight = np.bincount(full, 1.0 + (e["kind"] == SEVERAL))[full]
    first = np.concatenate([[True], full[1:] != full[:-1]])
    unlike = np.bincount(core, first)[core] + np.bincount(core, mixed)[core] > 1
    together = (size > 1) & ~mixed & (weight > 1)
    return e[together & (e["kind"] == PLAIN)], e[(size > 1) & ~mixed & unlike & ((weight < 2) | first)]


def _marks(docs, own, starts, extra, kind: int, bucket) -> pa.RecordBatch:
    n = len(docs)
    columns = [pa.array(np.asarray(bucket, np.int32)), pa.array(np.asarray(docs, np.int64)), pa.array(np.asarray(own, np.int32)), pa.array(np.asarray(starts, np.int32)), pa.array(np.asarray(extra, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=MARK_NAMES)


def _blobs(entries: np.ndarray, key: np.ndarray, buckets: int, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    bucket = ((key >> U64(20)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    entries, at = entries[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    parts = [(b, entries[i : min(i + most, at[b + 1])].tobytes()) for b in range(buckets) for i in range(int(at[b]), int(at[b + 1]), most)]
    for i in range(0, len(parts), 256):
        some = parts[i : i + 256]
        n = len(some)
        blank = pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.nulls(n, pa.int64()), blank, blank, blank, blank, pa.array([x for _, x in some], pa.binary())], names=MARK_NAMES)


def _by_bucket(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[pa.RecordBatch | np.ndarray]:
    """Marks as they come, and each bucket's entries as one array (rows are sorted by bucket)."""
    now, held = None, []
    for batch in batches:
        marks = batch.filter(pc.is_null(batch.column(6)))
        if marks.num_rows:
            yield marks
        rest = batch.filter(pc.is_valid(batch.column(6)))
        for bucket, blob in zip(rest.column(0).to_pylist(), rest.column(6).to_pylist(), strict=True):
            if bucket != now and held:
                yield np.frombuffer(b"".join(held), kind)
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield np.frombuffer(b"".join(held), kind)


def _spread(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (wordhash.mix(docs.view(np.uint64)) % U64(buckets)).astype(np.int32)


WINDOW = np.dtype([("core", "<u8"), ("text", "<u8"), ("doc", "<i8"), ("own", "<i4"), ("pos", "<i4"), ("kind", "u1")])


def _runs(doc: np.ndarray, own: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Merges the windows of each document that touch: document (both names), start, end."""
    if not len(doc):
        return doc, own, start, start
    order = np.lexsort((start, own, doc))
    doc, own, start = doc[order], own[order], start[order].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (start[1:] > start[:-1] + length)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], own[first], start[first], start[last] + length


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and if asked for the kept bytes (``kept``) and
    ``text``, the characters all of whose bytes are kept (halves on both sides of a removed run never make a new one).

    Removes each byte covered by a string of ``length`` UTF-8 bytes that also starts anywhere else in the input, in
    the same document too; all copies go, judged on the input. A null text is empty. Rows are told apart by 96 bits of id
    and text, so null and shared ids do no harm; rows repeated whole are copies of each other. Extra columns are
    ignored; an empty table gives an empty one. Strings are compared by 128-bit fingerprints.

    Texts cross the network once for the result, and those with border windows once more; about one 34-byte entry for every ``reach``
    / 2 bytes of text crosses once. A task's memory follows its own texts, a bucket's its share of distinct cuts.
    """
    spark = docs.sparkSession
    scratch = shared.Scratch(spark, "prefix-free")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    data = plain.select(F.xxhash64("doc_id", "text").alias("doc"), F.hash("text", "doc_id").alias("own"), "text", "doc_id")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = max(shared.table_partitions(spark), -(-(size or 0) // (1 << 29)))  # a bucket's entries stay under some tens of MB
    buckets = max(64, 4 * parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, serial = [], TaskContext.get().partitionId() << 36
        for b in shared.steps(batches, 2):
            found.append(parse(b.column(2), b.column(0).to_numpy(), b.column(1).to_numpy(), p, serial))
            serial += b.num_rows
        if found:
            covered, windows, leave = _local(np.concatenate(found))
            found.clear()
            for some, kind in ((covered, COVERED), (windows, WINDOWS)):
                for i in range(0, len(some), 100_000):
                    x = some[i : i + 100_000]
                    yield _marks(x["doc"], x["own"], x["pos"], x["gap"], kind, _spread(x["doc"].copy(), buckets))
            yield from _blobs(leave, leave["core"], buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_bucket(batches, CUT):
            if isinstance(x, np.ndarray):
                for some, kind in zip(_met(x), (COVERED, WINDOWS), strict=True):
                    if len(some):
                        yield _marks(some["doc"], some["own"], some["pos"], some["gap"], kind, np.zeros(len(some)))
            else:
                yield x

    dealt = data.select("doc", "own", "text").mapInArrow(cut, MARKS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    marks = scratch.keep(dealt.mapInArrow(meet, MARKS).select("doc", "own", "start", "extra", "kind"), "marks")
    scratch.tidy()

    border = scratch.keep(marks.where(F.col("kind") == WINDOWS).groupBy("doc", "own").agg(F.collect_set(F.struct("start", "extra")).alias("places")), "border")
    near = shared.IdFilter(border, "doc")

    def having_border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.filter(pa.array(near.passing(batch.column(3))))
            yield pa.RecordBatch.from_arrays(left.columns[:3], names=["doc", "own", "text"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in shared.steps(batches, 2):
            text, bounds = wordhash.joined(batch.column(2))
            places = batch.column(3)
            counts = pc.list_value_length(places).to_numpy()
            flat = places.flatten()
            start, extra = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row = np.repeat(np.arange(len(counts)), counts)
            owner = np.repeat(np.arange(len(row)), extra)  # one line for each window of each cut
            step = np.arange(len(owner)) - np.repeat(np.cumsum(extra) - extra, extra)
            pos = start[owner] - p.reach - step
            row = row[owner]
            good = (pos >= 0) & (bounds[row] + pos + p.length <= bounds[row + 1])
            pos, row, anchor = pos[good], row[good], start[owner][good]
            sums, second = wordhash.prefix_sums(text), wordhash.prefix_sums(text, 1)
            out = np.zeros(len(pos), WINDOW)
            at = bounds[row] + pos
            out["core"] = wordhash.span_hashes(sums, at, at + p.length) + wordhash.mix((anchor - pos).astype(np.uint64))
            out["text"] = wordhash.span_hashes(second, at, at + p.length, 1)
            out["doc"], out["own"], out["pos"] = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], pos
            found.append(out)
        if found:
            every = np.concatenate(found)
            found.clear()
            order, _, own = _classes(every["core"], every["text"])
            every = every[order]
            many = np.bincount(own, minlength=1)[own] > 1 if len(own) else np.zeros(0, bool)
            doc, other, a, b = _runs(every["doc"][many], every["own"][many], every["pos"][many], p.length)
            if len(doc):
                yield _marks(doc, other, a, b, COVERED, _spread(doc.copy(), buckets))
            lead = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else many
            leave = every[lead]
            leave["kind"] = np.where(many[lead], SEVERAL, PLAIN)
            yield from _blobs(leave, leave["core"], buckets)

    def meet_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_bucket(batches, WINDOW):
            if isinstance(x, np.ndarray):
                order, _, own = _classes(x["core"], x["text"])
                x = x[order]
                again = (np.bincount(own)[own] > 1) & (x["kind"] == PLAIN)
                doc, other, a, b = _runs(x["doc"][again], x["own"][again], x["pos"][again], p.length)
                if len(doc):
                    yield _marks(doc, other, a, b, COVERED, np.zeros(len(doc)))
            else:
                yield x

    texts = shared.IdFilter.hashed(data.select("doc", "own", "text"), "doc").mapInArrow(having_border, "doc long, own int, text string")
    looked = texts.join(border, ["doc", "own"]).select("doc", "own", "text", "places").mapInArrow(windows, MARKS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    spans = scratch.keep(looked.mapInArrow(meet_windows, MARKS).select("doc", "own", "start", F.col("extra").alias("end")), "spans")
    scratch.only("marks", "spans")
    scratch.tidy()
    whole = marks.where(F.col("kind") == COVERED).select("doc", "own", (F.col("start") - 2 * p.reach + 1).alias("start"), (F.col("start") + p.length - p.reach).alias("end"))
    gone = whole.unionByName(spans).groupBy("doc", "own").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string"

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.steps(batches, 1):
            rows = []
            for doc, text, gone in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text, kept, at, spans = text.encode(), [], 0, 0
                for span in sorted((s["start"], s["end"]) for s in gone or ()):
                    if span[0] > at or not spans:
                        kept.append(text[at : span[0]])
                        spans += 1
                    at = max(at, span[1])
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((doc, len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), left if keep_text else None, "".join(x.decode(errors="ignore") for x in kept) if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.string()], strict=True)], names=[x.split()[0] for x in out.split(", ")])

    done = data.join(gone, ["doc", "own"], "left").select("doc_id", "text", "gone").mapInArrow(result, out)
    return done if keep_text else done.drop("kept", "text")


#: Windows of 400 bytes by their md5; kept pieces as hexadecimal, of which characters that were cut are taken off at both ends.
SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, bytes, unnest(range(1, n - 398)) AS pos FROM b WHERE n >= 400),
w AS (SELECT doc_id, pos, md5_number(array_slice(bytes, pos, pos + 399)) AS name FROM s),
r AS (SELECT doc_id, pos FROM w WHERE name IN (SELECT name FROM w GROUP BY name HAVING count(*) > 1)),
f AS (SELECT doc_id, pos, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 400, 0) AS fresh FROM r),
g AS (SELECT doc_id, pos, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
gone AS (SELECT doc_id, min(pos) AS low, max(pos) + 400 AS high FROM g GROUP BY doc_id, run),
edges AS (SELECT doc_id, low, high FROM gone UNION ALL SELECT doc_id, n + 1, n + 1 FROM b),
p AS (SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low, high), 1) AS start FROM edges),
h AS (SELECT p.doc_id, p.start, hex(array_slice(b.bytes, p.start, p.low - 1)) AS piece FROM p JOIN b USING (doc_id) WHERE p.low > p.start),
c AS (SELECT doc_id, start, piece, regexp_replace(regexp_replace(piece, '^(?:[89AB].)+', ''),
             '^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$', '\1') AS letters FROM h),
k AS (SELECT doc_id, string_agg(piece, '' ORDER BY start) AS kept, string_agg(letters, '' ORDER BY start) AS letters FROM c GROUP BY doc_id),
d AS (SELECT doc_id, sum(high - low) AS removed, count(*) AS spans FROM gone GROUP BY doc_id)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(d.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(d.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256, decode(unhex(coalesce(k.letters, ''))) AS text
FROM b LEFT JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)
"""
