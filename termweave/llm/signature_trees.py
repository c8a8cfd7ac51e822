"""Exact Jaccard join of word shingle sets with signature trees.

A signature tree holds sets at its leaves. Every node has the OR of its sets' token bitmaps, their range of sizes, the
most tokens that share a bit inside one set, and the most tokens that follow the tree's own token in a set. Two nodes
can hold a linked pair only if their sizes allow it and the most tokens that they can have in common reach the overlap
that the smallest sizes need. A dual traversal of two trees (or of one with itself) descends only into such pairs, and
not into sets that are known to be connected already; sets that meet at the leaves are judged by their whole bitmaps,
and what those can't tell apart is intersected token by token.

One tree over a corpus would have to be met by every set, so there is one for each token that can be the first common
one of a linked pair. Tokens have one order for the whole corpus, rare ones first: by counts over all documents in a
table of fixed size, then by hash. The sets of a linked pair share a token within the first ``n - need + 1`` of either, so
only those are entered, with their place. The order decides cost alone: any order gives the same links. Frequent
passages come last in it, and texts that have nothing else in common never meet.

Trees of more sets than ``slice_sets`` are cut. First, sets meet inside their slice, and of each set only the few most
alike partners are intersected: work in proportion to the sets. Then slices meet each other, without pairs that
are connected by then, and everything that the bitmaps leave is intersected. Sets equal in full are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import shared, wordhash
from termweave.llm.components import components

U64 = np.uint64
ENTRY = np.dtype([("token", "<u8"), ("set", "<i8"), ("n", "<i4"), ("place", "<i4")])


@dataclass(frozen=True)
class Join:
    """``words`` in a shingle; linked when ``den`` * intersection >= ``num`` * union."""

    words: int = 5
    num: int = 80
    den: int = 100
    order_bits: int = 24  # counters of the token order
    hot: int = 1 << 16  # texts of one token from which its entries are dealt to several buckets
    slice_sets: int = 1024
    few: int = 3
    fanout: int = 8

    def need(self, a, b):
        """Least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def linked(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def prefix(self, n):
        """Tokens of a set of size n of which one is shared with any linked set."""
        return n + (-self.num * n // self.den) + 1


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct fingerprints of each text's shingles; a text of fewer words is one shingle, none without words."""
    hashes, counts = wordhash.words_of(column)
    keys, _, text = wordhash.windows(hashes, counts, words)
    bounds = np.searchsorted(text, np.arange(len(counts) + 1))
    ends = np.cumsum(counts)
    for k, n in enumerate(counts.tolist()):
        if n >= words:
            yield np.unique(keys[bounds[k] : bounds[k + 1]])
        elif n:
            value = U64(n)
            with np.errstate(over="ignore"):
                for h in hashes[ends[k] - n : ends[k]]:
                    value = value * U64(0x9FB21C651E98DF25) + h
            yield wordhash.mix(np.array([value], U64) ^ U64(0x5851F42D4C957F2D))
        else:
            yield np.zeros(0, U64)


def set_name(tokens: np.ndarray) -> int:
    return int(wordhash.mix(np.array([wordhash.mix(tokens).sum(dtype=U64) + U64(len(tokens))]))[0].astype(np.int64))


def _counter(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (wordhash.mix(tokens ^ U64(0xA24BAED4963EE407)) >> U64(64 - bits)).astype(np.int64)


def token_counts(data: DataFrame, join: Join) -> tuple[np.ndarray, int]:
    """For each of 2^order_bits counters its level (0: at most one text has such a token; else 8 log2 of the texts, 255 at
    most), and the number of all tokens. Counted over all texts; a task sends its counters packed."""
    size, cut = 1 << join.order_bits, 1 << max(0, join.order_bits - 10)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint32)
        some = False
        for batch in shared.steps(batches, 0):
            tokens = list(shingle_sets(batch.column(0), join.words))
            if tokens:
                some = True
                np.add.at(held, _counter(np.concatenate(tokens), join.order_bits), 1)
        for at in range(0, size if some else 0, cut * 64):
            numbers = [k for k in range(at // cut, min(at + cut * 64, size) // cut) if held[k * cut : (k + 1) * cut].any()]
            blobs = [pa.compress(held[k * cut : (k + 1) * cut].tobytes(), "zstd", asbytes=True) for k in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # at most all counters
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(pa.decompress(blob, 4 * cut, "zstd", asbytes=True), np.uint32)
                held[part] = held.get(part, 0) + found.astype(np.uint64)
        for part, total in held.items():
            level = np.where(total > 1, np.minimum(255, 8 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["part", "levels", "total"])

    parts = data.select("text").mapInArrow(count, "part int, counts binary").repartition(min(64, shared.table_partitions(data.sparkSession)), "part")
    out, tokens = np.zeros(size, np.uint8), 0
    for row in parts.mapInArrow(add, "part int, levels binary, total long").toArrow().to_pylist():  # 2^order_bits bytes in all
        out[row["part"] * cut : (row["part"] + 1) * cut] = np.frombuffer(row["levels"], np.uint8)
        tokens += row["total"]
    return out, tokens


def signature(tokens: np.ndarray) -> bytes:
    """OR bitmap of 2 to 4 bits for each token, 256 at least."""
    width = 1 << max(8, (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(tokens & U64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def entries_of(tokens: np.ndarray, own: int, levels: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """The set's entries for its first tokens in the corpus' order, and the tokens' levels."""
    level = levels[_counter(tokens, join.order_bits)]
    order = np.argsort((level.astype(np.uint64) << U64(56)) | (wordhash.mix(tokens) >> U64(8)), kind="stable")[: join.prefix(len(tokens))]
    out = np.zeros(len(order), ENTRY)
    out["token"], out["set"], out["n"], out["place"] = tokens[order], own, len(tokens), np.arange(len(order))
    return out, level[order]


def _salts(levels: np.ndarray, join: Join) -> np.ndarray:
    """Buckets that a token is dealt to, by its sets: more than one if very many texts may have it."""
    return np.maximum(1, (2.0 ** (levels / 8.0) / join.hot).astype(np.int64)).astype(np.uint64)


SKETCH = "bucket int, doc_id long, set_id long, n long, bits binary, entries binary"


def _sketch(join: Join, buckets: int, held):
    """Of each text its set's id, size and (once in a task) bitmap; and by bucket of the token, packed entries."""
    names = [x.split()[0] for x in SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in shared.steps(batches, 1):
            ids, sizes, bits, found, levels = [], [], [], [], []
            for tokens in shingle_sets(batch.column(1), join.words):
                sizes.append(len(tokens))
                bits.append(None)
                if not len(tokens):
                    ids.append(None)
                    continue
                own = set_name(tokens)
                ids.append(own)
                if own not in done:
                    if len(done) < 1_000_000:  # only saves sending equal sets again
                        done.add(own)
                    bits[-1] = signature(tokens)
                    some, level = entries_of(tokens, own, held.value, join)
                    found.append(some)
                    levels.append(level)
            n = len(ids)
            none = pa.nulls(n, pa.binary())
            places = np.arange(n) % buckets  # documents only pass through, so copies of one set are spread
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), none], names=names)
            if found:
                every, level = np.concatenate(found), np.concatenate(levels)
                salt = wordhash.mix(every["set"].copy().view(np.uint64)) % _salts(level, join)
                bucket = ((wordhash.mix(every["token"] + salt * U64(0x9FB21C651E98DF25)) >> U64(20)) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                every, at = every[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(at))
                blank = pa.nulls(len(full), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), blank, blank, blank, pa.nulls(len(full), pa.binary()), pa.array([every[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())], names=names)

    return run


def meeting(entries: np.ndarray, join: Join) -> np.ndarray:
    """Of distinct entries those of which another one of the token may be of a linked set, by sizes and places."""
    e = entries[np.lexsort((entries["n"], entries["token"]))]
    first = np.concatenate([[True], e["token"][1:] != e["token"][:-1]]) if len(e) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    size = np.bincount(group)[group] if len(e) else group
    keep = size > 64  # larger groups are left to the trees
    n, rest = e["n"].astype(np.int64), (e["n"] - e["place"]).astype(np.int64)
    for d in range(1, min(64, int(size.max(initial=0)))):
        i = np.flatnonzero(group[:-d] == group[d:])
        if not len(i):
            break
        ok = (join.den * n[i] >= join.num * n[i + d]) & (np.minimum(rest[i], rest[i + d]) >= join.need(n[i], n[i + d]))
        keep[i[ok]] = keep[i[ok] + d] = True
    return e[keep]


def _meet(join: Join, held_levels):
    """Passes documents through, and keeps the entries whose token is in other sets (all of a token dealt to several buckets)."""
    names = ["doc_id", "set_id", "n", "bits", "token", "place"]

    def rows(parts: list[bytes]) -> pa.RecordBatch | None:
        e = np.unique(np.frombuffer(b"".join(parts), ENTRY))
        dealt = _salts(held_levels.value[_counter(e["token"].copy(), join.order_bits)], join) > 1
        e = np.concatenate([meeting(e[~dealt], join), e[dealt]])
        if not len(e):
            return None
        return pa.RecordBatch.from_arrays([pa.nulls(len(e), pa.int64()), pa.array(e["set"].copy()), pa.array(e["n"].astype(np.int64)), pa.nulls(len(e), pa.binary()), pa.array(e["token"].copy().view(np.int64)), pa.array(e["place"].copy())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:  # rows come sorted by bucket, so only one bucket's entries are held
            document = batch.column(5).is_null()
            docs = batch.filter(document)
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([*docs.columns[1:5], pa.nulls(docs.num_rows, pa.int64()), pa.nulls(docs.num_rows, pa.int32())], names=names)
            rest = batch.filter(pc.invert(document))
            for bucket, blob in zip(rest.column(0).to_pylist(), rest.column(5).to_pylist(), strict=True):
                if bucket != now and held:
                    if out := rows(held):
                        yield out
                    held = []
                now = bucket
                held.append(blob)
        if held and (out := rows(held)):
            yield out

    return run


@dataclass
class Level:
    """Nodes of one height of many trees, in order; ``first`` are their first children one level below."""

    bits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rest: np.ndarray
    doubled: np.ndarray
    low: np.ndarray  # least and greatest component inside
    high: np.ndarray
    guest: np.ndarray
    tree: np.ndarray
    first: np.ndarray

    def over(self, fanout: int) -> Level | None:
        """The parents of ``fanout`` neighbours of one tree each; none if every tree has its root."""
        new = np.concatenate([[True], self.tree[1:] != self.tree[:-1]])
        begin = np.flatnonzero(new)
        if len(begin) == len(new):
            return None
        heads = np.flatnonzero((np.arange(len(new)) - begin[np.cumsum(new) - 1]) % fanout == 0)
        up = lambda f, x: f.reduceat(x, heads)
        return Level(
            np.bitwise_or.reduceat(self.bits, heads, axis=0), up(np.minimum, self.least), up(np.maximum, self.most), up(np.maximum, self.rest), up(np.maximum, self.doubled),
            up(np.minimum, self.low), up(np.maximum, self.high), up(np.logical_and, self.guest), self.tree[heads], np.append(heads, len(new)),
        )


@dataclass
class Members:
    """The sets of many trees: ``group`` ascending; ``side`` 0 or 1; a group with ``both`` joins its sides only with each other."""

    group: np.ndarray
    side: np.ndarray
    both: np.ndarray
    n: np.ndarray
    rest: np.ndarray
    component: np.ndarray
    bits: list[bytes]


def _leaves(m: Members, c: int, width: np.ndarray, join: Join) -> tuple[np.ndarray, Level]:
    """Members whose bitmaps have 2^c bits, and guests: larger ones, folded to as many, that may be linked with them."""
    own = np.flatnonzero(width == c)
    guest = np.flatnonzero((width > c) & (join.num * m.n <= join.den * ((1 << c) // 2)))
    guest = guest[np.isin(m.group[guest], m.group[own])]
    words = (1 << c) // 64
    fold = lambda b: np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), axis=0)
    bits = np.frombuffer(b"".join(m.bits[k] for k in own), np.uint64).reshape(-1, words)
    if len(guest):
        bits = np.concatenate([bits, np.stack([fold(m.bits[k]) for k in guest])])
    at = np.concatenate([own, guest])
    _, name, copies = np.unique(np.stack([m.group[at], m.component[at]], 1), axis=0, return_inverse=True, return_counts=True)
    name = name.ravel()
    several = np.where(copies[name] >= join.fanout, name + 1, 0)  # large components fill nodes of their own
    order = np.lexsort((m.n[at], several, m.side[at], m.group[at]))
    at, bits, folded = at[order], bits[order], np.arange(len(at))[order] >= len(own)
    n = m.n[at]
    tree = np.cumsum(np.concatenate([[True], (m.group[at][1:] != m.group[at][:-1]) | (m.side[at][1:] != m.side[at][:-1])])) - 1
    held = np.bitwise_count(bits).sum(1).astype(np.int64)
    return at, Level(bits, n, n, m.rest[at], n - held, m.component[at], m.component[at], folded, tree, np.arange(len(at) + 1))


def _possible(x: Level, i: np.ndarray, j: np.ndarray, leaf: bool, join: Join, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of nodes may hold a linked pair, and an upper bound of the overlap."""
    need = join.need(x.least[i], x.least[j])
    same = i == j
    good = (join.num * x.least[j] <= join.den * x.most[i]) & (join.num * x.least[i] <= join.den * x.most[j])
    good &= ~(x.guest[i] & x.guest[j]) & (np.minimum(x.rest[i], x.rest[j]) >= need)
    good &= (x.low[i] != x.high[j]) | (x.high[i] != x.low[j])  # not all of one component
    if leaf:
        good &= ~same
    bound = np.zeros(len(i), np.int64)
    look = np.flatnonzero(good & ~same)
    step = max(1, most // x.bits.shape[1])
    for k in range(0, len(look), step):
        a, b = i[look[k : k + step]], j[look[k : k + step]]
        p, q = x.bits[a], x.bits[b]
        if leaf:  # bits of only one of them stand for tokens of only one of them
            found = (x.least[a] + x.least[b] - np.bitwise_count(p ^ q).sum(1)) // 2
        else:
            found = np.bitwise_count(p & q).sum(1) + np.minimum(x.doubled[a], x.doubled[b])
        bound[look[k : k + step]] = found
        good[look[k : k + step]] = found >= need[look[k : k + step]]
    return good, bound


def survivors(m: Members, join: Join) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of members (numbers, and the bound of their overlap) that sizes, places, components and bitmaps can't tell apart."""
    width = np.array([(8 * len(b)).bit_length() - 1 for b in m.bits])
    for c in np.unique(width).tolist():
        at, leaves = _leaves(m, c, width, join)
        levels = [leaves]
        while (up := levels[-1].over(join.fanout)) is not None:
            levels.append(up)
        begin = np.flatnonzero(np.concatenate([[True], leaves.tree[1:] != leaves.tree[:-1]]))
        group, side, both = (x[at[begin]] for x in (m.group, m.side, m.both))
        alone = np.flatnonzero(~both)
        pair = np.flatnonzero(both[:-1] & (group[1:] == group[:-1]) & (side[1:] != side[:-1])) if len(both) > 1 else alone[:0]
        todo = [(len(levels) - 1, np.concatenate([alone, pair]), np.concatenate([alone, pair + 1]))]
        while todo:
            k, i, j = todo.pop()
            if len(i) > 1 << 13:
                todo += [(k, i[s : s + (1 << 13)], j[s : s + (1 << 13)]) for s in range(0, len(i), 1 << 13)]
                continue
            x = levels[k]
            good, bound = _possible(x, i, j, not k, join)
            i, j = i[good], j[good]
            if not len(i):
                continue
            if not k:
                yield at[i], at[j], bound[good]
                continue
            ni, nj = x.first[i + 1] - x.first[i], x.first[j + 1] - x.first[j]
            total = ni * nj
            number = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            across = np.repeat(nj, total)
            a, b = np.repeat(x.first[i], total) + number // across, np.repeat(x.first[j], total) + number % across
            keep = ~np.repeat(i == j, total) | (a <= b)
            todo.append((k - 1, a[keep], b[keep]))


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted distinct pairs, the smaller of each first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return np.stack([a[new], b[new]], 1)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 1 << 25) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by their first two columns, cut between groups as soon as ``rows`` rows or ``size`` bytes of bitmaps are reached."""
    held: list[pa.RecordBatch] = []
    weight, last = 0.0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, task = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate([[last != (token[0], task[0])], (token[1:] != token[:-1]) | (task[1:] != task[:-1])])
        cost = np.concatenate([[0], np.cumsum(1 / rows + pc.binary_length(batch.column(8)).to_numpy(zero_copy_only=False) / size)])
        at = 0
        for s in np.flatnonzero(new).tolist():
            if weight + cost[s] - cost[at] >= 1:
                if s > at:
                    held.append(batch.slice(at, s - at))
                yield held
                held, weight, at = [], 0.0, s
        held.append(batch.slice(at))
        weight += cost[-1] - cost[at]
        last = (token[-1], task[-1])
    if held:
        yield held


MEMBER = "token long, task long, side int, both boolean, set_id long, n long, place int, component long, bits binary"


def _trees(join: Join, few: int | None):
    """Pairs of sets (a < b) that trees leave, of one set ``few`` at most; tokens of which more were left are named."""

    def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        col = {c: t.column(c).to_numpy() for c in ("token", "task", "side", "both", "set_id", "n", "place", "component")}
        group = np.cumsum(np.concatenate([[True], (col["token"][1:] != col["token"][:-1]) | (col["task"][1:] != col["task"][:-1])])) - 1
        m = Members(group, col["side"], col["both"], col["n"], col["n"] - col["place"], col["component"], t.column("bits").to_pylist())
        pairs, more = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        found = list(survivors(m, join))
        if found:
            a, b, bound = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            if few is not None:
                x, y = np.concatenate([a, b]), np.concatenate([b, a])
                order = np.lexsort((col["set_id"][y], -np.concatenate([bound, bound]), x))
                x, y = x[order], y[order]
                new = np.concatenate([[True], x[1:] != x[:-1]])
                turn = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                more = np.unique(col["token"][x[turn >= few]])
                a, b = x[turn < few], y[turn < few]
            pairs = distinct_pairs(col["set_id"][a], col["set_id"][b])
        for k in range(0, len(pairs), 1 << 16):
            part = pairs[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.nulls(len(part), pa.int64())], names=["a", "b", "token"])
        if len(more):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int64()), pa.array(more)], names=["a", "b", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_groups(batches):
            yield from work(parts)

    return run


def _check(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                good.append(join.linked(len(p), len(q), int((q[at] == p).sum())))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, tokens: DataFrame, join: Join) -> DataFrame:
    """Of pairs (a, b) those that are linked, by their tokens. Joins may split a set that is in very many pairs."""
    ends = [tokens.select(F.col("set_id").alias(s), F.col("tokens").alias(f"tokens_{s}")).hint("merge") for s in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_check(join), "a long, b long")


def near_duplicates(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row of ``docs``.

    Null texts and texts without a word have no shingles and are linked with nothing, and are their own components. A
    repeated row is a copy of itself, and rows that share an id are judged by their own texts. A row with a null id is
    linked as any other; the component of rows that all have none is null. Words are lower-cased in A-Z only. Tokens and
    set ids are 64-bit fingerprints. Very long texts are sets like others, with larger bitmaps. Extra columns are
    ignored; an empty table gives an empty one.

    Every text is parsed twice (token order, sketch), and one text of each set in a pair that bitmaps leave once or twice
    more. What crosses the network: 24 bytes for each of a set's first tokens (a fifth of the shingles at 0.8), a bitmap of 2 to 4 bits a token for the sets that meet others, and the tokens of pairs left.
    """
    spark = docs.sparkSession
    scratch = shared.Scratch(spark, "signature-trees")
    data = shared.texts(docs, id_col, text_col)
    levels, total = token_counts(data, join)
    held = spark.sparkContext.broadcast(levels)  # 2^order_bits bytes
    entered = total * ENTRY.itemsize * (join.den - join.num) // join.den
    parts = max(shared.table_partitions(spark), -(-entered // (1 << 28)))
    buckets = max(64, 4 * parts)
    dealt = data.mapInArrow(_sketch(join, buckets, held), SKETCH).repartition(parts, "bucket").sortWithinPartitions("bucket")
    first = scratch.keep(dealt.mapInArrow(_meet(join, held), "doc_id long, set_id long, n long, bits binary, token long, place int"), "sketch")
    scratch.tidy()
    held.destroy()
    members = first.where("token is null").select("doc_id", "set_id", "n")
    sets = members.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    entries = first.where("token is not null").select("token", "set_id", "n", "place")
    named = entries.select("set_id").distinct()
    signed = first.where("bits is not null").select("set_id", "bits").join(named, "set_id", "left_semi").groupBy("set_id").agg(F.first("bits").alias("bits"))
    # one row for each token and set from here on
    entered = scratch.keep(entries.join(signed.hint("merge"), "set_id"), "entered")
    large = scratch.keep(entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > join.slice_sets), "large")
    some_large = not large.isEmpty()
    hashed = lambda salt: F.xxhash64("set_id", F.lit(salt))

    def joined(rows: DataFrame, few: int | None, table: str) -> DataFrame:
        """``rows``: token, task, side, both, component and an entry's columns."""
        columns = [x.split()[0] for x in MEMBER.split(", ")]
        dealt = rows.select(*columns).repartition(parts, "token", "task").sortWithinPartitions("token", "task")
        return scratch.keep(dealt.mapInArrow(_trees(join, few), "a long, b long, token long"), table)

    def tokens_of(pairs: DataFrame, table: str) -> DataFrame:
        """set_id and tokens of all sets in ``pairs``, from one text of each."""
        wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        wanted = scratch.keep(wanted.join(sets, "set_id").select("set_id", "rep"), f"{table}-wanted")
        near = shared.IdFilter(wanted, "rep")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in shared.steps((b.filter(pa.array(near.passing(b.column(2)))) for b in batches), 1):
                found = [(set_name(x), x.tobytes()) for x in shingle_sets(some.column(1), join.words) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["set_id", "tokens"])

        rows = shared.IdFilter.hashed(data, "doc_id").mapInArrow(run, "set_id long, tokens binary")
        return scratch.keep(rows.join(wanted.select("set_id").hint("merge"), "set_id", "left_semi").groupBy("set_id").agg(F.first("tokens").alias("tokens")), table)

    # first: whole trees, or slices of large ones
    task = F.lit(0).cast("long")
    rows = entered
    if some_large:
        rows = entered.join(large, "token", "left")
        task = F.coalesce(F.pmod(hashed(1), F.ceil(F.col("k") / join.slice_sets)), task)
    rows = rows.withColumns({"task": task, "side": F.lit(0), "both": F.lit(False), "component": F.col("set_id")})
    found = joined(rows, join.few, "found-1")
    pairs = scratch.keep(found.where("token is null").select("a", "b").distinct(), "pairs-1")
    links = scratch.keep(_verified(pairs, tokens_of(pairs, "tokens-1"), join), "links-1")
    # then: what the first round left open, without what is connected by now
    left = found.where("token is not null").select("token").distinct()
    left = scratch.keep(left.unionByName(large.select("token")).distinct() if some_large else left, "open")
    if not left.isEmpty():
        comps = components(links, scratch, "first").select(F.col("node").alias("set_id"), "component")
        rows = entered.join(left, "token", "left_semi").join(comps, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        rows = scratch.keep(rows, "rows")
        inside = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("sets"))
        trees = inside.groupBy("token").agg(F.max_by("component", F.struct("sets", "component")).alias("main"), F.sum("sets").alias("k"), F.max("sets").alias("top")).where("k > top")
        trees = scratch.keep(trees.select("token", "main", "k", F.ceil((F.col("k") - F.col("top")) / join.slice_sets).alias("strays"), F.ceil(F.col("k") / join.slice_sets).alias("slices")), "trees")
        rows = rows.join(trees, "token")
        whole = rows.where("slices = 1").withColumns({"task": F.lit(0).cast("long"), "side": F.lit(0), "both": F.lit(False)})
        cut = rows.where("slices > 1")
        # sets outside the tree's main component meet all its sets
        stray, all_of = F.pmod(hashed(2), F.col("strays")), F.pmod(hashed(3), F.col("slices"))
        one = cut.where("component <> main").withColumns({"task": F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda k: stray * F.col("slices") + k)), "side": F.lit(0), "both": F.lit(True)})
        two = cut.withColumns({"task": F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("strays") - 1), lambda k: k * F.col("slices") + all_of)), "side": F.lit(1), "both": F.lit(True)})
        found = joined(whole.unionByName(one).unionByName(two), None, "found-2")
        rest = scratch.keep(found.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs-2")
        if not rest.isEmpty():
            links = links.unionByName(scratch.keep(_verified(rest, tokens_of(rest, "tokens-2"), join), "links-2"))
    scratch.drop("entered", "tokens-1", "tokens-2", "rows")
    final = components(links, scratch, "final").select(F.col("node").alias("set_id"), "component")
    joint = sets.join(final, "set_id", "left")
    known = joint.where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "set_id"))
    lowest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    target = scratch.keep(known.join(lowest, "component").select("set_id", "component_id"), "target")
    scratch.only("sketch", "target")
    return members.join(target, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS sh
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(sh, chr(10) ORDER BY sh)) AS digest FROM s GROUP BY doc_id),
reps AS (SELECT digest, min(doc_id) AS rep FROM sets GROUP BY digest),
r AS (SELECT s.doc_id, s.sh FROM s JOIN reps ON s.doc_id = reps.rep),
f AS (SELECT sh FROM r GROUP BY sh HAVING count(*) > 1),
rf AS (SELECT r.* FROM r JOIN f USING (sh)),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM rf a JOIN rf b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 90 * (nx.n + ny.n - shared)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT x AS node, x AS seen FROM e2 UNION SELECT c.node, e2.y FROM c JOIN e2 ON c.seen = e2.x),
m AS (SELECT node, min(seen) AS component FROM c GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component, reps.rep, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id
LEFT JOIN reps ON reps.digest = sets.digest LEFT JOIN m ON m.node = reps.rep
"""
