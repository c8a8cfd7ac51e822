"""Token ids in files of fixed-width bit packing.

A shard file: the magic, a JSON header (length first), then one section after the other: the documents' ids
(int64, nulls as -2^63), the documents' token starts inside the shard (int64, one more than documents), the byte
offset of every block of ``block`` ids (int64), and the blocks: ids of ``width`` bits each, least significant bit
first, every block padded to whole bytes. Any id's bits are found from its number alone, so a reader can unpack
one document, one block or everything with numpy.
"""

from __future__ import annotations

import functools
import io
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import shared
from termweave.llm.chunk_store import ChunkStore, flattened, merged, ranges

MAGIC = b"TWPACK01"
NULL_ID = -(1 << 63)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Any width from 1 to 32 bits; 8, 16 and 32 are plain little-endian integers."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int, skip: int = 0) -> np.ndarray:
    """``count`` ids after the first ``skip`` of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, skip * width // 8).astype(np.uint32)
    first = skip * width // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=first), bitorder="little")[skip * width - 8 * first :][: count * width]
    return (bits.reshape(count, width).astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


class ShardReader:
    """Random access to one shard file."""

    def __init__(self, file):
        self.file = file
        head = file.read(12)
        if head[:8] != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.base = 12 + struct.unpack("<I", head[8:])[0]
        self.meta = json.loads(file.read(self.base - 12))
        n, blocks = self.meta["docs"], self.meta["blocks"]
        self.docs = np.frombuffer(file.read(8 * n), "<i8")
        self.starts = np.frombuffer(file.read(8 * (n + 1)), "<i8")
        self.offsets = np.frombuffer(file.read(8 * (blocks + 1)), "<i8")
        self.data = self.base + 8 * (2 * n + 1 + blocks + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids number start to end (exclusive) of the shard; reads only the blocks that hold them."""
        size, width = self.meta["block"], self.meta["width"]
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // size, (end - 1) // size
        self.file.seek(self.data + int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for b in range(first, last + 1):
            low, high = max(start, b * size), min(end, (b + 1) * size)
            part = data[int(self.offsets[b] - self.offsets[first]) : int(self.offsets[b + 1] - self.offsets[first])]
            out.append(unpack(part, high - low, width, low - b * size))
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_shard(out, docs: list[int | None], lengths: list[int], ids: Iterator[np.ndarray], width: int, block: int) -> None:
    """``ids``: arrays whose concatenation holds the documents' ids in order."""
    total = sum(lengths)
    blocks = -(-total // block)
    sizes = [(min(block, total - b * block) * width + 7) // 8 for b in range(blocks)]
    meta = json.dumps({"docs": len(docs), "tokens": total, "width": width, "block": block, "blocks": blocks}).encode()
    out.write(MAGIC + struct.pack("<I", len(meta)) + meta)
    out.write(np.array([NULL_ID if d is None else d for d in docs], "<i8").tobytes())
    out.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes())
    out.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes())
    held: list[np.ndarray] = []
    n = 0
    for part in ids:
        held.append(part)
        n += len(part)
        if n >= block:
            whole = np.concatenate(held)
            cut = n - n % block
            for at in range(0, cut, block):
                out.write(pack(whole[at : at + block], width))
            held, n = [whole[cut:]], n - cut
    if n:
        out.write(pack(np.concatenate(held), width))


_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_WHITE_ASCII = [c for c in _WHITE if c.isascii()]


def _loose(text: str, white: list[str]) -> bool:
    """Whether some blank has other white space (``white`` is all there is), or the text's end, beside it."""
    return text[0] == " " or text[-1] == " " or "  " in text or any(c + " " in text or " " + c in text for c in white)


#: A word (after a blank or a line's end) of letters of Latin script, and a few signs after it of which none is an apostrophe.
_TAILED = re.compile("(\n?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\\[-`{-~]{1,3})")


class ChunkEncoder:
    """Encodes texts with a tokenizers file by chunks, a chunk being a word with the blank before it.

    Cutting is safe where a single blank stands between two characters that are not white space, as byte-level
    pre-tokenizers always cut there; a text with other blanks is cut at its safe places only. Added tokens of the file
    (such as the end of a text) in a text are cut out first and keep their own ids, as the library has it.
    Where the file has the library's own byte-level pattern, a line's end between two such characters is a place to cut
    too, as is that between a letter and a sign (used for new words, whose letters are often known).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads cost more CPU time than they save
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.chunked = not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added)
        # the longest first, as one may begin another
        self.marks = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, self.marks)) + ")")
        size = self.tokenizer.get_vocab_size()
        self.blank = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])  # the mark of byte 0x20
        cutter, self.line = self.tokenizer.pre_tokenizer, self.tokenizer.token_to_id("\u010a")  # the mark of byte 0x0A
        self.lines = self.line is not None and type(cutter).__name__ == "ByteLevel" and cutter.use_regex and not cutter.add_prefix_space and self.tokenizer.normalizer is None
        self.tails: dict[str, list[int]] = {}
        self.store = ChunkStore(self._encode, 1_000_000)

    def _encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        kinds = np.array([2 if k[0] == " " else 1 if k[0] == "\n" else 0 for k in keys], np.int8)
        joined = self._joined(keys, kinds) if self.lines else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        some = [[keys[i] for i in np.flatnonzero(kinds == kind).tolist()] for kind in range(3)]
        ids, sizes = merged(kinds, [self._in_lines(some[0], " "), self._in_lines(some[1], ""), self._ids([k[1:] for k in some[2]]), joined])
        return ids, sizes, [True] * len(keys)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _in_lines(self, words: list[str], blank: str) -> tuple[np.ndarray, np.ndarray]:
        """Words are encoded many at once, as a text of their own: only a word's first token holds its blank (or is its
        line's end, which these words begin with)."""
        ids, _ = self._ids([blank + blank.join(words[i : i + 256]) for i in range(0, len(words), 256)])
        first = np.flatnonzero(self.blank[ids] if blank else ids == self.line)
        if len(first) != len(words):
            raise AssertionError("a word without a token of its own blank")
        return ids, np.diff(np.append(first, len(ids)))

    def _joined(self, keys: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with signs after them, from those of the word if it is known; these keys' kind becomes 3."""
        which, words, tails = [], [], []
        for i, found in enumerate(map(_TAILED.fullmatch, keys)):
            if found and (known := self.store.known.get(found[1])) is not None:
                which.append(i)
                words.append(known)
                tails.append(found[2])
        kinds[which] = 3
        if new := list(dict.fromkeys(t for t in tails if t not in self.tails)):
            self.tails.update((t, x.ids) for t, x in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True))
        at = np.array(words, np.int64)
        start = self.store.at[at]
        own = self.store.at[at + 1] - start
        ids, sizes = merged(np.tile(np.array([0, 1], np.int8), len(which)), [(self.store.flat[ranges(start, own)], own), flattened([self.tails[t] for t in tails])])
        return ids, sizes.reshape(-1, 2).sum(1)

    def keys(self, text: str) -> list[str]:
        if not self.chunked:
            return [" " + text] if text else []
        for m in self.marks:
            if m in text:
                break
        else:
            return self.plain(text)
        parts = self.added.split(text)  # every second one is an added token
        return [k for i, part in enumerate(parts) for k in ([" " + part] if i % 2 else self.plain(part))]

    def plain(self, text: str) -> list[str]:
        if not text:
            return []
        white = [c for c in (_WHITE_ASCII if text.isascii() else _WHITE) if c in text]  # a single character is found much faster
        if not _loose(text, white):
            if self.lines and white == ["\n"] and text[0] != "\n" and text[-1] != "\n" and "\n\n" not in text:
                text = text.replace("\n", " \n")
            words = text.split(" ")
            words[0] = " " + words[0]
            return words
        words = text.split(" ")
        out = [words[0]]
        for w in words[1:]:
            last = out[-1]
            if w and last and not w[0].isspace() and not last[-1].isspace():
                out.append(" " + w)
            else:
                out[-1] = last + " " + w
        return [" " + out[0], *(w[1:] if " " not in w[1:] else " " + w for w in out[1:])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        ids, counts, _ = self.store.lookup([self.keys(t) for t in texts])
        return ids, counts


@functools.cache
def vocabulary_of(path: str) -> int:
    """Ids of a tokenizers file, added tokens included."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def write(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int | None = None, end_id: int = 0, shards: int = 0, block: int = 4096, shard_ids: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every document's ids, ``end_id`` after each, into shard files in ascending order of the document id.

    Returns one row for each shard (file, first document and its text's hash, number in its task, documents, ids). A null text is
    empty, a null id comes first, repeated ids follow the hash of their text. Documents are dealt by ranges of id and hash,
    so no source, copy group or repeated id matters; a task holds one shard's ids packed, never the texts, and closes a shard at
    ``shard_ids`` ids (a longer document has one of its own). Files appear under
    their final names only when whole, so a retried or doubled task does no harm. ``vocabulary``: as the tokenizer has it if not given.
    """
    spark = docs.sparkSession
    data = shared.texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("hash"))
    shards = shards or shared.table_partitions(spark)
    dealt = data.repartitionByRange(shards, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    width = width_of(vocabulary or vocabulary_of(tokenizer))
    kind = "<u2" if width <= 16 else "<u4"
    own = ("packed-ids", tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.worker_keeps(own, lambda: ChunkEncoder(tokenizer))  # chunks stay known from task to task
        names: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        head, turn = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal turn
            fs, root = pafs.FileSystem.from_uri(folder)
            fs.create_dir(root, recursive=True)
            name = f"ids-{uuid.uuid4().hex}.bin"
            with fs.open_output_stream(f"{root}/.{name}") as out:
                write_shard(out, names, lengths, iter(parts), width, block)
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            first = NULL_ID if names[0] is None else names[0]
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((f"{folder}/{name}", first, head, turn, len(names), sum(lengths)), [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["file", "first_id", "first_hash", "turn", "n_docs", "n_ids"])
            turn += 1
            for x in (names, lengths, parts):
                x.clear()
            return out

        for batch in shared.steps(batches, 1, 1 << 20, own):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts = encoder.encode(texts)
            if names and sum(lengths) + len(ids) > shard_ids:
                yield close()
            if not names:
                head = batch.column(2)[0].as_py()
            parts.append(np.insert(ids, np.cumsum(counts), end_id).astype(kind))
            names += batch.column(0).to_pylist()
            lengths += (counts + 1).tolist()
        if names:
            yield close()

    return dealt.mapInArrow(run, "file string, first_id long, first_hash long, turn int, n_docs long, n_ids long")


def read(shards: DataFrame, digest: Callable[[np.ndarray], int] = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())) -> DataFrame:
    """Per document of the shard files: doc_id, start, n_tokens, ids_crc32, each document read by random access."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(at) as raw:
                    shard = ShardReader(io.BufferedReader(raw, 1 << 20) if not hasattr(raw, "seek") else raw)
                    step = 512
                    for k in range(0, len(shard.docs), step):
                        starts = shard.starts[k : k + step + 1]
                        ids = shard.ids(int(starts[0]), int(starts[-1]))
                        sums = [digest(ids[a - starts[0] : b - starts[0]]) for a, b in itertools.pairwise(starts)]
                        names = [None if d == NULL_ID else d for d in shard.docs[k : k + step].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("file", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, vocabulary: int | None = None, **how) -> DataFrame:
    """Files in the shared folder, then each document's place and checksum as read back from them.

    Only one row for each shard, of some 2^25 ids, comes to the driver.
    """
    scratch = shared.Scratch(spark, "packed-ids")
    manifest = scratch.keep(write(docs, scratch.path("files"), tokenizer, vocabulary, **how), "manifest")
    rows = sorted(manifest.collect(), key=lambda r: (r["first_id"], r["first_hash"], r["turn"]))
    bases = itertools.accumulate((r["n_ids"] for r in rows), initial=0)
    placed = spark.createDataFrame([(r["file"], b) for r, b in zip(rows, bases, strict=False)], "file string, base long")
    return read(placed.repartition(max(1, len(rows))))
