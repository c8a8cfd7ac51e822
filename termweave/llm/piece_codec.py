"""SentencePiece models on the tokenizers library: read the model file, rebuild its parts, encode and decode.

The model file is a protocol buffer, read here by a small wire-format parser. From it come the normaliser (its
precompiled character map, blank removal, the metaspace marker in front), the pieces with their scores, and byte
fallback. BPE models become ranked merges, unigram models keep their scores. Every whole text is also encoded by the
sentencepiece library, so parity is verified as the corpus is encoded.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import shared
from termweave.llm.chunk_store import ChunkStore, flattened, merged

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # fixed values: piece types of the model format
UNIGRAM, BPE = 1, 2  # fixed values: model types of the model format


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Field numbers and values of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        elif kind == 1:
            at += 8
            yield number, struct.unpack("<d", data[at - 8 : at])[0]
        elif kind == 2:
            n = varint()
            at += n
            yield number, data[at - n : at]
        elif kind == 5:
            at += 4
            yield number, struct.unpack("<f", data[at - 4 : at])[0]
        else:
            raise ValueError(f"wire type {kind} in a model file")


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    whole_words: bool = True
    suffix_mark: bool = False


def parse(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), piece[2], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.unknown = trainer.get(40, 0)
            model.suffix_mark = bool(trainer.get(24, 0))
        elif number == 3:
            norm = dict(_fields(value))
            model.charsmap = norm.get(2, b"")
            model.dummy_prefix = bool(norm.get(3, 1))
            model.squeeze = bool(norm.get(4, 1))
    if model.kind not in (UNIGRAM, BPE) or model.suffix_mark:
        raise ValueError("only unigram and BPE models with the marker in front are known")
    return model


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first; of one piece's splits, the earlier parts first."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL:
            splits = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
            found += [(-score, i, rank[a], rank[b], a, b) for a, b in splits]
    return [(a, b) for *_, a, b in sorted(found)]


def _user_tokens(model: PieceModel) -> list:
    from tokenizers import AddedToken

    return [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER]


def backend(model: PieceModel):
    """A tokenizers.Tokenizer for already marked text (see PieceCodec.keys)."""
    from tokenizers import Tokenizer, decoders, models

    names = [p for p, _, _ in model.pieces]
    if model.kind == BPE:
        core = models.BPE({p: i for i, p in enumerate(names)}, merges_of(model), unk_token=names[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    out = Tokenizer(core)
    out.add_tokens(_user_tokens(model))
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else steps)
    return out


class PieceCodec:
    """Encodes and decodes batches in this process; ``threads`` bounds the library's own threads."""

    def __init__(self, path: str, threads: int = 2, verify: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.tokenizer = backend(self.model)
        self.map = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.threads, self.verify = threads, verify
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        # a marker that only starts pieces lets every word be encoded alone
        self.chunked = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in self.model.pieces)
        names = [p for p, _, _ in self.model.pieces]
        # a line's end that is a byte of its own and in no piece lets every line be encoded alone, too
        self.lines = self.chunked and not verify and self.model.kind == BPE and self.model.byte_fallback and "<0x0A>" in names and not any("\n" in p for p in names)
        self.words = Tokenizer(self.tokenizer.model)  # the same, for words one after the other
        self.words.add_tokens(_user_tokens(self.model))
        self.words.pre_tokenizer = pre_tokenizers.Split(Regex(f"[{MARK}\n]") if self.lines else MARK, "merged_with_next")
        self.first = np.array([p.startswith(MARK) or self.lines and p == "<0x0A>" for p in names], bool)
        self.spelt = {i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace(MARK, " ").encode() for i, p in enumerate(names)}
        self.store = ChunkStore(self._learn)

    def normalised(self, text: str) -> str:
        if self.map:
            text = self.map.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return text

    def keys(self, text: str) -> list[str]:
        """Keys of a text for the store. Pieces never join a mark to what stands before it, so each word with its
        marks is encoded alone; a key that begins with a line's end has no mark."""
        text = self.normalised(text)
        if not text:
            return []
        if self.chunked and self.model.dummy_prefix and MARK not in text and text[0] != " " and text[-1] != " " and "  " not in text:
            return (text.replace("\n", " \n") if self.lines else text).split(" ")
        text = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        return [" " + c for c in (re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text) if self.chunked else [text])]

    def _agrees(self, chunks: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids for each chunk."""
        if not self.verify:
            return [True] * len(chunks)
        fronted = [c.startswith(MARK) for c in chunks]
        if self.model.dummy_prefix and all(fronted) and not self.model.squeeze:
            plain = [c[1:].replace(MARK, " ") for c in chunks]
            ok = [bool(p) for p in plain]  # a lone mark is no text of its own
            theirs = self.peer.encode([p for p, o in zip(plain, ok, strict=True) if o], num_threads=self.threads)
            theirs = iter(theirs)
            return [next(theirs) == mine if o else True for o, mine in zip(ok, ids, strict=True)]
        return [self.peer.encode(c) == mine or not self.chunked for c, mine in zip(chunks, ids, strict=True)]

    def _learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        literal = np.array([k[:1] == " " for k in keys])
        ids, counts = self._apart([k[1:] for k in keys if k[:1] == " "])
        if not literal.all():
            words = self._in_lines([k if self.lines and k[:1] == "\n" else MARK + k for k in keys if k[:1] != " "])
            ids, counts = merged(literal, [words, (ids, counts)])
        each = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if self.verify else []
        return ids, counts, self._agrees([k[1:] if k[:1] == " " else MARK + k for k in keys], each) if self.verify else [True] * len(keys)

    def _in_lines(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks whose one mark (or line's end) comes first, many in one text: only a chunk's first piece has it."""
        lines = ["".join(chunks[i : i + 256]) for i in range(0, len(chunks), 256)]
        ids, _ = flattened([x.ids for x in self.words.encode_batch_fast(lines, add_special_tokens=False)])
        first = np.flatnonzero(self.first[ids])
        if len(first) != len(chunks):  # a mark that is no piece
            return self._apart(chunks)
        return ids, np.diff(np.append(first, len(ids)))

    def _apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)  # a chunk is a word of one sequence
        return np.array(found.ids, np.int32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(chunks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after the other, how many each text has, and whether each text's chunks agree with the peer."""
        return self.store.lookup([self.keys(t) for t in texts])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self._text(x) for x in ids]

    def _text(self, ids: list[int]) -> str:
        """The pieces' own bytes in a row, which is what the library's decoder makes of them."""
        try:
            text = b"".join(map(self.spelt.__getitem__, ids)).decode()
        except (KeyError, UnicodeDecodeError):  # the library has a sign for bytes that are no text, and none for unknown ids
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


SCHEMA = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded_ok boolean, parity boolean"


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2, full_check: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, with the decoded text compared to the normalised one (in which a mark reads as a
    blank, as it does for every such model), in a narrow map.

    ``parity``: the ids are those that the sentencepiece library gives the whole text. Only if ``full_check`` is over 1, texts
    whose crc32 is not divisible by it are compared chunk by chunk instead. A null or empty text has no ids and is
    decoded to the empty text. Repeated rows repeat; extra columns are ignored. Memory follows the longest text.
    """
    own = ("piece-codec", model_path, threads, full_check > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.worker_keeps(own, lambda: PieceCodec(model_path, threads, full_check > 1))
        for batch in shared.steps(batches, 1, 1 << 20, own):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts, same = codec.encode(texts)
            ends = np.cumsum(counts)
            each = [ids[e - n : e] for e, n in zip(ends, counts, strict=True)]
            lists = [x.tolist() for x in each]
            decoded = [a == codec.normalised(b).replace(MARK, " ") for a, b in zip(codec.decode(lists), texts, strict=True)]
            whole = [i for i, t in enumerate(texts) if full_check == 1 or zlib.crc32(t.encode()) % full_check == 0]
            for i, theirs in zip(whole, codec.peer.encode_as_numpy([texts[i] for i in whole], num_threads=threads), strict=True):
                same[i] &= np.array_equal(theirs, each[i])
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()), pa.array(decoded), pa.array(same)], names=["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_ok", "parity"])

    return shared.texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of rows of ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.worker_keeps(("piece-codec", model_path, 2), lambda: PieceCodec(model_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.decode([x or [] for x in part.column(1).to_pylist()]), pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
