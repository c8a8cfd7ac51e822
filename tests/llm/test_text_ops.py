"""Map-style operators against brute force, round trips and edge rows."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import SF, check
from termweave.llm import chunk_store, compression_bands, kernel_langid, packed_ids, page_layout, perspectives, piece_codec, queries, shared, wordhash

EDGE = [(0, None), (1, ""), (2, "one two three"), (3, "Ünï cödé " * 40), (4, "x" * 3000), (4, "x" * 3000), (5, " \t\n\r\x0b\x0c "), (6, "\x00     z"), (None, "no id"), (7, "a b\n" * 500)]


def frame(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in rows], "doc_id long, text string, lang string, score string, n_words int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_of_many_texts():
    texts = [t for _, t in EDGE] + ["b a", "a"]
    hashes, counts = wordhash.words_of(pa.array(texts, pa.string()))
    expected = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    names = {}
    assert all(names.setdefault(w, h) == h for w, h in zip(expected, hashes.tolist(), strict=True)) and len(set(names.values())) == len(names)


def repeated(w, n=8):
    seen = {}
    for i in range(len(w) - n + 1):
        seen.setdefault(tuple(w[i : i + n]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)})


def base(text):
    w, lines = words(text), (text or "").split("\n")
    told = [x for x in lines if words(x)]
    n, again = len(w), repeated(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(told) - len(set(told)), again, n < 20 or 100 * again > 30 * n


def test_compression_bands(spark):
    import zstandard

    rng = random.Random(2)
    rows = EDGE + [(20 + i, " ".join(rng.choice("ab cd ef gh#|".split()) for _ in range(rng.randint(0, 60))) + "\n" * i) for i in range(10)]
    got = compression_bands.compression_quality(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = sorted((str(i), *base(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    bands = compression_bands.Bands()
    for r in got:
        text = dict(rows)[r.doc_id]
        data = (text or "").encode()
        if not r.base_failed:
            pack = zstandard.ZstdCompressor(level=3, write_content_size=False)
            assert r.ratio == len(pack.compress(data)) / len(data)
        assert not (r.kept and r.base_failed)
    assert compression_bands.compression_quality(frame(spark).limit(0)).count() == 0
    assert not compression_bands.verdicts(0.01, [], 5000, bands) and not compression_bands.verdicts(0.99, [], 5000, bands) and compression_bands.verdicts(0.4, [0.4, 0.5], 9000, bands)
    assert not compression_bands.verdicts(0.4, [0.01, 0.5], 9000, bands)


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice(["ta", "ren", "is", "mo", "lu", "dor", "e", "na"]) for _ in range(rng.randint(1, 4))) for _ in range(400))
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(60))
    stutter = " ".join(w for w in prose.split(" ")[:40] for _ in range(6))  # no window of eight words twice
    rows = [(4, stutter), (5, prose[:300]), (6, prose[:700]), (7, noise), (1, prose), (2, "word again " * 300), (3, "".join(rng.choice([chr(c) for c in range(33, 126)]) for _ in range(20000)) + " z" * 5 + prose[:150])]
    got = {r.doc_id: r.kept for r in compression_bands.compression_quality(frame(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False}


def langs(n=60, seed=0):
    rng = random.Random(seed)
    kinds = {"xx": "ka ko ku mi ro".split(), "yy": "sch pf ung ein ter".split(), "zz": "ção não lhe que os".split()}
    return [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 4))) for _ in range(30)), k) for i in range(n) for k in [rng.choice(sorted(kinds))]]


def test_language_id(spark):
    train = spark.createDataFrame([(i, t, k) for i, t, k in langs()] + [(900, None, "xx"), (901, "text", None), (902, "12 34", "xx")], "doc_id long, text string, lang string")
    model = kernel_langid.train(train, kernel_langid.KernelParams(per_language=15, landmarks=12))
    assert model.languages == ("xx", "yy", "zz") and model.landmarks.shape[1] == 12
    test = langs(40, 1)
    rows = [(i, t, "en", "clash", 1) for i, t, _ in test] + [(100, None, "", "", 0), (101, "", "", "", 0), (102, "12 !?", "", "", 0)]
    got = kernel_langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_words int"), model)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "lang_pred", "score"]
    found = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert sum(found[i][0] == k for i, _, k in test) >= 38 and all(0 <= s <= 1 for _, s in found.values())
    assert found[100] == found[101] == found[102] == ("und", 0.0)
    empty = kernel_langid.train(train.limit(0))
    assert {r.lang_pred for r in kernel_langid.predict(train, empty).collect()} == {"und"}


def test_letters_of_all_planes(spark):
    """Emoji and musical signs are no letters; letters beyond the first plane are."""
    p = kernel_langid.KernelParams()
    x = np.zeros(kernel_langid.buckets(p), np.float32)
    assert [kernel_langid.presence(t, p, x) for t in ("🤖🤖", "𝄞 🎵", "12", "𐐷", "𠀀", "é")] == [False, False, False, True, True, True]


def test_copies_do_not_fill_the_sample(spark):
    """A text of very many copies is learned from once, and no more rows than the bound reach the driver."""
    rows = langs(90) + [(1000 + k, "ka ko ku mi ro ka", "xx") for k in range(3000)]
    p = kernel_langid.KernelParams(per_language=20, landmarks=9)
    plain = kernel_langid.train(spark.createDataFrame(langs(90) + [(1000, "ka ko ku mi ro ka", "xx")], "doc_id long, text string, lang string"), p)
    many = kernel_langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), p)
    assert many.languages == plain.languages and np.array_equal(many.landmarks, plain.landmarks) and np.allclose(many.weights, plain.weights)
    wide = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} text", f"l{k:03d}") for k in range(300)]
    assert len(kernel_langid.train(spark.createDataFrame(wide, "doc_id long, text string, lang string"), p).languages) == 300


def test_predictions_by_direct_ridge(spark):
    """Landmarks that are all of the sample make the method plain kernel ridge regression: solved directly here."""
    rows = langs(24)
    p = kernel_langid.KernelParams(per_language=50, landmarks=50)
    model = kernel_langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), p)
    grams = lambda t: {(n, t[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1)}
    clean = lambda t: re.sub(r"[^\w]+", " ", t.lower())
    sets = [grams(clean(t)) for _, t, _ in rows]
    inner = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[inner(a, b) for b in sets] for a in sets])
    names = sorted({x for *_, x in rows})
    y = np.array([[1.0 if x == n else -1.0 for n in names] for *_, x in rows])
    weight = np.array([1 / (len(names) * np.mean([z == x for *_, z in rows])) for *_, x in rows])
    weight /= weight.sum()
    # features and targets are centred by weighted means; the kernel of centred features follows from the plain one
    mean_y, toward = weight @ y, k @ weight
    centred = k - toward[:, None] - toward[None, :] + weight @ toward
    solved = np.linalg.solve(centred * weight[None, :] * len(rows) + p.ridge * len(rows) * np.eye(len(rows)), y - mean_y)
    test = langs(30, 5)
    want = []
    for _, t, _ in test:
        row = np.array([inner(grams(clean(t)), s) for s in sets])
        row = row - row @ weight - toward + weight @ toward
        want.append(names[int((row * weight * len(rows) @ solved + mean_y).argmax())])
    got = {r.doc_id: r.lang_pred for r in kernel_langid.predict(spark.createDataFrame([(i, t) for i, t, _ in test], "doc_id long, text string"), model).collect()}
    assert [got[i] for i, _, _ in test] == want


def test_kernel_by_sets():
    p = kernel_langid.KernelParams(step_chars=7)
    texts = ["abc abd", "abd xyz, ab", "zzz"]
    x = np.zeros((3, kernel_langid.buckets(p)), np.float32)
    for i, t in enumerate(texts):
        kernel_langid.presence(t, p, x[i])
    grams = [{(n, t2[k : k + n]) for t2 in [re.sub("[^a-z]+", " ", t)] for n in (1, 2, 3) for k in range(len(t2) - n + 1)} for t in texts]
    k = kernel_langid.kernel(x, x.sum(1), x.T, x.sum(1))
    for a in range(3):
        for b in range(3):
            assert k[a, b] == pytest.approx(len(grams[a] & grams[b]) / math.sqrt(len(grams[a]) * len(grams[b])), abs=1e-6)


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op2_kernel_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("width", [1, 3, 8, 11, 15, 16, 17, 31, 32])
def test_bit_packing(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    data = packed_ids.pack(ids, width)
    assert len(data) == (1000 * width + 7) // 8
    assert (packed_ids.unpack(data, 1000, width) == ids).all() and (packed_ids.unpack(data, 77, width, 123) == ids[123:200]).all()


def test_widths():
    assert [packed_ids.width_of(v) for v in (1, 2, 3, 256, 257, 50_257, 32_000)] == [1, 1, 2, 8, 9, 16, 15]


def test_shards_random_access(tmp_path):
    rng = np.random.default_rng(1)
    lengths = [0, 5, 4000, 1, 9000, 0, 3]
    parts = [rng.integers(0, 32_000, n).astype(np.uint32) for n in lengths]
    with open(tmp_path / "s.bin", "wb") as out:
        packed_ids.write_shard(out, [None, 1, 2, 3, 4, 5, 6], lengths, iter(parts), 15, 512)
    with open(tmp_path / "s.bin", "rb") as f:
        shard = packed_ids.ShardReader(f)
        for k in (4, 0, 6, 2, 1, 5, 3):
            assert (shard.document(k) == parts[k]).all()
    (tmp_path / "x.bin").write_bytes(b"something else entirely")
    with open(tmp_path / "x.bin", "rb") as f, pytest.raises(ValueError):
        packed_ids.ShardReader(f)


@pytest.mark.parametrize("vocabulary", [None, 100_000])  # as the file has it: 16 bits; 17 bits
def test_token_files_against_whole_texts(spark, vocabulary):
    """Null and repeated ids, added tokens inside texts, many small shards."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(3)
    odd = ["<|endoftext|>", " ", "a", "it's", "\n", "  ", "<|endof", "text|>", "é", "12"]
    rows = [*EDGE, (9, "a\n b  c\td <|endoftext|> it's 12"), (8, "日本語 テスト　x 🤖"), (11, " lead"), (10, "trail "), (None, None), (4, "other text"), (12, "<|endoftext|>")]
    rows += [(20 + k, "".join(rng.choice(odd) for _ in range(rng.randint(1, 15)))) for k in range(60)]
    got = packed_ids.write_and_read(spark, frame(spark, rows), path, vocabulary, shard_ids=500, block=64).collect()
    want = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    digest = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), *digest(ids)) for i, ids in want)
    inside = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in inside]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in inside] == np.cumsum([0, *[r.n_tokens for r in inside]])[:-1].tolist()
    assert packed_ids.vocabulary_of(path) == 50_257
    assert packed_ids.write_and_read(spark, frame(spark, [(1, "a")]).limit(0), path).count() == 0


def test_chunks_end_at_lines_and_signs():
    """The library's ids of whole texts; lines share their words, and of known words with new signs only the signs are encoded."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encoder = Tokenizer.from_file(path), packed_ids.ChunkEncoder(path)
    rng = random.Random(8)
    bits = ["word", "The", "été", "ǅ", "e\u0301", "日本", " ", " ", "\n", "\n", "\t", "\u2028", "'", "'s", "'ll", ".", ",", "!!", "$$$$", "_", "7", "<|endoftext|>", "×", "😀", "\x1c"]
    for _ in range(20):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(100)]
        texts += [t.replace("\t", "").replace("\u2028", "").replace("\x1c", "").replace("<|endoftext|>", "") for t in texts]
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert encoder.keys("two lines\nof words") == [" two", "lines", "\nof", "words"]
    ids = encoder.encode(["a zebrawordy b\nzebrawordy"])[0]
    assert all(k in encoder.store.known for k in ("zebrawordy", "\nzebrawordy"))
    encoder.tokenizer = Only(whole, lambda t: "zebra" not in t)
    text = "a zebrawordy!, b\nzebrawordy."
    assert encoder.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids and len(ids)


class Only:
    """A tokenizer for texts that pass."""

    def __init__(self, tokenizer, passes):
        self.tokenizer, self.passes = tokenizer, passes

    def encode_batch_fast(self, texts, add_special_tokens):
        assert all(map(self.passes, texts))
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_workers_keep_only_what_the_stage_uses():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None])], names=["text"])
    once = shared.worker_keeps(("one",), object)
    assert len(list(shared.steps(iter([batch]), 0, 10, ("one",)))) == 1 and shared.worker_keeps(("one",), object) is once
    other = shared.worker_keeps(("two",), object)
    assert list(shared._kept.values()) == [other]
    list(shared.steps(iter([batch]), 0))
    assert not shared._kept


def test_chunk_store_beyond_its_limit():
    calls = []
    store = chunk_store.ChunkStore(lambda keys: (calls.append(list(keys)), (*chunk_store.flattened([[len(k), 7] for k in keys]), [k != "bad" for k in keys]))[1], limit=2)
    for _ in range(2):
        ids, counts, ok = store.lookup([["a", "bb", "a"], [], ["bad", "ccc"]])
        assert ids.tolist() == [1, 7, 2, 7, 1, 7, 3, 7, 3, 7] and counts.tolist() == [6, 0, 4] and ok.tolist() == [True, True, False]
    store.lookup([["new"]])
    store.lookup([["new"]])
    assert calls[-2:] == [["new"], ["new"]]  # no room: encoded again, and right


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def model_bytes(kind, pieces):
    import struct

    body = b""
    for p, s, t in pieces:
        x = b"\x0a" + varint(len(p.encode())) + p.encode() + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(t)
        body += b"\x0a" + varint(len(x)) + x
    trainer = b"\x18" + varint(kind) + b"\x98\x02\x01" + b"\xc0\x02\x00"
    norm = b"\x0a\x08identity" + b"\x18\x01\x20\x00"
    return body + b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(norm)) + norm


@pytest.mark.parametrize("kind", [piece_codec.UNIGRAM, piece_codec.BPE])
def test_small_models_agree_with_the_peer(tmp_path, kind):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    own = ["▁", "a", "b", "c", "ab", "▁a", "bc", "▁ab", "abc", "▁b", "ca"]
    pieces += [(p, -1.0 - i / 3, 1) for i, p in enumerate(own)]
    (tmp_path / "m.model").write_bytes(model_bytes(kind, pieces))
    codec = piece_codec.PieceCodec(str(tmp_path / "m.model"))
    assert codec.model.kind == kind and codec.model.byte_fallback
    rng = random.Random(4)
    texts = ["", "abc", " a  b", "é a", "cab abc\nab"] + ["".join(rng.choice("abc  é") for _ in range(rng.randint(0, 25))) for _ in range(80)]
    ids, counts, ok = codec.encode(texts)
    ends = np.cumsum(counts)
    mine = [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    assert mine == codec.peer.encode(texts) and ok.all()
    assert codec.decode(mine) == [codec.normalised(t) for t in texts]


def test_piece_codec_query(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [*EDGE, (30, "▁ a▁b"), (31, "  many   blanks "), (32, "<s> hi </s> <0x41>")]
    got = piece_codec.encode_documents(frame(spark, rows), path, full_check=1).collect()
    peer = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), peer.encode(t or "")) for i, t in rows)
    assert all(r.parity and r.decoded_ok for r in got)
    back = {r.doc_id: r.text for r in piece_codec.decode_documents(spark.createDataFrame(got), path).collect()}
    assert back[2] == "one two three" and back[0] == ""


def test_parity_is_of_every_whole_text(spark, tmp_path):
    """A piece over a blank (no chunks) and one made of an unused piece, which only the peer builds: its texts are no match."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, -1.0 - i, 5 if p == "ab" else 1) for i, p in enumerate(["ab", "abc", "▁", "a", "b", "c", "a▁b"])]
    path = str(tmp_path / "m.model")
    (tmp_path / "m.model").write_bytes(model_bytes(piece_codec.BPE, pieces).replace(b"\x18\x01\x20\x00", b"\x18\x01\x20\x01"))
    peer = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in enumerate(["abc", "a b", "cc abc", "ab", "c a b", "abc abc", None])]
    got = {r.doc_id: r for r in piece_codec.encode_documents(frame(spark, rows), path).collect()}
    assert {i: r.parity for i, r in got.items()} == {i: got[i].ids == peer.encode(t or "") for i, t in rows}
    assert {r.parity for r in got.values()} == {True, False}


def test_lines_are_encoded_alone_and_pieces_joined(monkeypatch):
    """Line ends at all places give the peer's ids, and no key goes over one; the library decodes only bytes that are no text."""
    import public_tokenizers

    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"), verify=False)
    rng = random.Random(6)
    texts = ["one\ntwo one", "\n", "\n\n a", "a \n b", "a\n", " \na", "\r\nc", "x▁\ny", "é\n日"] + ["".join(rng.choice(["a", "the", "\n", " ", "é", "日", "\t", "▁", "."]) for _ in range(rng.randint(1, 20))) for _ in range(400)]
    ids, counts, _ = codec.encode(texts)
    mine = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert mine == codec.peer.encode(texts)
    assert codec.keys("one\ntwo one") == ["one", "\ntwo", "one"]
    some = [[rng.choice([rng.randrange(len(codec.model.pieces)), *mine[8]]) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    some += [[], [10**6], [ids[0], 10**6, ids[0]]]
    assert codec.decode(some) == [codec.tokenizer.decode(x, skip_special_tokens=False) for x in some]
    monkeypatch.setattr(codec, "tokenizer", None)
    assert codec.decode(mine) == [codec.normalised(t).replace("▁", " ") for t in texts]


def test_perspectives_same_as_sql(spark):
    check(spark, queries.QUERIES["op4_perspectives"], perspectives.SQL)


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, None, "x"), (2, 0, "system", "alone"), (None, 5, "ann", "lost"), (1, 70, "ann", "late"), (1, None, "bob", "early")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = perspectives.rotate(df).collect()
    one = {(r.perspective, r.part): r for r in got if r.conv_id == 1}
    assert {p for p, _ in one} == {"ann", "bob", "unknown"} and not any(r.conv_id == 2 for r in got)
    ann = one["ann", 0]
    assert ann.text.startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n") and ann.n_turns == 4
    for r in got:
        for span in filter(None, r.target_spans.split(",")):
            a, b = map(int, span.split(":"))
            assert r.text[:a].endswith("<|assistant|>\n") and r.text[a:b].endswith("<|end|>\n")
    assert one["bob", -1].text == "<|assistant|>\nearly<|end|>\n" and one["bob", 1].target_spans == ""
    assert perspectives.rotate(df.limit(0)).count() == 0
    assert "Python" not in perspectives.rotate(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt; 5 < 6", "plain <b> 5 < 6"),
        ("<title>t</title><body><p>one<p>two", "one\n\ntwo"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
        ("<div>x</div><div hidden>y</div><div style='display: none'>z</div><span aria-hidden=true>q</span>w", "x\nqw"),
        ("<style>.ad, #k {display:none}</style><p class='big ad'>no</p><p id=k>no</p><p>yes</p>", "yes"),
        ("<table><tr><td>ab<td>c<tr><td>d<td>eee<br>f</table>", "ab | c\nd  | eee\n   | f"),
        ("<table><tr><th colspan=2>head<tr><td>a<td>b</table>", "head\na | b"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<pre> x\n   y</pre>", " x\n   y"),
        ("a<script>var x='<p>';</script>b<!-- c -->d<![CDATA[e]]>", "abde"),
        ("x   \n y<b> z</b>", "x y z"),
        ("<p>a</div>b</p></p>", "ab"),
        ("<a href='x", "<a href='x"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>x<tr><td>c<td>y</table>", "a | b   | x\nc |  |  | y"),
        ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</div>", "yes"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility: visible'>yes</ul>", "- yes"),
        ("<textarea>a\nb</textarea><select><option>c<option selected>d</select><input value=e><input type=hidden value=f><input type=checkbox value=g>", "a b d e"),
        ("<select multiple><option>c<option>d</select>", "c d"),
        ("<svg><title>no</title><text>yes</text></svg><math><mi>x</mi></math>", "yesx"),
        ("<style>@media print { .x {display:none} } @media (max-width: 600px) {p {display:none}}</style><p class=x>a", "a"),
        ("<style>@media screen and (min-width:800px) { .x {display:none} } @font-face {src: x} b{color:red}</style><p class=x>a</p>b", "b"),
        ("<style>.x {visibility: hidden; color: red} .y {visibility: visible}</style><p class=x>a<b class=y>c</b></p>", "c"),
    ],
)
def test_pages(page, text):
    assert page_layout.extract(page)[0] == text


def test_deep_and_long_pages():
    assert page_layout.extract("<div>" * 5000 + "deep")[0] == "deep"
    for depth in (250, 2500):
        assert page_layout.extract("<div>" * depth + "<div hidden>secret<div>more</div></div>seen")[0] == "seen"
    assert page_layout.extract("<p>w</p>" * 20000)[0].count("w") == 20000
    assert page_layout.extract('<a "' * 2000)[0]


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (None, None, None, None), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in page_layout.extract_pages(df).collect()) == [("1", "a"), ("1", "a"), ("None", "")]
    assert queries.QUERIES["op7_page_layout"](spark, SF).where("n_chars > 0").count() > 0


def test_empty_tables_and_very_long_texts(spark):
    """Maps over texts of over a megabyte, and over nothing."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    long = "plain words and more of them, again " * 40_000
    rows = [(1, long), (2, "short text of a few words")]
    train = spark.createDataFrame(langs(), "doc_id long, text string, lang string")
    model = kernel_langid.train(train)
    assert kernel_langid.predict(frame(spark).limit(0), model).count() == 0
    assert len(kernel_langid.predict(frame(spark, rows), model).collect()) == 2
    pages = spark.createDataFrame([(1, "<p>" + long + "</p>")], "page_id long, html string")
    assert page_layout.extract_pages(pages.limit(0)).count() == 0
    assert page_layout.extract_pages(pages).first().n_chars == len(long) - 1
    assert piece_codec.encode_documents(frame(spark).limit(0), path).count() == 0
    encoded = {r.doc_id: r for r in piece_codec.encode_documents(frame(spark, rows), path).collect()}
    assert all(r.decoded_ok and r.parity for r in encoded.values()) and encoded[1].n_tokens > 100_000
    quality = {r.doc_id: r for r in compression_bands.compression_quality(frame(spark, rows)).collect()}
    assert quality[1].n_words == 280_000 and not quality[1].kept
    files = {r.doc_id: r.n_tokens for r in packed_ids.write_and_read(spark, frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert files[1] > 100_000 and len(files) == 2
