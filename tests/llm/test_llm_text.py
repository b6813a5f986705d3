"""Text arrays, token encoders and files against the libraries themselves."""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import _text as X
from lodestone.llm import sentencepiece_bpe as piece
from lodestone.llm import token_store as store

P = pytest.importorskip("public_tokenizers")
PIECE, BYTE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "é", "漢字", "😀", "▁", "<s>", "<|endoftext|>", "\0", "\t", "aaaa", "tion", "　", "\xa0", "ﬁ", "0", "12", "==", "'s", "'re", "'", "!?", "ing", "\r\n", "\x85"]
texts = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_piece_ids(batch):
    enc = piece.Encoder.of(PIECE)
    ids = enc.encode(batch)
    assert [x.tolist() for x in ids] == enc.bpe.lib.encode(batch)
    assert enc.decode(ids) == [enc.bpe.lib.decode(x.tolist()) if len(x) else "" for x in ids]


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_byte_ids(batch):
    assert [x.tolist() for x in store.ByteEncoder.of(BYTE).encode(batch)] == [x.ids for x in _library().encode_batch(batch, add_special_tokens=False)]


@functools.cache
def _library():
    """The library as it comes, apart from the encoder's own object."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def test_added_tokens():
    got = [x.tolist() for x in store.ByteEncoder.of(BYTE).encode(["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|>", "<|endoftext", None])]
    assert got == [_library().encode(t, add_special_tokens=False).ids for t in ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|>", "<|endoftext", ""]]
    assert got[0] == [50256]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "漢" * 2000, " " * 3000, "x1" * 40000, "\n" * 3000, "the " * 20000])
def test_long_texts(text):
    a, b = piece.Encoder.of(PIECE), store.ByteEncoder.of(BYTE)
    assert a.encode([text, None, ""])[0].tolist() == a.bpe.lib.encode(text)
    assert b.encode([text])[0].tolist() == b.lib.encode(text, add_special_tokens=False).ids


def test_cache_starts_anew(monkeypatch):
    enc = piece.Encoder(PIECE)
    enc.cache.most = 3
    for t in ["one two three four five", "six seven", "one two", "six six one"]:
        assert enc.encode([t])[0].tolist() == enc.bpe.lib.encode(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**64 - 1), st.just(2**60 - 1)), max_size=3000))
def test_simple8b(values):
    x = np.array(values, np.uint64)
    words, offsets = store.pack(x)
    assert (store.unpack(words) == x).all() and (store.unpack(words, offsets) == x).all() and len(offsets) == -(-len(x) // store.BLOCK)
    for a, b in ((0, 1), (1, 3), (2, 9)):  # any range of blocks
        assert (store.unpack(words, offsets, a, b) == x[a * store.BLOCK : b * store.BLOCK]).all() if a < len(offsets) else True
    ends = np.array(sorted({len(x) // 3, len(x) // 2, len(x)}), np.int64)
    for blocks in (1, 2):
        assert np.concatenate(list(store.documents(words, offsets, ends, blocks)) or [x]).tolist() == x.tolist()
    for k, a in enumerate(offsets.tolist()):  # blocks stand alone
        b = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        assert (store.unpack(words[a:b]) == x[k * store.BLOCK : (k + 1) * store.BLOCK]).all()


def test_simple8b_is_dense():
    assert len(store.pack(np.zeros(2400, np.uint64))[0]) <= 30
    assert len(store.pack(np.full(1024, 50256, np.uint64))[0]) == 342


def test_span_hashes_tell_words_apart():
    cp, starts = X.flat(["ab ba ab", "ab", "x" * 3000 + " " + "x" * 3001])
    s, e, first = X.words(cp, starts)
    h = X.span_hashes(cp, s, e)
    assert h[0] == h[2] == h[3] and len(set(h.tolist())) == 4 and first.tolist() == [0, 3, 4, 6]


DOCS = [(3, "hello world", "x"), (1, None, "x"), (2, "", "x"), (9, "the " * 3000, "x"), (7, "same", "x"), (7, "same", "x"), (None, "no id", "x"), (2**60 + 1, "far", "x")]


def _docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_digests(spark):
    got = {r.doc_id: r for r in piece.digests(_docs(spark), PIECE).collect()}
    lib = piece.Encoder.of(PIECE).bpe.lib
    for i, t, _ in DOCS:
        ids = lib.encode(t or "")
        r = got[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest() if ids else True
    assert piece.digests(_docs(spark).where("false"), PIECE).count() == 0
    assert {tuple(r.ids): r.decoded for r in piece.encode_texts(_docs(spark), PIECE).collect()}[tuple(lib.encode("same"))] == "same"


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_tokens(_docs(spark), path, BYTE, chunk_docs=2)
    lib, start = _library(), 0
    got = sorted(store.read_checksums(spark, path).collect(), key=lambda r: r.start)
    for r, (i, t, _) in zip(got, sorted(DOCS, key=lambda d: (d[0] is not None, d[0]))):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(len(r.ids) for r in store.read_tokens(spark, path).collect()) == sorted(r.n_tokens for r in got)
    for i, t, _ in DOCS:
        if i is not None:
            found = [r.ids for r in store.read_document(spark, path, i).collect()]
            assert found == [[*lib.encode(t or "", add_special_tokens=False).ids, 0]] * sum(d[0] == i for d in DOCS)
    store.write_tokens(_docs(spark).where("false"), str(tmp_path / "e"), BYTE)
    assert store.read_tokens(spark, str(tmp_path / "e")).count() == 0
