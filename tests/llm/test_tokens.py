"""Token files and BPE against the tokenizers library."""

import hashlib
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidentia.llm import bpe, token_binary

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "Hello  World\n\n x", "aaaa <|endoftext|>b <|startoftext|>", "ΣΑΣ İstanbul ﬁ é ᲀ", "a\x1cb\x85c d　e\x00", "漢字 🙂🙂 x²½ 12345", "it's WE'LL don’t", "word " * 5000, "ab" * 3000, "İKſ ß ǅ", "%%%$$$ |", "tab\there\r\n\r\n  end  "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "Hello  World\n\n x", None), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_bpe_query(docs):
    lib = Tokenizer.from_file(WORD)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len(e := lib.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()) for r in docs.collect())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(docs, WORD).collect())
    assert got == want
    assert bpe.digest(docs.limit(0), WORD).count() == 0


def test_bpe_columns(docs):
    lib = Tokenizer.from_file(WORD)
    for r in bpe.decode_column(bpe.encode_column(docs, WORD), WORD, to="back").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.back) == (ids, lib.decode(ids, skip_special_tokens=False)) and r.n_tokens in ("clash", None)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), st.sampled_from("aeinst 'İΣẞﬁ")), max_size=40))
def test_bpe_any(text):
    global codec, lib
    if "codec" not in globals():
        codec, lib = bpe.BpeCodec(WORD), Tokenizer.from_file(WORD)
    assert codec.encode(text) == lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x500, exclude_categories=["Cs"]), st.sampled_from("aeinst ' \n’")), max_size=40))
def test_byte_encoder_any(text):
    global coder, byte
    if "coder" not in globals():
        coder, byte = token_binary.ChunkEncoder(BYTE), Tokenizer.from_file(BYTE)
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == byte.encode(text, add_special_tokens=False).ids


def test_byte_encoder_meets_each_pretoken_once():
    coder, lib, seen = token_binary.ChunkEncoder(BYTE), Tokenizer.from_file(BYTE), []

    class Counted:
        def tokenize(self, piece, model=coder.model):
            seen.append(piece)
            return model.tokenize(piece)

    coder.model = Counted()
    texts = ["Zorble zorble, zorble.\nQuix zorble;\n\n zorble's <b> 12 zorble12", "Zorble quix, quix. zorble", "", "a|b < c <|x", "<|endoftext|> zorble"]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)]
        assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert len(seen) == len(set(seen)) and "Ġzorble" in seen and "Ġzorble," not in seen


def test_byte_encoder_takes_no_step_for_each_chunk():
    coder, lib, steps = token_binary.ChunkEncoder(BYTE), Tokenizer.from_file(BYTE), 0

    def text(words):
        return " ".join(f"{a}.{b};{c}" for a in words for b in words for c in words)

    def step(frame, event, arg):
        nonlocal steps
        steps += event.endswith("call")

    # 27,000 distinct chunks, of which a few pre-tokens make all
    words = [f"zorb{chr(97 + k)}" for k in range(26)] + ["élan", "x's", "ll", "12"]
    coder.encode([text(words[:2]), *(f"{w}.{w} {w};{w}" for w in words)])
    texts = [text(words), "", "zorba"]
    sys.setprofile(step)
    try:
        got = coder.encode(texts)
    finally:
        sys.setprofile(None)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert steps < 1000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x500, exclude_categories=["Cs"]), st.sampled_from("stmdrevl ''\n\t\xa0.1’")), max_size=30), max_size=8))
def test_byte_encoder_forgets(texts):
    global forgetful, byte
    if "forgetful" not in globals():
        forgetful, byte = token_binary.ChunkEncoder(BYTE), Tokenizer.from_file(BYTE)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_binary, "CACHE_PIECES", 6)
        patch.setattr(token_binary, "BATCH_CHARS", 7)
        got = [np.frombuffer(x, "<u4").tolist() for x in forgetful.encode(texts)]
        assert got == [e.ids for e in byte.encode_batch(texts, add_special_tokens=False)]
        forgetful.encode([""])
        forgetful.encode([""])
        assert len(forgetful.places) == len(forgetful.size) <= 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_pack(ranks):
    r = np.array(ranks, np.uint32)
    control, data = token_binary.pack(r)
    assert len(control) == -(-len(r) // 4) and token_binary.unpack(control, data, len(r)).tolist() == ranks


@pytest.mark.parametrize("block", [1 << 21, 50])
def test_token_files(docs, monkeypatch, block):
    monkeypatch.setattr(token_binary, "BLOCK_TOKENS", block)
    lib, at, want = Tokenizer.from_file(BYTE), 0, []
    for r in sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "")):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_binary.round_trip(docs, BYTE).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_token_files_damage_and_empty(docs):
    with pytest.raises(ValueError):
        token_binary.parse_file(b"".join(token_binary.file_bytes(0, np.array([1]), np.array([1]), np.array([2]), np.array([5, 900], np.uint32)))[:-1])
    assert token_binary.round_trip(docs.limit(0), BYTE).count() == 0
