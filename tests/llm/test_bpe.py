import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import bpe
from plumbline.llm.bpe import decode, digests, encode, loaded, tokenizer_json

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OWN = loaded(tokenizer_json())


def wanted(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def got(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in OWN.encode([t.encode() for t in texts])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text(alphabet="ab 'st\n\té 　.1", max_size=300), max_size=6))
def test_any_text(texts):
    assert got(texts) == [wanted(t) for t in texts]


@pytest.mark.parametrize("chunk", [2, 8, 64])
def test_small_chunks(monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    parts = ["foo bar", "<|endoftext|>", "  ", " x", "don't", "\n\n ", "é à", "12 34", "a" * 50, " ", " ", "!?", "日本 語", "é\u00a0 x", "\u3000\t a", "語\n語", "\u2003\n", "x\x1c \x1f\n", "\x7f \r\n", "'s\t", "\u0085  "]
    texts = ["".join(parts[(i * j * 7 + j) % len(parts)] for j in range(1 + i * 5 % 70)) for i in range(200)]
    assert got(texts) == [wanted(t) for t in texts]
    assert OWN.decode(OWN.encode([t.encode() for t in texts])) == [LIBRARY.decode(wanted(t), skip_special_tokens=False) for t in texts]


def test_long_texts(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 1000)
    texts = ["a" * 100_000, " " * 5000, "word " * 40_000, "", "é" * 30_000]
    assert got(texts) == [wanted(t) for t in texts]


def test_text_without_spaces_is_cut_at_line_ends():
    text = "".join(chr(0x4E00 + i * i * i % 9973) + "\n" * (i % 40 == 39) for i in range(20_000))
    data = np.frombuffer(text.encode(), np.uint8)
    assert len(bpe.safe_places(data)) > 300 and len(bpe.chunk_ends(data)) > 5
    assert got([text]) == [wanted(text)]


def test_shared_chunks_are_encoded_once():
    OWN.forget()
    passage = " ".join(f"word{i}" for i in range(3000))
    got(["a start. " + passage])
    known = len(OWN.cache)
    got(["another beginning, longer than that. " + passage + " and an end"])
    assert known > 10 and len(OWN.cache) - known < 8


def test_cache_is_bounded_and_reused(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10_000)
    texts = [f"text number {i} and some more words of it" for i in range(3000)]
    assert got(texts) == [wanted(t) for t in texts]
    assert OWN.held < 20_000


def test_decode_of_broken_ids():
    assert OWN.decode([np.array([0x80, 200], "<u4").tobytes(), b""])[0] == LIBRARY.decode([0x80, 200], skip_special_tokens=False)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  wörld\n<|endoftext|> ok", "x"), (3, "Hello  wörld\n<|endoftext|> ok", "x"), (None, "z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {tuple(r) for r in digests(encode(docs)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert out == {(i, len(wanted(t or "")), sha(np.array(wanted(t or ""), "<u4").tobytes()), sha((t or "").encode())) for i, t, _ in rows}
    assert digests(encode(docs)).count() == 5
    assert digests(encode(docs.limit(0))).count() == 0
    assert {r.decoded for r in decode(encode(docs).select("ids")).collect()} == {"", "Hello  wörld\n<|endoftext|> ok", "z"}
