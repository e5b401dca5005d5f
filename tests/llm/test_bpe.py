from __future__ import annotations

import base64
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gramforge.llm import encode
from gramforge.llm.bpe import LONG, PATTERN, TOKENIZER_DIR, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")

ODD = [
    None, "", "a", "\n", " ", "   ", "a" * 5000, " " * 3000, "aAbB" * 300, "日本語" * 200, "😀" * 100, "<|endoftext|> x", "x" * LONG,
    "y" * (LONG + 1), "ab" * 96, "don't  we'll\r\n\t x", "é​", "\x00\x01",
]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _same(reference, texts):
    ids, offsets = encoder().encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == (reference.encode_ordinary(t) if t else []), repr(t)
    assert (encoder().count(texts) == np.diff(offsets)).all()


def test_odd_texts(reference):
    _same(reference, ODD)


@given(st.lists(st.text(max_size=300), max_size=8))
@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_text(reference, texts):
    _same(reference, texts)


@given(st.lists(st.text(st.characters(max_codepoint=127), max_size=200), max_size=8))
@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_ascii_text(reference, texts):
    _same(reference, texts)


def test_pieces_beyond_the_matrices(reference):
    rng = np.random.default_rng(1)
    _same(reference, ["".join(rng.choice(list("abcdeé"), n)) for n in (190, 192, 193, 300, 2000)])


def test_cache_is_bounded(reference, monkeypatch):
    from gramforge.llm import bpe

    monkeypatch.setattr(bpe, "_CACHE", 10)
    for k in range(5):
        _same(reference, [f"word{k} other{k} third{k}" * 3])


def test_documents(spark, reference):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (None, "hello world", "z"), (1, "hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode.encode_documents(docs)
    assert got.columns == ["doc_id", "ids"]
    hello = reference.encode_ordinary("hello world")
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == sorted([(1, hello), (2, []), (3, []), (None, hello), (1, hello)], key=str)
    counts = {r.doc_id: r.n_tokens for r in encode.count_tokens(docs).where("doc_id > 1").collect()}
    assert counts == {2: 0, 3: 0}
    assert encode.encode_documents(docs.limit(0)).collect() == []


def test_slices_by_bytes():
    import pyarrow as pa

    texts = pa.array(["aa", None, "b" * 10, "c", "d"])
    assert list(encode.slices(texts, 4)) == [(0, 2), (2, 3), (3, 5)]
    assert list(encode.slices(pa.array([], pa.string()))) == []
