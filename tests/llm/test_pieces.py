import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ionloom.llm import pieces as module
from ionloom.llm.pieces import Pieces, decode, digests, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def ours():
    return Pieces.load(PATH)


TEXT = st.one_of(
    st.text(max_size=60),
    st.lists(st.sampled_from([*"ab eéß\n\t 日本語한▁𝔘\x00", "  ", "    ", "the", " President", "Donald", "www", "ing", "<s>", "<0x41>", "́"]), max_size=40).map("".join),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_ids_and_decoded_text_equal_the_library(ours, library, texts):
    got = ours.encode_batch(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == library.encode(text)
        assert ours.decode(ids).decode() == library.decode(ids.tolist())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=40), st.lists(st.text(alphabet="ab", min_size=2, max_size=5), max_size=12, unique=True), st.randoms())
def test_rounds_equal_single_merges_for_any_ranks(text, words, random):
    """Also where a longer piece ranks before its parts, and where pieces share a rank."""
    vocabulary = [f"<0x{i:02X}>" for i in range(256)] + ["a", "b", *words]
    scores = [0.0] * 256 + [-float(random.randint(1, 8)) for _ in vocabulary[256:]]
    made = Pieces.of(vocabulary, scores, [i >= 256 for i in range(len(vocabulary))], [i < 256 for i in range(len(vocabulary))])
    points = module._points(text)
    symbol, place = made.merge(points, np.zeros(min(len(text), 1), np.int64))
    single, kept = made._one_by_one(made.symbols(points)) if text else (symbol, slice(None))
    assert symbol.tolist() == single[kept].tolist()
    assert "".join(vocabulary[s] for s in symbol) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 258), max_size=20))
def test_any_ids_decode_as_in_the_library(ours, library, ids):
    assert ours.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_long_texts_in_blocks_and_long_segments(ours, library, monkeypatch):
    rng = np.random.default_rng(5)
    solid = "".join(rng.choice(list("abcdefghij0123456789+/"), 9000))
    texts = ["x" * 5000 + " " + solid, " " * 3000, "日本" * 3000, "\n".join(["word salad, far away."] * 900)]
    monkeypatch.setattr(module, "BLOCK", 700)
    for text in texts:
        assert np.concatenate(list(ours.blocks(text))).tolist() == library.encode(text)
    assert [x.tolist() for x in ours.encode_batch(texts)] == library.encode(texts)


def test_other_models_are_refused():
    names = [f"<0x{i:02X}>" for i in range(255)]
    with pytest.raises(ValueError):
        Pieces.of(names, [0.0] * 255, [False] * 255, [True] * 255)


def test_documents(spark, odd_docs, no_docs, library):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    rows = digests(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    there = decode(encode(odd_docs, PATH), PATH)
    assert there.columns == [*odd_docs.columns, "ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in there.collect())
    assert digests(no_docs, PATH).count() == 0 and encode(no_docs, PATH).count() == 0
    with pytest.raises(ValueError):
        encode(odd_docs, PATH, ids="score")
