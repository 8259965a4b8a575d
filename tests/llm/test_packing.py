import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ionloom.llm.packing import LENGTH, Encoder, balance, pack, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def encode():
    return Encoder(PATH, cache=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab'st  \n\t.,12é日　\x1c\x85²ªſ") + ["<|endoftext|>", "'ll", " re"]), max_size=40).map("".join))
def test_cached_encoding_equals_the_tokenizer(encode, reference, text):
    assert encode(text) == reference(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, LENGTH), max_size=200))
def test_balance_places_every_token_once_with_the_fewest_sequences(lengths):
    placed = balance(np.array(lengths, np.int64))
    total = {}
    for s in {p[3] for p in placed}:
        total[s] = sum(p[2] for p in placed if p[3] == s)
    assert all(t <= LENGTH for t in total.values()) and len(total) == -(-sum(lengths) // LENGTH)
    for item, n in enumerate(lengths):
        pieces = sorted(p[1:3] for p in placed if p[0] == item)
        assert sum(m for _, m in pieces) == n and all(a + m == b for (a, m), (b, _) in zip(pieces, pieces[1:]))


def test_costs_are_even():
    lengths = np.random.default_rng(1).integers(1, 400, 4000)
    cost = {}
    for _, _, n, s in balance(lengths):
        cost[s] = cost.get(s, 0) + n + n * n / 4096
    values = np.array(list(cost.values()))[:-1]
    assert values.std() < 0.05 * values.mean()


def test_pieces_cover_documents_and_sequences(spark, odd_docs, no_docs, reference):
    pieces = pack(odd_docs, PATH, with_ids=True, chunk_ids=3000)
    rows = [r.asDict() for r in pieces.collect()]
    by_doc = {}
    for r in rows:
        ids = bytes(r["ids"])
        assert zlib.crc32(ids) == r["ids_crc32"] and len(ids) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids))
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for doc, parts in by_doc.items():
        joined = b"".join(dict(sorted(parts)).values()) if doc != 1 else None
        if joined is not None:
            assert joined == reference(texts[doc]) + np.array([1], "<u4").tobytes()
    assert len(by_doc) == len(texts) and len(by_doc[1]) >= 2
    whole = sequences(pieces).collect()
    assert all(len(r["ids"]) == 4 * LENGTH for r in whole) and len(whole) == len({r["sequence_id"] for r in rows})
    assert pack(no_docs, PATH).count() == 0


def test_many_small_partitions_share_their_last_sequences(spark):
    docs = spark.createDataFrame([(i, f"short text number {i}") for i in range(300)], "doc_id long, text string").repartition(60)
    rows = pack(docs, PATH).collect()
    tokens = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= tokens // LENGTH + 2
