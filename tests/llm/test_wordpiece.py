import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionloom.llm.packing import load_vocabulary
from ionloom.llm.wordpiece import Automaton, greedy_pieces, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
BYTES = {bytes([b]) for b in range(256)}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=30), st.lists(st.integers(97, 99), max_size=40))
def test_counts_equal_longest_match_for_any_vocabulary(pieces, word):
    vocabulary = BYTES | pieces
    assert Automaton(vocabulary).count(bytes(word)) == len(greedy_pieces(bytes(word), vocabulary))


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        Automaton({b"a", b"ab"})


def test_documents(spark, odd_docs, no_docs):
    vocabulary = set(load_vocabulary(PATH))
    out = {r["doc_id"]: r for r in token_counts(odd_docs, PATH).collect()}
    for r in odd_docs.collect():
        words = (r["text"] or "").split()
        pieces = [len(greedy_pieces(b" " + w.encode(), vocabulary)) for w in words]
        got = out[r["doc_id"]]
        assert (got["n_words"], got["n_tokens"], got["most_tokens_of_a_word"]) == (len(words), sum(pieces), max(pieces, default=0))
    assert token_counts(no_docs, PATH).count() == 0
