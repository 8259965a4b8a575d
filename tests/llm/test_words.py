import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ionloom.llm.words import shingles, words


def plain(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=list("abAB é日\t\n\x0b\x85\x1c"), max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_shingle_counts_equal_a_plain_split(texts):
    w = words(pa.array(texts, pa.string()))
    bounds = w.bounds()
    seen = {}
    for i, text in enumerate(texts):
        got = w.hash[bounds[i] : bounds[i + 1]].tolist()
        assert len(got) == len(plain(text))
        for word, h in zip(plain(text), got):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    for text, g in zip(texts, shingles(w)):
        p = plain(text)
        want = {tuple(p[i : i + 5]) for i in range(len(p) - 4)} if len(p) >= 5 else ({tuple(p)} if p else set())
        assert len(g) == len(want)


def test_blocks_and_slices_do_not_change_hashes():
    long = " ".join(f"w{i}" for i in range(100_000)) + " " + "x" * 600_000
    one = words(pa.array([long]))
    again = words(pa.array(["pad pad", long, "w0"]).slice(1, 2))
    assert one.hash.tolist() == again.hash.tolist()[:-1] and again.hash[-1] == one.hash[0]
