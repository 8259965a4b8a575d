import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionloom.llm.frames import Frames, Rules, arrange, choose, digests, draws, read, restore, select, store, transform

UNITS = re.compile(r"[^\n]*\n|[^\n]+")
TEXT = st.lists(st.sampled_from(["a", "é", "日本", "\n", "\n\n", " ", "<", ">", "<P", "S>", "x" * 9, "line of words\n"]), max_size=30).map("".join)


def plainly(text, doc_id, rules):
    """Output, form and lengths by the definition, on the whole text."""
    units = UNITS.findall(text)
    h1, h2, h3, h4 = (int(hashlib.sha256(f"{rules.seed}:{doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rules.rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h4 % 100 < rules.suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=500, deadline=None)
@given(TEXT, st.integers(0, 40), st.sampled_from([Rules(), Rules(3, 60, 20)]), st.integers(1, 12))
def test_output_and_rebuilt_text_at_any_frame_size(text, doc_id, rules, size):
    frames = Frames([text], size)
    n, form, prefix, middle, output = plainly(text, doc_id, rules)
    marked = any(m in text for m in ("<P>", "<S>", "<M>"))
    cut = choose(frames, marked, doc_id, rules)
    assert (frames.n_units, frames.n_chars, cut.form) == (n, len(text), form)
    assert "".join(arrange(frames, cut)) == output
    if form != "plain":
        assert (cut.prefix, cut.middle - cut.prefix) == (prefix, middle)
    assert "".join(restore(Frames([output], size), form)) == text


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 12))
def test_ranges_and_unit_ends(text, size):
    frames = Frames([text[:3], text[3:]], size)
    units = UNITS.findall(text)
    assert [frames.after(i) for i in range(len(units) + 1)] == [len("".join(units[:i])) for i in range(len(units) + 1)]
    for a in range(0, len(text) + 1, 3):
        for b in range(a, len(text) + 1, 2):
            assert "".join(frames.stream(a, b)) == text[a:b]


def test_a_cut_opens_one_frame(monkeypatch):
    frames = Frames(["word\n" * 5000], 100)
    opened = []
    real = Frames.frame
    monkeypatch.setattr(Frames, "frame", lambda self, i: opened.append(i) or real(self, i))
    assert frames.after(2500) == 12500 and len(opened) == 1
    assert "".join(frames.stream(12490, 12510)) == ("word\n" * 5000)[12490:12510] and len(opened) <= 3


def test_documents(spark, odd_docs, no_docs):
    marked = spark.createDataFrame([(50, "a <P> b\nc"), (51, "one\ntwo\nthree\n"), (52, "\n"), (53, "solid " * 40000)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(marked)
    texts = docs.collect()
    want = sorted(
        (str(r["doc_id"]), n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        for r in texts
        for n, form, p, m, out in [plainly(r["text"] or "", "null" if r["doc_id"] is None else r["doc_id"], Rules())]
    )
    got = digests(docs, size=1000).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert draws(None, 7) == draws("null", 7)
    out = transform(odd_docs).collect()
    assert {(r["output"], r["form"]) for r in out} == {(o, f) for r in odd_docs.collect() for _, f, _, _, o in [plainly(r["text"] or "", "null" if r["doc_id"] is None else r["doc_id"], Rules())]}
    assert digests(no_docs).count() == 0 and transform(no_docs).count() == 0 and store(no_docs).count() == 0
    with pytest.raises(ValueError):
        transform(odd_docs, output="score")


def test_stored_frames_are_read_back_and_sought(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(60, "".join(f"line {i}\n" for i in range(400)) + "end")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    frames = store(docs, size=64)
    assert {r["doc_id"]: r["text"] for r in read(frames).collect()} == texts
    for first, last in ((0, 1), (37, 43), (399, 500), (5, 5)):
        got = {r["doc_id"]: r["text"] for r in select(frames, first, last).collect()}
        assert got == {d: "".join(UNITS.findall(t)[first:last]) for d, t in texts.items()}
