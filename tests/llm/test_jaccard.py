import random
import re

import numpy as np
import pytest

from ionloom.llm import jaccard
from ionloom.llm.graph import components
from ionloom.llm.jaccard import Bands, _Signer, jaccard_join


def shingle_set(text):
    p = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(p[i : i + 5]) for i in range(len(p) - 4)} if len(p) >= 5 else ({tuple(p)} if p else set())


def brute(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        least[i] = min(ids, default=None)
    return sorted(((d, len(sets[i]), least[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, passage=False):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60 if seed % 2 else 3000)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for _ in range(45):
        n = rng.choice([1, 3, 5, 6, 8, 12, 30, 70, 90, 150, 400])
        words = rng.choices(vocabulary, k=n)
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * rng.uniform(0.7, 1)))]
            text = " ".join(copy)
            rows.append((len(rows) * 7 % 1000, f"{shared} {text}" if passage else text))
    return rows


@pytest.mark.parametrize(("seed", "passage"), [(1, False), (4, True)])
def test_components_equal_all_pairs(spark, seed, passage):
    rows = corpus(seed, passage)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_frequent_signatures_are_spread_without_losing_links(spark, monkeypatch):
    # Functions travel by value, so the lower bound reaches the workers too.
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rows = corpus(6, True)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in jaccard_join(docs).collect()), key=str)
    assert got == brute(rows)


def test_every_linked_size_lies_in_the_same_or_the_next_band():
    bands = Bands()
    lows = bands.low(30_000)
    for a in range(1, 20_000):
        k = int(np.searchsorted(lows, a, "right")) - 1
        assert int(np.searchsorted(lows, bands.partner(a), "right")) - 1 in (k, k + 1)


def test_pigeonhole_holds_for_the_most_different_partner():
    """Of the segments a set could take, enough are always met by a partner that differs as much as it may."""
    rng = np.random.default_rng(3)
    signer = _Signer(Bands())
    for a in (5, 60, 80, 120, 400, 1500):
        h = signer.bands.differences(a)
        for _ in range(20):
            r = np.unique(rng.integers(0, 2**64, a, np.uint64))
            s = np.unique(np.r_[np.delete(r, rng.choice(len(r), h // 2, False)), rng.integers(0, 2**64, h - h // 2, np.uint64)])
            band = signer.band(len(r))
            exact, gone, items, cover = signer.sign(r, band)
            theirs = np.concatenate(signer.sign(s, band)[:2])
            met = np.isin(exact, theirs).sum() + sum(2 for i in np.unique(items) if np.isin(gone[items == i], theirs).any())
            assert cover - met <= h


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows.append((None, "a lone text of an unknown row"))
    docs = odd_docs.select("doc_id", "text", "n", "hash").union(spark.createDataFrame([(*rows[-1], 1, 1)], "doc_id long, text string, n int, hash long"))
    got = sorted((tuple(r) for r in jaccard_join(docs).collect()), key=str)
    assert got == brute(rows)
    assert jaccard_join(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(-5, 160), (160, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), "u", "v").distinct().collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == -5 for i in [-5, *range(100, 161)])
    assert components(spark.createDataFrame([], "u long, v long"), "u", "v").count() == 0


def test_components_let_go_of_finished_rounds(spark):
    """A long chain takes several rounds; what they have shuffled and broadcast does not stay on the driver."""

    def collections():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName())

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    before = collections()
    out = components(edges, "a", "b")
    assert collections() >= before + 2
    assert sorted(out.collect()) == [(i, 0) for i in range(41)]
