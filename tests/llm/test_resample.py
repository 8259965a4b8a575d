import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ionloom.llm.radix import blocks, digits, radix_sort
from ionloom.llm.resample import Options, features, gains, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def plainly(docs, target, o):
    """``(doc_id, n_features, weight, score, rank)`` by the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % o.buckets
    have = Counter(bucket(f) for _, t in docs for f in plain_features(t, o.longest)[0])
    want = Counter(bucket(f) for t in target for f in plain_features(t, o.longest)[0])
    s, t = sum(have.values()), sum(want.values())
    gain = {b: math.floor(o.scale * math.log((want[b] + 1) * (s + o.buckets) / ((have[b] + 1) * (t + o.buckets)))) for b in have}
    rows = []
    for doc, text in docs:
        f, n = plain_features(text, o.longest)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{o.seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-o.scale * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= o.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: o.draw * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB9é日 .-\n", max_size=30) | st.just("x" * 70), max_size=6), st.integers(1, 3))
def test_features_equal_plain_ones(texts, longest):
    o = Options(longest=longest, buckets=1 << 20)
    bucket, before, words = features(pa.array(texts, pa.string()), o)
    for i, t in enumerate(texts):
        f, n = plain_features(t, longest)
        assert words[i] == n
        assert sorted(bucket[before[i] : before[i + 1]]) == sorted(zlib.crc32(x.encode()) % o.buckets for x in f)


def test_gains_of_nothing_are_zero():
    nothing = np.zeros(5, np.int64)
    assert gains(nothing, nothing, Options(buckets=5)).tolist() == [0] * 5


RECORD = np.dtype([("low", "<u8"), ("high", "<u8"), ("at", "<i8")])


def test_digits_cover_all_bits():
    for low, high in ((0, 0), (1, 0), (18, 16), (64, 33), (0, 7)):
        seen = [b for shift, width in digits(low, high) for b in range(shift, shift + width)]
        assert seen == [*range(low), *range(64, 64 + high)]


def sort(spark, low, high, parts, size, bits):
    keys = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(low, high))], "at long, low long, high long").repartitionByRange(parts, "at").sortWithinPartitions("at")

    def pack(batch):
        out = np.zeros(batch.num_rows, RECORD)
        out["at"] = batch.column("at").to_numpy()
        out["low"], out["high"] = (batch.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))
        return out

    done = radix_sort(blocks(keys, RECORD, pack, size), RECORD, *bits, size).orderBy("block").collect()
    assert [r["block"] for r in done] == list(range(len(done))) and all(r["n"] == size for r in done[:-1])
    return [np.frombuffer(bytes(r["records"]), RECORD) for r in done]


def test_radix_sort_is_stable_over_both_words(spark):
    rng = np.random.default_rng(3)
    low = rng.integers(0, 2**63, 900)
    low[:400] = low[5]  # one key holds nearly half of the rows
    high = rng.integers(0, 3, 900)
    got = np.concatenate(sort(spark, low, high, 7, 64, (63, 2)))
    assert got["at"].tolist() == np.lexsort((np.arange(900), low, high)).tolist()


def test_equal_keys_keep_their_order(spark):
    zeros = np.zeros(50, np.int64)
    assert np.concatenate(sort(spark, zeros, zeros, 4, 8, (3, 2)))["at"].tolist() == list(range(50))


def test_documents(spark, odd_docs, no_docs):
    o = Options(longest=2, buckets=300, least_words=3, draw=60)
    rng = np.random.default_rng(8)
    more = [(100 + i, " ".join(rng.choice(["apple", "pear", "Plum", "fig", "nut"], rng.integers(0, 9)))) for i in range(120)]
    target = spark.createDataFrame([("apple pear apple",), (None,), ("FIG nut",)], "text string")
    docs = odd_docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(*m, 0.0) for m in more], "doc_id long, text string, score double"))
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: str(r)
    for size in (16, 1 << 16):
        got = [tuple(r) for r in resample(docs, target, o, size=size).collect()]
        assert sorted(got, key=key) == sorted(plainly(pairs, ["apple pear apple", None, "FIG nut"], o), key=key)
    assert resample(no_docs, target, o).count() == 0
    assert resample(docs, target.where("false"), o).count() == len(pairs)
    none = resample(docs, target, Options(least_words=10**9)).collect()
    assert len(none) == len(pairs) and all(r["rank"] is None for r in none)
