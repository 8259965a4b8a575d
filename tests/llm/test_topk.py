import math
import random

import pytest
from pyspark.sql import functions as F

from ionloom.llm import topk
from ionloom.llm.topk import top_k


def brute(rows, k=5, every=3):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(700)]
    rows += [(700 + i, rows[i % 5][1]) for i in range(40)]  # ties
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan"), 1.0]), (903, [float("inf")]), (904, []), (None, [1.0] * 16), (906, [1.0] * 3), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = top_k(df.where(F.col("vec_id") % 3 == 0), df, n_candidates=100, n_queries=64)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)
    assert sorted(map(tuple, top_k(two, two).collect())) == [(0, 1, 1, 128 * 256), (1, 1, 0, 128 * 256)]
    none = spark.createDataFrame([], schema)
    assert top_k(none, two).count() == 0 and top_k(two, none).count() == 0


def test_far_blocks_stay_at_home(spark, monkeypatch):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 4) for _ in range(12)] for _ in range(16)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 16]]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    shipped = []
    scored = topk._scored

    def counted(visits, *more):
        shipped.append(visits.count())
        return scored(visits, *more)

    monkeypatch.setattr(topk, "_scored", counted)
    got = top_k(df.where(F.col("vec_id") % 3 == 0), df, n_candidates=50, n_queries=40)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    grid = 16 * 32  # halved to at most 40 and 50: 534 queries make 16 blocks, 2 x 800 candidates 32
    assert sum(shipped) < grid / 2
