"""Buckets of signatures follow the input's bytes; a large one is looked at in turns."""

import numpy as np
import pyarrow as pa

from ionloom.llm import jaccard
from ionloom.llm.words import shingles, words


def test_many_partitions_do_not_make_many_buckets(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        assert jaccard._buckets(spark.read.parquet(str(tmp_path / "d"))) <= jaccard.FEW_BUCKETS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_turns_find_what_one_look_finds(monkeypatch):
    rng = np.random.default_rng(5)
    base = [[f"w{k}" for k in rng.integers(0, 400, 120)] for _ in range(40)]
    texts = [" ".join(w[: 120 - cut]) for w in base for cut in (0, 0, 3, 40)] * 2 + [None, ""]
    signer, batches = jaccard._Signer(jaccard.Bands()), []
    for at in range(0, len(texts), 50):
        chunk = jaccard._Chunk(2)
        for i, g in enumerate(shingles(words(pa.array(texts[at : at + 50], pa.string())))):
            chunk.add(at + i, g, signer)
        batches += chunk.batches(at)
    table = pa.Table.from_batches(batches)
    one = sorted(map(str, jaccard._shared(table).to_pylist()))
    monkeypatch.setattr(jaccard, "TURN_SIGNATURES", 100)
    assert len(one) > 2000 and sorted(map(str, jaccard._shared(table).to_pylist())) == one


def test_signatures_are_packed_tightly_and_read_back():
    """Five bytes and half a tag for a signature, few for a count or a deletion's segment, wherever it is sent."""
    rng = np.random.default_rng(8)
    signer, chunk = jaccard._Signer(jaccard.Bands()), jaccard._Chunk(32)
    for i in range(300):
        chunk.add(i, np.unique(rng.integers(0, 2**64, 400, np.uint64)), signer)
    table = pa.Table.from_batches(chunk.batches(0))
    size = sum(len(b) for name in ("sets", "counts", "low", "high", "tags", "items", "homes") for b in table.column(name).to_pylist())
    assert size < 7.2 * chunk.held
    values = np.array([3, 70_000, 0], np.uint32)
    assert jaccard._wide(jaccard._narrow(values), 3).tolist() == values.tolist()
    assert jaccard._wide(jaccard._narrow(values[:0]), 0).tolist() == []
    tags = np.array([1, 15, 0, 8, 5], np.uint8)
    assert jaccard._doubled(jaccard._halved(tags), 5).tolist() == tags.tolist()


def test_a_whole_set_goes_once_to_a_block(spark, monkeypatch):
    g = [np.arange(100, dtype=np.uint64) + np.uint64(k) for k in (0, 5, 60)]
    members = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(g)], "cid long, members binary")
    rows = [(7, 0, 0, [1, 2]), (7, 1, 1, [2]), (7, 1, 1, None), (7, 2, 2, None), (8, 2, 2, [1]), (8, 1, 1, None)]
    seekers = spark.createDataFrame(rows, "block long, cid long, label long, seeks array<long>")
    met, links = [], jaccard._links

    def counted(bands):
        run = links(bands)

        def of_block(rows):
            assert len(rows.column("members").drop_null()) == len(rows.column("cid").unique())
            return run(rows)

        return of_block

    monkeypatch.setattr(jaccard, "_links", counted)
    for few in (jaccard.BROADCAST_PLACES, -1):
        monkeypatch.setattr(jaccard, "BROADCAST_PLACES", few)
        met.append(sorted(map(tuple, jaccard._meet(seekers, members, jaccard.Bands()).collect())))
    assert met == [[(0, 1)], [(0, 1)]]
