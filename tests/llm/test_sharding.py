import collections

from pyspark.sql import functions as F

from ionloom.llm.sharding import number_slots, place


def test_adding_a_shard_moves_rows_only_into_it(spark):
    keys = spark.range(4000).withColumnRenamed("id", "k")
    both = place(place(keys, "k", [1.0] * 40, grown="grown"), "k", [1.0] * 41, shard="later").collect()
    assert all(r["grown"] == r["later"] for r in both)
    moved = [r for r in both if r["shard"] != r["grown"]]
    assert all(r["grown"] == 40 for r in moved) and 50 < len(moved) < 160


def test_weights_set_the_shares(spark):
    counts = collections.Counter(r["shard"] for r in place(spark.range(6000), "id", [1.0, 2.0, 3.0]).collect())
    assert abs(counts[0] - 1000) < 150 and abs(counts[1] - 2000) < 200 and abs(counts[2] - 3000) < 200


def test_slots_have_no_gap_also_for_one_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("extra").alias("slot"))
    out = number_slots(place(rows.repartition(7), "k", [1.0] * 5)).collect()
    for shard in range(5):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in out if r["k"] == 7}) == 1


def test_odd_rows(odd_docs, no_docs):
    out = number_slots(place(odd_docs, "doc_id", [1.0] * 4)).collect()
    assert len(out) == odd_docs.count() and all(r["shard"] is not None for r in out)
    assert number_slots(place(no_docs, "doc_id", [1.0] * 4)).count() == 0
