"""The manifest log: versions appear with their header, chunks are added once, torn and lost data are not read."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ionloom.operators.catalog import corpus_facts
from ionloom.sinks.manifest_log import ManifestLog
from ionloom.streaming import incremental

SOURCE = {"config_fingerprint": "f1", "policy_version": 2}


def chunks(spark, *names):
    return spark.createDataFrame([(f"s/{n}", f"set{n[0]}", 3, n) for n in names], "uri string, dataset string, rows bigint, source_shard string")


def prepared(spark, *rows):
    return spark.createDataFrame(list(rows), "dataset string, split string, irt double")


def names(log, version=None):
    return sorted(r["source_shard"] for r in log.chunks(version).collect())


@pytest.fixture
def log(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "manifest"))
    log.append(chunks(spark, "b1", "b2"), corpus_facts(prepared(spark, ("setb", "train", 2.0), ("setb", "val", float("nan")))), "w1", SOURCE, "t1")
    log.append(chunks(spark, "a1"), corpus_facts(prepared(spark, ("seta", "train", 3.0), ("setb", "train", None))), "w2", SOURCE, "t2")
    return log


def test_versions_add_up_and_stay_readable(log):
    header = log.newest()
    assert (header.version, header.chunks, header.added) == (2, 3, 1)
    assert header.split_rows == {"train": 3, "val": 1} and header.irt_stats == [2.0, 5.0, 13.0]
    assert header.split_datasets == {"seta": ["train"], "setb": ["train", "val"]} and header.datasets == {"seta": 1, "setb": 2}
    assert names(log) == ["a1", "b1", "b2"] and names(log, 1) == ["b1", "b2"]
    assert log.newest().val_winners_uri == "w2" and log.newest(1).val_winners_uri == "w1"


def test_a_version_without_header_is_not_read(spark, log):
    chunks(spark, "c1").write.json(f"{log.folder}/chunks/00000000000000000003-torn")
    Path(log.folder, "commits", f"{3:020d}", "_temporary").mkdir(parents=True)
    assert names(log) == ["a1", "b1", "b2"] and log.newest().version == 2


def test_a_chunk_folder_that_lost_rows_is_refused(log):
    folder = Path(log.folder, "chunks", log.newest().folder)
    for part in folder.glob("part-*"):
        part.write_text("")
    with pytest.raises(ValueError, match="version 2 has 0 of 1 chunks"):
        log.chunks()
    assert names(log, 1) == ["b1", "b2"]


def test_a_transaction_counts_once_and_chunks_stay_as_they_are(spark, log):
    facts = corpus_facts(prepared(spark, ("seta", "test", 1.0)))
    assert log.append(chunks(spark, "a9"), facts, "w", SOURCE, "t2").version == 2
    with pytest.raises(ValueError, match="there already"):
        log.append(chunks(spark, "a1"), facts, "w", SOURCE, "t3")
    assert log.newest().version == 2 and names(log) == ["a1", "b1", "b2"]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        log.commit(log.newest(1))


def test_changed_settings_start_a_new_base(spark, log):
    assert not log.stale("f1") and log.stale("f2")
    log.append(chunks(spark, "a1"), corpus_facts(prepared(spark, ("seta", "val", 1.0))), "w", {"config_fingerprint": "f2"}, base=True)
    assert names(log) == ["a1"] and log.newest().split_rows == {"val": 1} and not log.stale("f2")
    assert names(log, 2) == ["a1", "b1", "b2"]


def test_an_empty_log_and_empty_chunks(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "none"))
    assert log.headers() == [] and log.stale("f")
    with pytest.raises(ValueError, match="no complete version"):
        log.newest()
    with pytest.raises(ValueError, match="no chunks"):
        log.append(chunks(spark, "a").where("false"), corpus_facts(prepared(spark, ("a", "val", 1.0))), "w", SOURCE)


def test_a_stream_records_its_batches(spark, tmp_path):
    schema = spark.createDataFrame([("setA", "train", 1.0)], "dataset string, split string, irt double").schema
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    log = ManifestLog(spark, str(tmp_path / "log"))

    def record(folder, transaction):
        rows = spark.read.parquet(folder)
        found = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
        made = found.select(F.concat(F.lit(folder + "#"), "dataset").alias("uri"), "dataset", "rows", F.lit(transaction).alias("source_shard"))
        for _ in range(2):  # a batch that is tried again
            log.append(made, corpus_facts(rows), "", SOURCE, transaction)

    def run():
        incremental.process_new_files(spark, source, schema, lambda b: b, out, state, "f1", written=record)

    for i in range(2):
        spark.createDataFrame([("setA", "train", float(i)), ("setB", "val", 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
        run()
    run()
    assert log.newest().version == 2 and log.newest().split_rows == {"train": 2, "val": 2}
    assert log.chunks().count() == 4
