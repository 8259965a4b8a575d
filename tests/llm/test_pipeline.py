import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_queries import compare, connect
from ionloom.llm.queries import QUERIES, SQL
from ionloom.session import tune

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="driver tables are not here")


def test_each_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert compare(QUERIES[name](spark, TABLES), connect(TABLES), SQL[name]) == []


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, TABLES).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[1] >= 0.98 * counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[4] == counts[3]
    assert docs.select("doc_id").distinct().count() == counts[4]


def test_run_chains_the_stages_over_documents(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("secrets", "packing")])
    pieces = corpus_pipeline.run(spark, TABLES)
    assert pieces.select("doc_id").distinct().count() == spark.read.parquet(f"{TABLES}/documents.parquet").count()


def test_odd_and_empty_documents_pass_every_stage(spark, odd_docs, no_docs, tmp_path):
    shutil.copy(f"{TABLES}/benchmark.parquet", tmp_path / "benchmark.parquet")
    for k, table in enumerate((odd_docs, no_docs)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        assert docs.count() >= 0


def test_rows_go_for_their_own_text_only(spark, tmp_path):
    one = "the quick brown fox jumps over the lazy dog while seven old wizards box in the dark cold garden"
    other = "a clean text about rivers and boats that nobody copied and that shares no passage with any other"
    item = "which of the three old bridges over the wide river was the first to be built from grey stone"
    rows = [(2, one), (1, one), (2, other), (None, one), (None, item), (4, item), (4, other + " at all")]
    rows += [(7, "same id " + other[::-1]), (7, "same id " + other[::-1]), (None, one[::-1]), (None, one[::-1]), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a/x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert left(clean) == sorted((r for r in rows if r[1] != item), key=str)
    single = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    # The fourth identifier's two texts differ, so both stay; the copy of the item without an identifier goes.
    want = [(1, one), (4, item), (7, "same id " + other[::-1]), (None, one[::-1]), (None, ""), (None, "")]
    got = left(single)
    assert [r for r in got if not str(r[1]).startswith("a clean")] == sorted(want, key=str)
    assert [r for r in got if str(r[1]).startswith("a clean")] == [(2, other)]


def test_columns_with_the_names_of_helpers_pass_unchanged(spark, tmp_path):
    """Every helper name of the stages, in both cases of letters, as an input column."""
    helpers = ["__key", "__KEY_", "key", "__lang", "__score", "__id", "id", "__crc", "crc", "__ranges", "__new", "count", "n", "component_id", "spans", "row", "first", "score", "lang_pred"]
    shutil.copy(f"{TABLES}/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    for h in helpers:
        docs = docs.withColumn(h, F.concat(F.lit(h), F.col("doc_id").cast("string")))
    plain = spark.read.parquet(f"{TABLES}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        stage(spark, plain, str(tmp_path)).write.parquet(str(tmp_path / f"{name}-plain"))
        docs, plain = spark.read.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / f"{name}-plain"))
        assert docs.where(" or ".join(f"`{h}` <> concat('{h}', doc_id)" for h in helpers)).count() == 0
        rows = lambda df: sorted(map(tuple, df.select(*plain.columns).collect()), key=str)
        assert rows(docs) == rows(plain)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_entered_by_itself_sets_its_options(spark, no_docs, tmp_path, stage):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        stage(spark, no_docs.select("doc_id", "text", "lang", "source", "n_chars"), str(tmp_path)).count()
        assert spark.conf.get(name) == "4m"
    finally:
        tune(spark)
