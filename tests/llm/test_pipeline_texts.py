"""The pipeline joins texts only with what has been found already."""

import corpus_pipeline


def test_decontamination_searches_before_it_joins_texts(spark, tmp_path):
    question = "Anna has 12 red apples and gives 5 of them to her friend Ben at school"
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, f"so {question} then"), (2, "nothing of the kind is in here at all"), (3, None)], "doc_id long, text string")
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert "MapInArrow" not in clean._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3]
