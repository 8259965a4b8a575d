"""op6: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.base import held_out, query, table
from ionloom.llm.langid import fit, predict


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    model = fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    scored = predict(docs.select("doc_id", "held_out", "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")
