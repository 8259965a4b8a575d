"""op2: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.base import held_out, query, table
from ionloom.llm.toxicity import draw, fit_drawn, is_toxic, score


@query("op2_toxicity_grammar")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    drawn = draw(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "held_out", "text"), fit_drawn(drawn))
    return scored.select("doc_id", "held_out", "score", is_toxic(F.col("score")).alias("predicted"))
