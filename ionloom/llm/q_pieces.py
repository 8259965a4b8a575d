"""op11: ids and decoded text of every document by a sentence-piece model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionloom.llm.base import query, table
from ionloom.llm.pieces import digests


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_sentencepiece_merge_rounds")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
