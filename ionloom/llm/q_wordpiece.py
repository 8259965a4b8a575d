"""op8: word-piece token counts of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionloom.llm.base import query, table
from ionloom.llm.q_packing import bpe_path
from ionloom.llm.wordpiece import token_counts


@query("op8_longest_match_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), bpe_path())
