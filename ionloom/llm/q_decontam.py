"""op10: documents that hold benchmark items, by classes of items with one template."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionloom.llm.base import query, table
from ionloom.llm.decontam import contaminated


@query("op10_template_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
