"""FASTA as one row per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators.joins import require_empty


def read_fasta(spark: SparkSession, path: str, identifier: str = "token", check: bool = True) -> DataFrame:
    """``(protein_id, header, residues)`` from FASTA files.

    Records are split by the text reader itself (``\\n>``), so a large file is read in parallel and
    no record is ever put together across rows. ``identifier`` is ``token`` (first word of the
    header) or ``header``. ``check`` makes text before the first header an error, at the price of
    one more pass over the text; an empty header and an empty file are always errors.
    """
    if identifier not in ("token", "header"):
        raise ValueError("identifier must be 'token' or 'header'")
    raw = spark.read.option("lineSep", "\n>").text(path)
    if check:
        require_empty(_headless_files(spark, path), "residues before the first FASTA header")
    record = F.regexp_replace("value", r"^\s*>", "")
    header = F.trim(F.regexp_replace(F.substring_index(record, "\n", 1), r"\s+$", ""))
    cut = F.locate("\n", record)
    body = F.when(cut > 0, F.substring(record, cut + 1, F.length(record))).otherwise(F.lit(""))
    residues = F.upper(F.regexp_replace(F.regexp_replace(body, r"\s*\n\s*", ""), r"^\s+|\s+$", ""))
    named = F.when(header == "", F.raise_error(F.lit("empty FASTA header"))).otherwise(header)
    rows = raw.where(F.regexp_like(F.col("value"), F.lit(r"\S"))).select(
        named.alias("header"), residues.alias("residues")
    )
    if rows.isEmpty():
        raise ValueError(f"FASTA {path} contains no records")
    word = F.regexp_extract("header", r"^(\S+)", 1) if identifier == "token" else F.col("header")
    return rows.select(word.alias("protein_id"), "header", "residues")


def _headless_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose first line with text is not a header."""
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.trim("value").alias("value"),
    )
    return (
        lines.where("value <> ''")
        .groupBy("file")
        .agg(F.min_by(F.substring("value", 1, 1), F.struct("block", "line")).alias("first"))
        .where("first <> '>'")
    )
