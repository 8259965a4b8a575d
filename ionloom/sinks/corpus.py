"""Prepared corpora, winners, curation reports, manifests and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.hashing import unsigned
from ionloom.operators.curation import CONTEXT, Curation, selection_counts
from ionloom.operators.reports import curation_report
from ionloom.schemas import PREPARED, WINNERS, enforce_schema

ROW_GROUP_ROWS = 65_536


def write_prepared(prepared: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Zstandard Parquet with bounded row groups; optional extra columns become directories.

    With directories, rows are rebalanced on those columns: a source has as many files as its size asks for,
    a large one is written by several tasks, and no task writes to every directory.
    """
    if partition_by:
        prepared = prepared.hint("rebalance", *partition_by)
    writer = (
        prepared.write.mode("error")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def contract(prepared: DataFrame) -> DataFrame:
    """Rows under the published schema, with unsigned identifiers from signed bits."""
    if dict(prepared.dtypes)["spectrum_id"] == "bigint":
        prepared = prepared.withColumn("spectrum_id", unsigned(F.col("spectrum_id")))
    return enforce_schema(prepared.select(*PREPARED.names), PREPARED)


def write_winners(winners: DataFrame, path: str) -> None:
    enforce_schema(winners.select("spectrum_id"), WINNERS).write.mode("error").option(
        "compression", "zstd"
    ).parquet(path)


def write_curation(
    curation: Curation, annotations_path: str, report_path: str, spectra_table: DataFrame | None = None, keys: list[str] = CONTEXT
) -> None:
    """Annotations as Parquet, the report as one JSON row.

    With ``spectra_table`` (``spectrum_id, ms2``) the report has replication quantiles and the three replicate ceilings,
    without it the counts and the policy.
    """
    curation.annotations().write.mode("error").option("compression", "zstd").parquet(annotations_path)
    if spectra_table is None:
        policy = F.struct(*[F.lit(v).alias(k) for k, v in curation.policy.canonical().items()])
        report = selection_counts(curation).withColumn("policy", policy)
    else:
        report = curation_report(curation, spectra_table, keys)
    report.coalesce(1).write.mode("error").json(report_path)


def provenance_sidecar(document: DataFrame, counts: DataFrame) -> DataFrame:
    """A settings document with the result counts of the build added under ``output.counts``.

    Both are one row. ``document`` has the column ``settings`` (JSON text).
    """
    one = F.lit(0).alias("__one")
    body = counts.select(F.to_json(F.struct(*counts.columns)).alias("counts"), one)
    return document.select("settings", one).join(body, "__one").select(
        F.concat(
            F.lit('{"settings":'), F.col("settings"),
            F.lit(',"output":{"counts":'), F.col("counts"), F.lit("}}"),
        ).alias("value")
    )
