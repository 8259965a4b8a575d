"""Parquet and JSON inputs: metadata, fragments, prepared corpora, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom import schemas
from ionloom.functions.sequence import stripped_length
from ionloom.operators.joins import require_empty
from ionloom.operators.resolve import keep_backbone_fragments, require_metadata_columns


def select_metadata(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """The known metadata columns that are there, required ones checked.

    ``rename`` maps contract names to the source's own names.
    """
    for want, have in (rename or {}).items():
        if have in df.columns:
            df = df.withColumnRenamed(have, want)
    require_metadata_columns(df)
    return df.select(*[name for name in schemas.PSM_METADATA.names if name in df.columns])


def read_metadata(
    spark: SparkSession, paths: list[str], raw_files: DataFrame | None = None, rename: dict | None = None
) -> DataFrame:
    """PSM metadata, reduced to the raw files of interest by a semi join."""
    df = select_metadata(spark.read.parquet(*paths), rename)
    return df if raw_files is None else for_raw_files(df, raw_files)


def for_raw_files(df: DataFrame, raw_files: DataFrame) -> DataFrame:
    """Rows of the listed raw files. Spark broadcasts the list when its measured size is small."""
    return df.join(raw_files.select("raw_file").distinct(), "raw_file", "left_semi")


def raw_files(df: DataFrame) -> DataFrame:
    """Distinct raw files: a one-column scan with map-side distinct."""
    return df.select("raw_file").distinct()


def read_fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The seven annotation columns, backbone ions only; both reach the Parquet reader."""
    df = spark.read.parquet(*paths).select(*schemas.FRAGMENTS.names)
    return keep_backbone_fragments(df)


def read_prepared(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Prepared spectra of any number of shards under the strict contract."""
    return schemas.enforce_schema(spark.read.parquet(*paths), schemas.PREPARED)


def split_scan(
    prepared: DataFrame, splits: list[str], dataset_ids: DataFrame, winners: DataFrame | None = None
) -> DataFrame:
    """Rows of some splits with sequence length and dataset id, shortest first within a task.

    Winners restrict a scan of ``val`` alone. The identifier is not carried on.
    """
    rows = prepared.where(F.col("split").isin(*splits))
    if winners is not None and splits == ["val"]:
        rows = rows.join(winners.select("spectrum_id"), "spectrum_id", "left_semi")
    return (
        rows.drop("spectrum_id")
        .withColumn("sequence_length", stripped_length(F.col("proforma")))
        .join(dataset_ids, "dataset")
        .sortWithinPartitions("sequence_length")
    )


def read_shard_manifests(
    spark: SparkSession, prefix: str, pattern: str = "manifest.json", multi_line: bool = True
) -> DataFrame:
    """Every ``shards/**/manifest.json`` under a prefix, with an explicit schema.

    One document per file by default; one per line with ``multi_line`` off.
    """
    return (
        spark.read.schema(schemas.SHARD_MANIFEST)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(f"{prefix.rstrip('/')}/shards")
    )


def read_corpus_manifest(spark: SparkSession, prefix: str) -> DataFrame:
    """The corpus manifest as one row; version and chunk list are checked."""
    df = (
        spark.read.schema(schemas.CORPUS_MANIFEST)
        .option("multiLine", True)
        .json(f"{prefix.rstrip('/')}/manifest.json")
    )
    require_empty(df.where("version is null or version <> 1").select("version"), "unsupported manifest version")
    require_empty(df.where("chunks is null or size(chunks) = 0").select("version"), "manifest has no chunks")
    return df


def manifest_chunks(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("chunks").alias("chunk")).select("chunk.*")


def manifest_winners(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Validation winners: the inline list, or the side file when the list is empty."""
    head = manifest.select(F.coalesce(F.size("val_winners"), F.lit(0)).alias("inline"), "val_winners_uri").first()
    if head["inline"] <= 0 and head["val_winners_uri"]:
        return schemas.enforce_schema(spark.read.parquet(head["val_winners_uri"]), schemas.WINNERS)
    return manifest.select(F.explode("val_winners").alias("spectrum_id"))
