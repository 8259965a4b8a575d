"""From candidate assignments and long fragments to one dense spectrum per scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.constants import ION_COLUMNS
from ionloom.functions.spectra import evidence, fragment_cell
from ionloom.schemas import REQUIRED_METADATA, missing_columns

_SCAN = ["raw_file", "scan_number"]
_NUMERIC = (
    "retention_time",
    "indexed_retention_time",
    "aligned_collision_energy",
    "andromeda_score",
    "precursor_intensity",
)
_LABELS = ("mass_analyzer", "fragmentation")


def fill_optional(df: DataFrame) -> DataFrame:
    """Absent or null numbers become NaN, absent or null labels the empty string."""
    nan = F.lit(float("nan"))
    for name in _NUMERIC:
        df = df.withColumn(
            name, F.coalesce(F.col(name).cast("double"), nan) if name in df.columns else nan
        )
    for name in _LABELS:
        df = df.withColumn(
            name, F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")
        )
    return df


def key_null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: nulls per required column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def usable_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: all rows and the rows with a finite number."""
    value = F.col(column)
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(usable).alias(f"usable_{column}")
    )


def localization_verdicts(
    candidates: DataFrame,
    stripped: Column,
    *,
    form: str = "modified_sequence",
    score: str | None = "andromeda_score",
    tie: list[str],
) -> DataFrame:
    """One row per (raw_file, scan_number, stripped) with the verdict on its best-scored forms.

    The best score's lexically smallest and largest form are both kept: they differ exactly when
    the placement is ambiguous. Without any score every candidate ties. All of it is one
    aggregate of fixed size, so nothing is collected per scan. ``best`` is the winning row, the
    first by ``tie`` when a form is reported several times.
    """
    payload = [c for c in candidates.columns if c not in _SCAN]
    rows = candidates.withColumn("__stripped", stripped)
    # A missing score loses to any score and ties with other missing ones.
    value = F.coalesce(evidence(F.col(score).cast("double")), F.lit(float("-inf"))) if score else F.lit(0.0)
    low = F.struct(
        (-value).alias("worst_first"),
        F.col(form).alias("form"),
        *[F.col(t).alias(f"tie_{i}") for i, t in enumerate(tie)],
        F.struct(*payload).alias("row"),
    )
    high = F.struct(value.alias("best_last"), F.col(form).alias("form"))
    return (
        rows.groupBy(*_SCAN, "__stripped")
        .agg(F.min(low).alias("low"), F.max(high).alias("high"))
        .select(
            *_SCAN,
            F.col("__stripped").alias("stripped"),
            (F.col("low.form") != F.col("high.form")).alias("unlocalizable"),
            F.col("low.row").alias("best"),
        )
    )


def resolve_scans(verdicts: DataFrame) -> DataFrame:
    """One row per scan: its status and, when usable, the winning candidate.

    ``resolved`` has one localized peptide; ``unidentifiable`` has several; ``unlocalizable`` has
    none left because every peptide's placement was tied. ``any_unlocalizable`` counts the scan
    for the localization loss even when another peptide of it survived.
    """
    usable = ~F.col("unlocalizable")
    return (
        verdicts.groupBy(*_SCAN)
        .agg(
            F.count_if(usable).alias("peptides"),
            F.bool_or("unlocalizable").alias("any_unlocalizable"),
            F.min(F.when(usable, F.struct("stripped", "best"))).alias("kept"),
        )
        .select(
            *_SCAN,
            F.when(F.col("peptides") == 1, "resolved")
            .when(F.col("peptides") > 1, "unidentifiable")
            .otherwise("unlocalizable")
            .alias("status"),
            "any_unlocalizable",
            F.col("kept.stripped").alias("stripped"),
            F.col("kept.best").alias("best"),
        )
    )


def resolved_metadata(scans: DataFrame) -> DataFrame:
    return scans.where("status = 'resolved'").select(*_SCAN, "stripped", "best.*")


def resolution_counts(scans: DataFrame) -> DataFrame:
    """Scans per fate, counted in scans: one row."""
    return scans.agg(
        F.count(F.lit(1)).alias("scans"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if("any_unlocalizable").alias("unlocalizable"),
        F.count_if(F.col("status") == "unidentifiable").alias("unidentifiable"),
    )


def require_metadata_columns(df: DataFrame) -> DataFrame:
    missing = missing_columns(df.columns, REQUIRED_METADATA)
    if missing:
        raise ValueError(f"metadata is missing required columns {missing}")
    return df


def keep_backbone_fragments(fragments: DataFrame) -> DataFrame:
    """b/y ions at charge 1 or 2 without a neutral loss. All three tests reach the scan."""
    return fragments.where(
        F.col("ion_type").isin("b", "y")
        & F.col("charge").isin(1, 2)
        & (F.col("neutral_loss").isNull() | (F.col("neutral_loss") == ""))
    )


def fragment_cells(fragments: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fragments joined to their scan's peptide length, as collapsed grid cells.

    Fragments without metadata are skipped. The cell maximum is an aggregate with map-side
    combining; the join carries the scan key and one length.
    """
    cell = fragment_cell(F.col("ion_type"), F.col("no"), F.col("charge"), F.col("length"))
    return (
        fragments.join(metadata.select(*_SCAN, "length"), _SCAN)
        .withColumn("cell", cell)
        .where("cell is not null")
        .groupBy(*_SCAN, F.col("cell.site").alias("site"), F.col("cell.col").alias("col"))
        .agg(F.max("intensity").alias("intensity"), F.max("length").alias("length"))
    )


def dense_spectra(cells: DataFrame) -> DataFrame:
    """One flat ``(length - 1) x 4`` grid per scan; scans without any intensity are dropped.

    After the collapse a scan has at most ``4 (length - 1)`` cells, so the list is bounded by the
    peptide.
    """
    width = len(ION_COLUMNS)
    index = (F.col("site") * width + F.col("col")).cast("int")
    return (
        cells.groupBy(*_SCAN)
        .agg(
            F.max("length").alias("length"),
            F.map_from_entries(F.collect_list(F.struct(index, F.col("intensity")))).alias("filled"),
        )
        .select(
            *_SCAN,
            "length",
            F.transform(
                F.sequence(F.lit(0), (F.col("length") - 1) * width - 1),
                lambda i: F.coalesce(
                    F.try_element_at("filled", i.cast("int")).cast("float"), F.lit(0.0).cast("float")
                ),
            ).alias("ms2"),
        )
        .where(F.exists("ms2", lambda x: x != 0))
    )
