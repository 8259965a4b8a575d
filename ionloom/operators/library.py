"""Spectral library rows: assembly from files, validation, capping, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.constants import PROTON
from ionloom.functions import chemistry, spectra
from ionloom.functions.spectra import finite
from ionloom.operators.joins import require_empty


def spectrum_rows(
    predicted: DataFrame, min_intensity: float = 0.0, max_fragments: int | None = None
) -> DataFrame:
    """Predicted precursors as validated rows with capped peaks.

    ``predicted`` has ``masses`` (per-position), ``charge``, ``ms2``, ``rt``, ``ccs`` and any
    identity columns. Every peak is judged before the cap, so the cap cannot hide a bad one:
    ``problem`` names the first fault, null when there is none.
    """
    neutral = F.aggregate("masses", F.lit(chemistry.WATER), lambda acc, m: acc + m)
    rows = (
        predicted.withColumn("neutral_mass", neutral)
        .withColumn("precursor_mz", chemistry.charged_mz(F.col("neutral_mass"), F.col("charge")))
        .withColumn("mobility", chemistry.mobility(F.col("ccs"), F.col("charge"), F.col("precursor_mz")))
        .withColumn("peaks", spectra.grid_peaks(F.col("ms2"), chemistry.fragment_grid(F.col("masses")), min_intensity))
    )
    rows = rows.withColumn("problem", row_problem()).drop("ms2", "masses")
    if max_fragments is not None:
        rows = rows.withColumn("peaks", spectra.strongest(F.col("peaks"), max_fragments))
    return rows


def row_problem() -> Column:
    """First fault of a spectrum row, or null."""
    positive = lambda c: finite(F.col(c)) & (F.col(c) > 0)
    return (
        F.when(
            ~(positive("precursor_mz") & finite(F.col("rt")) & positive("ccs")),
            "non-physical precursor prediction",
        )
        .when(~positive("mobility"), "non-physical mobility")
        .when(F.exists("peaks", lambda p: ~F.coalesce(spectra.physical_peak(p), F.lit(False))), "invalid fragment")
    )


def require_valid_rows(rows: DataFrame) -> DataFrame:
    """Raise at the first faulty row, in the task that meets it, without a pass of its own."""
    message = F.concat(F.col("problem"), F.lit(" for charge "), F.col("charge").cast("string"))
    checked = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.where(checked).drop("problem")


def neutral_mass(mz: Column, charge: Column) -> Column:
    return (mz - F.lit(PROTON)) * charge


def library_counts(rows: DataFrame) -> DataFrame:
    """Precursors, decoys, peptides and kept fragments, in one pass."""
    return rows.agg(
        F.count(F.lit(1)).alias("precursors"),
        F.count_if("decoy").alias("decoys"),
        F.count_distinct(F.when(~F.col("decoy"), F.col("peptide"))).alias("peptides"),
        F.sum(F.size("peaks")).alias("fragments"),
    )


def library_precursors(rows: DataFrame, drop_excluded: bool = False) -> DataFrame:
    """One record per (modified sequence, charge) of a library read fragment by fragment.

    ``rows`` has ``line, peptide_text, charge, retention, mobility, ion, ordinal,
    fragment_charge, lossless, intensity, decoy, excluded, length``. The first line gives retention
    and mobility. A repeated grid cell keeps its last line, as on the dense grid, so a record
    lists at most ``4 (length - 1)`` fragments however many lines it has; ``fragment_rows`` counts
    the lines. Records without any fragment have an empty list.
    """
    kept = rows.where(~F.col("decoy"))
    if drop_excluded:
        kept = kept.where(~F.col("excluded"))
    cell = spectra.fragment_cell(F.col("ion"), F.col("ordinal"), F.col("fragment_charge"), F.col("length"))
    by_cell = (
        kept.withColumn("cell", F.when(F.col("lossless"), cell))
        .groupBy("peptide_text", "charge", "cell")
        .agg(
            F.min(F.struct("line", "retention", "mobility")).alias("first"),
            F.max(F.struct("line", "intensity")).alias("last"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    inside = F.col("cell").isNotNull()
    entry = F.when(inside, F.struct("last.line", "cell.site", "cell.col", "last.intensity"))
    return (
        by_cell.groupBy("peptide_text", "charge")
        .agg(
            F.min("first").alias("first"),
            F.array_sort(F.collect_list(entry)).alias("fragments"),
            F.sum(F.when(inside, F.col("rows")).otherwise(0)).alias("fragment_rows"),
            F.sum(F.when(inside, 0).otherwise(F.col("rows"))).alias("fragments_dropped"),
        )
        .select(
            "peptide_text",
            "charge",
            F.col("first.retention").alias("retention"),
            F.col("first.mobility").alias("mobility"),
            F.transform(
                "fragments",
                lambda f: F.struct(f["site"].alias("site"), f["col"].alias("col"), f["intensity"].alias("intensity")),
            ).alias("fragments"),
            "fragment_rows",
            "fragments_dropped",
        )
    )


def reader_counts(rows: DataFrame, precursors: DataFrame) -> DataFrame:
    """What a read kept and discarded, as one row."""
    lines = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("decoy").alias("decoys"),
        F.count_if(F.col("excluded") & ~F.col("decoy")).alias("excluded"),
        F.lit(0).alias("__one"),
    )
    records = precursors.agg(
        F.count_if(F.size("fragments") > 0).alias("precursors"),
        F.count_if(F.size("fragments") == 0).alias("precursors_without_fragments"),
        F.coalesce(F.sum("fragments_dropped"), F.lit(0)).alias("fragments_dropped"),
        F.lit(0).alias("__one"),
    )
    return lines.join(records, "__one").drop("__one")


def require_no_unmapped(resolved: DataFrame) -> DataFrame:
    """Raise when a mass shift has no declared alias."""
    require_empty(resolved.where("accession is null"), "mass shifts no declared alias explains")
    return resolved


def scatter_library(precursors: DataFrame, length: str) -> DataFrame:
    """Sparse fragments onto the flat grid."""
    filled = F.aggregate(
        "fragments",
        F.array_repeat(F.lit(0.0), ((F.col(length) - 1) * 4).cast("int")),
        lambda acc, f: F.transform(
            acc,
            lambda old, i: F.when(i == f["site"] * 4 + f["col"], f["intensity"].cast("double")).otherwise(old),
        ),
    )
    return precursors.withColumn("ms2", filled)
