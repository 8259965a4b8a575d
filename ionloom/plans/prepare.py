"""Preparation: candidates and fragments in, one dense spectrum per usable scan out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions import hashing
from ionloom.functions.sequence import is_valid_sequence, repair_nterm, stripped_length, stripped_sequence
from ionloom.functions.spectra import finite
from ionloom.operators.curation import Curation, CurationPolicy, curate
from ionloom.operators.resolve import (
    dense_spectra,
    fill_optional,
    fragment_cells,
    keep_backbone_fragments,
    localization_verdicts,
    resolve_scans,
    resolved_metadata,
)
from ionloom.schemas import REQUIRED_METADATA
from ionloom.sinks.corpus import contract


def require_no_missing(metadata: DataFrame) -> None:
    """Refuse a source with a null in a required column or a peptidoform that cannot be read."""
    required = [c for c in REQUIRED_METADATA if c in metadata.columns]
    unread = ~is_valid_sequence(stripped_sequence(repair_nterm(F.col("modified_sequence"))))
    faults = metadata.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required], F.count_if(unread).alias("unreadable peptidoform")).first()
    found = {c: n for c, n in faults.asDict().items() if n}
    if found:
        raise ValueError(f"unusable metadata rows: {found}")


def prepare_spectra(metadata: DataFrame, fragments: DataFrame, dataset: str, instrument: str) -> DataFrame:
    """Prepared spectra with precursor intensity and signed-bit identifiers.

    One job over all shards: two aggregates resolve the candidates, one join brings the lengths
    to the fragments, two aggregates make the grids, one join brings the metadata back.
    """
    require_no_missing(metadata)
    has_score = "andromeda_score" in metadata.columns
    verdicts = localization_verdicts(
        metadata,
        stripped_sequence(F.col("modified_sequence")),
        score="andromeda_score" if has_score else None,
        tie=["precursor_charge"],
    )
    rt_name = "indexed_retention_time" if "indexed_retention_time" in metadata.columns else "retention_time"
    if rt_name not in metadata.columns:
        raise ValueError("metadata has no retention time column")
    meta = fill_optional(resolved_metadata(resolve_scans(verdicts)))
    meta = meta.withColumn("proforma", repair_nterm(F.col("modified_sequence"))).withColumn(
        "length", stripped_length(F.col("proforma"))
    )
    grids = dense_spectra(fragment_cells(keep_backbone_fragments(fragments), meta)).drop("length")
    # Replicates share their stripped sequence: hash each distinct one once and join the label back.
    meta = meta.withColumn("__stripped", stripped_sequence(F.col("proforma")))
    splits = meta.select("__stripped").distinct().withColumn("split", hashing.split_label(hashing.blake_unit()(F.col("__stripped"))))
    meta = meta.join(splits, "__stripped").drop("__stripped")
    raw_rt = F.col("retention_time") if "retention_time" in metadata.columns else F.col(rt_name)
    return grids.join(meta, ["raw_file", "scan_number"]).select(
        hashing.spectrum_id()(F.lit(dataset), "raw_file", "scan_number").alias("spectrum_id"),
        F.lit(dataset).alias("dataset"),
        "raw_file",
        "scan_number",
        "proforma",
        F.col("precursor_charge").cast("bigint").alias("charge"),
        "split",
        F.col(rt_name).alias("irt"),
        raw_rt.alias("raw_rt"),
        F.lit(instrument).alias("instrument"),
        F.col("mass_analyzer").alias("detector"),
        "fragmentation",
        F.col("aligned_collision_energy").alias("energy"),
        "andromeda_score",
        "ms2",
        "precursor_intensity",
    )


def curate_prepared(spectra: DataFrame, policy: CurationPolicy) -> tuple[DataFrame, Curation]:
    """Spectra the policy keeps, and the verdicts. A source without any intensity is an error."""
    if spectra.where(finite(F.col("precursor_intensity"))).isEmpty():
        raise ValueError("no usable precursor_intensity in any spectrum; cannot estimate a window")
    curation = curate(spectra, policy)
    kept = curation.verdicts.where("selected").select("spectrum_id")
    return contract(spectra.join(kept, "spectrum_id", "left_semi")), curation
