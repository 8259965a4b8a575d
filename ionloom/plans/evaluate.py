"""Library evaluation: a published library scored against a predictor, facet by facet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.constants import MODIFICATIONS
from ionloom.functions import chemistry, spectra
from ionloom.functions.sequence import SITE_TYPE
from ionloom.operators.evaluate import angle_histogram, facet_levels, facet_report
from ionloom.operators.joins import resolve_shifts
from ionloom.operators.labeler import smooth_labels
from ionloom.operators.ordering import exact_quantiles
from ionloom.operators.library import library_precursors, require_no_unmapped, scatter_library
from ionloom.plans.library import DEFAULT_DELTAS
from ionloom.session import materialise
from ionloom.sources.libraries import distinct_shifts, parsed_peptides

TITLES = {f"UNIMOD:{accession}": title for accession, title, _, _ in MODIFICATIONS}


def named_peptides(peptides: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct library peptides with their shifts turned into named sites.

    Shifts join their resolution by value; a peptide's sites come together again as a list no
    longer than the peptide.
    """
    shifts = peptides.select("peptide_text", F.explode("shifts").alias("s")).select("peptide_text", "s.*")
    site = F.struct(
        "site_kind", "pos", F.lit("").alias("residue"), F.concat(F.lit("UNIMOD:"), F.col("accession").cast("string")).alias("spec")
    )
    named = (
        shifts.join(resolved, "shift").groupBy("peptide_text").agg(F.array_sort(F.collect_list(site)).alias("sites"))
    )
    return (
        peptides.select("peptide_text", F.col("residues").alias("peptide"))
        .join(named, "peptide_text", "left")
        .withColumn("sites", F.coalesce("sites", F.array().cast(SITE_TYPE)))
    )


def with_smooth_prediction(rows: DataFrame, deltas: dict[int, float] = DEFAULT_DELTAS) -> DataFrame:
    """Default predictor: the built-in labels as column ``predicted``."""
    masses = chemistry.residue_masses(F.col("peptide"), F.col("sites"), deltas)
    labels = smooth_labels(F.col("peptide"), F.col("masses"), F.col("mass"), F.col("charge"))
    return rows.withColumn("masses", masses).withColumn("predicted", labels["ms2"]).drop("masses")


def score_library(
    rows: DataFrame,
    aliases: DataFrame,
    predict: Callable[[DataFrame], DataFrame] = with_smooth_prediction,
    deltas: dict[int, float] = DEFAULT_DELTAS,
) -> DataFrame:
    """One scored row per library precursor: angle, distance and the facet inputs.

    ``rows`` are library fragments; ``aliases`` the declared modifications. A mass shift that no
    alias explains refuses the whole library. ``predict`` adds ``predicted`` to rows with
    ``peptide, sites, charge, mass``.
    """
    records = materialise(library_precursors(rows))
    peptides = materialise(parsed_peptides(records.select("peptide_text").distinct()))
    resolved = require_no_unmapped(materialise(resolve_shifts(distinct_shifts(peptides), aliases)))
    named = named_peptides(peptides, resolved)
    filled = records.where(F.size("fragments") > 0).join(named, "peptide_text")
    observed = scatter_library(filled.withColumn("length", F.length("peptide")), "length")
    observed = observed.withColumn(
        "mass", chemistry.mono_mass(F.col("peptide"), chemistry.mods_mass(F.col("sites"), deltas))
    )
    scored = predict(observed.withColumnRenamed("ms2", "observed")).where(spectra.total(F.col("observed")) > 0)
    return scored.select(
        "peptide_text",
        "peptide",
        "sites",
        "charge",
        "length",
        "mass",
        spectra.spectral_angle(F.col("predicted"), F.col("observed"), float("nan")).alias("angle"),
        spectra.sum_normalised_l2(F.col("predicted"), F.col("observed")).alias("distance"),
    )


def faceted(scored: DataFrame, titles: dict[str, str] = TITLES) -> DataFrame:
    """Scored rows repeated per modification set, length, charge and mass class."""
    names = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.transform("sites", lambda s: F.try_element_at(chemistry.literal_map(titles), s["spec"]))
            )
        )
    )
    return facet_levels(scored, names)


def library_facets(scored: DataFrame, titles: dict[str, str] = TITLES) -> DataFrame:
    """Count, mean and median angle per facet level."""
    return facet_report(faceted(scored, titles))


def library_facet_histograms(scored: DataFrame, titles: dict[str, str] = TITLES) -> DataFrame:
    """Angle counts on the shared grid per facet level."""
    return angle_histogram(faceted(scored, titles), ["facet", "level"])


def library_distance(scored: DataFrame) -> DataFrame:
    """Count and exact median of the distance over the whole library, as one row."""
    return exact_quantiles(scored.withColumn("scope", F.lit("overall")), ["scope"], "distance", {"median": 0.5})


def library_histogram(scored: DataFrame) -> DataFrame:
    """Overall angle counts on the shared grid."""
    return angle_histogram(scored.withColumn("scope", F.lit("overall")), ["scope"])
