"""Replicate curation: shared retention windows, ranking per context, consensus ceilings.

Peptidoforms and contexts may be of any size, so nothing here is a window over them. Group facts
are aggregates put back by a join (AQE splits a hot key there), medians and ranks come from one
distributed sort (:mod:`ionloom.operators.ordering`).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import spectra
from ionloom.functions.binding import let
from ionloom.functions.spectra import evidence, finite
from ionloom.operators.joins import checked_join, null_safe
from ionloom.operators.ordering import exact_quantiles, with_position
from ionloom.session import materialise

PEPTIDOFORM = ["raw_file", "proforma"]
CONTEXT = [*PEPTIDOFORM, "charge", "detector", "fragmentation", "energy_key"]
REPORT_QUANTILES = {
    "p00": 0.0,
    "p25": 0.25,
    "p50": 0.5,
    "p75": 0.75,
    "p90": 0.9,
    "p95": 0.95,
    "p99": 0.99,
    "p100": 1.0,
}


@dataclass(frozen=True)
class CurationPolicy:
    """Settings of the confidence filter; bounds are checked here only."""

    half_max_fraction: float = 0.5
    min_in_window_psms: int = 4
    max_psms_per_context: int = 2
    width_anchor_min_psms: int = 8
    energy_bucket_width: float = 1.0
    min_run_width_minutes: float = 0.05
    max_run_width_minutes: float = 0.25

    def __post_init__(self) -> None:
        checks = {
            "half_max_fraction must be in (0, 1]": 0.0 < self.half_max_fraction <= 1.0,
            "min_in_window_psms must be positive": self.min_in_window_psms >= 1,
            "max_psms_per_context must be positive": self.max_psms_per_context >= 1,
            "width_anchor_min_psms must be at least two": self.width_anchor_min_psms >= 2,
            "energy_bucket_width must be positive": self.energy_bucket_width > 0,
            "min_run_width_minutes must not be negative": self.min_run_width_minutes >= 0,
            "max_run_width_minutes must not be below min_run_width_minutes": (
                self.max_run_width_minutes >= self.min_run_width_minutes
            ),
        }
        for message, holds in checks.items():
            if not holds:
                raise ValueError(message)

    def canonical(self) -> dict:
        return asdict(self)


def with_intensity(prepared: DataFrame, metadata: DataFrame) -> DataFrame:
    """Prepared spectra with the source's precursor intensity.

    The metadata is reduced to one row per scan (the smallest intensity by value when repeated),
    then joined one to one.
    """
    key = ["raw_file", "scan_number"]
    reduced = metadata.groupBy(*key).agg(F.min("precursor_intensity").alias("precursor_intensity"))
    return checked_join(prepared, reduced, key, "left", validate="1:1")


def apex_ratio(psms: DataFrame, half_max_fraction: float) -> DataFrame:
    """Intensity relative to the peptidoform's strongest PSM and whether it supports half height."""
    apex = psms.groupBy(*PEPTIDOFORM).agg(
        F.max(evidence(F.col("precursor_intensity"))).alias("apex_intensity")
    )
    top = F.col("apex_intensity")
    ratio = F.when(top == 0, F.lit(float("nan"))).otherwise(
        F.col("precursor_intensity") / F.when(top != 0, top)
    )
    return (
        null_safe(psms, apex, PEPTIDOFORM, "left")
        .withColumn("intensity_ratio", ratio)
        .withColumn(
            "supports_half_max",
            finite(F.col("intensity_ratio"))
            & F.coalesce(F.col("intensity_ratio") >= half_max_fraction, F.lit(False)),
        )
        .drop("apex_intensity")
    )


def peptidoform_summary(supported: DataFrame) -> DataFrame:
    """Per peptidoform: PSMs, support, apex retention time and observed half-height span.

    The apex is the most intense supporting PSM, the smallest identifier on a tie.
    """
    support = F.col("supports_half_max")
    rt = evidence(F.col("raw_rt"))
    strongest = F.when(support, F.struct((-F.col("precursor_intensity")).alias("i"), F.col("spectrum_id")))
    return (
        supported.groupBy(*PEPTIDOFORM)
        .agg(
            F.count(F.lit(1)).alias("psms"),
            F.count_if(support).alias("half_max_support_psms"),
            F.min_by("raw_rt", strongest).alias("apex_rt"),
            F.min(F.when(support, rt)).alias("observed_start"),
            F.max(F.when(support, rt)).alias("observed_end"),
        )
        .withColumn("observed_width_minutes", F.col("observed_end") - F.col("observed_start"))
    )


def run_widths(peptidoforms: DataFrame, policy: CurationPolicy) -> DataFrame:
    """One width per raw file: median of the anchors, else of all positive widths, else null.

    The width is clamped into the plausible range and flagged; a null width stays null, since
    nothing was measured.
    """
    positive = peptidoforms.where("observed_width_minutes > 0").select(
        "raw_file", "observed_width_minutes", "half_max_support_psms"
    )
    anchors = positive.where(F.col("half_max_support_psms") >= policy.width_anchor_min_psms)
    median = {"median": 0.5}
    anchored = exact_quantiles(anchors, ["raw_file"], "observed_width_minutes", median)
    fallback = exact_quantiles(positive, ["raw_file"], "observed_width_minutes", median)
    widths = (
        peptidoforms.select("raw_file")
        .distinct()
        .join(
            anchored.select("raw_file", F.col("median").alias("anchor_width"), F.col("n").alias("anchors")),
            "raw_file",
            "left",
        )
        .join(fallback.select("raw_file", F.col("median").alias("fallback_width")), "raw_file", "left")
        .withColumn("measured", F.coalesce("anchor_width", "fallback_width"))
    )
    low, high = F.lit(policy.min_run_width_minutes), F.lit(policy.max_run_width_minutes)
    measured = F.col("measured")
    return widths.select(
        "raw_file",
        F.when(measured.isNotNull(), F.greatest(F.least(measured, high), low)).alias("run_width_minutes"),
        F.coalesce("anchors", F.lit(0)).cast("bigint").alias("width_anchor_peptidoforms"),
        F.coalesce((measured < low) | (measured > high), F.lit(False)).alias("width_clamped"),
    )


def apex_windows(peptidoforms: DataFrame, widths: DataFrame) -> DataFrame:
    """Acceptance window per peptidoform: its apex plus and minus half the run's width."""
    half = F.col("run_width_minutes") / 2
    return null_safe(peptidoforms, widths, ["raw_file"], "left").select(
        *PEPTIDOFORM,
        "apex_rt",
        "run_width_minutes",
        (F.col("apex_rt") - half).alias("apex_window_start"),
        (F.col("apex_rt") + half).alias("apex_window_end"),
    )


def window_membership(supported: DataFrame, windows: DataFrame, min_in_window: int) -> DataFrame:
    """Whether each PSM lies in its window, and how many of its groups do."""
    rt = F.col("raw_rt")
    inside = rt.between(F.col("apex_window_start"), F.col("apex_window_end")) & finite(F.col("apex_rt"))
    placed = (
        null_safe(supported, windows, PEPTIDOFORM, "left")
        .withColumn("within_apex_window", F.coalesce(inside, F.lit(False)))
        .withColumn("apex_distance", F.abs(rt - F.col("apex_rt")))
    )
    by_context = placed.groupBy(*CONTEXT).agg(
        F.count_if("within_apex_window").alias("context_window_psms")
    )
    by_peptidoform = by_context.groupBy(*PEPTIDOFORM).agg(
        F.sum("context_window_psms").alias("peptidoform_window_psms")
    )
    return (
        null_safe(placed, null_safe(by_context, by_peptidoform, PEPTIDOFORM, "inner"), CONTEXT, "left")
        .withColumn(
            "eligible",
            F.col("within_apex_window") & (F.col("peptidoform_window_psms") >= min_in_window),
        )
    )


def rank_contexts(members: DataFrame, policy: CurationPolicy) -> DataFrame:
    """Cumulative eligible rank per context, selection under the cap, and a reason for each PSM.

    Eligible first, then score, apex distance, intensity and identifier; missing values last.
    """
    order = [F.col(c).asc() for c in CONTEXT] + [
        F.col("eligible").desc(),
        evidence(F.col("andromeda_score")).desc_nulls_last(),
        evidence(F.col("apex_distance")).asc_nulls_last(),
        evidence(F.col("precursor_intensity")).desc_nulls_last(),
        F.col("spectrum_id").asc(),
    ]
    placed = with_position(members, order, "place")
    starts = placed.groupBy(*CONTEXT).agg(
        F.min("place").alias("start"), F.count_if("eligible").alias("eligible_psms")
    )
    rank = F.when(F.col("eligible"), F.col("place") - F.col("start") + 1).otherwise(F.col("eligible_psms"))
    ranked = null_safe(placed, starts, CONTEXT, "left").withColumn("selection_rank", rank)
    selected = F.col("eligible") & (F.col("selection_rank") <= policy.max_psms_per_context)
    reason = (
        F.when(F.col("selected"), "top_context_psm")
        .when(F.col("peptidoform_window_psms") < policy.min_in_window_psms, "insufficient_in_window_replication")
        .when(~F.col("within_apex_window"), "outside_shared_window")
        .otherwise("context_cap")
    )
    return (
        ranked.withColumn("selected", selected)
        .withColumn("selection_reason", reason)
        .drop("place", "start", "eligible_psms")
    )


def with_context_key(psms: DataFrame, energy_bucket_width: float) -> DataFrame:
    """The energy bucket as part of the context; a null bucket, like any null key, is a group of its own."""
    return psms.withColumn("energy_key", spectra.energy_bucket(F.col("energy"), energy_bucket_width))


_RANKING = [
    "spectrum_id",
    *PEPTIDOFORM,
    "charge",
    "detector",
    "fragmentation",
    "energy",
    "raw_rt",
    "andromeda_score",
    "precursor_intensity",
]


@dataclass(frozen=True)
class Curation:
    """Per-spectrum verdicts and the tables behind them."""

    verdicts: DataFrame
    peptidoforms: DataFrame
    widths: DataFrame
    policy: CurationPolicy

    def annotations(self) -> DataFrame:
        return self.verdicts.select(
            "spectrum_id",
            "precursor_intensity",
            "intensity_ratio",
            "supports_half_max",
            "apex_rt",
            "run_width_minutes",
            "apex_window_start",
            "apex_window_end",
            "within_apex_window",
            "peptidoform_window_psms",
            "context_window_psms",
            "selection_rank",
            "selected",
            "selection_reason",
        )


def curate(psms: DataFrame, policy: CurationPolicy = CurationPolicy()) -> Curation:
    """Apply one window per raw-file peptidoform, then keep the best PSMs of each context.

    Only the narrow ranking columns take part; spectra join back by identifier at the end.
    """
    narrow = with_context_key(psms.select(*_RANKING), policy.energy_bucket_width)
    supported = apex_ratio(narrow, policy.half_max_fraction)
    # Read three times below (widths twice, windows once), so written once.
    peptidoforms = materialise(peptidoform_summary(supported))
    widths = run_widths(peptidoforms, policy)
    members = window_membership(
        supported, apex_windows(peptidoforms, widths), policy.min_in_window_psms
    )
    # Annotations, selection and report all read the verdicts: narrow rows, written once.
    return Curation(materialise(rank_contexts(members, policy)), peptidoforms, widths, policy)


def peptidoform_groups(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(*PEPTIDOFORM).agg(
        F.count(F.lit(1)).alias("psms"),
        F.count_if("supports_half_max").alias("half_max_support_psms"),
        F.count_if("within_apex_window").alias("window_psms"),
        F.count_if("selected").alias("selected_psms"),
    )


def context_groups(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(*CONTEXT).agg(
        F.count_if("within_apex_window").alias("window_psms"),
        F.count_if("selected").alias("selected_psms"),
    )


def selection_counts(curation: Curation) -> DataFrame:
    """The report's scalar block as one row."""
    verdicts = curation.verdicts
    groups = peptidoform_groups(verdicts).agg(
        F.count(F.lit(1)).alias("peptidoform_groups"),
        F.count_if(F.col("window_psms") >= curation.policy.min_in_window_psms).alias("qualifying_peptidoforms"),
    )
    contexts = context_groups(verdicts).agg(
        F.count(F.lit(1)).alias("context_groups"),
        F.count_if(F.col("selected_psms") > 0).alias("selected_contexts"),
    )
    rows = verdicts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~finite(F.col("precursor_intensity"))).alias("missing_precursor_intensity_rows"),
        F.count_if("within_apex_window").alias("apex_window_rows"),
        F.count_if("selected").alias("selected_rows"),
    )
    runs = curation.widths.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("width_clamped").alias("clamped_runs")
    )
    one = F.lit(0).alias("__one")
    joined = rows.select("*", one)
    for part in (groups, contexts, runs):
        joined = joined.join(part.select("*", one), "__one")
    return joined.drop("__one").withColumn(
        "rejected_peptidoforms", F.col("peptidoform_groups") - F.col("qualifying_peptidoforms")
    )


def replication_quantiles(curation: Curation) -> DataFrame:
    """Quantile set of PSM counts per peptidoform, one row per measure."""
    groups = peptidoform_groups(curation.verdicts)
    long = groups.select(
        F.explode(
            F.create_map(
                F.lit("psms_per_peptidoform"), F.col("psms"),
                F.lit("window_psms_per_peptidoform"), F.col("window_psms"),
                F.lit("selected_psms_per_peptidoform"), F.col("selected_psms"),
            )
        ).alias("measure", "value")
    )
    return exact_quantiles(long, ["measure"], "value", REPORT_QUANTILES)


SUBSETS = ("all", "within_apex_window", "selected")


def leave_one_out_angles(verdicts: DataFrame, spectra_table: DataFrame, keys: list[str]) -> DataFrame:
    """Each replicate's angle to the consensus of its peers, for three nested subsets at once.

    ``spectra_table`` is ``(spectrum_id, ms2)``. The consensus of the others is the group's sum
    minus the row itself, so no pair of replicates is ever formed. Sums are per (group, cell) and
    combined before the shuffle; a group's sum vector is as long as one spectrum. Rows without
    intensity take no part, and a subset needs two usable rows.
    """
    unit = (
        verdicts.select("spectrum_id", *keys, "within_apex_window", "selected")
        .join(spectra_table.select("spectrum_id", "ms2"), "spectrum_id")
        .withColumn("unit", spectra.unit(F.col("ms2")))
        .where("unit is not null")
        .drop("ms2")
    )
    flags = {
        "all": F.lit(True),
        "within_apex_window": F.col("within_apex_window"),
        "selected": F.col("selected"),
    }
    cells = unit.select(*keys, "within_apex_window", "selected", F.posexplode("unit").alias("cell", "value"))
    sums = cells.groupBy(*keys, "cell").agg(
        *[F.sum(F.when(flag, F.col("value")).otherwise(0.0)).alias(name) for name, flag in flags.items()],
        *[F.count_if(flag).alias(f"n_{name}") for name, flag in flags.items()],
    )
    entry = F.struct("cell", *SUBSETS)
    totals = sums.groupBy(*keys).agg(
        F.array_sort(F.collect_list(entry)).alias("sums"),
        *[F.max(f"n_{name}").alias(f"n_{name}") for name in SUBSETS],
    )
    rows = null_safe(unit, totals.where("n_all >= 2"), keys, "inner")

    def angle(name: str) -> Column:
        def against(peers: Column) -> Column:
            length = spectra.norm(peers)
            along = spectra.dot(F.col("unit"), peers)
            return F.when(length > 0, along / F.when(length > 0, length))

        cosine = let(F.zip_with("unit", "sums", lambda u, s: s[name] - u), against)
        counted = flags[name] & (F.col(f"n_{name}") >= 2)
        return F.struct(
            F.lit(name).alias("subset"),
            F.when(counted, spectra.angle_from_cosine(cosine)).alias("angle"),
        )

    scored = F.explode(F.filter(F.array(*[angle(n) for n in SUBSETS]), lambda a: a["angle"].isNotNull()))
    return rows.select("spectrum_id", *keys, scored.alias("scored")).select(
        "spectrum_id", *keys, "scored.subset", "scored.angle"
    )
