"""Reports from mergeable states: histograms of fixed length that add up element by element, at several grains at once.

The rows are aggregated once at the finest grain; every coarser line of a report is a sum of those states, a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.constants import ANGLE_BINS, REFUSAL_REASONS
from ionloom.functions.spectra import angle_bin, finite
from ionloom.operators.curation import CONTEXT, SUBSETS, Curation, leave_one_out_angles, replication_quantiles, selection_counts
from ionloom.operators.evaluate import FIVE_QUANTILES
from ionloom.operators.joins import null_safe
from ionloom.operators.ordering import exact_quantiles
from ionloom.session import materialise


def histogram_states(scores: DataFrame, keys: list[str], value: str = "angle", bins: int = ANGLE_BINS) -> DataFrame:
    """``(keys, n, total, bins)``: values, their sum, and counts on the shared grid as an array of fixed length."""
    cells = scores.where(F.col(value).isNotNull()).groupBy(*keys, angle_bin(F.col(value), bins).alias("__bin")).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum(value).alias("__sum")
    )
    inside = F.when(F.col("__bin").isNotNull(), F.struct("__bin", "__rows"))
    groups = cells.groupBy(*keys).agg(
        F.sum("__rows").alias("n"), F.sum("__sum").alias("total"), F.map_from_entries(F.collect_list(inside)).alias("__filled")
    )  # at most one entry per bin
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("__filled", i), F.lit(0)).cast("bigint"))
    return groups.select(*keys, "n", "total", counts.alias("bins"))


def added(column: str, length: int = ANGLE_BINS) -> Column:
    """Arrays of a fixed length added element by element: as many sums as the array is long, combined before the shuffle."""
    return F.array(*[F.coalesce(F.sum(F.col(column)[i]), F.lit(0)).cast("bigint") for i in range(length)])


def histogram_count(bins: Column) -> Column:
    return F.aggregate(bins, F.lit(0).cast("bigint"), lambda a, x: a + x)


def histogram_mean(bins: Column, length: int = ANGLE_BINS) -> Column:
    """Mean by bin centres, a bin weighing as much as its count; null for an empty histogram."""
    weighted = F.aggregate(F.transform(bins, lambda n, i: n * (i + F.lit(0.5)) / F.lit(float(length))), F.lit(0.0), lambda a, x: a + x)
    n = histogram_count(bins)
    return F.when(n > 0, weighted / F.when(n > 0, n))


def ceiling_states(angles: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, ceilings)``: a map of subset to its histogram, from ``(keys, subset, angle)`` rows."""
    states = histogram_states(angles, [*keys, "subset"])
    return states.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("subset", "bins"))).alias("ceilings"))


def merged_ceilings(shards: DataFrame, subsets: tuple[str, ...] = SUBSETS) -> DataFrame:
    """Per dataset and for the corpus (``*``) three ceilings: replicates compared, mean, histogram.

    ``shards`` has ``dataset`` and ``ceilings`` (null where a shard has none). Counts add up, so a shard weighs as much
    as the replicates it compared.
    """
    long = shards.select("dataset", F.explode("ceilings").alias("subset", "bins"))
    merged = long.groupingSets([["dataset", "subset"], ["subset"]], "dataset", "subset").agg(added("bins").alias("bins"))
    named = merged.withColumn("dataset", F.coalesce("dataset", F.lit("*")))
    wide = named.groupBy("dataset").agg(*[F.max(F.when(F.col("subset") == s, F.col("bins"))).alias(s) for s in subsets])
    columns = []
    for s in subsets:
        columns += [
            F.coalesce(histogram_count(F.col(s)), F.lit(0)).cast("bigint").alias(f"ceiling_{s}_replicates"),
            histogram_mean(F.col(s)).alias(f"ceiling_{s}_mean"),
            F.col(s).alias(f"ceiling_{s}_histogram"),
        ]
    return wide.select("dataset", *columns)


def with_ceilings(summary: DataFrame, shards: DataFrame) -> DataFrame:
    """A corpus summary with its ceilings; a source without any has counts of zero and null means."""
    out = summary.join(merged_ceilings(shards), "dataset", "left")
    return out.select(*summary.columns, *[F.coalesce(c, F.lit(0)).alias(c) if c.endswith("_replicates") else F.col(c) for c in out.columns if c not in summary.columns])


def curation_report(curation: Curation, spectra_table: DataFrame, keys: list[str] = CONTEXT) -> DataFrame:
    """The report of one curated source as one nested row: counts, replication quantiles, ceilings, policy."""
    one = F.lit(0).alias("__one")
    counts = selection_counts(curation)
    block = lambda *names: F.struct(*names)
    head = counts.select(
        block("rows", "missing_precursor_intensity_rows", "peptidoform_groups", "context_groups").alias("input"),
        block("runs", "clamped_runs").alias("chromatography"),
        block("apex_window_rows", "selected_rows", "qualifying_peptidoforms", "rejected_peptidoforms", "selected_contexts").alias("selection"),
        one,
    )
    quantiles = replication_quantiles(curation)
    levels = [c for c in quantiles.columns if c not in ("measure", "n")]
    replication = quantiles.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("measure", F.struct(*levels))))).alias("replication"), one)
    angles = leave_one_out_angles(curation.verdicts, spectra_table, keys)
    states = histogram_states(angles, ["subset"])
    facts = F.struct((F.col("total") / F.col("n")).alias("mean"), F.col("n").alias("replicates_compared"), F.struct(F.col("bins").alias("counts")).alias("histogram"))
    ceilings = states.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subset", facts)))).alias("achievable_ceiling"), one)
    policy = F.struct(*[F.lit(v).alias(k) for k, v in curation.policy.canonical().items()])
    return head.join(replication, "__one").join(ceilings, "__one").drop("__one").withColumn("policy", policy)


_FIT = ("fit_n", "sx", "sy", "sxx", "syy", "sxy")


def _levels() -> Column:
    cell = F.concat_ws("/", "detector", "fragmentation")
    state = F.when(F.col("labelled"), F.lit("labelled ")).otherwise(F.lit("label-free "))
    pairs = (("dataset", F.col("dataset")), ("acquisition", cell), ("label_acquisition", F.concat(state, cell)), ("overall", F.lit("all")))
    return F.explode(F.array(*[F.struct(F.lit(level).alias("level"), column.alias("cell")) for level, column in pairs]))


def multi_grain_report(rows: DataFrame, reasons: tuple[str, ...] = REFUSAL_REASONS) -> DataFrame:
    """Angle, histogram, refusals and retention fit per dataset, acquisition, label state and overall.

    ``rows`` has ``dataset, detector, fragmentation, labelled, angle, reason, observed, predicted``: a row is scored
    (``angle``) or refused (``reason``). They are aggregated once at the finest grain; a line of the report adds up
    states. Retention is summed about the dataset's own first values, so sums stay small. The residual of the fit needs
    the fit first, and quantiles need order: both read the narrow rows once more, stored.
    """
    narrow = materialise(rows.select("dataset", "detector", "fragmentation", "labelled", "angle", "reason", "observed", "predicted"))
    grain = ["dataset", "detector", "fragmentation", "labelled"]
    paired = F.col("angle").isNotNull() & finite(F.col("observed")) & finite(F.col("predicted"))
    x, y = F.when(paired, F.col("predicted")), F.when(paired, F.col("observed"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # One more key for the histogram: a state has at most one row per bin and reason.
    cells = narrow.groupBy(*grain, angle_bin(F.col("angle")).alias("bin"), "reason").agg(
        F.count("angle").alias("scored"), zero(F.sum("angle")).alias("total"), F.count_if(F.col("angle").isNull()).alias("refused"),
        F.count(x).alias("fit_n"), zero(F.sum(x)).alias("sx"), zero(F.sum(y)).alias("sy"), zero(F.sum(x * x)).alias("sxx"), zero(F.sum(y * y)).alias("syy"), zero(F.sum(x * y)).alias("sxy"),
    )
    states = materialise(cells)
    leveled = states.select("*", _levels().alias("at")).select("*", "at.level", "at.cell")
    lines = leveled.groupBy("level", "cell").agg(
        F.sum("scored").alias("scored"), F.sum("total").alias("__total"), F.sum("refused").alias("refused"),
        *[F.sum(F.when(F.col("reason") == r, F.col("refused")).otherwise(0)).alias(f"refused_{r}") for r in reasons],
        *[F.sum(c).alias(c) for c in _FIT],
        F.array(*[F.sum(F.when(F.col("bin") == i, F.col("scored")).otherwise(0)) for i in range(ANGLE_BINS)]).alias("histogram"),
    )
    n = F.when(F.col("fit_n") >= 2, F.col("fit_n"))
    vx, vy = F.col("sxx") / n - F.pow(F.col("sx") / n, F.lit(2.0)), F.col("syy") / n - F.pow(F.col("sy") / n, F.lit(2.0))
    cov = F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n
    # Flat up to rounding is flat.
    varies = (vx > F.lit(1e-12) * (F.col("sxx") / n)) & (vy > F.lit(1e-12) * (F.col("syy") / n))
    r2 = F.when(varies, F.pow(cov, F.lit(2.0)) / F.when(varies, vx * vy))
    slope = F.when(varies, cov / F.when(varies, vx))
    fitted = lines.withColumn("r_squared", r2).withColumn("__slope", slope).withColumn("__intercept", F.col("sy") / n - F.col("__slope") * F.col("sx") / n)
    lines_of_fit = fitted.where("level = 'dataset' and __slope is not null").select(F.col("cell").alias("dataset"), "__slope", "__intercept")
    residual = null_safe(narrow.where(paired).select("dataset", "observed", "predicted"), lines_of_fit, ["dataset"], "inner").groupBy("dataset").agg(
        F.avg(F.abs(F.col("observed") - F.col("__slope") * F.col("predicted") - F.col("__intercept"))).alias("residual_mae")
    )
    scored = narrow.where("angle is not null").select(_levels().alias("at"), "angle", "dataset").select("at.level", "at.cell", "angle")
    quantiles = exact_quantiles(scored, ["level", "cell"], "angle", FIVE_QUANTILES).drop("n")
    out = null_safe(fitted, quantiles, ["level", "cell"], "left")
    out = null_safe(out, residual.select(F.lit("dataset").alias("level"), F.col("dataset").alias("cell"), "residual_mae"), ["level", "cell"], "left")
    own = F.col("level") == "dataset"
    return out.select(
        "level", "cell", "scored", "refused", *[f"refused_{r}" for r in reasons],
        F.when(F.col("scored") > 0, F.col("__total") / F.when(F.col("scored") > 0, F.col("scored"))).alias("mean"), *FIVE_QUANTILES, "histogram",
        F.when(own, F.col("r_squared")).alias("r_squared"), "residual_mae",
    )
