"""Best row per key, top candidates per group, shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions.binding import let
from ionloom.functions.spectra import evidence
from ionloom.operators.joins import null_safe
from ionloom.operators.ordering import with_group_position
from ionloom.session import materialise


def validation_winners(
    prepared: DataFrame, keys: tuple[str, ...] = ("dataset", "proforma", "charge"), split: str = "val"
) -> DataFrame:
    """Best-scored spectrum per peptidoform, ties by identifier, a missing score last.

    A minimum of a small struct: combined before the shuffle, whatever the size of a group.
    """
    score = evidence(F.col("andromeda_score"))
    best = F.struct(
        score.isNull().alias("unscored"),
        F.coalesce(-score, F.lit(0.0)).alias("worst_first"),
        F.col("spectrum_id"),
    )
    return (
        prepared.where(F.col("split") == split)
        .groupBy(*keys)
        .agg(F.min(best).alias("best"))
        .select(*keys, F.col("best.spectrum_id").alias("spectrum_id"))
    )


def best_per_key(df: DataFrame, keys: list[str], quality: Column, first: list[str]) -> DataFrame:
    """The row of highest quality per key; the first by ``first`` wins a tie.

    Any quality column may be passed. A NaN or missing quality loses to any number.
    """
    value = F.coalesce(evidence(quality.cast("double")), F.lit(float("-inf")))
    carried = [c for c in df.columns if c not in keys]
    best = F.struct(
        (-value).alias("worst_first"),
        *[F.col(c).alias(f"first_{i}") for i, c in enumerate(first)],
        F.struct(*carried).alias("row"),
    )
    return (
        df.groupBy(*keys)
        .agg(F.min(best).alias("best"))
        .select(*keys, *[F.col(f"best.row.{c}").alias(c) for c in carried])
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows per group, numbered from one: places from one distributed sort.

    A group of any size is spread over the sort's partitions, whatever the limit is.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    placed = with_group_position(df, keys, order, "rank")
    return placed.withColumn("rank", F.col("rank") + 1).where(F.col("rank") <= limit)


def backbone_coverage(ms2: Column, min_intensity: float) -> Column:
    """Share of backbone sites with a peak at or over the floor, relative to the base peak.

    Null for a spectrum without a positive intensity.
    """

    def share(top: Column) -> Column:
        site = F.transform(
            ms2,
            lambda x, i: F.when(x.cast("double") / F.when(top > 0, top) >= min_intensity, F.floor(i / 4)),
        )
        covered = F.size(F.array_distinct(F.array_compact(site)))
        return F.when((top > 0) & (covered > 0), covered / (F.size(ms2) / F.lit(4)))

    return let(F.array_max(ms2).cast("double"), share)


def reference_shortlist(
    prepared: DataFrame,
    count: int,
    detector: str = "FTMS",
    min_intensity: float = 0.01,
    candidates: int = 200,
) -> DataFrame:
    """The best-covered spectrum of each of the best datasets.

    Score narrows every dataset to ``candidates`` rows, coverage picks one of them, and the
    ``count`` best datasets remain. Fewer usable datasets is an error. The ranking moves dataset, identifier and
    score; spectra are fetched for the rows that pass it.
    """
    usable = prepared.where((F.col("split") == "val") & (F.col("detector") == detector))
    narrow = top_per_group(
        usable.select("dataset", "spectrum_id", "andromeda_score"),
        ["dataset"],
        [evidence(F.col("andromeda_score")).desc_nulls_last(), F.col("spectrum_id").asc()],
        candidates,
    )
    chosen_rows = materialise(narrow.select("dataset", "spectrum_id"))
    shortlist = null_safe(usable.select("dataset", "spectrum_id", "andromeda_score", "ms2"), chosen_rows, ["dataset", "spectrum_id"], "left_semi")
    shortlist = shortlist.withColumn("backbone_coverage", backbone_coverage(F.col("ms2"), min_intensity))
    scored = shortlist.where("backbone_coverage is not null")
    best = F.struct(
        (-F.col("backbone_coverage")).alias("coverage"),
        (-F.coalesce(evidence(F.col("andromeda_score")), F.lit(float("-inf")))).alias("score"),
        F.col("spectrum_id"),
    )
    per_dataset = (
        scored.groupBy("dataset")
        .agg(F.min(best).alias("best"))
        .select(
            "dataset",
            F.col("best.spectrum_id").alias("spectrum_id"),
            (-F.col("best.coverage")).alias("backbone_coverage"),
            (-F.col("best.score")).alias("andromeda_score"),
        )
    )
    # The published figure has four decimals and ranks the datasets.
    chosen = per_dataset.orderBy(F.round("backbone_coverage", 4).desc(), F.col("dataset").asc()).limit(count)
    found = chosen.count()
    if found < count:
        raise ValueError(f"only {found} usable validation spectra found, {count} wanted")
    return chosen
