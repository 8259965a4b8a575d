"""Joins with checks: cardinality, band, full-outer difference, set difference, uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join where a null key equals a null key; the key columns appear once."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when ``violations`` has a row. Reads at most a handful of them."""
    sample = violations.limit(5).collect()
    if sample:
        raise ValueError(f"{message}: {[row.asDict() for row in sample]}")


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    require_empty(duplicates(df, keys), f"{what} must be unique by {keys}")


def checked_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "m:1"
) -> DataFrame:
    """Join that refuses to fan out.

    ``1:1`` needs unique keys on both sides, ``m:1`` on the right. Each check is one aggregate
    with map-side combining and looks at a few offending keys only.
    """
    if validate not in ("1:1", "m:1"):
        raise ValueError(f"unknown validation {validate!r}")
    require_unique(right, keys, "the right side of the join")
    if validate == "1:1":
        require_unique(left, keys, "the left side of the join")
    return left.join(right, keys, how)


def missing_keys(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct expected keys that are absent from ``present``."""
    return expected.select(*keys).distinct().join(present.select(*keys), keys, "left_anti")


def band_join(
    shifts: DataFrame, aliases: DataFrame, shift: str, target: str, tolerance: float
) -> DataFrame:
    """Pairs with ``|shift - target| <= tolerance`` as an equi-join on neighbouring bins.

    Bins are two tolerances wide, so a match can only be in the same or an adjacent bin. The alias
    side is repeated three times; nothing is compared with everything.
    """
    width = 2.0 * tolerance
    left = shifts.withColumn("__bin", F.floor(F.col(shift) / F.lit(width)))
    near = F.floor(F.col(target) / F.lit(width))
    right = aliases.withColumn(
        "__bin", F.explode(F.array(near - 1, near, near + 1))
    )
    within = F.abs(F.col(shift) - F.col(target)) <= F.lit(tolerance)
    return left.join(right, "__bin").where(within).drop("__bin")


def resolve_shifts(
    shifts: DataFrame,
    aliases: DataFrame,
    shift: str = "shift",
    tolerance: float = 1e-4,
    declared_tolerance: float = 0.01,
) -> DataFrame:
    """Each distinct mass shift with the first declared alias that explains it, or null.

    ``aliases`` has ``alias_order, accession, table_mass, observed_mass``. A declared observed
    mass replaces the table mass; one further than ``declared_tolerance`` from it is an error.
    """
    far = aliases.where(F.abs(F.col("observed_mass") - F.col("table_mass")) > declared_tolerance)
    require_empty(far, "declared mass is too far from the table mass")
    targets = aliases.withColumn("target", F.coalesce("observed_mass", "table_mass"))
    distinct = shifts.select(shift).where(F.col(shift).isNotNull()).distinct()
    hits = (
        band_join(distinct, targets, shift, "target", tolerance)
        .groupBy(shift)
        .agg(F.min_by("accession", "alias_order").alias("accession"))
    )
    return distinct.join(hits, shift, "left")


def settings_difference(library: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys that two ``(key, value)`` documents spell differently, with both values."""
    left = library.select("key", F.col("value").alias("library"))
    right = expected.select("key", F.col("value").alias("expected"))
    both = left.join(right, "key", "full_outer")
    return both.where(~F.col("library").eqNullSafe(F.col("expected")))


def overlapping_rules(fixed: DataFrame, variable: DataFrame) -> DataFrame:
    """Variable rules that share a target with any fixed rule: ``(rule, shared)``, one row each.

    Both sides have ``rule`` and ``targets`` (array of residues, ``n`` or ``c``). The fixed targets together
    are at most 28 letters, so they reach the driver as one list.
    """
    taken = sorted(r[0] for r in fixed.select(F.explode("targets")).distinct().collect())
    shared = F.array_sort(F.array_intersect("targets", F.array(*[F.lit(t) for t in taken]).cast("array<string>")))
    return variable.select("rule", shared.alias("shared")).where(F.size("shared") > 0)


def scored_pairs(predicted: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted and observed spectra of one precursor; unequal grids stop the job."""
    pairs = observed.join(predicted, keys)
    agree = F.size("predicted") == F.size("observed")
    return pairs.where(
        F.when(agree, F.lit(True)).otherwise(
            F.raise_error(F.lit("predicted and observed spectra have different sizes")).cast("boolean")
        )
    )


def interleave_order(rank: Column, mix: Column) -> list[Column]:
    """Order that takes one row from each mix in turn until all are exhausted."""
    return [rank.asc(), mix.asc()]
