"""Spectrum arithmetic on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.constants import ANGLE_BINS, ION_COLUMNS
from ionloom.functions.binding import let


def finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(
        ~F.isnan(value) & (value != float("inf")) & (value != float("-inf")), F.lit(False)
    )


def evidence(value: Column) -> Column:
    """NaN means the same as null: nothing was measured. Aggregates and orderings need null."""
    return F.when(~F.isnan(value), value)


def fragment_cell(ion: Column, ordinal: Column, charge: Column, length: Column) -> Column:
    """Grid cell ``(site, col)`` of an annotated fragment, or null when it has no place."""
    kind = F.lower(ion)
    is_b = kind == "b"
    inside = (
        kind.isin("b", "y")
        & charge.isin(1, 2)
        & (length >= 2)
        & (ordinal >= 1)
        & (ordinal <= length - 1)
    )
    site = F.when(is_b, ordinal - 1).otherwise(length - 1 - ordinal)
    col = F.when(is_b, F.lit(0)).otherwise(F.lit(1)) + 2 * (charge - 1)
    return F.when(
        inside, F.struct(site.cast("int").alias("site"), col.cast("int").alias("col"))
    )


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(a: Column) -> Column:
    """The array scaled to length one, or null when it has no length."""
    return let(
        norm(a),
        lambda length: F.when(
            length > 0, F.transform(a, lambda x: x.cast("double") / F.when(length > 0, length))
        ),
    )


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def nan_total(a: Column) -> Column:
    """Sum of the entries that are numbers."""
    return F.aggregate(
        a,
        F.lit(0.0),
        lambda acc, x: acc + F.coalesce(evidence(x.cast("double")), F.lit(0.0)),
    )


def cosine_of(dot_ab: Column, norm_a: Column, norm_b: Column, zero: Column | float) -> Column:
    """Cosine from its parts; ``zero`` is the answer when either vector has no length."""
    fallback = F.lit(zero) if isinstance(zero, float) else zero
    length = norm_a * norm_b
    return F.when(length > 0, dot_ab / F.when(length > 0, length)).otherwise(fallback)


def cosine(a: Column, b: Column, zero: Column | float = 0.0) -> Column:
    return cosine_of(dot(a, b), norm(a), norm(b), zero)


def angle_from_cosine(value: Column) -> Column:
    """Normalised spectral contrast angle; NaN stays NaN."""
    clamped = F.when(F.isnan(value), value).otherwise(
        F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))
    )
    return 1.0 - 2.0 * F.acos(clamped) / F.lit(math.pi)


def spectral_angle(a: Column, b: Column, zero: Column | float = 0.0) -> Column:
    """Angle in [0, 1] for non-negative spectra. ``zero`` is the *cosine* of an empty spectrum.

    The default scores an empty spectrum 0; pass NaN to mark it as not measurable.
    """
    return angle_from_cosine(cosine(a, b, zero))


def masked_angle(a: Column, b: Column, sites: Column) -> Column:
    """Angle over the first ``sites`` grid rows; padding beyond them does not count."""
    cells = sites * len(ION_COLUMNS)
    return spectral_angle(F.slice(a, F.lit(1), cells), F.slice(b, F.lit(1), cells))


def sum_normalised_l2(a: Column, b: Column) -> Column:
    """Distance of the two spectra as distributions; NaN when either sums to nothing."""

    def distance(sums: Column) -> Column:
        usable = (sums["a"] > 0) & (sums["b"] > 0)
        gaps = F.zip_with(
            a,
            b,
            lambda x, y: x.cast("double") / F.when(usable, sums["a"])
            - y.cast("double") / F.when(usable, sums["b"]),
        )
        return F.when(usable, norm(gaps)).otherwise(F.lit(float("nan")))

    return let(F.struct(total(a).alias("a"), total(b).alias("b")), distance)


def base_peak(values: Column) -> Column:
    """Largest entry, or 1 when no entry is positive: the divisor that never fails."""
    top = F.array_max(values).cast("double")
    return F.when(top > 0, top).otherwise(F.lit(1.0))


def grid_peaks(ms2: Column, grid: Column, min_intensity: float = 0.0) -> Column:
    """Peaks of a flat grid: relative to the base peak, floor applied, m/z from ``grid``."""
    cells = let(
        base_peak(ms2),
        lambda top: F.zip_with(
            grid,
            ms2,
            lambda cell, value: F.struct(
                cell["mz"].alias("mz"),
                (value.cast("double") / top).alias("intensity"),
                cell["ion"].alias("ion"),
                cell["ordinal"].alias("ordinal"),
                cell["charge"].alias("charge"),
            ),
        ),
    )
    return F.filter(cells, lambda peak: peak["intensity"] >= min_intensity)


def strongest(peaks: Column, limit: int) -> Column:
    """The ``limit`` strongest peaks in their original order; ties keep the earlier peak.

    One spectrum has at most four peaks per backbone site, so the sort stays inside a row.
    """
    ranked = F.array_sort(
        F.transform(
            peaks,
            lambda peak, i: F.struct((-peak["intensity"]).alias("k"), i.alias("i"), peak.alias("p")),
        )
    )
    kept = F.slice(ranked, F.lit(1), F.lit(limit))
    back = F.array_sort(F.transform(kept, lambda r: F.struct(r["i"].alias("i"), r["p"].alias("p"))))
    return F.when(F.size(peaks) <= limit, peaks).otherwise(F.transform(back, lambda r: r["p"]))


def angle_bin(value: Column, bins: int = ANGLE_BINS) -> Column:
    """Zero-based bin on [0, 1]; the last bin is closed. Null outside, so totals show losses.

    Edges are compared as ``k / bins``, so a value on an edge falls into the upper bin whatever
    rounding a multiplication would add.
    """
    guess = F.floor(value * bins).cast("int")
    fixed = (
        F.when(value < guess / F.lit(float(bins)), guess - 1)
        .when(value >= (guess + 1) / F.lit(float(bins)), guess + 1)
        .otherwise(guess)
    )
    inside = finite(value) & (value >= 0.0) & (value <= 1.0)
    return F.when(inside, F.least(fixed, F.lit(bins - 1)))


def energy_bucket(energy: Column, width: float) -> Column:
    """Nearest multiple of ``width``; null when the energy is not a finite number.

    Halves round away from zero.
    """
    return F.when(finite(energy), F.round(energy / F.lit(float(width))).cast("bigint"))


def physical_peak(peak: Column) -> Column:
    """A peak every writer accepts: finite positive m/z, intensity in [0, 1]."""
    return (
        finite(peak["mz"])
        & (peak["mz"] > 0)
        & finite(peak["intensity"])
        & peak["intensity"].between(0.0, 1.0)
    )


def peak_annotation(ion: Column, ordinal: Column, charge: Column) -> Column:
    """``y7`` or ``b2^2``: charge is written only when it is not one."""
    base = F.concat(ion, ordinal.cast("string"))
    return F.when(charge == 1, base).otherwise(F.concat(base, F.lit("^"), charge.cast("string")))
