"""Masses, m/z, compositions and mobility as column arithmetic."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.binding import let
from ionloom.constants import (
    DRIFT_GAS_MASS,
    ELEMENTS,
    HYDROPATHY,
    ION_COLUMNS,
    MOBILITY_COEFFICIENT,
    NUCLIDE_MASS,
    PROTON,
    RESIDUE_ATOMS,
    RESIDUE_MASS,
    WATER,
)


def literal_map(values: dict) -> Column:
    """A constant map column; the keys are a fixed alphabet or a declared modification table."""
    return F.create_map(*[F.lit(item) for item in itertools.chain(*values.items())])


def residue_count(residues: Column, residue: str) -> Column:
    return F.length(residues) - F.length(F.replace(residues, F.lit(residue), F.lit("")))


def weighted_residue_sum(residues: Column, weights: dict[str, float]) -> Column:
    """Sum of a per-residue weight, as counts times weights.

    Twenty replacements stay inside generated code, unlike a per-residue lambda. Text with any
    other letter gives null.
    """
    total = F.lit(0.0)
    for residue in sorted(weights):
        total = total + residue_count(residues, residue) * F.lit(float(weights[residue]))
    known = F.regexp_like(residues, F.lit(f"^[{''.join(sorted(weights))}]+$"))
    return F.when(known, total)


def residue_mass_sum(residues: Column) -> Column:
    return weighted_residue_sum(residues, RESIDUE_MASS)


def hydropathy_sum(residues: Column) -> Column:
    return weighted_residue_sum(residues, HYDROPATHY)


def mono_mass(residues: Column, mod_mass: Column | float = 0.0) -> Column:
    """Neutral monoisotopic mass: residues, modification deltas and one water."""
    delta = F.lit(mod_mass) if isinstance(mod_mass, float) else mod_mass
    return residue_mass_sum(residues) + delta + F.lit(WATER)


def charged_mz(neutral: Column, charge: Column) -> Column:
    return (neutral + charge * F.lit(PROTON)) / charge


def spec_mass(spec: Column, deltas: dict[int, float]) -> Column:
    """Delta of one descriptor: table lookup, or the mass it states. Unknown is null, never zero."""
    accession = F.regexp_extract(spec, r"^UNIMOD:(\d+)$", 1).try_cast("int")
    stated = F.when(F.regexp_like(spec, F.lit(r"^[+-]\d+(?:\.\d+)?$")), spec.try_cast("double"))
    return F.coalesce(F.try_element_at(literal_map(deltas), accession), stated)


def mods_mass(sites: Column, deltas: dict[int, float]) -> Column:
    """Sum of all modification deltas; null when any of them is unknown."""
    return F.aggregate(sites, F.lit(0.0), lambda acc, s: acc + spec_mass(s["spec"], deltas))


def residue_masses(residues: Column, sites: Column | None = None, deltas: dict | None = None) -> Column:
    """Per-position masses with every delta folded in; terminal deltas sit on the end residues."""
    table = literal_map(RESIDUE_MASS)
    bare = F.transform(F.split(residues, ""), lambda residue: F.try_element_at(table, residue))
    if sites is None:
        return bare
    placed = F.transform(
        sites,
        lambda s: F.struct(s["pos"].alias("pos"), spec_mass(s["spec"], deltas or {}).alias("delta")),
    )
    return let(
        placed,
        lambda bound: F.transform(
            bare,
            lambda mass, i: F.aggregate(
                bound, mass, lambda acc, s: F.when(s["pos"] == i, acc + s["delta"]).otherwise(acc)
            ),
        ),
    )


def prefix_sums(masses: Column) -> Column:
    """Running sums of an array, same length."""
    return F.slice(
        F.aggregate(
            masses,
            F.array(F.lit(0.0)),
            lambda acc, mass: F.concat(acc, F.array(F.element_at(acc, -1) + mass)),
        ),
        F.lit(2),
        F.size(masses),
    )


def fragment_grid(masses: Column) -> Column:
    """m/z of every fragment: an array over sites and the four (ion, charge) columns.

    Site ``i`` lies after residue ``i+1``: b ordinal ``i+1``, y ordinal ``length-1-i``.
    """
    return let(prefix_sums(masses), _grid_of)


def _grid_of(prefix: Column) -> Column:
    total = F.element_at(prefix, -1)
    length = F.size(prefix)

    def row(p: Column, i: Column) -> Column:
        cells = []
        for ion, z in ION_COLUMNS:
            neutral = p if ion == "b" else total - p + F.lit(WATER)
            cells.append(
                F.struct(
                    i.cast("int").alias("site"),
                    F.lit(ion).alias("ion"),
                    (i + 1 if ion == "b" else length - 1 - i).cast("int").alias("ordinal"),
                    F.lit(z).alias("charge"),
                    ((neutral + F.lit(z * PROTON)) / F.lit(float(z))).alias("mz"),
                )
            )
        return F.array(*cells)

    return F.flatten(F.transform(F.slice(prefix, F.lit(1), length - 1), row))


def element_counts(residues: Column) -> dict[str, Column]:
    """Element counts of bare residues on the fixed basis, one column per element."""
    return {
        element: F.when(
            F.regexp_like(residues, F.lit(f"^[{''.join(sorted(RESIDUE_ATOMS))}]+$")),
            sum(
                (
                    residue_count(residues, residue) * F.lit(atoms[i])
                    for residue, atoms in sorted(RESIDUE_ATOMS.items())
                    if atoms[i]
                ),
                start=F.lit(0),
            ),
        ).cast("bigint")
        for i, element in enumerate(ELEMENTS)
    }


def composition_terms(text: Column) -> Column:
    """``H(20) C(8) 13C(4) N`` as an array of (symbol, element, count); isotopes name a parent."""
    terms = F.filter(F.split(F.trim(text), r"\s+"), lambda term: term != "")

    def term(raw: Column) -> Column:
        symbol = F.regexp_extract(raw, r"^(\d*[A-Z][a-z]?)(?:\((-?\d+)\))?$", 1)
        count = F.regexp_extract(raw, r"^(\d*[A-Z][a-z]?)(?:\((-?\d+)\))?$", 2)
        return F.struct(
            F.when(symbol != "", symbol).alias("symbol"),
            F.when(symbol != "", F.regexp_replace(symbol, r"^\d+", "")).alias("element"),
            F.when(count != "", count.try_cast("int")).otherwise(F.lit(1)).alias("count"),
        )

    return F.transform(terms, term)


def composition_mass(terms: Column, nuclides: dict[str, float] | None = None) -> Column:
    """Exact monoisotopic mass of parsed terms; null when a nuclide is not in the table.

    ``12C`` is read as ``C``: the bare symbol names the principal isotope.
    """
    table = dict(nuclides or NUCLIDE_MASS)
    for symbol, mass in list(table.items()):
        if re.match(r"^[A-Z]", symbol):
            table.setdefault(f"{round(mass)}{symbol}", mass)
    lookup = literal_map(table)
    return F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, t: acc + F.try_element_at(lookup, t["symbol"]) * t["count"],
    )


def mobility(ccs: Column, charge: Column, mz: Column) -> Column:
    """Inverse reduced mobility from a cross section, by the reduced mass with the drift gas."""
    mass = mz * charge
    reduced = mass * F.lit(DRIFT_GAS_MASS) / (mass + F.lit(DRIFT_GAS_MASS))
    return ccs * F.sqrt(reduced) / charge / F.lit(MOBILITY_COEFFICIENT)
