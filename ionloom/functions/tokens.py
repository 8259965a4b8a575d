"""Token feature columns of a peptide, padded to a declared width."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.constants import TOKEN_CTERM, TOKEN_NTERM, TOKEN_OFFSET, TOKEN_PAD
from ionloom.functions.chemistry import spec_mass


def token_ids(residues: Column, max_length: int) -> Column:
    """``[N] r1..rL [C]`` then padding, ``max_length + 2`` entries."""
    body = F.transform(F.split(residues, ""), lambda residue: F.ascii(residue) - TOKEN_OFFSET)
    return F.concat(
        F.array(F.lit(TOKEN_NTERM)),
        body,
        F.array(F.lit(TOKEN_CTERM)),
        F.array_repeat(F.lit(TOKEN_PAD), F.lit(max_length) - F.length(residues)),
    )


def _runs(residues: Column, *runs: tuple[bool, Column]) -> Column:
    """Runs of equal flags, each of a given length (none below one); flags are null without residues."""
    return F.concat(*[F.array_repeat(F.when(residues.isNotNull(), F.lit(flag)), F.greatest(n, F.lit(0)).cast("int")) for flag, n in runs])


def pad_mask(residues: Column, max_length: int) -> Column:
    """True where a column holds padding."""
    used = F.least(F.coalesce(F.length(residues), F.lit(0)) + 2, F.lit(max_length + 2))
    return _runs(residues, (False, used), (True, F.lit(max_length + 2) - used))


def site_mask(residues: Column, max_length: int) -> Column:
    """True for the ``length - 1`` backbone sites; the first one is column 1."""
    sites = F.least(F.greatest(F.coalesce(F.length(residues), F.lit(0)) - 1, F.lit(0)), F.lit(max_length))
    return _runs(residues, (False, F.lit(1)), (True, sites), (False, F.lit(max_length) - sites))


def site_column(site: Column, length: Column) -> Column:
    """Token column of a modification site: terminal sites have their own."""
    return (
        F.when(site["site_kind"] == "n", F.lit(0))
        .when(site["site_kind"] == "c", length + 1)
        .otherwise(site["pos"] + 1)
    )


def mod_mass_columns(
    residues: Column, sites: Column, max_length: int, deltas: dict[int, float]
) -> Column:
    """Summed modification mass per token column."""
    add = lambda old, s: old + spec_mass(s["spec"], deltas)
    return _placed(residues, sites, max_length, F.lit(0.0), add)


def mod_present_columns(residues: Column, sites: Column, max_length: int) -> Column:
    """Whether a token column carries any modification, whatever its mass."""
    return _placed(residues, sites, max_length, F.lit(False), lambda old, s: F.lit(True))


def _placed(
    residues: Column, sites: Column, max_length: int, start: Column, change: Callable[[Column, Column], Column]
) -> Column:
    """``start`` in every column, changed by the sites of the column one after another: a step a site."""
    none = F.when(sites.isNotNull(), start)
    columns = F.array_repeat(none, max_length + 2)

    def one(row: Column, s: Column) -> Column:
        at = site_column(s, F.length(residues))
        inside = (at >= 0) & (at <= max_length + 1)
        changed = F.concat(
            F.slice(row, F.lit(1), at), F.array(change(F.get(row, at), s)), F.slice(row, at + 2, F.lit(max_length + 2))
        )
        return F.when(inside, changed).otherwise(row)

    return F.when(F.size(sites) > 0, F.aggregate(sites, columns, one)).otherwise(columns)
