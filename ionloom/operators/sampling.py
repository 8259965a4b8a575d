"""Seeded tables of random peptides and windows, and interleaving of several mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.constants import ABUNDANCE
from ionloom.functions.binding import let
from ionloom.functions.hashing import uniform
from ionloom.operators.joins import interleave_order
from ionloom.operators.ordering import with_group_position, with_position


def weighted_residue(u: Column) -> Column:
    """Residue at quantile ``u`` of the natural abundances; ``u`` is drawn once, not per comparison."""

    def chosen(drawn: Column) -> Column:
        total = sum(ABUNDANCE.values())
        running = 0.0
        out = None
        for residue in sorted(ABUNDANCE):
            running += ABUNDANCE[residue]
            hit = drawn < F.lit(running / total)
            out = F.when(hit, residue) if out is None else out.when(hit, residue)
        return out.otherwise(max(ABUNDANCE))

    return let(u, chosen)


def random_peptides(
    seeds: DataFrame, key: str, min_length: int = 7, max_length: int = 30, seed: str = "random"
) -> DataFrame:
    """One tryptic-looking random peptide per seed row, ending in K or R."""
    k = F.col(key)
    length = F.lit(min_length) + F.floor(uniform(f"{seed}-length", k) * (max_length - min_length + 1))
    body = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("length") - 1),
        lambda i: weighted_residue(uniform(f"{seed}-residue", k, i)),
    )
    last = F.when(uniform(f"{seed}-end", k) < 0.5, "K").otherwise("R")
    return (
        seeds.withColumn("length", length.cast("bigint"))
        .withColumn("peptide", F.concat(F.array_join(body, ""), last))
    )


def random_windows(
    seeds: DataFrame,
    key: str,
    proteins: DataFrame,
    min_length: int = 8,
    max_length: int = 11,
    seed: str = "window",
) -> DataFrame:
    """One random protein window per seed row, without listing the windows.

    Each seed row draws a protein by its place in identifier order, then a length and a start.
    """
    usable = with_position(
        proteins.where(F.length("residues") >= min_length), [F.col("protein_id").asc()], "__place"
    )
    total = usable.count()
    if total == 0:
        raise ValueError(f"no proteins of at least {min_length} residues")
    k = F.col(key)
    drawn = seeds.withColumn("__place", F.floor(uniform(f"{seed}-protein", k) * total)).join(usable, "__place")
    size = F.length("residues")
    span = F.least(F.lit(max_length), size) - min_length + 1
    return (
        drawn.withColumn("width", (F.lit(min_length) + F.floor(uniform(f"{seed}-width", k) * span)).cast("int"))
        .withColumn("start", F.floor(uniform(f"{seed}-start", k) * (size - F.col("width") + 1)).cast("int"))
        .withColumn("window", F.substring("residues", F.col("start") + 1, F.col("width")))
        .drop("__place", "residues")
    )


def round_robin(mixes: DataFrame, mix: str, order: list[Column], name: str = "turn") -> DataFrame:
    """Rows of several mixes in turn, one of each, until all are exhausted."""
    ranked = with_group_position(mixes, [mix], order, "__rank")
    return with_position(
        ranked, interleave_order(F.col("__rank"), F.col(mix)), name
    ).drop("__rank")
