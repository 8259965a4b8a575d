"""Digestion, protein groups, sequence windows and their guards."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.constants import ENZYMES
from ionloom.functions.sequence import cleaved_fragments, is_valid_sequence, reverse_interior
from ionloom.operators.parcels import BUCKETS, by_bucket, parcel_partitions


@dataclass(frozen=True)
class DigestRules:
    """What a digest yields. Checked when it is made, before any table is read."""

    enzyme: str = "trypsin"
    missed_cleavages: int = 2
    min_length: int = 7
    max_length: int = 30
    min_charge: int = 2
    max_charge: int = 4

    def __post_init__(self) -> None:
        if self.enzyme not in ENZYMES:
            raise ValueError(f"unknown enzyme {self.enzyme!r}; known: {sorted(ENZYMES)}")
        if self.min_length < 2 or self.max_length < self.min_length:
            raise ValueError(f"invalid length range {self.min_length}..{self.max_length}")
        if self.min_charge < 1 or self.max_charge < self.min_charge:
            raise ValueError(f"invalid charge range {self.min_charge}..{self.max_charge}")
        cuts_everywhere = len(ENZYMES[self.enzyme][0]) >= 20
        if cuts_everywhere and self.missed_cleavages + 1 < self.min_length:
            raise ValueError(
                f"{self.enzyme!r} cuts after every residue, so a peptide has at most "
                f"{self.missed_cleavages + 1} residues; min_length {self.min_length} is out of reach"
            )


def joined_runs(proteins: DataFrame, pieces: Column, longest: int, name: str) -> DataFrame:
    """Every run of up to ``longest`` neighbouring pieces of each protein, as text.

    The piece list is zipped with its own shifts, so a run is a concatenation of the columns of
    one row. Work is linear in the protein, and nothing is looked up by position.
    """
    listed = proteins.withColumn("__pieces", pieces)
    shifts = [
        (F.slice("__pieces", F.lit(i + 1), F.size("__pieces")) if i else F.col("__pieces")).alias(f"p{i}")
        for i in range(longest)
    ]
    rows = listed.select("protein_id", F.explode(F.arrays_zip(*shifts)).alias("at"))
    # a shift that ran off the end is null, and so is every run that would need it
    runs = [F.concat(*[F.col(f"at.p{j}") for j in range(i)]) for i in range(1, longest + 1)]
    return rows.select("protein_id", F.explode(F.array(*runs)).alias(name)).where(F.col(name).isNotNull())


def digest(proteins: DataFrame, rules: DigestRules = DigestRules()) -> DataFrame:
    """``(protein_id, peptide)`` rows, one per occurrence. Narrow: no shuffle."""
    pieces = cleaved_fragments(F.col("residues"), rules.enzyme)
    runs = joined_runs(proteins, pieces, rules.missed_cleavages + 1, "peptide")
    return runs.where(
        F.length("peptide").between(rules.min_length, rules.max_length)
        & is_valid_sequence(F.col("peptide"))
    )


def require_peptides(peptides: DataFrame, rules: DigestRules) -> DataFrame:
    """An empty digest is a configuration error, not a result. Reads one row."""
    if peptides.isEmpty():
        raise ValueError(f"the digest produced no peptides with {rules}")
    return peptides


def protein_groups(memberships: DataFrame) -> DataFrame:
    """Per distinct peptide the number of proteins and the alphabetically first one.

    Aggregates of fixed size, combined before the shuffle, so a peptide shared by a third of all
    proteins costs no more than any other.
    """
    return memberships.groupBy("peptide").agg(
        F.count_distinct("protein_id").alias("n_proteins"),
        F.min("protein_id").alias("first_protein"),
    )


def protein_lists(memberships: DataFrame) -> DataFrame:
    """``(peptide, n_proteins, proteins)`` with the sorted protein list of every distinct peptide.

    A library file writes this list into one field of each line, so a group has to fit into a row; it is
    never cut. Repeated memberships are removed before the shuffle that collects them.
    """
    distinct = memberships.select("peptide", "protein_id").distinct()
    return (
        distinct.groupBy("peptide")
        .agg(F.array_sort(F.collect_list("protein_id")).alias("proteins"))
        .select("peptide", F.size("proteins").alias("n_proteins"), "proteins")
    )


def _distinct(table: pa.Table) -> pa.Table:
    return table.group_by(table.column_names).aggregate([]).combine_chunks()


def _reversed_interior(peptide: str) -> str:
    return peptide[0] + peptide[-2:0:-1] + peptide[-1] if len(peptide) > 3 else peptide


def peptide_table(memberships: DataFrame, lists: bool = False, decoys: bool = True) -> DataFrame:
    """``(peptide, n_proteins, first_protein or proteins, emits_decoy)`` of every distinct peptide, from one shuffle.

    What :func:`protein_groups` or, with ``lists``, :func:`protein_lists` give, and whether the peptide's reversal is
    free of the targets. A peptide and its reversal go to one bucket, where both questions are settled; rows travel in parcels, repeated
    memberships are removed before. The result is dealt evenly over several tasks a core.
    """
    partitions = parcel_partitions(memberships.sparkSession)
    meeting = F.least("peptide", reverse_interior(F.col("peptide")))
    placed = F.pmod(F.xxhash64(meeting), F.lit(partitions * BUCKETS)).cast("int")
    rows = memberships.select(placed.alias("bucket"), "peptide", F.col("protein_id").cast("string").alias("protein_id"))

    def gather(bucket: int, table: pa.Table) -> pa.Table:
        table = _distinct(table).sort_by([("peptide", "ascending"), ("protein_id", "ascending")]).combine_chunks()  # nulls last
        peptide, protein = table.column("peptide").chunk(0), table.column("protein_id").chunk(0)
        starts = np.flatnonzero(np.r_[True, pc.not_equal(peptide[1:], peptide[:-1]).to_numpy(zero_copy_only=False)])
        named = np.add.reduceat(protein.is_valid().to_numpy(zero_copy_only=False).astype(np.int32), starts).astype(np.int32)
        own = peptide.take(pa.array(starts))
        if lists:
            about = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(named)], pa.int32()), protein.drop_null())
        else:
            about = protein.take(pa.array(starts))
        if decoys:
            free = pc.invert(pc.is_in(pa.array([_reversed_interior(p) for p in own.to_pylist()], pa.string()), value_set=own))
        else:
            free = pa.array(np.zeros(len(own), bool))
        return pa.table([own, pa.array(named), about, free], names=["peptide", "n_proteins", "proteins" if lists else "first_protein", "emits_decoy"])

    result = f"peptide string, n_proteins int, {'proteins array<string>' if lists else 'first_protein string'}, emits_decoy boolean"
    return by_bucket(rows, ["peptide", "protein_id"], partitions, lambda table: table.column("bucket").to_numpy(), gather, result, _distinct)


def overlapping_blocks(proteins: DataFrame, overlap: int, block: int) -> DataFrame:
    """``(protein_id, block, owned)``: pieces of ``block`` residues, each with the next ``overlap`` residues behind it.

    A place in a protein is owned by the one block whose first ``owned`` residues hold it. The text is cut in one pass, so
    a row is a block however long its protein is.
    """
    pieces = F.regexp_extract_all("residues", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    cut = proteins.select("protein_id", pieces.alias("__pieces"))
    following = F.slice("__pieces", F.lit(2), F.greatest(F.size("__pieces"), F.lit(1)))
    pairs = cut.select("protein_id", F.explode(F.arrays_zip(F.col("__pieces").alias("own"), following.alias("next"))).alias("at"))
    return pairs.select(
        "protein_id",
        F.concat("at.own", F.coalesce(F.substring("at.next", 1, overlap), F.lit(""))).alias("block"),
        F.length("at.own").alias("owned"),
    )


#: A number to the base 36 of so many letters fits into a bigint.
NUMBERED_LENGTH = 12


def windows(proteins: DataFrame, min_length: int, max_length: int, block: int = 128, numbered: bool = False) -> DataFrame:
    """Every substring of ``min_length..max_length`` residues, one row per occurrence.

    ``numbered`` adds ``number``, the window of upper-case letters read to the base 36: windows of one width are in the order of their
    text by it, and :func:`window_text` gives that back. Aggregates of numbers need no sort, those of text do.

    A window belongs to the block it starts in. Blocks are short, so that finding a place in one is cheap, and hold the
    longest window at least; a null or empty protein has no window.
    """
    if not 1 <= min_length <= max_length:
        raise ValueError(f"invalid length range {min_length}..{max_length}")
    blocks = overlapping_blocks(proteins, max_length - 1, max(block, max_length))
    starts = blocks.select("protein_id", "block", F.explode(F.sequence(F.lit(1), F.col("owned"))).alias("start"))
    longest = starts.select("protein_id", F.substring("block", F.col("start"), F.lit(max_length)).alias("longest"))
    longest = longest.where(F.length("longest") >= min_length)
    carried = ["protein_id", "longest"]
    if numbered:
        if max_length > NUMBERED_LENGTH:
            raise ValueError(f"windows of more than {NUMBERED_LENGTH} residues have no number")
        # Read once per start, the shorter windows follow by division.
        longest = longest.withColumn("whole", F.conv(F.rpad("longest", max_length, "0"), 36, 10).cast("bigint"))
        carried.append("whole")
    widths = longest.select(*carried, F.explode(F.sequence(F.lit(min_length), F.length("longest"))).alias("width"))
    found = widths.withColumn("window", F.substring("longest", F.lit(1), F.col("width")))
    if not numbered:
        return found.select("protein_id", "window", "width")
    number = reduce(
        lambda case, width: case.when(F.col("width") == width, F.call_function("div", F.col("whole"), F.lit(36 ** (max_length - width)).cast("bigint"))),
        range(min_length, max_length),
        F.when(F.col("width") == max_length, F.col("whole")),
    )
    return found.select("protein_id", "window", "width", number.alias("number"))


def window_text(number: Column) -> Column:
    """The window of a number of :func:`windows`."""
    return F.conv(number.cast("string"), 10, 36)
