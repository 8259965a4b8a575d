"""Library building: proteins in, validated spectrum rows out."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.constants import MODIFICATIONS
from ionloom.functions import chemistry
from ionloom.functions.sequence import ModRule, diann_spelling, move_sites_reversed, parse_rule, render_proforma, reverse_interior
from ionloom.operators.decoys import DECOY_PREFIX, number_decoy_groups, search_decoys
from ionloom.operators.digest import DigestRules, digest, peptide_table, protein_lists
from ionloom.operators.labeler import library_batches, predicted_rows, smooth_arrays
from ionloom.operators.modforms import expand_charges, modified_forms
from ionloom.operators.parcels import numbered, parcel_partitions
from ionloom.session import let_go, materialise
from ionloom.sinks.library_writer import save_library

DEFAULT_DELTAS = {accession: delta for accession, _, _, delta in MODIFICATIONS}


@dataclass(frozen=True)
class LibraryOptions:
    """What a library contains."""

    rules: DigestRules = DigestRules()
    fixed: tuple[str, ...] = ("C[UNIMOD:4]",)
    variable: tuple[str, ...] = ()
    max_variable: int = 1
    decoys: bool = True
    min_intensity: float = 0.01
    max_fragments: int | None = None
    deltas: dict = field(default_factory=lambda: dict(DEFAULT_DELTAS))

    def __post_init__(self) -> None:
        if not 0.0 <= self.min_intensity <= 1.0:
            raise ValueError(f"min_intensity must be in [0, 1], got {self.min_intensity}")
        fixed, variable = self.parsed()
        for a in fixed:
            for b in variable:
                if set(a.targets) & set(b.targets):
                    raise ValueError(f"fixed and variable rules overlap: {a} and {b}")

    def parsed(self) -> tuple[list[ModRule], list[ModRule]]:
        return [parse_rule(r) for r in self.fixed], [parse_rule(r) for r in self.variable]


def peptidoform_frame(peptides: DataFrame, options: LibraryOptions, target_form: bool = False) -> DataFrame:
    """Target and decoy peptidoforms, one row each, with ``sites``, ``proforma`` and ``decoy``.

    ``target_form`` also names the target's peptidoform on both, which is what their competition groups share.

    ``peptides`` has distinct ``peptide`` and carried columns. Collisions are decided on stripped
    sequences, before forms multiply them, and once for all forms of a peptide; a table that says
    with ``emits_decoy`` how they were decided is taken at its word.
    """
    rows = peptides
    if "emits_decoy" not in peptides.columns:
        rows = flag_decoys(peptides) if options.decoys else peptides.withColumn("emits_decoy", F.lit(False))
    forms = target_forms(rows, options)
    if target_form:
        forms = forms.withColumn("target_form", render_proforma(F.col("peptide"), F.col("sites")))
    return both_readings(forms)


def target_forms(peptides: DataFrame, options: LibraryOptions) -> DataFrame:
    """Target peptidoforms of the given peptides, one row each, with ``sites``."""
    fixed, variable = options.parsed()
    return modified_forms(peptides, fixed, variable, options.max_variable).drop("n_variable")


def both_readings(forms: DataFrame) -> DataFrame:
    """Each target peptidoform and, where it ``emits_decoy``, its reversal; ``source`` is the target's peptide."""
    both = F.when(F.col("emits_decoy"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    read = forms.withColumn("source", F.col("peptide")).withColumn("decoy", F.explode(both)).drop("emits_decoy")
    turned = F.when(
        F.col("decoy"), move_sites_reversed(F.col("sites"), F.length("peptide"))
    ).otherwise(F.col("sites"))
    return (
        read.withColumn("sites", turned)
        .withColumn("peptide", F.when(F.col("decoy"), reverse_interior(F.col("peptide"))).otherwise(F.col("peptide")))
        .withColumn("proforma", render_proforma(F.col("peptide"), F.col("sites")))
    )


def flag_decoys(peptides: DataFrame) -> DataFrame:
    """Whether each distinct peptide's reversal is free of the targets: one join, no fan-out.

    Reversal undone is the target again, so at most one peptide maps to each reading.
    """
    targets = peptides.select(F.col("peptide").alias("decoy_peptide"), F.lit(True).alias("taken"))
    return (
        peptides.withColumn("decoy_peptide", reverse_interior(F.col("peptide")))
        .join(targets, "decoy_peptide", "left")
        .withColumn("emits_decoy", F.col("taken").isNull())
        .drop("decoy_peptide", "taken")
    )


def precursor_frame(peptides: DataFrame, options: LibraryOptions) -> DataFrame:
    """Peptidoforms by charges with their neutral mass."""
    mass = chemistry.mono_mass(F.col("peptide"), chemistry.mods_mass(F.col("sites"), options.deltas))
    rows = peptidoform_frame(peptides, options).withColumn("neutral_mass", mass)
    return expand_charges(rows, options.rules.min_charge, options.rules.max_charge)


def build_library(proteins: DataFrame, options: LibraryOptions = LibraryOptions()) -> DataFrame:
    """Spectrum rows of a whole proteome, labelled by the built-in predictor."""
    # One shuffle, of the memberships; forms, decoys and spectra stay with their peptide.
    peptides = peptide_table(digest(proteins, options.rules), decoys=options.decoys)
    return library_from_peptides(peptides, options, dealt=True)


def predictor_inputs(forms: DataFrame, options: LibraryOptions) -> DataFrame:
    """Peptidoforms with the positions and masses of their modifications in place of the sites."""
    delta = lambda s: chemistry.spec_mass(s["spec"], options.deltas)
    known = F.forall("sites", lambda s: delta(s).isNotNull())
    return forms.where(
        F.when(known, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("unknown modification in "), F.col("proforma"))).cast("boolean")
        )
    ).select(
        *[c for c in forms.columns if c != "sites"],
        F.transform("sites", lambda s: s["pos"]).alias("mod_pos"),
        F.transform("sites", delta).alias("mod_delta"),
    )


def library_from_peptides(
    peptides: DataFrame, options: LibraryOptions, factory=smooth_arrays, target_form: bool = False, dealt: bool = False
) -> DataFrame:
    """Spectrum rows of given peptides; ``factory`` makes the predictor in each task.

    Peptides that are ``dealt`` over several tasks a core already stay where they are. A modification without a known mass stops the job instead of counting as zero.
    """
    inputs = predictor_inputs(peptidoform_frame(peptides, options, target_form), options)
    keys = [c for c in inputs.columns if c not in ("mod_pos", "mod_delta")]
    charges = list(range(options.rules.min_charge, options.rules.max_charge + 1))
    rows = library_batches(inputs, factory, keys, charges, options.min_intensity, options.max_fragments, dealt)
    return rows.withColumn("irt", F.lit(None).cast("double"))


def numbered_groups(peptides: DataFrame, options: LibraryOptions) -> DataFrame:
    """``(target_form, charge, decoy_group)``: a block of numbers per target peptidoform, one per charge.

    A form keeps its block when its decoy is skipped. Narrow rows are sorted, not spectra.
    """
    fixed, variable = options.parsed()
    forms = modified_forms(peptides.select("peptide"), fixed, variable, options.max_variable)
    named = forms.select(render_proforma(F.col("peptide"), F.col("sites")).alias("target_form"))
    return number_decoy_groups(named, [F.col("target_form").asc()], options.rules.min_charge, options.rules.max_charge)


def complete_library(proteins: DataFrame, options: LibraryOptions = LibraryOptions(), factory=smooth_arrays) -> DataFrame:
    """Library rows that the writers take: peaks, protein names and competition groups of a whole proteome."""
    memberships = digest(proteins, options.rules).select("peptide", "protein_id")
    lists = materialise(protein_lists(memberships))
    peptides = lists.select("peptide")
    rows = library_from_peptides(peptides, options, factory, target_form=True)
    grouped = rows.join(numbered_groups(peptides, options), ["target_form", "charge"])
    return with_protein_names(grouped, lists).drop("target_form", "n_proteins")


def writer_inputs(proteins: DataFrame, options: LibraryOptions) -> DataFrame:
    """What a library writer needs of every peptidoform, before any spectrum: narrow rows, in the order of their targets.

    ``first_group`` and ``place`` number competition groups and entries: a peptidoform's charges take the numbers from
    there on. Two shuffles of parcels: memberships by peptide, forms by ranges of their text, so spectra are never shuffled.
    """
    memberships = digest(proteins, options.rules).select("peptide", "protein_id")
    # Stored, since the ranges, their counts and the forms are read from it; compact, since it stays beside the library.
    peptides = materialise(peptide_table(memberships, lists=True, decoys=options.decoys), "zstd")
    let_go(proteins.sparkSession)
    forms = target_forms(peptides.drop("n_proteins"), options)
    text = render_proforma(F.col("peptide"), F.col("sites"))
    shown = forms.withColumn("shown", F.when(text != F.col("peptide"), text))
    weighed = shown.withColumn("entries", F.when(F.col("emits_decoy"), 2).otherwise(1))
    carried = ["peptide", "sites", "proteins", "emits_decoy"]
    # Targets before decoys: a form's number is its place among the targets.
    placed = numbered(weighed, carried, "shown", "entries", parcel_partitions(proteins.sparkSession), otherwise="peptide")
    block = options.rules.max_charge - options.rules.min_charge + 1
    named = both_readings(placed).select(
        "peptide", "sites", "decoy", "proforma", decoy_names().alias("proteins"),
        (F.col("rank") * block + 1).alias("first_group"), (F.col("before") + F.col("decoy").cast("int")).alias("place"),
        diann_spelling(F.col("proforma")).alias("spelling"),
    )
    return predictor_inputs(named, options)


def settings_document(options: LibraryOptions) -> dict:
    """The settings of a build as a nested document; what a library records about itself."""
    rules = options.rules
    return {
        "digest": asdict(rules),
        "modifications": {"fixed": list(options.fixed), "variable": list(options.variable), "max_variable": options.max_variable},
        "decoys": {"enabled": options.decoys, "method": "reverse"},
        "spectrum": {"min_intensity": options.min_intensity, "max_fragments": options.max_fragments},
    }


def write_library(
    proteins: DataFrame,
    folder: str,
    options: LibraryOptions = LibraryOptions(),
    form: str = "diann",
    factory=smooth_arrays,
    name: str = "library",
    compression: str | None = "gzip",
) -> dict:
    """A whole proteome to a library on storage: predicted, rendered, compressed and written in one pass.

    ``form`` is ``diann`` (tab-separated peaks) or ``text`` (entries). The settings go into the header of the text form
    and, with the counts of the build, into a sidecar for both. Returns the counts.
    """
    inputs = writer_inputs(proteins, options)
    charges = list(range(options.rules.min_charge, options.rules.max_charge + 1))
    keys = [c for c in inputs.columns if c not in ("mod_pos", "mod_delta")]
    least, most = options.min_intensity, options.max_fragments

    def rows(batches):
        for batch in predicted_rows(batches, factory, keys, charges, least, most):
            step = pc.subtract(batch.column("charge").cast("int64"), charges[0])
            index = pc.add(pc.add(pc.multiply(batch.column("place"), len(charges)), step), 1)
            yield batch.append_column("decoy_group", pc.add(batch.column("first_group"), step)).append_column("index", index)

    counts = save_library(inputs, folder, form, settings_document(options), name, compression, rows)
    let_go(proteins.sparkSession)
    return counts


def listed_library(
    rows: DataFrame, options: LibraryOptions = LibraryOptions(), method: str = "reverse", seed: int = 0, factory=smooth_arrays
) -> tuple[DataFrame, DataFrame]:
    """A library of given peptidoforms at given charges, and ``(targets, decoys, unpaired)`` as one row.

    ``rows`` has ``ordinal, peptide, sites, charge, decoy, decoy_group, proteins``. Groups that come with a decoy
    keep it, for the others one is searched; a target without a free decoy stays and is counted as unpaired.
    """
    found = materialise(search_decoys(rows, method, seed))
    made = found.where("paired").select(
        "ordinal", F.col("decoy_peptide").alias("peptide"), F.col("decoy_sites").alias("sites"), "charge",
        F.lit(True).alias("decoy"), "decoy_group", "proteins",
    )
    prefixed = F.transform("proteins", lambda p: F.concat(F.lit(DECOY_PREFIX), p))
    every = rows.select(*made.columns).unionByName(made.withColumn("proteins", prefixed))
    delta = lambda s: chemistry.spec_mass(s["spec"], options.deltas)
    inputs = every.select(
        "ordinal", "peptide", "decoy", "decoy_group", "proteins", F.col("charge").cast("int").alias("own_charge"),
        render_proforma(F.col("peptide"), F.col("sites")).alias("proforma"),
        F.transform("sites", lambda s: s["pos"]).alias("mod_pos"),
        F.transform("sites", delta).alias("mod_delta"),
    )
    keys = [c for c in inputs.columns if c not in ("mod_pos", "mod_delta", "own_charge")]
    labelled = library_batches(inputs, factory, keys, "own_charge", options.min_intensity, options.max_fragments)
    out = labelled.withColumn("irt", F.lit(None).cast("double"))
    counts = every.agg(F.count_if(~F.col("decoy")).alias("targets"), F.count_if("decoy").alias("decoys"), F.lit(0).alias("__one"))
    unpaired = found.agg(F.count_if(~F.col("paired")).alias("unpaired"), F.lit(0).alias("__one"))
    return out, counts.join(unpaired, "__one").drop("__one")


def decoy_names() -> Column:
    """``proteins`` of a row; generated decoys carry the decoy prefix."""
    return F.when(
        F.col("decoy"), F.transform("proteins", lambda p: F.concat(F.lit(DECOY_PREFIX), p))
    ).otherwise(F.col("proteins"))


def with_protein_names(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows with their protein list by source peptide; generated decoys carry the decoy prefix.

    A source peptide without a list stops the job: no row is left out.
    """
    missing = F.raise_error(F.concat(F.lit("no protein list for "), F.col("source"))).cast("array<string>")
    joined = rows.join(lists.select(F.col("peptide").alias("source"), "proteins"), "source", "left")
    return joined.withColumn("proteins", F.coalesce(decoy_names(), missing))
