"""Modified forms: exhaustive enumeration, sampling, charges, precursor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import chemistry, hashing, sequence
from ionloom.functions.binding import let
from ionloom.functions.sequence import SITE_TYPE, ModRule


def fixed_sites(residues: Column, rules: list[ModRule]) -> Column:
    if not rules:
        return F.array().cast(SITE_TYPE)
    return F.concat(*[sequence.rule_sites(residues, rule) for rule in rules])


def _same_site(a: Column, b: Column) -> Column:
    return (a["site_kind"] == b["site_kind"]) & (a["pos"] == b["pos"])


def modified_forms(
    peptides: DataFrame,
    fixed: list[ModRule],
    variable: list[ModRule],
    max_mods: int = 1,
    one_per_site: bool = True,
) -> DataFrame:
    """One row per peptidoform with ``sites``; other columns are carried along.

    Every choice of up to ``max_mods`` candidate sites. ``one_per_site`` forbids two variable modifications on one
    site; without it all combinations of (site, modification) candidates count. Narrow: a level adds one site or
    ends the form, and a row holds one partial form with the next candidate open to it, never all forms of a peptide.
    """
    if max_mods < 0:
        raise ValueError("max_mods must not be negative")
    residues = F.col("peptide")
    none = F.array().cast(SITE_TYPE)
    rows = peptides.withColumn("__form", none)
    if variable and max_mods:
        rows = rows.withColumn("__candidates", fixed_sites(residues, variable)).withColumn("__next", F.lit(0))
        for _ in range(max_mods):
            rows = _one_more_site(rows, one_per_site)
        rows = rows.drop("__candidates", "__next")
    return (
        rows.withColumn("sites", F.concat(fixed_sites(residues, fixed), F.col("__form")))
        .withColumn("n_variable", F.size("__form"))
        .drop("__form")
    )


def _one_more_site(rows: DataFrame, one_per_site: bool) -> DataFrame:
    """Each partial form as it is, closed, and with each candidate from ``__next`` on; a closed form has none left."""
    count, at = F.size("__candidates"), F.col("__at")
    site = F.get("__candidates", at)
    chosen = at < count
    grown = rows.withColumn("__at", F.explode(F.sequence(F.col("__next"), count)))
    if one_per_site:
        grown = grown.where(~chosen | ~F.exists("__form", lambda f: _same_site(f, site)))
    return (
        grown.withColumn("__form", F.when(chosen, F.concat("__form", F.array(site))).otherwise(F.col("__form")))
        .withColumn("__next", F.least(at + 1, count))
        .drop("__at")
    )


def expand_charges(df: DataFrame, min_charge: int, max_charge: int) -> DataFrame:
    return df.withColumn("charge", F.explode(F.sequence(F.lit(min_charge), F.lit(max_charge))))


def sampled_forms(
    peptides: DataFrame,
    rules: list[tuple[ModRule, float]],
    max_mods: int,
    seed: str = "forms",
) -> DataFrame:
    """One sampled form per peptide: each site draws at its rule's probability.

    Above ``max_mods`` the kept draws are a random subset (the smallest second hash), so the cap
    does not favour the N-terminus. Draws depend on seed, peptide, rule and site only.
    """
    residues = F.col("peptide")
    drawn = []
    for index, (rule, probability) in enumerate(rules):
        if not 0.0 < probability <= 1.0:
            raise ValueError(f"probability {probability} must be in (0, 1]")
        tagged = F.transform(
            sequence.rule_sites(residues, rule),
            lambda site: F.struct(
                hashing.uniform(f"{seed}-draw", residues, F.lit(index), site["pos"]).alias("u"),
                hashing.uniform(f"{seed}-keep", residues, F.lit(index), site["pos"]).alias("keep"),
                F.lit(index).alias("rule"),
                site.alias("site"),
            ),
        )
        drawn.append(F.filter(tagged, lambda d: d["u"] < F.lit(float(probability))))
    if not drawn or max_mods <= 0:
        return peptides.withColumn("sites", F.array().cast(SITE_TYPE))
    hits = F.concat(*drawn)
    by_keep = F.array_sort(
        F.transform(
            hits,
            lambda d: F.struct(
                d["keep"].alias("keep"), d["rule"].alias("rule"), d["site"]["pos"].alias("pos"), d["site"].alias("site")
            ),
        )
    )
    kept = F.slice(by_keep, F.lit(1), F.lit(max_mods))
    in_order = F.array_sort(
        F.transform(
            kept,
            lambda d: F.struct(d["rule"].alias("rule"), d["pos"].alias("pos"), d["site"].alias("site")),
        )
    )
    return peptides.withColumn("sites", F.transform(in_order, lambda d: d["site"]))


def sampled_charge(
    df: DataFrame, min_charge: int, max_charge: int, seed: str = "charge"
) -> DataFrame:
    """One charge per peptide, uniform over the range."""
    span = max_charge - min_charge + 1
    u = hashing.uniform(seed, F.col("peptide"))
    return df.withColumn("charge", (F.lit(min_charge) + F.floor(u * span)).cast("int"))


def energy_sweep(df: DataFrame, low: float, high: float, keys: list[str], seed: str = "energy") -> DataFrame:
    """One uniform collision energy per precursor."""
    u = hashing.uniform(seed, *[F.col(k) for k in keys])
    return df.withColumn("energy", F.lit(low) + u * F.lit(high - low))


def precursor_table(precursors: DataFrame, deltas: dict[int, float]) -> DataFrame:
    """Flat table: ``sequence, mods, modified_sequence, length, charge, precursor_mz, split``.

    The input has ``peptide, sites, charge, split``. An unknown modification gives a null m/z,
    which :func:`require_known_mods` turns into an error.
    """
    neutral = chemistry.mono_mass(F.col("peptide"), chemistry.mods_mass(F.col("sites"), deltas))
    return precursors.select(
        F.col("peptide").alias("sequence"),
        sequence.mods_text(F.col("sites")).alias("mods"),
        sequence.render_proforma(F.col("peptide"), F.col("sites")).alias("modified_sequence"),
        F.length("peptide").alias("length"),
        "charge",
        chemistry.charged_mz(neutral, F.col("charge")).alias("precursor_mz"),
        "split",
    )


def precursors_from_table(table: DataFrame) -> DataFrame:
    """Inverse of :func:`precursor_table`."""
    return table.select(
        F.col("sequence").alias("peptide"),
        sequence.parse_mods_text(F.col("mods"), F.col("sequence")).alias("sites"),
        "charge",
        "split",
    )


def site_deltas(sites: DataFrame, table: DataFrame) -> DataFrame:
    """Exploded sites with their delta from a user modification table ``(accession, delta)``.

    Unknown accessions keep a null delta; callers assert there are none.
    """
    accession = F.regexp_extract("spec", r"^UNIMOD:(\d+)$", 1).try_cast("int")
    stated = F.when(
        F.regexp_like(F.col("spec"), F.lit(r"^[+-]\d+(?:\.\d+)?$")), F.col("spec").try_cast("double")
    )
    return (
        sites.withColumn("accession", accession)
        .join(table.select("accession", "delta"), "accession", "left")
        .withColumn("delta", F.coalesce("delta", stated))
    )


def substitute_residue(
    df: DataFrame, probability: float, key: list[str], seed: str = "swap"
) -> DataFrame:
    """Swap at most one residue per row and state the mass and composition difference as a delta.

    A chosen residue is replaced by one of a different composition; ``swap_pos`` is -1 when the
    row keeps its residues. Sites listed in ``mass_only`` (positions with a mass-only
    modification) are not eligible. Adding ``mass_delta`` restores the peptide mass.
    """
    from ionloom.constants import RESIDUE_ATOMS, RESIDUE_MASS

    if not 0.0 <= probability <= 1.0:
        raise ValueError("probability must be between 0 and 1")
    residues = F.col("peptide")
    eligible = F.filter(
        F.sequence(F.lit(0), F.length(residues) - 1),
        lambda i: ~F.array_contains(F.col("mass_only"), i)
        & F.substring(residues, i + 1, F.lit(1)).isin(*sorted(RESIDUE_MASS)),
    )
    identity = [F.col(k) for k in key]
    chosen = hashing.uniform(f"{seed}-row", *identity) < F.lit(float(probability))
    u_site = hashing.uniform(f"{seed}-site", *identity)
    u_new = hashing.uniform(f"{seed}-new", *identity)
    other = {
        residue: [r for r in sorted(RESIDUE_MASS) if RESIDUE_ATOMS[r] != RESIDUE_ATOMS[residue]]
        for residue in sorted(RESIDUE_MASS)
    }
    options = F.create_map(
        *[
            part
            for residue, allowed in other.items()
            for part in (F.lit(residue), F.array(*[F.lit(r) for r in allowed]))
        ]
    )
    masses = chemistry.literal_map(RESIDUE_MASS)
    step = (
        df.withColumn("__eligible", eligible)
        .withColumn(
            "swap_pos",
            F.when(
                chosen & (F.size("__eligible") > 0),
                F.element_at("__eligible", (F.floor(u_site * F.size("__eligible")) + 1).cast("int")),
            ).otherwise(F.lit(-1)),
        )
        .withColumn("old_residue", F.when(F.col("swap_pos") >= 0, F.substring(residues, F.col("swap_pos") + 1, F.lit(1))))
    )
    allowed = F.try_element_at(options, F.col("old_residue"))
    step = step.withColumn(
        "new_residue", F.try_element_at(allowed, (F.floor(u_new * F.size(allowed)) + 1).cast("int"))
    )
    swapped = F.concat(
        F.substring(residues, F.lit(1), F.col("swap_pos")),
        F.col("new_residue"),
        F.substring(residues, F.col("swap_pos") + 2, F.length(residues)),
    )
    delta = F.try_element_at(masses, F.col("old_residue")) - F.try_element_at(masses, F.col("new_residue"))
    return step.withColumn(
        "augmented", F.when(F.col("swap_pos") >= 0, swapped).otherwise(residues)
    ).withColumn("mass_delta", F.coalesce(delta, F.lit(0.0))).drop("__eligible")
