"""Decoys: reversal, shuffle, collision checks, retry search, competition groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions.binding import let
from ionloom.functions.sequence import (
    SITE_TYPE,
    move_sites_reversed,
    render_proforma,
    reverse_interior,
)
from ionloom.operators.joins import require_empty
from ionloom.operators.ordering import with_position
from ionloom.session import materialise

SHUFFLE_ATTEMPTS = 32
DECOY_PREFIX = "DECOY_"


def pseudo_reversed(peptides: DataFrame) -> DataFrame:
    """Reversed reading of each target: ``decoy_peptide`` and, with ``sites``, ``decoy_sites``."""
    out = peptides.withColumn("decoy_peptide", reverse_interior(F.col("peptide")))
    if "sites" in peptides.columns:
        out = out.withColumn(
            "decoy_sites", move_sites_reversed(F.col("sites"), F.length("peptide"))
        )
    return out


def without_collisions(decoys: DataFrame, targets: DataFrame) -> DataFrame:
    """Decoys whose residues are not those of any target.

    Reversal undone is the target again, so two targets never share a decoy and no distinct is
    needed.
    """
    return decoys.join(
        targets.select(F.col("peptide").alias("decoy_peptide")).distinct(), "decoy_peptide", "left_anti"
    )


def shuffle_order(residues: Column, charge: Column, attempt: Column, seed: int) -> Column:
    """Order of residues after a seeded shuffle of the interior.

    Interior places are sorted by a hash of the seed, the peptide, its charge, the attempt and the place, so
    a row's result does not depend on its partition. Peptides under four residues keep their order.
    """
    n = F.length(residues)
    key = F.concat_ws("|", F.lit(str(seed)), residues, charge.cast("string"), attempt.cast("string"))
    places = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
    draw = lambda bound, i: F.struct(F.md5(F.concat_ws("|", bound, i.cast("string"))).alias("draw"), i.alias("place"))
    drawn = let(key, lambda bound: F.transform(places, lambda i: draw(bound, i)))
    inner = F.sort_array(drawn).getField("place")
    return F.when(n >= 4, F.concat(F.array(F.lit(0)), inner, F.array(n - 1))).otherwise(F.sequence(F.lit(0), n - 1))


def reordered(residues: Column, order: Column) -> Column:
    """Residues read in ``order`` (old index per new place)."""
    return F.array_join(F.transform(order, lambda i: F.substring(residues, i + 1, F.lit(1))), "")


def reordered_sites(sites: Column, order: Column) -> Column:
    """Residue sites moved to where their residue went."""
    return F.transform(
        sites,
        lambda s: F.when(
            s["site_kind"] == "r",
            s.withField("pos", (F.array_position(order, s["pos"]) - 1).cast("int")),
        ).otherwise(s),
    )


def decoy_candidates(
    rows: DataFrame, method: str, seed: int = 0, first: int = 0, last: int | None = None
) -> DataFrame:
    """One row per target and attempt with the candidate peptidoform.

    ``rows`` has ``ordinal, peptide, sites, charge``. Attempt 0, 1, ... reverses all but 1, 2, ...
    residues on either end, or shuffles with its own seed. ``first`` and ``last`` bound the
    attempts made here.
    """
    if method == "reverse":
        tries = F.floor((F.length("peptide") - 2) / 2).cast("int")
    elif method == "shuffle":
        tries = F.lit(SHUFFLE_ATTEMPTS)
    else:
        raise ValueError(f"unknown decoy method {method!r}")
    end = tries if last is None else F.least(tries, F.lit(last + 1))
    made = rows.where(end > first).withColumn("attempt", F.explode(F.sequence(F.lit(first), end - 1)))
    if method == "reverse":
        flank = F.col("attempt") + 1
        made = made.withColumn("decoy_peptide", reverse_interior(F.col("peptide"), flank)).withColumn(
            "decoy_sites", move_sites_reversed(F.col("sites"), F.length("peptide"), flank)
        )
    else:
        made = (
            made.withColumn(
                "__order", shuffle_order(F.col("peptide"), F.col("charge"), F.col("attempt"), seed)
            )
            .withColumn("decoy_peptide", reordered(F.col("peptide"), F.col("__order")))
            .withColumn("decoy_sites", reordered_sites(F.col("sites"), F.col("__order")))
            .drop("__order")
        )
    return made.withColumn("identity", render_proforma(F.col("decoy_peptide"), F.col("decoy_sites")))


def search_decoys(rows: DataFrame, method: str = "reverse", seed: int = 0) -> DataFrame:
    """First collision-free decoy per target, as if targets were served in input order.

    ``rows`` has ``ordinal, peptide, sites, charge, decoy, decoy_group``. A candidate is free when
    it is no target peptidoform at any charge and nothing at its own charge holds it. Groups that
    come with a decoy are left alone.

    Every target proposes its first open candidate and a candidate goes to the earliest proposer;
    whoever loses proposes its next one. With one common order of service this settles on what
    serving the targets one by one gives. Nearly all targets settle on their first candidate, so
    later rounds work on differences only: the losers, the holders of the slots they ask for, and the
    slots that changed hands. Further candidates are made only for those who lost.
    """
    identity = render_proforma(F.col("peptide"), F.col("sites"))
    targets = materialise(rows.where(~F.col("decoy")).select(identity.alias("identity")).distinct())
    # Targets are excluded at every charge, so of the given rows only decoys can hold a slot.
    held_before = rows.where("decoy").select(identity.alias("identity"), "charge").distinct()
    supplied = rows.where("decoy").select("decoy_group").distinct()
    seekers = rows.where(~F.col("decoy")).join(supplied, "decoy_group", "left_anti")
    slot = ["identity", "charge"]

    def free(made: DataFrame) -> DataFrame:
        return materialise(
            made.join(targets, "identity", "left_anti")
            .join(held_before, slot, "left_anti")
            .select("ordinal", "attempt", "identity", "charge", "decoy_peptide", "decoy_sites")
        )

    def best(asking: DataFrame) -> DataFrame:
        return asking.groupBy(*slot).agg(F.min(F.struct("ordinal", "attempt")).alias("holder")).select(*slot, "holder.*")

    narrow = ["ordinal", "attempt", *slot]
    made = free(decoy_candidates(seekers, method, seed, last=0))
    held = materialise(best(made.select(*narrow)))  # never rewritten; ``changed`` overrides it
    changed = materialise(held.limit(0))
    losers = seekers.select("ordinal").join(held.select("ordinal"), "ordinal", "left_anti").withColumn("tried", F.lit(0))
    pending, expanded = materialise(losers), None
    while not pending.isEmpty():
        new = pending.select("ordinal") if expanded is None else pending.select("ordinal").join(expanded, "ordinal", "left_anti")
        new = materialise(new)
        if not new.isEmpty():
            more = free(decoy_candidates(seekers.join(new, "ordinal", "left_semi"), method, seed, first=1))
            made = made.unionByName(more)
            later = more if expanded is None else later.unionByName(more)
            expanded = new if expanded is None else expanded.unionByName(new)
        open_ = later.select(*narrow).join(pending, "ordinal").where("attempt > tried")
        asking = materialise(
            open_.groupBy("ordinal").agg(F.min(F.struct("attempt", *slot)).alias("p")).select("ordinal", "p.*")
        )
        asked = asking.select(*slot).distinct()
        overridden = changed.select(*slot)
        holders = held.join(asked, slot, "left_semi").join(overridden, slot, "left_anti").unionByName(
            changed.join(asked, slot, "left_semi"), allowMissingColumns=False
        )
        contest = asking.select(*narrow).unionByName(holders.select(*narrow))
        winners = materialise(best(contest))
        pending = materialise(
            contest.join(winners.select("ordinal", *slot), ["ordinal", *slot], "left_anti").select("ordinal", F.col("attempt").alias("tried"))
        )
        changed = materialise(changed.join(asked, slot, "left_anti").unionByName(winners))
    final = held.join(changed.select(*slot), slot, "left_anti").unionByName(changed).select("ordinal", "attempt")
    found = made.join(final, ["ordinal", "attempt"]).drop("charge")
    return seekers.join(found, "ordinal", "left").withColumn("paired", F.col("identity").isNotNull())


def number_decoy_groups(forms: DataFrame, order: list[Column], min_charge: int, max_charge: int) -> DataFrame:
    """Competition group per form and charge: each form owns a block of ids, one per charge.

    A form keeps its block when its decoy is skipped, so target-only groups remain visible.
    """
    block = max_charge - min_charge + 1
    placed = with_position(forms, order, "__form")
    return (
        placed.withColumn("charge", F.explode(F.sequence(F.lit(min_charge), F.lit(max_charge))))
        .withColumn("decoy_group", F.col("__form") * block + 1 + F.col("charge") - F.lit(min_charge))
        .drop("__form")
    )


def fill_missing_groups(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Give rows without a group the ids after the largest declared one, in input order."""
    missing = with_position(rows.where("decoy_group is null"), order, "__place")
    largest = rows.agg(F.coalesce(F.max("decoy_group"), F.lit(0))).scalar()
    filled = missing.withColumn("decoy_group", largest + F.col("__place") + 1).drop("__place")
    return rows.where("decoy_group is not null").unionByName(filled)


def group_violations(rows: DataFrame) -> DataFrame:
    """Groups that are not one target with at most one decoy of one charge."""
    return (
        rows.groupBy("decoy_group")
        .agg(
            F.count_if(~F.col("decoy")).alias("targets"),
            F.count_if("decoy").alias("decoys"),
            F.count_distinct("charge").alias("charges"),
        )
        .where((F.col("targets") != 1) | (F.col("decoys") > 1) | (F.col("charges") > 1))
    )


def require_valid_groups(rows: DataFrame) -> DataFrame:
    """Raise on an invalid group or on a charged peptidoform listed twice."""
    repeated = rows.groupBy("proforma", "charge").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    require_empty(repeated, "duplicate charged peptides")
    require_empty(group_violations(rows), "each decoy_group needs one target and at most one decoy")
    return rows


def pair_targets(targets: DataFrame, decoys: DataFrame) -> DataFrame:
    """Target and decoy precursors of one competition group and charge."""
    return targets.alias("t").join(decoys.alias("d"), ["decoy_group", "charge"])


def no_sites() -> Column:
    return F.array().cast(SITE_TYPE)
