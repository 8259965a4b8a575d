"""Peptide text: stripping, sites, rendering, spellings, digestion, forms."""

import pytest
from pyspark.sql import functions as F

from ionloom.functions import sequence as seq
from ionloom.operators import modforms, sampling
from ionloom.operators.digest import DigestRules, digest, protein_lists, require_peptides, windows


def values(spark, rows, column, *exprs):
    df = spark.createDataFrame([(r,) for r in rows], f"{column} string")
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_stripping_removes_accessions_and_separators(spark):
    c = F.col("p")
    got = values(spark, ["[UNIMOD:737]-PEP[UNIMOD:21]TIDE", "K"], "p", seq.stripped_sequence(c), seq.stripped_length(c))
    assert got == [("PEPTIDE", 7), ("K", 1)]


@pytest.mark.parametrize(
    ("text", "fixed"),
    [
        ("[UNIMOD:737]NWIQK", "[UNIMOD:737]-NWIQK"),
        ("[UNIMOD:737]-NWIQK", "[UNIMOD:737]-NWIQK"),
        ("[UNIMOD:1][UNIMOD:2]K", "[UNIMOD:1][UNIMOD:2]K"),
        ("PEP[UNIMOD:21]K", "PEP[UNIMOD:21]K"),
    ],
)
def test_missing_separator_is_the_only_repair(spark, text, fixed):
    assert values(spark, [text], "p", seq.repair_nterm(F.col("p"))) == [(fixed,)]


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ("PEPTIDE", True),
        ("[UNIMOD:1]-PEP[+79.96633]TIDE-[UNIMOD:2]", True),
        ("PEP[Formula:[13C6]H12O]TIDE", True),
        ("PEP[Phospho]TIDE", False),
        ("PEP[+0.0]TIDE", False),
        ("peptide", False),
        ("[UNIMOD:1]PEPTIDE", False),
        ("PEP[UNIMOD:4junk]K", False),
        ("", False),
    ],
)
def test_grammar(spark, text, valid):
    assert values(spark, [text], "p", seq.is_valid_proforma(F.col("p"))) == [(valid,)]


def test_sites_of_every_kind(spark):
    df = spark.createDataFrame([("[UNIMOD:1]-AM[UNIMOD:35][+2.5]C[Formula:[13C2]H2]K-[UNIMOD:4]",)], "p string")
    rows = df.select(F.explode(seq.proforma_sites(F.col("p"))).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in rows] == [
        ("n", 0, "A", "UNIMOD:1"),
        ("r", 1, "M", "UNIMOD:35"),
        ("r", 1, "M", "+2.5"),
        ("r", 2, "C", "Formula:[13C2]H2"),
        ("c", 3, "K", "UNIMOD:4"),
    ]


def test_rendering_orders_specs_and_round_trips(spark):
    canonical = "[UNIMOD:1]-AM[UNIMOD:4][UNIMOD:35][Formula:H2][+2.5]K-[UNIMOD:2]"
    df = spark.createDataFrame([(canonical,)], "p string").withColumn("s", seq.proforma_sites(F.col("p")))
    shuffled = F.reverse("s")
    assert df.select(seq.render_proforma(F.lit("AMK"), shuffled)).first()[0] == canonical


def test_diann_spelling(spark):
    got = values(spark, ["[UNIMOD:1]-PEPC[UNIMOD:4]T[+79.9660]K[+8.0]-[Formula:H2O]"], "p", seq.diann_spelling(F.col("p")))
    assert got == [("(UniMod:1)PEPC(UniMod:4)T(+79.966)K(+8)[Formula:H2O]",)]


def test_library_peptide_places_shifts(spark):
    got = values(spark, ["_[+42.0106]PEPc(57.02)K_", "PEP[Phospho]K", "PEP[+1"], "p", seq.library_peptide(F.col("p")).alias("x"))
    first, second, third = (r[0] for r in got)
    assert first["residues"] == "PEPCK" and first["valid"]
    assert [(s["site_kind"], s["pos"], s["shift"]) for s in first["shifts"]] == [("n", 0, 42.0106), ("r", 3, 57.02)]
    assert not second["valid"] and not third["valid"]


def test_reversal_is_an_involution_and_carries_mods(spark):
    df = spark.createDataFrame([("PEPTIDEK",), ("AK",), ("ACK",)], "p string")
    once = seq.reverse_interior(F.col("p"))
    rows = df.select("p", once.alias("d"), seq.reverse_interior(once).alias("back")).collect()
    assert [r["d"] for r in rows] == ["PEDITPEK", "AK", "ACK"]
    assert all(r["back"] == r["p"] for r in rows)
    text = spark.createDataFrame([("[UNIMOD:1]-PEC[UNIMOD:4]TIDEK",)], "m string")
    sites = seq.move_sites_reversed(seq.proforma_sites(F.col("m")), F.lit(8))
    assert text.select(seq.render_proforma(F.lit("PEDITCEK"), sites)).first()[0] == "[UNIMOD:1]-PEDITC[UNIMOD:4]EK"


def brute_digest(protein, after, unless, missed, low, high):
    cuts = [0]
    for i, letter in enumerate(protein):
        if letter in after and not (i + 1 < len(protein) and protein[i + 1] in unless):
            cuts.append(i + 1)
    if cuts[-1] != len(protein):
        cuts.append(len(protein))
    out = []
    for i in range(len(cuts) - 1):
        for j in range(i + 1, min(i + missed + 2, len(cuts))):
            piece = protein[cuts[i] : cuts[j]]
            if low <= len(piece) <= high and set(piece) <= set("GASPVTCLINDQKEMHFRYW"):
                out.append(piece)
    return sorted(out)


@pytest.mark.parametrize(
    ("enzyme", "after", "unless"),
    [("trypsin", "KR", "P"), ("trypsin/p", "KR", ""), ("lysc", "K", ""), ("unspecific", "GASPVTCLINDQKEMHFRYW", "")],
)
def test_digest_matches_brute_force(spark, enzyme, after, unless):
    proteins = ["MKPRAKRPKKLLR", "KKK", "AXKBRK", "PEPTIDE", "RPKRPK"]
    rules = DigestRules(enzyme, missed_cleavages=2, min_length=2, max_length=9)
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(proteins)], "protein_id string, residues string")
    got = digest(df, rules).groupBy("protein_id").agg(F.sort_array(F.collect_list("peptide")).alias("p")).collect()
    want = {str(i): brute_digest(p, after, unless, 2, 2, 9) for i, p in enumerate(proteins)}
    assert {r["protein_id"]: r["p"] for r in got} == {k: v for k, v in want.items() if v}


def test_digest_guards(spark):
    with pytest.raises(ValueError, match="out of reach"):
        DigestRules("unspecific", missed_cleavages=2)
    with pytest.raises(ValueError, match="unknown enzyme"):
        DigestRules("glue")
    empty = digest(spark.createDataFrame([("a", "MK")], "protein_id string, residues string"))
    with pytest.raises(ValueError, match="no peptides"):
        require_peptides(empty, DigestRules())


def test_windows_list_every_substring(spark):
    df = spark.createDataFrame([("a", "ABCDE"), ("b", "AB")], "protein_id string, residues string")
    got = sorted(tuple(r) for r in windows(df, 3, 4).select("protein_id", "window").collect())
    assert got == [("a", "ABC"), ("a", "ABCD"), ("a", "BCD"), ("a", "BCDE"), ("a", "CDE")]


def test_windows_cross_blocks_once(spark):
    """Blocks shorter and longer than the protein, against every substring; a text beyond any block passes."""
    texts = ["ACDEFGHIKLMNPQRSTVWYACDEFGH", "AC", "ACD", "", None, "ÄÖÜ😀" * 5]
    df = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "protein_id string, residues string")
    want = sorted((f"p{i}", t[a : a + n], n) for i, t in enumerate(texts) for n in (2, 3, 5) if t for a in range(len(t) - n + 1))
    for block in (1, 5, 7, 27, 100):
        got = windows(df, 2, 5, block).where("width <> 4").select("protein_id", "window", "width").collect()
        assert sorted(tuple(r) for r in got) == want
    with pytest.raises(ValueError):
        windows(df, 3, 2)
    long = spark.range(1).select(F.lit("p").alias("protein_id"), F.repeat(F.lit("ACDEFGHIKL"), 400_000).alias("residues"))
    assert windows(long, 30, 30).count() == 4_000_000 - 29


def test_forms_of_many_sites_are_grown_row_by_row(spark):
    from math import comb

    df = spark.createDataFrame([("ST" * 15, 7), ("PEPK", 8), (None, 9)], "peptide string, tag int")
    forms = modforms.modified_forms(df, [], [seq.parse_rule("ST[UNIMOD:21]")], 3)
    counts = {(r["tag"], r["n_variable"]): r["count"] for r in forms.groupBy("tag", "n_variable").count().collect()}
    assert counts == {**{(7, n): comb(30, n) for n in range(4)}, (8, 0): 1}
    with pytest.raises(ValueError):
        modforms.modified_forms(df, [], [], -1)


def test_protein_lists_lose_no_member_of_a_large_group(spark):
    rows = [("HOT", f"P{i:03d}") for i in range(50)] + [("HOT", "P000"), ("COLD", "P2"), ("COLD", "P1")]
    df = spark.createDataFrame(rows, "peptide string, protein_id string")
    lists = {r["peptide"]: (r["n_proteins"], r["proteins"]) for r in protein_lists(df).collect()}
    assert lists == {"COLD": (2, ["P1", "P2"]), "HOT": (50, [f"P{i:03d}" for i in range(50)])}


def test_rules_and_fixed_sites(spark):
    assert seq.parse_rule("STY[UNIMOD:21]").targets == ("S", "T", "Y")
    assert seq.parse_rule("[UNIMOD:737]-").targets == ("n",)
    assert seq.parse_rule("-[UNIMOD:2]").targets == ("c",)
    for bad in ("STY[Phospho]", "sty[UNIMOD:21]", "[UNIMOD:1]"):
        with pytest.raises(ValueError):
            seq.parse_rule(bad)


def brute_forms(candidates, limit, one_per_site):
    from itertools import combinations

    out = []
    for n in range(limit + 1):
        for combo in combinations(candidates, n):
            places = [c[0] for c in combo]
            if not one_per_site or len(set(places)) == len(places):
                out.append(combo)
    return len(out)


@pytest.mark.parametrize("one_per_site", [True, False])
@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_forms_match_combinations(spark, limit, one_per_site):
    rules = [seq.parse_rule("M[UNIMOD:35]"), seq.parse_rule("MS[UNIMOD:21]"), seq.parse_rule("[UNIMOD:1]-")]
    df = spark.createDataFrame([("MSPMK",)], "peptide string")
    forms = modforms.modified_forms(df, [seq.parse_rule("K[UNIMOD:737]")], rules, limit, one_per_site)
    candidates = [(0, "a"), (3, "a"), (0, "b"), (1, "b"), (3, "b"), ("n", "c")]
    rows = forms.select(seq.mods_text(F.col("sites")).alias("t")).collect()
    assert len(rows) == brute_forms(candidates, limit, one_per_site)
    assert len({r["t"] for r in rows}) == len(rows)
    assert all("4:UNIMOD:737" in r["t"] for r in rows)


def test_sampled_forms_are_seeded_and_capped(spark):
    df = spark.createDataFrame([("STSTSTSTK",), ("PEPK",)], "peptide string")
    rules = [(seq.parse_rule("ST[UNIMOD:21]"), 1.0)]
    first = modforms.sampled_forms(df, rules, 3).collect()
    again = modforms.sampled_forms(df.repartition(3), rules, 3).collect()
    assert {r["peptide"]: r["sites"] for r in first} == {r["peptide"]: r["sites"] for r in again}
    assert sorted(len(r["sites"]) for r in first) == [0, 3]
    with pytest.raises(ValueError, match="probability"):
        modforms.sampled_forms(df, [(rules[0][0], 0.0)], 1)


def test_substitution_keeps_the_mass(spark):
    from ionloom.functions.chemistry import mono_mass

    df = spark.createDataFrame([(f"PEPTIDESEQK{'A' * (i % 7)}",) for i in range(40)], "peptide string").withColumn(
        "mass_only", F.array(F.lit(0), F.lit(1))
    )
    assert modforms.substitute_residue(df, 0.0, ["peptide"]).where("swap_pos >= 0").count() == 0
    swapped = modforms.substitute_residue(df, 1.0, ["peptide"]).withColumn(
        "drift", F.abs(mono_mass(F.col("augmented")) + F.col("mass_delta") - mono_mass(F.col("peptide")))
    )
    rows = swapped.collect()
    assert all(r["swap_pos"] >= 2 and r["drift"] < 1e-9 and r["augmented"] != r["peptide"] for r in rows)
    assert not any({r["old_residue"], r["new_residue"]} == {"I", "L"} for r in rows)


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "mix string, n int")
    rows = sampling.round_robin(df, "mix", [F.col("n").asc()]).orderBy("turn").collect()
    assert [(r["mix"], r["n"]) for r in rows] == [("a", 1), ("b", 1), ("a", 2), ("a", 3)]


def test_random_peptides_end_tryptic(spark):
    df = sampling.random_peptides(spark.range(200).withColumnRenamed("id", "k"), "k")
    rows = df.collect()
    assert all(7 <= len(r["peptide"]) <= 30 and r["peptide"][-1] in "KR" for r in rows)
    assert all(len(r["peptide"]) == r["length"] for r in rows)


def test_mods_text_round_trip(spark):
    text = "[UNIMOD:1]-PEC[UNIMOD:4]K-[+1.5]"
    df = spark.createDataFrame([(text,)], "p string").withColumn("s", seq.proforma_sites(F.col("p")))
    table = df.withColumn("t", seq.mods_text(F.col("s")))
    assert table.first()["t"] == "n:UNIMOD:1;2:UNIMOD:4;c:+1.5"
    back = table.select(seq.render_proforma(F.lit("PECK"), seq.parse_mods_text(F.col("t"), F.lit("PECK"))))
    assert back.first()[0] == text
