"""Masses, m/z, compositions, hashes and tokens against published and hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from ionloom.constants import MODIFICATIONS, RESIDUE_ATOMS, RESIDUE_MASS, NUCLIDE_MASS, ELEMENTS, PROTON
from ionloom.functions import chemistry, hashing, tokens
from ionloom.functions.sequence import proforma_sites

# --- Fixed values: published q1 of a commercial retention kit (sequence, charge 2 m/z) --------
KIT = [
    ("LGGNEQVTR", 487.257),
    ("GAGSSEPVTGLDAK", 644.823),
    ("VEATFGVDESNAK", 683.828),
    ("YILAGVENSK", 547.298),
    ("TPVISGGPYEYR", 669.838),
    ("GTFIIDPGGVIR", 622.854),
    ("LFLQFGAQGSPFLK", 776.930),
]


def test_kit_precursors(spark):
    df = spark.createDataFrame(KIT, "p string, mz double")
    got = df.select("mz", chemistry.charged_mz(chemistry.mono_mass(F.col("p")), F.lit(2)).alias("x")).collect()
    assert all(abs(r["mz"] - r["x"]) < 2e-3 for r in got)


def test_residue_masses_agree_with_their_atoms():
    for residue, mass in RESIDUE_MASS.items():
        total = sum(n * NUCLIDE_MASS[e] for n, e in zip(RESIDUE_ATOMS[residue], ELEMENTS))
        assert total == pytest.approx(mass, abs=1e-6)


def test_modification_deltas_follow_from_their_compositions(spark):
    df = spark.createDataFrame([(c, d) for _, _, c, d in MODIFICATIONS], "c string, d double")
    mass = chemistry.composition_mass(chemistry.composition_terms(F.col("c")))
    assert all(abs(r["d"] - r["m"]) < 1e-5 for r in df.select("d", mass.alias("m")).collect())


def test_composition_folds_isotopes_and_refuses_unknown_nuclides(spark):
    df = spark.createDataFrame([("H(20) C(8) 13C(4) N 15N O(-2)",), ("12C(2)",), ("Xx(1)",)], "c string")
    rows = df.select(
        chemistry.composition_terms(F.col("c")).alias("t"),
        chemistry.composition_mass(chemistry.composition_terms(F.col("c"))).alias("m"),
    ).collect()
    assert [(t["element"], t["count"]) for t in rows[0]["t"]] == [("H", 20), ("C", 8), ("C", 4), ("N", 1), ("N", 1), ("O", -2)]
    assert rows[1]["m"] == pytest.approx(24.0)
    assert rows[2]["m"] is None


def test_unknown_modification_is_null_not_zero(spark):
    df = spark.createDataFrame([("PEP[UNIMOD:999]K",), ("PEP[+1.25]K",)], "p string")
    rows = df.select(chemistry.mods_mass(proforma_sites(F.col("p")), {4: 57.0}).alias("m")).collect()
    assert [r["m"] for r in rows] == [None, 1.25]


def test_fragments_are_complementary(spark):
    df = spark.createDataFrame([("PEPTIDEK",)], "p string")
    grid = df.select(chemistry.fragment_grid(chemistry.residue_masses(F.col("p"))).alias("g")).first()["g"]
    mass = sum(RESIDUE_MASS[r] for r in "PEPTIDEK") + chemistry.WATER
    by_cell = {(c["site"], c["ion"], c["charge"]): c for c in grid}
    for site in range(7):
        b, y = by_cell[(site, "b", 1)], by_cell[(site, "y", 1)]
        assert b["mz"] + y["mz"] == pytest.approx(mass + 2 * PROTON)
        assert (b["ordinal"], y["ordinal"]) == (site + 1, 7 - site)
        assert by_cell[(site, "b", 2)]["mz"] == pytest.approx((b["mz"] + PROTON) / 2)


def test_terminal_mods_sit_on_the_ends(spark):
    df = spark.createDataFrame([("[UNIMOD:1]-PEK-[+2.0]",)], "p string")
    masses = chemistry.residue_masses(F.lit("PEK"), proforma_sites(F.col("p")), {1: 42.0105647})
    got = df.select(masses.alias("m")).first()["m"]
    assert got == pytest.approx([RESIDUE_MASS["P"] + 42.0105647, RESIDUE_MASS["E"], RESIDUE_MASS["K"] + 2.0])


# --- Fixed values: unit hashes of five sequences under the published salt ---------------------
GOLDEN = [
    ("PEPTIDEK", 0.0019235956629146),
    ("ACDEFGHIK", 0.1480341390298396),
    ("SAMPLERK", 0.7175794793886064),
    ("TESTPEPTIDER", 0.2640048695401419),
    ("K", 0.0126003690975303),
]


def test_golden_split_hashes(spark):
    df = spark.createDataFrame(GOLDEN, "s string, u double")
    rows = df.withColumn("got", hashing.blake_unit()(F.col("s"))).withColumn("split", hashing.split_label(F.col("got"))).collect()
    assert all(abs(r["u"] - r["got"]) < 1e-12 for r in rows)
    assert {r["split"] for r in rows} == {"train"}


def test_split_boundaries(spark):
    df = spark.createDataFrame([(0.0,), (0.7999,), (0.8,), (0.8999,), (0.9,)], "u double")
    assert [r[0] for r in df.select(hashing.split_label(F.col("u"))).collect()] == ["train", "train", "val", "val", "test"]
    with pytest.raises(ValueError, match="sum to 1"):
        hashing.split_label(F.lit(0.5), (0.8, 0.1, 0.2))


def test_identifiers_use_the_whole_unsigned_range(spark):
    df = spark.createDataFrame([(-1,), (5,), (-(2**63),)], "b bigint")
    rows = df.select(hashing.unsigned(F.col("b")).alias("u"), "b").collect()
    assert [int(r["u"]) for r in rows] == [2**64 - 1, 5, 2**63]
    back = df.select("b", hashing.signed(hashing.unsigned(F.col("b"))).alias("s")).collect()
    assert all(r["b"] == r["s"] for r in back)


def test_spectrum_identifier_matches_the_digest(spark):
    import hashlib

    want = int.from_bytes(hashlib.blake2b(b"set\0run1\0" + b"7", digest_size=8).digest(), "big")
    df = spark.createDataFrame([("set", "run1", 7)], "d string, r string, s bigint")
    assert int(df.select(hashing.unsigned(hashing.spectrum_id()("d", "r", "s"))).first()[0]) == want


def test_mobility_formula(spark):
    got = spark.range(1).select(chemistry.mobility(F.lit(400.0), F.lit(2), F.lit(600.0))).first()[0]
    mass = 1200.0
    assert got == pytest.approx(400.0 * math.sqrt(mass * 28 / (mass + 28)) / 2 / 1059.62245)


def test_token_layout(spark):
    df = spark.createDataFrame([("[UNIMOD:1]-ACK",)], "p string")
    p = F.lit("ACK")
    row = df.select(
        tokens.token_ids(p, 5).alias("t"),
        tokens.pad_mask(p, 5).alias("pad"),
        tokens.site_mask(p, 5).alias("sites"),
        tokens.mod_present_columns(p, proforma_sites(F.col("p")), 5).alias("mod"),
    ).first()
    assert row["t"] == [27, 0, 2, 10, 28, 26, 26]
    assert row["pad"] == [False] * 5 + [True] * 2
    assert row["sites"] == [False, True, True, False, False, False]
    assert row["mod"] == [True] + [False] * 6
