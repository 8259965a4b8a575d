"""Decoy search against a serial search, shuffles, groups and numbering."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ionloom.operators import decoys

def serial_shuffle(residues, seed, charge, attempt):
    """Interior places in the order of their hashes."""
    if len(residues) < 4:
        return residues
    draw = lambda i: hashlib.md5(f"{seed}|{residues}|{charge}|{attempt}|{i}".encode()).hexdigest()
    return residues[0] + "".join(residues[i] for i in sorted(range(1, len(residues) - 1), key=draw)) + residues[-1]


def reverse(residues, flank):
    return residues[:flank] + residues[flank : len(residues) - flank][::-1] + residues[len(residues) - flank :]


def serial_search(rows, method, seed):
    """Targets served one by one in input order."""
    targets = {r[1] for r in rows if not r[3]}
    taken = {(r[1], r[2]) for r in rows}
    supplied = {r[4] for r in rows if r[3]}
    out = {}
    for ordinal, peptide, charge, decoy, group in rows:
        if decoy or group in supplied:
            continue
        attempts = (len(peptide) - 2) // 2 if method == "reverse" else 32
        out[ordinal] = None
        for attempt in range(attempts):
            made = reverse(peptide, attempt + 1) if method == "reverse" else serial_shuffle(peptide, seed, charge, attempt)
            if made not in targets and (made, charge) not in taken:
                taken.add((made, charge))
                out[ordinal] = made
                break
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "ordinal bigint, peptide string, charge int, decoy boolean, decoy_group bigint"
    ).withColumn("sites", decoys.no_sites())


def crowded():
    """Short peptides over two letters: many reversals and shuffles meet."""
    from itertools import product

    words = ["".join(w) for w in product("AC", repeat=6)][5:45]
    rows = [(i, "K" + w + "R", 2 + i % 2, False, i) for i, w in enumerate(words)]
    rows.append((100, "KAAACCCR", 2, True, 3))
    return rows


@pytest.mark.parametrize("method", ["reverse", "shuffle"])
def test_search_equals_serial_service(spark, method):
    rows = crowded()
    got = decoys.search_decoys(frame(spark, rows), method, seed=5).collect()
    want = serial_search(rows, method, 5)
    assert {r["ordinal"]: r["identity"] for r in got} == want
    assert any(v is None for v in want.values()) or method == "shuffle"
    assert all(r["paired"] == (r["identity"] is not None) for r in got)


def test_shuffle_carries_modifications(spark):
    from ionloom.functions.sequence import proforma_sites, stripped_sequence

    df = spark.createDataFrame([(1, "PEC[UNIMOD:4]TIM[UNIMOD:35]EDK")], "ordinal bigint, proforma string")
    rows = df.select(
        "ordinal", stripped_sequence(F.col("proforma")).alias("peptide"), proforma_sites(F.col("proforma")).alias("sites"), F.lit(2).alias("charge")
    )
    for r in decoys.decoy_candidates(rows, "shuffle", seed=3).collect():
        made, sites = r["decoy_peptide"], r["decoy_sites"]
        assert sorted(made) == sorted("PECTIMEDK") and made[0] == "P" and made[-1] == "K"
        assert made == serial_shuffle("PECTIMEDK", 3, 2, r["attempt"])
        assert {made[s["pos"]]: s["spec"] for s in sites} == {"C": "UNIMOD:4", "M": "UNIMOD:35"}


def test_group_numbers_are_blocks(spark):
    df = spark.createDataFrame([("B",), ("A",)], "peptide string")
    rows = decoys.number_decoy_groups(df, [F.col("peptide").asc()], 2, 4).collect()
    assert {(r["peptide"], r["charge"]): r["decoy_group"] for r in rows} == {
        ("A", 2): 1, ("A", 3): 2, ("A", 4): 3, ("B", 2): 4, ("B", 3): 5, ("B", 4): 6,
    }


def test_missing_groups_follow_the_largest(spark):
    df = spark.createDataFrame([(1, None), (2, 7), (3, None)], "line int, decoy_group bigint")
    got = {r["line"]: r["decoy_group"] for r in decoys.fill_missing_groups(df, [F.col("line").asc()]).collect()}
    assert got == {1: 8, 2: 7, 3: 9}


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([("A", 2, False, 1), ("A", 2, True, 1)], "duplicate"),
        ([("A", 2, False, 1), ("B", 3, True, 1)], "one target"),
        ([("A", 2, True, 1)], "one target"),
        ([("A", 2, False, 1), ("B", 2, True, 1), ("C", 2, True, 1)], "one target"),
        ([("A", 2, False, 1), ("B", 2, False, 1)], "one target"),
    ],
)
def test_invalid_groups(spark, rows, message):
    df = spark.createDataFrame(rows, "proforma string, charge int, decoy boolean, decoy_group bigint")
    with pytest.raises(ValueError, match=message):
        decoys.require_valid_groups(df)


def test_colliding_decoys_are_left_out(spark):
    targets = spark.createDataFrame([("KACR",), ("KCAR",), ("KAAR",), ("KAGR",)], "peptide string")
    left = decoys.without_collisions(decoys.pseudo_reversed(targets), targets).collect()
    assert [r["peptide"] for r in left] == ["KAGR"]
