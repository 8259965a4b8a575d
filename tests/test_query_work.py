"""Named queries do each step once: what is parsed, drawn, digested or flagged is not made again."""

import pytest
from pyspark.sql import functions as F

from ionloom.functions import tokens
from ionloom.queries import QUERIES

SITE = "array<struct<site_kind:string,pos:int,residue:string,spec:string>>"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("work")
    texts = [(1, "MACDEFGHIK LLGGNEQVTR PEPTIDECK"), (2, "AMMWWSTAAK LEPTIDECK AAACCCK"), (3, None), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_library_peptides_are_parsed_once(spark, tables):
    out = QUERIES["library_peptide_parse"].build(spark, tables)
    assert planned(out).count("flatten(") == 1
    got = {(r["peptide"], r["site_kind"], r["pos"], r["spelled"], r["shift"]) for r in out.collect()}
    assert {x for x in got if x[0] == "AMMWWSTAAK"} == {
        ("AMMWWSTAAK", "n", 0, "[+42.0106]", 42.0106), ("AMMWWSTAAK", "r", 1, "[+15.9949]", 15.9949), ("AMMWWSTAAK", "r", 2, "[+15.9949]", 15.9949)
    }


def test_only_the_first_shuffle_is_drawn(spark, tables):
    out = QUERIES["shuffled_decoys"].build(spark, tables)
    assert "30,31" not in planned(out).replace(" ", "")
    rows = out.collect()
    assert rows and all(r["same_letters"] and r["same_ends"] for r in rows)


def test_pairs_read_the_stored_digest(spark, tables):
    out = QUERIES["target_decoy_pairs"].build(spark, tables)
    assert "split(" not in planned(out)


def flags(spark, column, residues):
    rows = spark.createDataFrame([(r,) for r in residues], "p string")
    return [r[0] for r in rows.select(column).collect()]


def test_flags_are_runs(spark):
    p, residues = F.col("p"), ["ACDK", "", "A", "ACDEFGHIKLM", None]
    for mask, want in (
        (tokens.pad_mask(p, 6), lambda n, i: i >= n + 2),
        (tokens.site_mask(p, 6), lambda n, i: 1 <= i < n),
    ):
        assert "lambda" not in str(mask)
        width = len(flags(spark, mask, ["A"])[0])
        assert flags(spark, mask, residues) == [[None if r is None else want(len(r), i) for i in range(width)] for r in residues]


def test_sites_take_a_step_each(spark):
    sites = [("n", 0, "A", "UNIMOD:1"), ("r", 1, "M", "UNIMOD:35"), ("r", 1, "M", "UNIMOD:4"), ("r", 40, "M", "UNIMOD:35"), ("r", 2, "C", "UNIMOD:9999"), ("c", 3, "K", "UNIMOD:35")]
    rows = spark.createDataFrame([("AMCK", sites), ("AMCK", []), ("AMCK", None)], f"p string, s {SITE}")
    deltas = {1: 42.0, 4: 57.0, 35: 16.0}
    mass, there = tokens.mod_mass_columns(F.col("p"), F.col("s"), 6, deltas), tokens.mod_present_columns(F.col("p"), F.col("s"), 6)
    assert "sequence(" not in str(mass) + str(there)
    got = rows.select(mass.alias("mass"), there.alias("there")).collect()
    assert [tuple(r["mass"]) for r in got] == [(42.0, 0.0, 73.0, None, 0.0, 16.0, 0.0, 0.0), (0.0,) * 8, (None,) * 8]
    assert [tuple(r["there"]) for r in got] == [(True, False, True, True, False, True, False, False), (False,) * 8, (None,) * 8]
