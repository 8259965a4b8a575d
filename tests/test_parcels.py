"""Parcels: blocks that open as they were packed, buckets in one task, numbers in the order of the text, one shuffle a library."""

import gzip
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom.operators import parcels
from ionloom.operators.digest import DigestRules, digest, peptide_table, protein_groups, protein_lists
from ionloom.plans import library as plan
from ionloom.sinks import library_writer as writer

SITE = pa.struct([("site_kind", pa.string()), ("pos", pa.int32()), ("spec", pa.string())])
SCHEMA = pa.schema([("t", pa.string()), ("l", pa.list_(pa.string())), ("s", pa.list_(SITE)), ("b", pa.bool_()), ("i", pa.int64()), ("d", pa.float64())])


def table(n):
    rows = [
        {"t": None if i % 5 == 0 else "äß" * (i % 4) + str(i), "l": None if i % 7 == 0 else ["x" * (300 * (i % 2)), None][: i % 3],
         "s": [{"site_kind": "r", "pos": i, "spec": None}] * (i % 3), "b": [True, False, None][i % 3], "i": None if i == 2 else -(i**9), "d": i / 3}
        for i in range(n)
    ]
    return pa.Table.from_pylist(rows, SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 40])
def test_a_block_opens_as_it_was_packed(n):
    assert parcels.unpacked(parcels.packed(table(n)), SCHEMA).to_pylist() == table(n).to_pylist()


def test_a_slice_is_packed_alone():
    part = table(40).slice(11, 9)
    assert parcels.unpacked(parcels.packed(part), SCHEMA).to_pylist() == part.to_pylist()


def test_a_type_that_cannot_be_packed_is_refused():
    with pytest.raises(TypeError, match="parcel"):
        parcels.packed(pa.table({"x": pa.array([b"1"], pa.binary())}))


@pytest.fixture(scope="module")
def memberships(spark):
    rows = [("P2", "PEPTIDEK"), ("P1", "PEPTIDEK"), ("P1", "PEPTIDEK"), (None, "PEPTIDEK"), (None, "LONELYR"), ("P1", "PEDITPEK"), ("P3", "PALLAPK"), ("P3", "PALLAKK"), ("P9", "KAR")]
    rows += [(f"Q{i:03d}", "SHAREDK") for i in range(300)]
    return spark.createDataFrame(rows, "protein_id string, peptide string").repartition(5)


@pytest.mark.parametrize("lists", [False, True])
@pytest.mark.parametrize("rows", [1, 1 << 20])
def test_peptides_equal_groups_lists_and_the_join_for_decoys(memberships, lists, rows, monkeypatch):
    monkeypatch.setattr(parcels, "HELD_ROWS", rows)
    want = plan.flag_decoys((protein_lists if lists else protein_groups)(memberships))
    got = peptide_table(memberships, lists)
    key = lambda r: r["peptide"]
    assert sorted(got.collect(), key=key) == sorted(want.select(*got.columns).collect(), key=key)
    free = {r["peptide"]: r["emits_decoy"] for r in got.collect()}
    assert not free["PEPTIDEK"] and not free["PEDITPEK"] and not free["KAR"] and free["SHAREDK"]
    assert not peptide_table(memberships, lists, decoys=False).where("emits_decoy").count()
    assert peptide_table(memberships.where("false"), lists).count() == 0


def test_rows_are_numbered_in_the_order_of_their_text(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACK[")) for _ in range(rng.integers(1, 9))) + f"z{i}" for i in range(3000)]
    rows = spark.createDataFrame([(None if i % 2 else t, t, 1 + i % 2) for i, t in enumerate(texts)], "shown string, peptide string, weight int").repartition(7)
    out = parcels.numbered(rows, ["peptide"], "shown", "weight", 16, otherwise="peptide")
    weights, before = {t: 1 + i % 2 for i, t in enumerate(texts)}, 0
    found = out.withColumn("part", F.spark_partition_id()).orderBy("rank").collect()
    for rank, (row, text) in enumerate(zip(found, sorted(texts), strict=True)):
        assert (row["peptide"], row["rank"], row["before"]) == (text, rank, before)
        before += weights[text]
    parts = [r["part"] for r in found]
    assert parts == sorted(parts) and max(np.bincount(parts)) < 3 * 3000 / 16
    assert parcels.numbered(rows.where("false"), ["peptide"], "shown", "weight", 16, otherwise="peptide").collect() == []


def stored(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return set(os.listdir(f"{top}/tables")) if os.path.isdir(f"{top}/tables") else set()


@pytest.fixture(scope="module")
def proteins(spark):
    rng = np.random.default_rng(5)
    rows = [(f"P{i % 40}", "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 300))) for i in range(50)]
    return spark.createDataFrame(rows, "protein_id string, residues string")


def test_a_library_is_built_from_one_shuffle_and_stores_nothing(spark, proteins):
    options = plan.LibraryOptions(rules=DigestRules(min_charge=2, max_charge=3), variable=("M[UNIMOD:35]",))
    before = stored(spark)
    rows = plan.build_library(proteins, options)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and stored(spark) == before
    slow = plan.library_from_peptides(protein_groups(digest(proteins, options.rules)), options)
    names = ["source", "proforma", "charge", "decoy", "n_proteins", "first_protein", "n_peaks", "precursor_mz"]
    got, want = (sorted(map(tuple, x.select(*names).collect())) for x in (rows, slow))
    assert got == want and len(got) > 1000


def test_a_capped_library_is_built_from_the_same_shuffle(proteins):
    options = plan.LibraryOptions(rules=DigestRules(min_charge=2, max_charge=3), max_fragments=15)
    rows = plan.build_library(proteins, options)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    slow = plan.library_from_peptides(protein_groups(digest(proteins, options.rules)), options)
    got, want = (sorted(map(tuple, x.select("proforma", "charge", "decoy", "n_peaks").collect())) for x in (rows, slow))
    assert got == want and max(r[3] for r in got) == 15


def test_a_library_is_written_from_one_stored_table_in_the_order_of_its_entries(spark, proteins, tmp_path):
    options = plan.LibraryOptions(rules=DigestRules(min_charge=2, max_charge=3), variable=("M[UNIMOD:35]",), max_fragments=3)
    before = stored(spark)
    inputs = plan.writer_inputs(proteins, options)
    assert len(stored(spark) - before) == 1
    assert inputs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = [(r["place"], r["part"], r["decoy"], r["first_group"]) for r in inputs.withColumn("part", F.spark_partition_id()).orderBy("place").collect()]
    assert [f[0] for f in found] == list(range(len(found))) and [f[1] for f in found] == sorted(f[1] for f in found)
    groups = [f[3] for f in found if not f[2]]
    assert groups == [1 + 2 * i for i in range(len(groups))] and [f[3] for f in found] == sorted(f[3] for f in found)
    counts = plan.write_library(proteins, str(tmp_path / "made"), options, form="text")
    assert counts["precursors"] == 2 * len(found)


def test_an_empty_proteome_is_an_empty_library(spark, proteins, tmp_path):
    counts = plan.write_library(proteins.where("false"), str(tmp_path / "none"), plan.LibraryOptions())
    assert counts == {"precursors": 0, "fragments": 0, "decoys": 0}


def test_parts_leave_out_short_repeats(spark, proteins, tmp_path):
    """Digits that happen to repeat are dearer as a reference than as digits."""
    plan.write_library(proteins, str(tmp_path / "made"), plan.LibraryOptions(rules=DigestRules(missed_cleavages=0)))
    parts = [p.read_bytes() for p in sorted((tmp_path / "made").glob("part-*"))]
    text = b"".join(gzip.decompress(p) for p in parts)
    fast = zlib.compressobj(1, zlib.DEFLATED, 31)
    assert len(b"".join(parts)) < 0.85 * len(fast.compress(text) + fast.flush())
    assert writer.read_diann_lines(spark, str(tmp_path / "made")).count() == text.count(b"\n") - 1
