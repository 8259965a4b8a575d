"""Library batches: each peptidoform at the charges it is asked for, in several tasks a core, peaks put together where read."""

import json

import pytest
from pyspark.sql import functions as F

from ionloom.operators.decoys import no_sites
from ionloom.operators.digest import DigestRules
from ionloom.operators.labeler import smooth_arrays
from ionloom.plans import library as plan
from ionloom.sinks import library_writer as writer


def test_listed_peptides_are_predicted_at_their_own_charge(spark):
    def factory():
        predict = smooth_arrays()

        def checked(batch):
            if {chr(r[0]) for r in batch.residues} - ({"P"} if batch.charge == 2 else {"M"}):
                raise ValueError("a charge nobody asked for")
            return predict(batch)

        return checked

    given = spark.createDataFrame([(1, "PEPTIDECK", 2), (2, "MACDEFGHK", 3), (3, "MACDEFGHK", None)], "ordinal long, peptide string, charge int")
    rows = given.select("ordinal", "peptide", no_sites().alias("sites"), "charge", F.lit(False).alias("decoy"), F.col("ordinal").alias("decoy_group"), F.array(F.lit("P")).alias("proteins"))
    out, _ = plan.listed_library(rows, factory=factory)
    got = {(r["peptide"], r["charge"]) for r in out.where("not decoy").collect()}
    assert got == {("PEPTIDECK", 2), ("MACDEFGHK", 3)}


@pytest.fixture(scope="module")
def peptides(spark):
    return spark.createDataFrame([(f"PEPT{a}DE{b}CK",) for a in "ACDEFGH" for b in "LMNQRST"], "peptide string")


def test_peaks_are_put_together_only_where_read(spark, peptides):
    rows = plan.library_from_peptides(peptides, plan.LibraryOptions(rules=DigestRules(min_charge=2, max_charge=3), max_fragments=9))
    counted = rows.agg(F.sum("n_peaks"))
    assert "arrays_zip" not in counted._jdf.queryExecution().optimizedPlan().toString()
    read = rows.select("n_peaks", "peaks").collect()
    assert all(r["n_peaks"] == len(r["peaks"]) == 9 for r in read) and counted.first()[0] == 9 * len(read)
    assert {(p["ion"], p["ordinal"] > 0, p["charge"] in (1, 2)) for r in read for p in r["peaks"]} == {("b", True, True), ("y", True, True)}
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_a_library_is_written_by_several_tasks_a_core(spark, peptides, tmp_path):
    proteins = peptides.select(F.col("peptide").alias("protein_id"), F.col("peptide").alias("residues"))
    counts = plan.write_library(proteins, str(tmp_path / "made"), plan.LibraryOptions(max_fragments=3))
    parts = json.loads((tmp_path / "made" / writer.SIDECAR).read_text())["output"]["parts"]
    assert parts > 2 * spark.sparkContext.defaultParallelism and counts["fragments"] == 3 * counts["precursors"]
