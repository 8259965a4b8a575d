"""Library rows: both assembly paths, validation, files, streams, evaluation."""

import json
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionloom.functions import chemistry, spectra
from ionloom.operators import evaluate, labeler, library, winners
from ionloom.operators.digest import DigestRules, protein_lists
from ionloom.plans import library as plan
from ionloom.plans.prepare import curate_prepared, prepare_spectra
from ionloom.operators.curation import CurationPolicy
from ionloom.sinks import libraries as sink
from ionloom.streaming import incremental

OPTIONS = plan.LibraryOptions(
    rules=DigestRules(min_charge=2, max_charge=3),
    variable=("M[UNIMOD:35]",),
    max_fragments=7,
    min_intensity=0.05,
)


@pytest.fixture(scope="module")
def peptides(spark):
    words = ["PEPTIDEK", "MACDEFGHIK", "KACMMR", "KMMCAR", "LLGGNEQVTR"]
    return spark.createDataFrame([(w, f"P{i}") for i, w in enumerate(words)], "peptide string, first_protein string")


def test_numpy_and_column_assembly_agree(spark, peptides):
    fast = plan.library_from_peptides(peptides, OPTIONS)
    forms = plan.peptidoform_frame(peptides, OPTIONS)
    masses = chemistry.residue_masses(F.col("peptide"), F.col("sites"), OPTIONS.deltas)
    neutral = chemistry.mono_mass(F.col("peptide"), chemistry.mods_mass(F.col("sites"), OPTIONS.deltas))
    rows = forms.withColumn("charge", F.explode(F.array(F.lit(2), F.lit(3)))).withColumn("masses", masses)
    labels = labeler.smooth_labels(F.col("peptide"), F.col("masses"), neutral, F.col("charge"))
    slow = library.require_valid_rows(
        library.spectrum_rows(rows.select("*", labels.alias("l")).select("*", "l.*"), OPTIONS.min_intensity, OPTIONS.max_fragments)
    )
    key = lambda r: (r["proforma"], r["charge"], r["decoy"])
    a = {key(r): r for r in fast.collect()}
    b = {key(r): r for r in slow.collect()}
    assert set(a) == set(b) and len(a) > 20
    for k in a:
        for name in ("precursor_mz", "rt", "ccs", "mobility", "neutral_mass"):
            assert a[k][name] == pytest.approx(b[k][name])
        assert [(p["ion"], p["ordinal"], p["charge"]) for p in a[k]["peaks"]] == [(p["ion"], p["ordinal"], p["charge"]) for p in b[k]["peaks"]]
        assert [p["mz"] for p in a[k]["peaks"]] == pytest.approx([p["mz"] for p in b[k]["peaks"]])
        assert [p["intensity"] for p in a[k]["peaks"]] == pytest.approx([p["intensity"] for p in b[k]["peaks"]], abs=1e-6)


def test_colliding_targets_have_no_decoy(spark, peptides):
    forms = plan.peptidoform_frame(peptides, OPTIONS).where("decoy").select("source").distinct()
    assert {r["source"] for r in forms.collect()} == {"PEPTIDEK", "MACDEFGHIK", "LLGGNEQVTR"}


def test_options_are_checked():
    with pytest.raises(ValueError, match="overlap"):
        plan.LibraryOptions(fixed=("C[UNIMOD:4]",), variable=("CM[UNIMOD:35]",))
    with pytest.raises(ValueError, match="min_intensity"):
        plan.LibraryOptions(min_intensity=1.5)


def test_unknown_modification_stops_the_build(spark, peptides):
    options = plan.LibraryOptions(fixed=("C[UNIMOD:999]",), rules=DigestRules(min_charge=2, max_charge=2))
    with pytest.raises(Exception, match="unknown modification"):
        plan.library_from_peptides(peptides, options).collect()


def test_faulty_predictor_stops_the_build(spark, peptides):
    def factory():
        good = labeler.smooth_arrays()

        def predict(batch):
            ms2, rt, ccs = good(batch)
            return ms2, rt, np.full_like(ccs, np.nan)

        return predict

    with pytest.raises(Exception, match="non-physical ccs"):
        plan.library_from_peptides(peptides, OPTIONS, factory).collect()


def test_batch_labeler_contract(spark):
    df = spark.createDataFrame([("PEPTIDEK", 2), ("AAK", 3), ("SKIPK", 2)], "peptide string, charge int")

    def factory():
        def predict(frame):
            ms2 = [None if p == "SKIPK" else [float(len(p))] for p in frame["peptide"]]
            return pd.DataFrame({"ms2": ms2, "rt": frame["charge"] * 1.0, "ccs": 1.0})

        return predict

    got = {r["peptide"]: (r["ms2"], r["rt"]) for r in labeler.label_batches(df, factory, ["peptide", "charge"]).collect()}
    assert got == {"PEPTIDEK": ([8.0], 2.0), "AAK": ([3.0], 3.0)}

    def short():
        return lambda frame: pd.DataFrame({"ms2": [], "rt": [], "ccs": []})

    with pytest.raises(Exception, match="one label per precursor"):
        labeler.label_batches(df, short, ["peptide", "charge"]).collect()


def test_library_files(spark, peptides, tmp_path):
    members = spark.createDataFrame(
        [(w, p) for w in ("PEPTIDEK", "MACDEFGHIK", "KACMMR", "KMMCAR", "LLGGNEQVTR") for p in ("P2", "P1")],
        "peptide string, protein_id string",
    )
    rows = plan.with_protein_names(plan.library_from_peptides(peptides, OPTIONS), protein_lists(members))
    sink.write_diann(rows, str(tmp_path / "lib"), compression=None)
    texts = [p.read_text().splitlines() for p in (tmp_path / "lib").glob("part-*")]
    header = texts[0][0].split("\t")
    assert len(header) == 14 and header[0] == "ModifiedPeptide" and header[-1] == "RelativeIntensity"
    lines = [line.split("\t") for t in texts for line in t[1:]]
    assert len(lines) == rows.select(F.sum(F.size("peaks"))).first()[0]
    assert {line[6] for line in lines} == {"P1;P2", "DECOY_P1;DECOY_P2"}
    assert any("(UniMod:4)" in line[0] for line in lines)

    entries = rows.withColumn("decoy_group", F.lit(1))
    order = [F.col("proforma").asc(), F.col("charge").asc(), F.col("decoy").asc()]
    sink.write_speclib(entries, order, str(tmp_path / "text"), sink.speclib_header("lib", "0.1", [("digest.min", "7")]))
    body = "".join(p.read_text() for p in sorted((tmp_path / "text" / "spectra").glob("part-*")))
    blocks = body.split("<Spectrum=")[1:]
    assert [int(b.split(">")[0]) for b in blocks] == list(range(1, rows.count() + 1))
    for block in blocks:
        peaks = block.split("<Peaks>\n")[1].strip().splitlines()
        assert f"MS:1003059|number of peaks={len(peaks)}\n" in block
        assert [float(p.split("\t")[0]) for p in peaks] == sorted(float(p.split("\t")[0]) for p in peaks)


def test_whole_proteome_files_hold_every_peptide(spark, tmp_path):
    from ionloom.queries import QUERIES

    proteins = {1: "AGDEFGHKLLCNEVTRSSYWAAGDDKTTR", 2: "LLCNEVTRGGAAVVDDEEFFRSTAAANNQQGGHHIIK", 3: "VTADSLLKSSYWAAGDDKAA"}
    spark.createDataFrame(list(proteins.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = {}
    for i, text in proteins.items():
        pieces = re.findall(r"[^KR]*[KR]|[^KR]+$", text)
        for j in range(len(pieces)):
            for k in range(j + 1, min(j + 3, len(pieces)) + 1):
                peptide = "".join(pieces[j:k])
                if 7 <= len(peptide) <= 30:
                    names.setdefault(peptide, set()).add(f"D{i}")
    carbamide = lambda p, mark: p.replace("C", f"C{mark}")
    want = set()
    for place, p in enumerate(sorted(names, key=lambda p: carbamide(p, "[UNIMOD:4]"))):
        decoy = p[0] + p[1:-1][::-1] + p[-1]
        for z in (2, 3):
            want.add((p, z, 0, ";".join(sorted(names[p])), place * 2 + z - 1))
            if decoy not in names:
                want.add((decoy, z, 1, ";".join(sorted("DECOY_" + n for n in names[p])), place * 2 + z - 1))
    lengths = {len(w[0]) for w in want}
    assert max(lengths) > 20 and any(sum(map(w[0].count, "KR")) == 3 for w in want)
    lines = QUERIES["library_file_whole"].build(spark, str(tmp_path)).collect()
    assert len(lines) == len(want)
    assert {(r["peptide"], int(r["charge"]), int(r["decoy"]), r["proteins"]) for r in lines} == {(carbamide(p, "(UniMod:4)"), z, d, n) for p, z, d, n, _ in want}
    entries = QUERIES["library_text_whole"].build(spark, str(tmp_path)).collect()
    assert len(entries) == len(want)
    assert {(r["ion"], r["decoys"], r["proteins"], r["decoy_group"]) for r in entries} == {(f"{carbamide(p, '[UNIMOD:4]')}/{z}", d, n, g) for p, z, d, n, g in want}


def test_reference_shortlist_needs_enough_datasets(spark):
    df = spark.createDataFrame(
        [(1, "a", "val", "FTMS", 5.0, [1.0] * 4 + [0.0] * 4), (2, "a", "val", "FTMS", 4.0, [1.0] * 8), (3, "b", "val", "ITMS", 9.0, [1.0] * 8)],
        "spectrum_id bigint, dataset string, split string, detector string, andromeda_score double, ms2 array<double>",
    )
    best = winners.reference_shortlist(df, 1).first()
    assert (best["spectrum_id"], best["backbone_coverage"]) == (2, 1.0)
    with pytest.raises(ValueError, match="only 1"):
        winners.reference_shortlist(df, 2)


def test_top_per_group_beyond_the_small_limit(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    rows = winners.top_per_group(df, ["g"], [F.col("id").desc()], 1200)
    assert rows.groupBy("g").agg(F.min("id").alias("m"), F.max("rank").alias("r")).orderBy("g").collect()[0][:] == (0, 2600, 1200)


def test_angles_and_empty_spectra(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = [r[0] for r in df.select(spectra.spectral_angle(a, b)).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0])
    marked = [r[0] for r in df.select(spectra.spectral_angle(a, b, float("nan"))).collect()]
    assert math.isnan(marked[2])
    l2 = [r[0] for r in df.select(spectra.sum_normalised_l2(a, b)).collect()]
    assert l2[:2] == pytest.approx([0.0, math.sqrt(2)]) and math.isnan(l2[2])


def test_histogram_edges_and_summary(spark):
    values = [0.0, 0.02, 0.019999, 1.0, 0.98, 1.5, -0.1, float("nan"), 0.58]
    df = spark.createDataFrame([("g", v) for v in values] + [("none", 7.0)], "g string, angle double")
    rows = evaluate.angle_histogram(df, ["g"])
    got = {(r["g"], r["bin"]): r["count"] for r in rows.collect()}
    want, _ = np.histogram([v for v in values if v == v], bins=50, range=(0.0, 1.0))
    assert [got[("g", i)] for i in range(50)] == want.tolist()
    assert sum(got[("none", i)] for i in range(50)) == 0
    first = rows.where("g = 'g'").first()
    assert (first["counted"], first["total"]) == (6, 9)
    summary = {r["g"]: r for r in evaluate.histogram_summary(rows, ["g"]).collect()}
    assert summary["none"]["mean"] is None and summary["none"]["median"] is None
    centres = [(i + 0.5) / 50 for i in range(50)]
    assert summary["g"]["mean"] == pytest.approx(float(np.average(centres, weights=want)))


def test_regression_of_degenerate_data(spark):
    df = spark.createDataFrame([("flat", 1.0, 3.0), ("flat", 1.0, 5.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0)], "g string, o double, p double")
    got = {r["g"]: r for r in evaluate.regression(df, ["g"], "o", "p").collect()}
    assert (got["flat"]["slope"], got["flat"]["r_squared"], got["flat"]["mae"]) == (0.0, 0.0, 3.0)
    assert got["line"]["slope"] == pytest.approx(2.0) and got["line"]["mae"] == pytest.approx(1.5)
    residual = {r["g"]: r["residual_mae"] for r in evaluate.affine_residuals(df, ["g"], "o", "p").collect()}
    assert residual["flat"] is None and residual["line"] == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(ValueError, match="two observations"):
        evaluate.require_pairs(df.limit(1))


def test_masked_mse_without_labels_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 5.0, float("nan")), ("b", 1.0, float("nan"))], "g string, p double, t double")
    got = {r["g"]: (r["labelled"], r["mse"]) for r in evaluate.masked_mse(df, ["g"], "p", "t").collect()}
    assert got == {"a": (1, 1.0), "b": (0, 0.0)}


def test_pca_is_centred_and_ordered(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 4)) * np.array([5.0, 2.0, 0.5, 0.1]) + 10
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "i int, v array<double>")
    placed, model, _ = evaluate.pca_basis(df, "i", "v", 2)
    got = np.abs(np.array([r["scores"] for r in placed.orderBy("i").collect()]))
    centred = data - data.mean(axis=0)
    _, singular, vt = np.linalg.svd(centred, full_matrices=False)
    assert got == pytest.approx(np.abs(centred @ vt[:2].T), abs=1e-8)
    assert list(model.explainedVariance) == pytest.approx(list(singular[:2] ** 2 / (singular**2).sum()))


def test_incremental_files_run_once_per_fingerprint(spark, tmp_path):
    schema = spark.createDataFrame([(1, "a")], "n int, s string").schema
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = []

    def step(batch):
        seen.append(batch.count())
        return batch.where("n > 0")

    def run(mark):
        return spark.read.parquet(incremental.process_new_files(spark, source, schema, step, out, state, mark))

    spark.createDataFrame([(1, "a"), (0, "b")], schema).coalesce(1).write.parquet(source)
    assert run("v1").count() == 1
    spark.createDataFrame([(5, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    assert run("v1").count() == 2 and seen == [2, 1]
    assert run("v1").count() == 2 and seen == [2, 1]
    assert run("v2").count() == 2 and sum(seen) == 6


def test_stream_histogram_equals_batch(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") % 101 / 100.0).alias("angle"))
    source = str(tmp_path / "in")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = incremental.maintain_histogram(stream, ["g"], "angle", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["g"], r["bin"]): r["count"] for r in incremental.latest_version(spark, out).collect()}
    want = {(r["g"], r["bin"]): r["count"] for r in evaluate.angle_histogram(df, ["g"]).where("count > 0").collect()}
    assert got == want


def test_prepare_end_to_end(spark):
    meta = spark.createDataFrame(
        [
            ("run1", 1, "[UNIMOD:1]PEPTIDEK", 2, 10.0, 20.0, 30.0, "FTMS", "HCD", 90.0, 100.0),
            ("run1", 2, "PEPTIDEK", 2, 10.1, None, 30.0, "FTMS", None, 80.0, 90.0),
            ("run1", 3, "PEPTIDEK", 2, 10.2, 20.0, None, None, "HCD", None, 95.0),
            ("run1", 4, "S[UNIMOD:21]AMPLER", 2, 11.0, 20.0, 30.0, "FTMS", "HCD", 50.0, 10.0),
            ("run1", 4, "SAMPLE[UNIMOD:21]R", 2, 11.0, 20.0, 30.0, "FTMS", "HCD", 50.0, 10.0),
        ],
        "raw_file string, scan_number bigint, modified_sequence string, precursor_charge bigint, retention_time double, "
        "indexed_retention_time double, aligned_collision_energy double, mass_analyzer string, fragmentation string, "
        "andromeda_score double, precursor_intensity double",
    )
    frags = spark.createDataFrame(
        [("run1", s, "b", 1, 1, 0.5, None) for s in (1, 2, 3, 4)] + [("run1", s, "y", 2, 1, 1.0, None) for s in (1, 2, 3)],
        "raw_file string, scan_number bigint, ion_type string, no bigint, charge bigint, intensity float, neutral_loss string",
    )
    rows = {r["scan_number"]: r for r in prepare_spectra(meta, frags, "set", "Lumos").collect()}
    assert sorted(rows) == [1, 2, 3]
    assert rows[1]["proforma"] == "[UNIMOD:1]-PEPTIDEK" and len(rows[1]["ms2"]) == 28
    assert math.isnan(rows[2]["irt"]) and rows[2]["fragmentation"] == ""
    assert math.isnan(rows[3]["andromeda_score"]) and rows[3]["detector"] == ""
    assert rows[1]["ms2"][0] == 0.5 and rows[1]["ms2"][5 * 4 + 1] == 1.0
    assert {r["split"] for r in rows.values()} == {"train"}
    spectra_rows = prepare_spectra(meta, frags, "set", "Lumos")
    kept, curation = curate_prepared(
        spectra_rows, CurationPolicy(min_in_window_psms=1, width_anchor_min_psms=2, max_run_width_minutes=60.0)
    )
    assert kept.count() == curation.verdicts.where("selected").count() > 0
    with pytest.raises(ValueError, match="precursor_intensity"):
        curate_prepared(spectra_rows.withColumn("precursor_intensity", F.lit(float("nan"))), CurationPolicy())


def test_sidecar_holds_the_counts(spark):
    from ionloom.sinks.corpus import provenance_sidecar

    doc = spark.createDataFrame([('{"digest":{"min":7}}',)], "settings string")
    counts = spark.createDataFrame([(3, 5)], "precursors int, fragments int")
    assert json.loads(provenance_sidecar(doc, counts).first()["value"]) == {
        "settings": {"digest": {"min": 7}}, "output": {"counts": {"precursors": 3, "fragments": 5}},
    }


def test_a_source_without_proteins_stops_the_job(spark, peptides):
    members = spark.createDataFrame([("PEPTIDEK", "P1")], "peptide string, protein_id string")
    rows = plan.with_protein_names(plan.library_from_peptides(peptides, OPTIONS), protein_lists(members))
    with pytest.raises(Exception, match="no protein list"):
        rows.collect()


def test_complete_library_groups_targets_with_their_decoys(spark):
    proteins = spark.createDataFrame([("P1", "PEPTIDEKMACDEFGHIK"), ("P2", "PEPTIDEKLLGGNEQVTR")], "protein_id string, residues string")
    options = plan.LibraryOptions(rules=DigestRules(missed_cleavages=0, min_charge=2, max_charge=3))
    rows = plan.complete_library(proteins, options).collect()
    by_group = {}
    for r in rows:
        by_group.setdefault(r["decoy_group"], []).append(r)
    assert sorted(by_group) == [1, 2, 3, 4, 5, 6]
    for group in by_group.values():
        assert len({r["charge"] for r in group}) == 1 and sorted(r["decoy"] for r in group) == [False, True]
        assert len({r["source"] for r in group}) == 1
    shared = next(r for r in rows if r["peptide"] == "PEPTIDEK")
    assert shared["proteins"] == ["P1", "P2"]
    assert next(r for r in rows if r["decoy"] and r["source"] == "PEPTIDEK")["proteins"] == ["DECOY_P1", "DECOY_P2"]
