"""Readers and writers: formats, refusals, round trips."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ionloom import schemas
from ionloom.operators import catalog, library
from ionloom.sinks import corpus
from ionloom.sinks import libraries as sink
from ionloom.sources import fasta, libraries, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_joins_lines_and_names(spark, tmp_path):
    path = write(tmp_path / "p.fasta", ">sp|P1 first one\nmkvl\n\nAAK\r\n>P2\n  gg \n>P3 empty\n")
    rows = fasta.read_fasta(spark, path).orderBy("protein_id").collect()
    assert [(r["protein_id"], r["residues"]) for r in rows] == [("P2", "GG"), ("P3", ""), ("sp|P1", "MKVLAAK")]
    whole = fasta.read_fasta(spark, path, identifier="header")
    assert "sp|P1 first one" in {r["protein_id"] for r in whole.collect()}


def test_fasta_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="before the first"):
        fasta.read_fasta(spark, write(tmp_path / "a.fasta", "MKV\n>P1\nAAK\n"))
    with pytest.raises(Exception, match="empty FASTA header"):
        fasta.read_fasta(spark, write(tmp_path / "b.fasta", ">P1\nAAK\n>\nMKV\n")).collect()
    with pytest.raises(ValueError, match="no records"):
        fasta.read_fasta(spark, write(tmp_path / "c.fasta", "\n\n"))


def test_large_fasta_is_split_between_tasks(spark, tmp_path):
    text = "".join(f">P{i}\n{'ACDEFGHIK' * 40}\nLMNPQ\n" for i in range(3000))
    path = write(tmp_path / "big.fasta", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        df = fasta.read_fasta(spark, path)
        assert df.rdd.getNumPartitions() > 4
        assert df.select("protein_id").distinct().count() == 3000
        assert df.agg(F.min(F.length("residues")), F.max(F.length("residues"))).first()[:] == (365, 365)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


HEAD = "proforma\tprotein_ids\tdecoy\tdecoy_group\n"


def test_peptide_list(spark, tmp_path):
    path = write(
        tmp_path / "p.tsv",
        HEAD + "PEC[UNIMOD:4]TIDEK/2\tP1;P2\t\t\nPEPK/3\tP1\tfalse\t9\nKPEPR/3\tP3\ttrue\t9\nAAAK/2\tP1\t0\t\n",
    )
    rows = {r["proforma"]: r for r in libraries.read_peptide_list(spark, path).collect()}
    assert rows["PEC[UNIMOD:4]TIDEK"]["proteins"] == ["P1", "P2"]
    assert rows["PEC[UNIMOD:4]TIDEK"]["decoy_group"] == 10 and rows["AAAK"]["decoy_group"] == 11
    assert rows["KPEPR"]["decoy"] and rows["KPEPR"]["decoy_group"] == 9


@pytest.mark.parametrize(
    ("line", "message"),
    [
        ("PEPTIDEK\tP1\t\t", "must include charge"),
        ("PEPTIDEK/x\tP1\t\t", "invalid charge"),
        ("PEPTIDEK/0\tP1\t\t", "invalid charge"),
        ("PEP[Phospho]K/2\tP1\t\t", "invalid proforma"),
        ("PEPTIDEK/2\tP1; \t\t", "empty protein id"),
        ("PEPTIDEK/2\tP1\tmaybe\t", "invalid decoy flag"),
        ("PEPTIDEK/2\tP1\ttrue\t", "needs decoy_group"),
        ("PEPTIDEK/2\tP1\t\tx", "must be an integer"),
    ],
)
def test_peptide_list_refusals(spark, tmp_path, line, message):
    with pytest.raises(ValueError, match=message):
        libraries.read_peptide_list(spark, write(tmp_path / "p.tsv", HEAD + line + "\n"))


def test_ragged_peptide_list_stops(spark, tmp_path):
    path = write(tmp_path / "p.tsv", HEAD + "PEPTIDEK/2\tP1\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        libraries.read_peptide_list(spark, path)


SPECTRONAUT = (
    "ModifiedPeptide\tPrecursorCharge\tTr_recalibrated\tIonMobility\tDecoy\tFragmentType\tFragmentNumber\t"
    "FragmentCharge\tFragmentLossType\tRelativeIntensity\n"
)


def test_speclib_assembly(spark, tmp_path):
    lines = [
        "_PEPT[+79.96633]IDEK_\t2\t10.5\t0.9\t0\ty\t3\t1\tnoloss\t0.5",
        "_PEPT[+79.96633]IDEK_\t2\t10.5\t0.9\t0\tb\t2\t2\tnoloss\t1.0",
        "_PEPT[+79.96633]IDEK_\t2\t10.5\t0.9\t0\ty\t9\t1\tnoloss\t0.3",
        "_PEPT[+79.96633]IDEK_\t2\t10.5\t0.9\t0\ty\t4\t1\tH2O\t0.2",
        "_AAAAK_\t2\t1.0\t\t0\ty\t2\t3\tnoloss\t0.2",
        "_DECOYK_\t2\t1.0\t\t1\ty\t2\t1\tnoloss\t0.2",
    ]
    path = write(tmp_path / "l.tsv", SPECTRONAUT + "\n".join(lines) + "\n")
    rows = libraries.read_speclib(spark, path)
    records = library.library_precursors(rows)
    counts = library.reader_counts(rows, records).first().asDict()
    assert counts == {
        "rows": 6, "decoys": 1, "excluded": 0, "precursors": 1, "precursors_without_fragments": 1, "fragments_dropped": 3,
    }
    kept = libraries.parsed_peptides(records.where(F.size("fragments") > 0)).first()
    assert [(f["site"], f["col"], f["intensity"]) for f in kept["fragments"]] == [(4, 1, 0.5), (1, 2, 1.0)]
    assert kept["residues"] == "PEPTIDEK" and kept["retention"] == 10.5
    grid = library.scatter_library(records.where(F.size("fragments") > 0).withColumn("n", F.lit(8)), "n").first()["ms2"]
    assert len(grid) == 28 and grid[4 * 4 + 1] == 0.5 and grid[1 * 4 + 2] == 1.0
    assert [r["spelled"] for r in libraries.library_shifts(rows).collect()] == ["[+79.96633]"]


def test_speclib_formats(spark, tmp_path):
    assert libraries.library_format(["FragmentSeriesNumber", "transition_group_id", "FragmentNumber", "ModifiedPeptide"]) == "diann"
    with pytest.raises(ValueError, match="unrecognised"):
        libraries.library_format(["a", "b"])
    bad = write(tmp_path / "l.tsv", SPECTRONAUT + "_PEPT[Phospho]IDEK_\t2\t1\t\t0\ty\t3\t1\tnoloss\t0.5\n")
    with pytest.raises(Exception, match="unreadable modified sequence"):
        libraries.library_shifts(libraries.read_speclib(spark, bad)).collect()
    bad = write(tmp_path / "m.tsv", SPECTRONAUT + "_PEPK_\tx\t1\t\t0\ty\t3\t1\tnoloss\t0.5\n")
    with pytest.raises(Exception, match="unreadable precursor charge"):
        libraries.read_speclib(spark, bad).collect()


def test_excluded_rows_count_and_drop(spark, tmp_path):
    head = SPECTRONAUT.replace("FragmentNumber", "FragmentSeriesNumber").replace("RelativeIntensity", "LibraryIntensity").replace("Decoy", "decoy")
    head = head.rstrip("\n") + "\tExcludeFromAssay\ttransition_group_id\n"
    path = write(
        tmp_path / "l.tsv",
        head + "PEPK\t2\t1\t\t0\ty\t2\t1\tnoloss\t0.5\tTrue\tg\nPEPK\t2\t1\t\t0\ty\t1\t1\tnoloss\t0.5\tFalse\tg\n",
    )
    rows = libraries.read_speclib(spark, path)
    assert library.reader_counts(rows, library.library_precursors(rows)).first()["excluded"] == 1
    assert len(library.library_precursors(rows).first()["fragments"]) == 2
    assert len(library.library_precursors(rows, drop_excluded=True).first()["fragments"]) == 1


def test_panel_cells(spark):
    df = spark.createDataFrame([("PEPTIDEK", "y7;b2^2", "1.0;0.25")], "proforma string, annotations string, relative_intensity string")
    rows = libraries.panel_cells(df, ["proforma"]).collect()
    assert [(r["site"], r["col"], r["intensity"]) for r in rows] == [(0, 1, 1.0), (1, 2, 0.25)]
    with pytest.raises(Exception, match="counts differ"):
        libraries.panel_cells(df.withColumn("relative_intensity", F.lit("1")), ["proforma"]).collect()
    with pytest.raises(Exception, match="no grid cell"):
        libraries.panel_cells(df.withColumn("annotations", F.lit("y8;b2")), ["proforma"]).collect()


def prepared(spark, n=3):
    rows = [
        (i, "set", "run", i, "PEPTIDE", 2, "train", 1.0, 2.0, "Lumos", "FTMS", "HCD", 30.0, 5.0, [0.5, 1.0]) for i in range(n)
    ]
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.PREPARED.fields[1:])
    return spark.createDataFrame(rows, "spectrum_id bigint, " + names)


def test_prepared_contract_is_strict(spark, tmp_path):
    df = corpus.contract(prepared(spark))
    assert df.schema.simpleString() == schemas.PREPARED.simpleString()
    with pytest.raises(ValueError, match="columns differ"):
        schemas.enforce_schema(df.drop("ms2"), schemas.PREPARED)
    with pytest.raises(ValueError, match="columns differ"):
        schemas.enforce_schema(df.withColumn("extra", F.lit(1)), schemas.PREPARED)
    with pytest.raises(ValueError, match="charge"):
        schemas.enforce_schema(df.withColumn("charge", F.col("charge").cast("int")), schemas.PREPARED)
    legacy = df.withColumn("spectrum_id", F.col("spectrum_id").cast("bigint"))
    assert schemas.enforce_schema(legacy, schemas.PREPARED).schema["spectrum_id"].dataType == schemas.IDENTIFIER


def test_prepared_files_have_bounded_row_groups(spark, tmp_path):
    many = corpus.contract(prepared(spark, 2).crossJoin(spark.range(70_000)).withColumn("spectrum_id", F.col("id")).drop("id"))
    out = str(tmp_path / "out")
    corpus.write_prepared(many.coalesce(1), out)
    meta = pq.read_metadata(next((tmp_path / "out").glob("*.parquet")))
    assert meta.row_group(0).column(0).compression == "ZSTD"
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= corpus.ROW_GROUP_ROWS
    assert tables.read_prepared(spark, [out]).count() == 140_000


def test_metadata_needs_its_keys(spark):
    df = spark.createDataFrame([("r", 1)], "raw_file string, scan_number bigint")
    with pytest.raises(ValueError, match="modified_sequence"):
        tables.select_metadata(df)


def test_manifests(spark, tmp_path):
    for i in range(3):
        folder = tmp_path / "shards" / f"src{i}" / "000000"
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(
            json.dumps({"version": 1, "rows": i, "data_uri": "x", "task": {"dataset": "set", "config_fingerprint": "f"}}, indent=2)
        )
        (folder / "other.json").write_text("{}")
    rows = tables.read_shard_manifests(spark, str(tmp_path)).collect()
    assert sorted(r["rows"] for r in rows) == [0, 1, 2]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "manifest.json").write_text(json.dumps({"version": 2, "chunks": [{"uri": "x"}]}))
    with pytest.raises(ValueError, match="version"):
        tables.read_corpus_manifest(spark, str(bad))
    (bad / "manifest.json").write_text(json.dumps({"version": 1, "chunks": []}))
    with pytest.raises(ValueError, match="no chunks"):
        tables.read_corpus_manifest(spark, str(bad))


def test_manifest_winners_inline_or_beside(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(
        json.dumps({"version": 1, "chunks": [{"uri": "x"}], "val_winners": [18446744073709551615]})
    )
    inline = tables.manifest_winners(spark, tables.read_corpus_manifest(spark, str(tmp_path)))
    assert [int(r[0]) for r in inline.collect()] == [2**64 - 1]
    side = str(tmp_path / "winners")
    corpus.write_winners(inline, side)
    other = tmp_path / "o"
    other.mkdir()
    (other / "manifest.json").write_text(json.dumps({"version": 1, "chunks": [{"uri": "x"}], "val_winners_uri": side}))
    assert tables.manifest_winners(spark, tables.read_corpus_manifest(spark, str(other))).count() == 1


def test_catalog_globs_and_picks(spark):
    archives = spark.createDataFrame([("TUM_first_1",), ("TUM_first_2",), ("other",)], "archive string")
    sources = catalog.expand_sources(archives, "rec", ["TUM_*"], ["*_2"], strip_prefix="TUM_")
    assert sources.first()[:3] == ("rec_TUM_first_1", "rec_first", "TUM_first_meta_data.parquet")
    every = catalog.expand_sources(archives, "rec", ["*"], [])
    shards = spark.createDataFrame([("TUM_first_1", i) for i in range(4)] + [("other", 0)], "archive string, shard_index int")
    tasks = catalog.expand_tasks(every, shards)
    assert [r["ordinal"] for r in tasks.orderBy("source_id", "shard_index").collect()] == list(range(5))
    picks = spark.createDataFrame([("rec_TUM_first_1", 2)], "source_id string, shard_index int")
    chosen = {(r["source_id"], r["shard_index"]) for r in catalog.expand_tasks(every, shards, picks).collect()}
    assert chosen == {("rec_TUM_first_1", 2), ("rec_other", 0)}
    with pytest.raises(ValueError, match="outside"):
        catalog.expand_tasks(every, shards, picks.withColumn("shard_index", F.lit(9)))
    with pytest.raises(ValueError, match="range"):
        catalog.select_range(tasks, 3, 9, 5)


def test_nested_settings_flatten(spark):
    doc = json.dumps({"a": {"b": {"c": 1.5, "d": None}, "e": "x"}, "f": [1, {"g": 2}], "h": True})
    df = spark.createDataFrame([(doc,)], "j string")
    got = {r["key"]: r["value"] for r in catalog.flatten_document(df, [], "j").collect()}
    assert got == {"a.b.c": "1.5", "a.e": "x", "f": '[1,{"g":2}]', "h": "true"}


def test_settings_verdicts(spark):
    def doc(**kv):
        return spark.createDataFrame([(k.replace("_", "."), v) for k, v in kv.items()], "key string, value string")

    mine = doc(digest_min="7", output_path="a")
    assert catalog.check_settings(mine, doc(digest_min="7", output_path="b")).first()["verdict"] == "same"
    assert catalog.check_settings(mine, doc(digest_min="8")).first()[:] == ("different", 1)
    assert catalog.check_settings(mine, doc(digest_min="7", digest_max="9")).first()[:] == ("different", 1)
    assert catalog.check_settings(mine.where("false"), mine).first()["verdict"] == "unknown"


def test_header_refuses_line_endings():
    lines = sink.speclib_header("lib", "0.1", [("a.b", "1"), ("a.a", "x=y")])
    assert lines[0] == "<mzSpecLib>" and "[1]MS:1003275|other attribute name=ionloom:a.a" in lines
    with pytest.raises(ValueError, match="line ending"):
        sink.speclib_header("lib", "0.1", [("a", "x\ny")])


def test_fixed_decimals_round_halves_to_even(spark):
    df = spark.createDataFrame([(1 / 512,), (3 / 512,), (0.1,), (-0.25,)], "x double")
    assert [r[0] for r in df.select(sink.fixed(F.col("x"), 8)).collect()] == [f"{v:.8f}" for v in (1 / 512, 3 / 512, 0.1, -0.25)]
