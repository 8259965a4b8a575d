"""Reader and writer queries: files derived from the tables, written, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import spectra
from ionloom.functions.hashing import unsigned
from ionloom.operators import catalog, library, resolve, winners
from ionloom.operators.joins import resolve_shifts
from ionloom.queries import views
from ionloom.queries.base import Book, run_folder
from ionloom.schemas import PREPARED, enforce_schema
from ionloom.sinks import corpus, libraries as sink
from ionloom.sinks.manifest_log import ManifestLog
from ionloom.sources import fasta, libraries, tables

BOOK = Book()
add = BOOK.add


@add(
    "fasta_scan",
    "S1",
    needs=("proteome",),
    sql="SELECT protein_id, length(residues)::BIGINT AS length, md5(residues) AS digest FROM proteome",
)
def fasta_scan(spark, sf):
    """The proteome written as FASTA in 60-letter lines and read back."""
    folder = run_folder(spark)
    lines = F.rtrim(F.regexp_replace("residues", "(.{60})", "$1\n"))
    record = F.concat(F.lit(">"), F.col("protein_id"), F.lit(" stand-in\n"), F.lower(lines))
    views.proteome(spark, sf).select(record.alias("value")).write.text(folder)
    return fasta.read_fasta(spark, folder).select(
        "protein_id", F.length("residues").alias("length"), F.md5("residues").alias("digest")
    )


@add(
    "psm_metadata_scan",
    "S2",
    needs=("candidates",),
    sql="SELECT raw_file, count(*) AS rows, count(DISTINCT scan_number) AS scans, max(andromeda_score) AS best FROM candidates GROUP BY 1",
)
def psm_metadata_scan(spark, sf):
    """Metadata written under other names, read under the contract's."""
    folder = run_folder(spark)
    views.candidates(spark, sf).withColumnRenamed("andromeda_score", "score").write.parquet(folder)
    meta = tables.read_metadata(spark, [folder], rename={"andromeda_score": "score"})
    return meta.groupBy("raw_file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("scan_number").alias("scans"),
        F.max("andromeda_score").alias("best"),
    )


@add(
    "fragment_scan",
    "S3",
    needs=("fragments",),
    sql="""SELECT raw_file, ion_type, charge, count(*) AS rows, round(sum(intensity::FLOAT::DOUBLE), 2) AS intensity FROM fragments
WHERE ion_type IN ('b', 'y') AND charge IN (1, 2) AND neutral_loss IS NULL GROUP BY 1, 2, 3""",
)
def fragment_scan(spark, sf):
    """Long fragments as Parquet; the three filters and seven columns reach the reader."""
    folder = run_folder(spark)
    rows = views.fragments(spark, sf).withColumn("intensity", F.col("intensity").cast("float"))
    rows.withColumn("unused", F.lit("x")).write.parquet(folder)
    kept = tables.read_fragments(spark, [folder])
    return kept.groupBy("raw_file", "ion_type", "charge").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("intensity").cast("double")), 2).alias("intensity")
    )


_SPECLIB_SQL = """ok AS (SELECT *, lossless AND fragment_charge <= 2 AND ordinal BETWEEN 1 AND 8 AS ok FROM library_lines WHERE NOT decoy)
SELECT residues, charge, round(any_value(retention)::FLOAT::DOUBLE, 4) AS retention, count(DISTINCT ion || ordinal || '^' || fragment_charge) FILTER (ok) AS fragments, count(*) FILTER (NOT ok) AS dropped
FROM ok GROUP BY 1, 2 HAVING count(*) FILTER (ok) > 0"""


@add("speclib_scan", "S4", needs=("library_lines",), sql=f"WITH {_SPECLIB_SQL}")
def speclib_scan(spark, sf):
    """A library export written as tab-separated text, detected, read and assembled."""
    folder = run_folder(spark)
    views.library_lines(spark, sf).write.option("sep", "\t").option("header", True).csv(folder)
    rows = libraries.read_speclib(spark, folder)
    records = library.library_precursors(rows).where(F.size("fragments") > 0)
    return libraries.parsed_peptides(records).select(
        "residues", "charge", F.round("retention", 4).alias("retention"), F.size("fragments").alias("fragments"),
        F.col("fragments_dropped").alias("dropped"),
    )


@add("speclib_scan_rich", "S4", needs=("library_lines",), sql=f"WITH {_SPECLIB_SQL}")
def speclib_scan_rich(spark, sf):
    """The richer export's column names; its header decides the format."""
    folder = run_folder(spark)
    rows = views.library_lines(spark, sf).withColumnsRenamed(
        {"FragmentNumber": "FragmentSeriesNumber", "RelativeIntensity": "LibraryIntensity", "Decoy": "decoy"}
    )
    rows = rows.withColumn("transition_group_id", F.lit("g")).withColumn("ExcludeFromAssay", F.lit("False"))
    rows.write.option("sep", "\t").option("header", True).csv(folder)
    parsed = libraries.read_speclib(spark, folder)
    records = library.library_precursors(parsed).where(F.size("fragments") > 0)
    return libraries.parsed_peptides(records).select(
        "residues", "charge", F.round("retention", 4).alias("retention"), F.size("fragments").alias("fragments"),
        F.col("fragments_dropped").alias("dropped"),
    )


@add(
    "library_shifts",
    "S4",
    "J9",
    needs=("library_lines",),
    sql="""SELECT spelled, accession::BIGINT AS accession FROM (VALUES ('[+15.9949]', 35, 'M'), ('[+57.0215]', -1, 'C')) v(spelled, accession, r)
WHERE EXISTS (SELECT 1 FROM library_lines WHERE NOT decoy AND contains(residues, r))""",
)
def library_shifts(spark, sf):
    """Mass shifts of a whole library resolved once each; an unexplained one is reported."""
    raw = views.library_lines(spark, sf)
    rows = libraries.library_rows(raw, line=F.xxhash64(*raw.columns))
    shifts = libraries.library_shifts(rows)
    aliases = spark.createDataFrame(
        [(0, 35, 15.994914622, None), (1, 21, 79.9663312, None)],
        "alias_order int, accession int, table_mass double, observed_mass double",
    )
    resolved = resolve_shifts(shifts, aliases)
    return shifts.join(resolved, "shift").select("spelled", F.coalesce("accession", F.lit(-1)).alias("accession"))


@add(
    "peptide_list_scan",
    "S5",
    sql="""WITH r AS (SELECT p_partkey AS line, translate(lpad(p_partkey::VARCHAR, 6, '0'), '0123456789', 'ACDEFGHIKM') AS proforma, p_size % 5 - 1 AS z, p_partkey % 6 = 0 AS blank,
  p_partkey % 4 = 0 AS decoy, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey END AS g FROM part)
SELECT line, proforma, z::BIGINT AS charge, CASE WHEN blank THEN 'P' || line || ';' ELSE 'P' || line || ';Q' END AS proteins, decoy, coalesce(g, -1) AS decoy_group,
  coalesce(CASE WHEN z < 1 THEN 'invalid charge' WHEN blank THEN 'empty protein id' WHEN decoy AND g IS NULL THEN 'a supplied decoy needs decoy_group' END, '') AS problem FROM r""",
)
def peptide_list_scan(spark, sf):
    """Parsed rows of a peptide list with the first problem of each."""
    k = F.col("p_partkey")
    raw = views.table(spark, sf, "part").select(
        k.alias("line"),
        F.concat(
            F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "ACDEFGHIKM"), F.lit("/"),
            (F.col("p_size") % 5 - 1).cast("string"),
        ).alias("proforma"),
        F.concat(F.lit("P"), k.cast("string"), F.when(k % 6 == 0, ";").otherwise(";Q")).alias("protein_ids"),
        F.when(k % 4 == 0, "true").otherwise("").alias("decoy"),
        F.when(k % 8 != 0, k.cast("string")).otherwise("").alias("decoy_group"),
    )
    rows = libraries.peptide_list_rows(raw, F.col("line"))
    return rows.select(
        "line",
        "proforma",
        "charge",
        F.array_join("proteins", ";").alias("proteins"),
        "decoy",
        F.coalesce("decoy_group", F.lit(-1)).alias("decoy_group"),
        F.coalesce("problem", F.lit("")).alias("problem"),
    )


def prepared_contract(spark, sf):
    return corpus.contract(views.prepared(spark, sf))


_PREPARED_COLUMNS = """spectrum_id::VARCHAR AS spectrum_id, dataset, raw_file, scan_number, proforma, charge, split, coalesce(irt, -1) AS irt, detector"""


def _shown(df):
    return df.select(
        "spectrum_id", "dataset", "raw_file", "scan_number", "proforma", "charge", "split",
        F.coalesce(spectra.evidence(F.col("irt")), F.lit(-1.0)).alias("irt"), "detector",
    )


@add("prepared_scan", "S6", needs=("prepared",), sql=f"SELECT {_PREPARED_COLUMNS} FROM prepared")
def prepared_scan(spark, sf):
    """Two shards read as one table under the strict contract."""
    folder = run_folder(spark)
    rows = prepared_contract(spark, sf)
    corpus.write_prepared(rows.where("detector = 'FTMS'"), f"{folder}/a")
    corpus.write_prepared(rows.where("detector <> 'FTMS'"), f"{folder}/b")
    return _shown(tables.read_prepared(spark, [f"{folder}/a", f"{folder}/b"]))


@add("prepared_parquet", "K1", needs=("prepared",), sql=f"SELECT {_PREPARED_COLUMNS} FROM prepared")
def prepared_parquet(spark, sf):
    """Written partitioned by source, read back and enforced."""
    folder = run_folder(spark)
    rows = prepared_contract(spark, sf).withColumn("source_id", F.concat(F.lit("src_"), "dataset"))
    corpus.write_prepared(rows, folder, partition_by=("source_id",))
    back = spark.read.parquet(folder).select(*PREPARED.names)
    return _shown(enforce_schema(back, PREPARED))


@add(
    "prepared_split_scan",
    "S7",
    needs=("prepared",),
    sql="""WITH ids AS (SELECT dataset, row_number() OVER (ORDER BY dataset) AS dataset_id FROM (SELECT DISTINCT dataset FROM prepared)),
w AS (SELECT spectrum_id FROM prepared WHERE split = 'val' QUALIFY row_number() OVER (PARTITION BY dataset, proforma, charge ORDER BY andromeda_score DESC NULLS LAST, spectrum_id) = 1)
SELECT p.scan_number, p.dataset, dataset_id, length(p.peptide)::BIGINT AS sequence_length FROM prepared p JOIN ids ON ids.dataset = p.dataset
WHERE split = 'val' AND spectrum_id IN (SELECT spectrum_id FROM w)""",
)
def prepared_split_scan(spark, sf):
    rows = views.prepared(spark, sf)
    ids = catalog.dataset_ids(rows.select("dataset"))
    scan = tables.split_scan(rows, ["val"], ids, winners.validation_winners(rows))
    return scan.select("scan_number", "dataset", "dataset_id", "sequence_length")


def shard_manifests(spark, sf):
    """One manifest document per supplier shard."""
    s = views.table(spark, sf, "supplier").withColumn("k", F.col("s_suppkey"))
    return s.select(
        F.lit(1).cast("bigint").alias("version"),
        F.concat(F.lit("base/shards/src"), F.col("k").cast("string"), F.lit("/data.parquet")).alias("data_uri"),
        (F.col("k") * 3 + 1).alias("rows"),
        F.concat(F.lit("shard"), F.col("k").cast("string")).alias("source_shard"),
        F.struct(
            F.col("k").alias("ordinal"),
            F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("source_id"),
            F.concat(F.lit("set"), (F.col("s_nationkey") % 6).cast("string")).alias("dataset"),
            (F.col("k") % 10).alias("shard_index"),
            F.lit("now").alias("config_fingerprint"),
            F.lit(2).cast("bigint").alias("policy_version"),
        ).alias("task"),
    )


@add(
    "shard_manifest_scan",
    "S8",
    sql="""SELECT 'set' || (s_nationkey % 6) AS dataset, count(*) AS shards, sum(s_suppkey * 3 + 1)::BIGINT AS rows, 'now' AS fingerprint, 0::BIGINT AS curated FROM supplier GROUP BY 1""",
)
def shard_manifest_scan(spark, sf):
    """Manifest documents below a prefix, read with their schema and no inference."""
    folder = run_folder(spark)
    shard_manifests(spark, sf).withColumn("part", F.col("task.shard_index")).write.partitionBy("part").json(f"{folder}/shards")
    manifests = tables.read_shard_manifests(spark, folder, pattern="*.json", multi_line=False)
    return manifests.groupBy("task.dataset").agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("rows").alias("rows"),
        F.max("task.config_fingerprint").alias("fingerprint"),
        F.count("curation").alias("curated"),
    )


def corpus_log(spark, sf):
    """The manifest log of a corpus that came in two parts, with a third whose writer died before its header."""
    log = ManifestLog(spark, f"{run_folder(spark)}/manifest")
    chunks = shard_manifests(spark, sf).select(
        F.col("data_uri").alias("uri"), F.col("task.dataset").alias("dataset"), "rows", "source_shard"
    )
    prepared = views.prepared(spark, sf)
    early, first = F.col("rows") % 2 == 1, F.col("scan_number") % 2 == 0
    source = {"config_fingerprint": "now", "policy_version": 2}
    for number, (part, rows) in enumerate(((early, first), (~early, ~first))):
        log.append(chunks.where(part), catalog.corpus_facts(prepared.where(rows)), "base/validation/winners", source, f"part {number}")
    chunks.limit(1).withColumn("uri", F.lit("torn")).write.json(f"{log.folder}/chunks/00000000000000000003-torn")
    return log


@add(
    "corpus_manifest_load",
    "S9",
    sql="SELECT 'base/shards/src' || s_suppkey || '/data.parquet' AS uri, 'set' || (s_nationkey % 6) AS dataset, s_suppkey * 3 + 1 AS rows, 'shard' || s_suppkey AS source_shard FROM supplier",
)
def corpus_manifest_load(spark, sf):
    """The newest complete version of a corpus manifest: its chunks, without those of a half-written version."""
    return corpus_log(spark, sf).chunks()


@add(
    "corpus_manifest_table",
    "K2",
    needs=("prepared",),
    sql="""SELECT 'datasets' AS part, dataset AS key, row_number() OVER (ORDER BY dataset)::VARCHAR AS value FROM (SELECT DISTINCT 'set' || (s_nationkey % 6) AS dataset FROM supplier)
UNION ALL SELECT 'split_rows', split, count(*)::VARCHAR FROM prepared GROUP BY 2
UNION ALL SELECT 'split_datasets', dataset, string_agg(split, ',' ORDER BY split) FROM (SELECT DISTINCT dataset, split FROM prepared) GROUP BY 2
UNION ALL SELECT 'irt_stats', 'n', count(irt)::VARCHAR FROM prepared WHERE split = 'train'
UNION ALL SELECT 'source', 'shards', count(*)::VARCHAR FROM supplier""",
)
def corpus_manifest_table(spark, sf):
    """The header of the newest version as a table: what two parts of a corpus add up to."""
    m = corpus_log(spark, sf).newest()
    parts = {
        "datasets": {k: str(v) for k, v in m.datasets.items()},
        "split_rows": m.split_rows,
        "split_datasets": {k: ",".join(v) for k, v in m.split_datasets.items() if v},
        "irt_stats": {"n": int(m.irt_stats[0])},
        "source": {"shards": m.chunks},
    }
    rows = [(part, key, str(value)) for part, entries in parts.items() for key, value in entries.items()]
    return spark.createDataFrame(rows, "part string, key string, value string")


@add(
    "raw_file_discovery",
    "S10",
    needs=("fragments",),
    sql="SELECT DISTINCT raw_file FROM fragments",
)
def raw_file_discovery(spark, sf):
    return tables.raw_files(views.fragments(spark, sf))


@add(
    "task_catalog",
    "S11",
    sql="""WITH a AS (SELECT DISTINCT replace(p_name, ' ', '_') || '_' || (p_size % 7) AS archive FROM part),
s AS (SELECT 'rec_' || archive AS source_id, 'rec_' || lower(regexp_replace(CASE WHEN archive LIKE 'red\\_%' ESCAPE '\\' THEN substr(archive, 5) ELSE archive END, '_[1-9][0-9]*$', '')) AS dataset,
  regexp_replace(archive, '_[1-9][0-9]*$', '') || '_meta_data.parquet' AS meta, archive FROM a
  WHERE (archive LIKE 'red%' OR archive LIKE '%widget%') AND NOT regexp_matches(archive, '[34]$'))
SELECT source_id, dataset, meta, shard_index, shard_name, row_number() OVER (ORDER BY source_id, shard_index) - 1 AS ordinal FROM s JOIN (
  SELECT replace(p_name, ' ', '_') || '_' || (p_size % 7) AS archive, p_partkey AS shard_index, p_brand || '.parquet' AS shard_name FROM part) p ON p.archive = s.archive""".replace(
        "\\\\", "\\"
    ),
)
def task_catalog(spark, sf):
    """Archives selected by globs and expanded to numbered shard tasks."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (F.col("p_size") % 7).cast("string"))
    part = views.table(spark, sf, "part").withColumn("archive", name)
    sources = catalog.expand_sources(
        part.select("archive").distinct(), "rec", ["red*", "*widget*"], ["*[34]"], strip_prefix="red_"
    )
    shards = part.select(
        "archive", F.col("p_partkey").alias("shard_index"), F.concat("p_brand", F.lit(".parquet")).alias("shard_name")
    )
    return catalog.expand_tasks(sources, shards).select(
        "source_id", "dataset", "meta", "shard_index", "shard_name", "ordinal"
    )


@add(
    "reference_panel_scan",
    "S12",
    needs=("precursors", "cells"),
    sql="""SELECT spectrum_id, length(peptide)::BIGINT AS length, cell AS peak, CASE WHEN cell // 16 % 2 = 0 THEN cell % 16 ELSE 15 - cell % 16 END::BIGINT AS site,
  (cell // 16)::BIGINT AS col, round(signed, 6) AS intensity FROM precursors JOIN (SELECT spectrum_id AS sid, cell, signed FROM cells) ON sid = spectrum_id""",
)
def reference_panel_scan(spark, sf):
    """A panel of semicolon lists: sixteen b and y annotations at either charge, the whole vector."""
    names = ";".join(f"{ion}{i}{charge}" for charge in ("", "^2") for ion in "by" for i in range(1, 17))
    values = F.array_join(F.transform("embedding", lambda x: sink.fixed(x, 12)), ";")
    raw = views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("spectrum_id"),
        views.hashed_peptide(F.col("vec_id")).alias("proforma"),
        F.lit(names).alias("annotations"),
        values.alias("relative_intensity"),
    )
    cells = libraries.panel_cells(raw, ["spectrum_id"])
    return cells.select("spectrum_id", "length", "peak", "site", "col", "intensity")


@add("validation_winners_file", "K5", needs=("prepared",), sql="""SELECT spectrum_id::VARCHAR AS spectrum_id FROM prepared WHERE split = 'val'
  QUALIFY row_number() OVER (PARTITION BY dataset, proforma, charge ORDER BY andromeda_score DESC NULLS LAST, spectrum_id) = 1""")
def validation_winners_file(spark, sf):
    folder = run_folder(spark)
    best = winners.validation_winners(views.prepared(spark, sf))
    corpus.write_winners(best.withColumn("spectrum_id", unsigned(F.col("spectrum_id"))), folder)
    return spark.read.parquet(folder)


def settings_documents(spark, sf):
    """One nested settings document per nation."""
    n = views.table(spark, sf, "nation")
    document = F.struct(
        F.struct(F.col("n_name").alias("tool"), F.lit("0.1").alias("version")).alias("generator"),
        F.struct(
            F.struct(F.lit("fasta").alias("kind"), F.md5("n_name").alias("blake2b_256")).alias("sequence"),
            F.array(F.lit("C[UNIMOD:4]"), F.lit("M[UNIMOD:35]")).alias("fixed_mods"),
            F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("max_fragments"),
            (F.col("n_nationkey") % 3 == 0).alias("decoys"),
        ).alias("digest"),
    )
    return n.select("n_nationkey", F.to_json(document, {"ignoreNullFields": "false"}).alias("settings"))


@add(
    "provenance_pairs",
    "K10",
    sql="""SELECT n_nationkey::BIGINT AS n_nationkey, 'generator.tool' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'generator.version', '0.1' FROM nation
UNION ALL SELECT n_nationkey, 'digest.sequence.kind', 'fasta' FROM nation UNION ALL SELECT n_nationkey, 'digest.sequence.blake2b_256', md5(n_name) FROM nation
UNION ALL SELECT n_nationkey, 'digest.fixed_mods', '["C[UNIMOD:4]","M[UNIMOD:35]"]' FROM nation
UNION ALL SELECT n_nationkey, 'digest.max_fragments', n_regionkey::VARCHAR FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 'digest.decoys', CASE WHEN n_nationkey % 3 = 0 THEN 'true' ELSE 'false' END FROM nation""",
)
def provenance_pairs(spark, sf):
    return catalog.flatten_document(settings_documents(spark, sf), ["n_nationkey"], "settings")


@add(
    "provenance_sidecar",
    "K10",
    sql="""SELECT 'output.counts.precursors' AS key, count(*)::VARCHAR AS value FROM embeddings UNION ALL SELECT 'settings.label', max(label)::VARCHAR FROM embeddings""",
)
def provenance_sidecar(spark, sf):
    """A sidecar document with the build's counts, flattened again."""
    e = views.table(spark, sf, "embeddings")
    document = e.agg(F.to_json(F.struct(F.max("label").alias("label"))).alias("settings"))
    counts = e.agg(F.count(F.lit(1)).alias("precursors"))
    sidecar = corpus.provenance_sidecar(document, counts)
    return catalog.flatten_document(sidecar, [], "value")


@add(
    "metadata_key_checks",
    "S2",
    "A23",
    needs=("candidates",),
    sql="""SELECT count(*) FILTER (raw_file IS NULL) AS null_raw_file, count(*) FILTER (scan_number IS NULL) AS null_scan_number,
  count(*) FILTER (modified_sequence IS NULL) AS null_modified_sequence, count(*) FILTER (precursor_charge IS NULL) AS null_precursor_charge FROM candidates""",
)
def metadata_key_checks(spark, sf):
    meta = tables.select_metadata(views.candidates(spark, sf))
    return resolve.key_null_counts(meta, ["raw_file", "scan_number", "modified_sequence", "precursor_charge"])


