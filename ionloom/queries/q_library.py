"""Library, writer, label and predictor queries."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from ionloom.constants import HYDROPATHY
from ionloom.functions import chemistry, sequence, spectra
from ionloom.operators import labeler, library, modforms
from ionloom.operators.catalog import check_settings
from ionloom.operators.digest import DigestRules
from ionloom.plans import evaluate as evaluation
from ionloom.plans import library as plan
from ionloom.queries import views
from ionloom.operators.decoys import no_sites
from ionloom.operators.ordering import with_position
from ionloom.queries.base import Book, run_folder
from ionloom.queries.q_joins import DECOY_SEARCH_SQL
from ionloom.queries.q_projections import _GRID_SQL, SQL_PROTON
from ionloom.queries.views import SQL_WATER, sql_mass
from ionloom.session import materialise
from ionloom.sinks import libraries as sink
from ionloom.sinks import library_writer as writer
from ionloom.sources import libraries

BOOK = Book()
add = BOOK.add


def spectrum_rows(spark, sf):
    """Validated rows with all their peaks, as the writers take them."""
    sid = F.col("spectrum_id")
    rows = library.spectrum_rows(
        views.precursors(spark, sf).withColumn("masses", chemistry.residue_masses(F.col("peptide"))), 0.0, None
    )
    return library.require_valid_rows(rows).select(
        "*",
        F.col("peptide").alias("proforma"),
        (sid % 4 == 0).alias("decoy"),
        F.when(sid % 2 == 0, sid).alias("decoy_group"),
        F.when(sid % 3 == 0, F.col("rt") * 2).alias("irt"),
        F.when(sid % 5 == 0, F.array(F.lit("P1"), F.lit("P2"))).otherwise(F.array(F.lit("P1"))).alias("proteins"),
    )


_ROWS_SQL = f"""{_GRID_SQL},
kept AS (SELECT * FROM peaks),
heads AS (SELECT *, {sql_mass('peptide')} + {SQL_WATER} AS neutral, ({sql_mass('peptide')} + {SQL_WATER} + charge * {SQL_PROTON}) / charge AS pmz FROM precursors),
rows AS (SELECT *, ccs * sqrt(pmz * charge * 28.0 / (pmz * charge + 28.0)) / charge / 1059.62245 AS mobility,
  CASE WHEN spectrum_id % 5 = 0 THEN 'P1;P2' ELSE 'P1' END AS proteins FROM heads)"""


@add(
    "diann_rows",
    "K3",
    needs=("precursors", "spectra"),
    sql=f"""WITH {_ROWS_SQL} SELECT r.peptide AS "ModifiedPeptide", r.peptide AS "StrippedPeptide", printf('%.8f', pmz) AS "PrecursorMz", r.charge::VARCHAR AS "PrecursorCharge",
  printf('%.6f', rt) AS "Tr_recalibrated", printf('%.8f', mobility) AS "IonMobility", proteins AS "ProteinID", CASE WHEN r.spectrum_id % 4 = 0 THEN '1' ELSE '0' END AS "Decoy",
  printf('%.8f', mz) AS "FragmentMz", ion AS "FragmentType", ordinal::VARCHAR AS "FragmentNumber", k.charge::VARCHAR AS "FragmentCharge", 'noloss' AS "FragmentLossType",
  printf('%.8f', intensity) AS "RelativeIntensity" FROM rows r JOIN kept k ON k.spectrum_id = r.spectrum_id""",
)
def diann_rows(spark, sf):
    return sink.diann_rows(spectrum_rows(spark, sf))


@add(
    "speclib_entries",
    "K4",
    needs=("precursors", "spectra"),
    sql=f"""WITH {_ROWS_SQL}, p AS (SELECT spectrum_id, count(*) AS n, string_agg(printf('%.6f', mz) || chr(9) || printf('%.6f', intensity) || chr(9) ||
  ion || ordinal || CASE WHEN charge = 2 THEN '^2' ELSE '' END, chr(10) ORDER BY mz, cell) AS lines FROM kept GROUP BY 1)
SELECT row_number() OVER (ORDER BY r.spectrum_id) AS "index", '<Spectrum=' || row_number() OVER (ORDER BY r.spectrum_id) || '>' || chr(10) || concat_ws(chr(10),
  'MS:1003061|library spectrum name=' || peptide || '/' || charge,
  CASE WHEN r.spectrum_id % 4 = 0 THEN 'MS:1003212|library attribute set name=Decoy' END,
  CASE WHEN r.spectrum_id % 2 = 0 THEN '[3]MS:1003275|other attribute name=ionloom:decoy_group' || chr(10) || '[3]MS:1003276|other attribute value=' || r.spectrum_id END,
  'MS:1000041|charge state=' || charge, 'MS:1000744|selected ion m/z=' || printf('%.8f', pmz),
  CASE WHEN r.spectrum_id % 3 = 0 THEN '[1]MS:1000894|retention time=' || printf('%.6f', rt) || chr(10) || '[1]UO:0000000|unit=UO:0000031|minute' || chr(10) ||
    '[2]MS:1000896|normalized retention time=' || printf('%.6f', rt * 2) || chr(10) || '[2]UO:0000000|unit=UO:0000031|minute'
  ELSE '[1]MS:1000896|normalized retention time=' || printf('%.6f', rt) || chr(10) || '[1]UO:0000000|unit=UO:0000031|minute' END,
  'MS:1002815|inverse reduced ion mobility=' || printf('%.8f', mobility), 'MS:1003059|number of peaks=' || n, '<Analyte=1>',
  'MS:1003270|proforma peptidoform ion notation=' || peptide || '/' || charge, 'MS:1000888|stripped peptide sequence=' || peptide,
  'MS:1003043|number of residues=17', 'MS:1003637|theoretical neutral monoisotopic mass=' || printf('%.8f', neutral),
  'MS:1000885|protein accession=P1', CASE WHEN r.spectrum_id % 5 = 0 THEN 'MS:1000885|protein accession=P2' END, '<Peaks>', lines) || chr(10) AS entry
FROM rows r JOIN p ON p.spectrum_id = r.spectrum_id""",
)
def speclib_entries(spark, sf):
    """One text entry per precursor, numbered in identifier order."""
    return sink.speclib_entries(spectrum_rows(spark, sf), [F.col("spectrum_id").asc()])


@add(
    "library_counts",
    "A16",
    needs=("precursors", "spectra"),
    sql=f"""WITH {_GRID_SQL} SELECT count(*) AS precursors, count(*) FILTER (spectrum_id % 4 = 0) AS decoys, count(DISTINCT peptide) FILTER (spectrum_id % 4 <> 0) AS peptides,
  (SELECT count(*) FROM peaks) AS fragments FROM precursors""",
)
def library_counts(spark, sf):
    return library.library_counts(spectrum_rows(spark, sf))


def split_precursors(spark, sf):
    """Modified peptides at three charges with a split."""
    rows = views.modified(spark, sf).select(
        "peptide", sequence.proforma_sites(F.col("proforma")).alias("sites"), F.lit("train").alias("split")
    )
    return modforms.expand_charges(rows, 2, 4)


_MODS_SQL = """letters AS (SELECT peptide, unnest(string_split(peptide, '')) AS r, generate_subscripts(string_split(peptide, ''), 1) - 1 AS i FROM cleaved),
mods AS (SELECT peptide, string_agg(i || ':' || CASE r WHEN 'M' THEN 'UNIMOD:35' ELSE 'UNIMOD:4' END, ';' ORDER BY i) AS inner_mods FROM letters WHERE r IN ('M', 'C') GROUP BY 1)"""

_MOD_MASS_SQL = f"""({sql_mass('m.peptide')} + {SQL_WATER} + (length(m.peptide) - length(replace(m.peptide, 'M', ''))) * 15.994914622::DOUBLE
  + (length(m.peptide) - length(replace(m.peptide, 'C', ''))) * 57.021463723::DOUBLE + CASE WHEN m.peptide LIKE 'A%' THEN 42.0105647::DOUBLE ELSE 0 END)"""


@add(
    "precursor_table",
    "K7",
    needs=("modified",),
    sql=f"""WITH {_MODS_SQL} SELECT m.peptide AS sequence, concat_ws(';', CASE WHEN m.peptide LIKE 'A%' THEN 'n:UNIMOD:1' END, inner_mods) AS mods, proforma AS modified_sequence,
  length(m.peptide)::BIGINT AS length, z::BIGINT AS charge, round(({_MOD_MASS_SQL} + z * {SQL_PROTON}) / z, 6) AS precursor_mz, 'train' AS split
FROM modified m LEFT JOIN mods ON mods.peptide = m.peptide CROSS JOIN range(2, 5) r(z)""",
)
def precursor_table(spark, sf):
    return modforms.precursor_table(split_precursors(spark, sf), plan.DEFAULT_DELTAS)


@add(
    "precursor_roundtrip",
    "K7",
    needs=("modified",),
    sql="SELECT proforma, z::BIGINT AS charge FROM modified CROSS JOIN range(2, 5) r(z)",
)
def precursor_roundtrip(spark, sf):
    """The flat table read back renders to the peptidoforms it came from."""
    back = modforms.precursors_from_table(precursor_table_raw(spark, sf))
    return back.select(sequence.render_proforma(F.col("peptide"), F.col("sites")).alias("proforma"), "charge")


def precursor_table_raw(spark, sf):
    return modforms.precursor_table(split_precursors(spark, sf), plan.DEFAULT_DELTAS)


_HYDRO_SQL = " + ".join(
    f"(length(peptide) - length(replace(peptide, '{r}', ''))) * ({v!r}::DOUBLE)" for r, v in sorted(HYDROPATHY.items())
)
_WAVE_SQL = f"""sites AS (SELECT peptide, unnest(range(0, length(peptide) - 1)) AS site FROM cleaved),
masses AS (SELECT peptide, site, {sql_mass('substr(peptide, 1, site + 1)')} AS b, {sql_mass('substr(peptide, site + 2)')} AS y FROM sites),
waves AS (SELECT peptide, site, 0.5 * (1 + sin(b / 37.0 + 2)) AS b1, 0.5 * (1 + sin(y / 37.0 + 2)) AS y1, 0.5 * (1 + sin(b / 74.0 + 2)) AS b2, 0.5 * (1 + sin(y / 74.0 + 2)) AS y2 FROM masses),
tops AS (SELECT peptide, max(greatest(b1, y1, b2, y2)) AS top FROM waves GROUP BY 1)"""


def smooth(spark, sf):
    """Built-in labels as columns for every cleaved peptide at charge 2."""
    p, charge = F.col("peptide"), F.lit(2)
    labels = labeler.smooth_labels(p, chemistry.residue_masses(p), F.col("neutral"), charge)
    peptides = views.cleaved(spark, sf).withColumn("neutral", chemistry.mono_mass(p))
    return peptides.select("peptide", labels.alias("l")).select("peptide", "l.*")


@add(
    "smooth_labels",
    "F2",
    needs=("cleaved",),
    sql=f"""WITH {_WAVE_SQL}, t AS (SELECT w.peptide, sum(b1 + y1 + b2 + y2) / max(top) AS total FROM waves w JOIN tops ON tops.peptide = w.peptide GROUP BY 1)
SELECT peptide, round(total, 6) AS total, round({_HYDRO_SQL} + 0.02::DOUBLE * ({sql_mass('peptide')} + {SQL_WATER}), 6) AS rt,
  round(0.9::DOUBLE * ({sql_mass('peptide')} + {SQL_WATER}) / 2 + 60, 6) AS ccs FROM t""",
)
def smooth_labels(spark, sf):
    return smooth(spark, sf).select("peptide", spectra.total(F.col("ms2")).alias("total"), "rt", "ccs")


@add(
    "batch_labels",
    "F1",
    needs=("cleaved",),
    sql=f"""WITH {_WAVE_SQL}, t AS (SELECT w.peptide, sum((b1 / top)::FLOAT::DOUBLE + (y1 / top)::FLOAT::DOUBLE + (b2 / top)::FLOAT::DOUBLE + (y2 / top)::FLOAT::DOUBLE) AS total
  FROM waves w JOIN tops ON tops.peptide = w.peptide GROUP BY 1)
SELECT peptide, round(total, 5) AS total, round({_HYDRO_SQL} + 0.02::DOUBLE * ({sql_mass('peptide')} + {SQL_WATER}), 6) AS rt,
  round(0.9::DOUBLE * ({sql_mass('peptide')} + {SQL_WATER}) / 2 + 60, 6) AS ccs FROM t""",
)
def batch_labels(spark, sf):
    """The same labels from a batch predictor behind the user contract."""
    rows = views.cleaved(spark, sf).select(
        "peptide",
        F.lit(2).alias("charge"),
        chemistry.mono_mass(F.col("peptide")).alias("neutral_mass"),
        chemistry.hydropathy_sum(F.col("peptide")).alias("rt_index"),
    )
    labelled = labeler.label_batches(rows, labeler.smooth_predictor, ["peptide", "charge"])
    return labelled.select("peptide", F.round(spectra.total(F.col("ms2")), 5).alias("total"), "rt", "ccs")


@add(
    "label_tables",
    "K8",
    needs=("cleaved",),
    sql=f"""WITH {_WAVE_SQL} SELECT w.peptide, site AS position, round(b1 / top, 6) AS b_z1, round(y1 / top, 6) AS y_z1, round(b2 / top, 6) AS b_z2, round(y2 / top, 6) AS y_z2
FROM waves w JOIN tops ON tops.peptide = w.peptide""",
)
def label_tables(spark, sf):
    return labeler.labels_tables(smooth(spark, sf), "peptide")[1]


@add(
    "label_roundtrip",
    "K8",
    needs=("cleaved",),
    sql=f"""WITH {_WAVE_SQL} SELECT w.peptide, string_agg(printf('%.4f', b1 / top) || ';' || printf('%.4f', y1 / top) || ';' || printf('%.4f', b2 / top) || ';' || printf('%.4f', y2 / top), ';' ORDER BY site) AS ms2
FROM waves w JOIN tops ON tops.peptide = w.peptide GROUP BY 1""",
)
def label_roundtrip(spark, sf):
    """Both label tables put together again give every grid back."""
    from ionloom.queries.base import joined

    heads, cells = labeler.labels_tables(smooth(spark, sf), "peptide")
    back = labeler.labels_from_tables(heads, cells, "peptide")
    return back.select("peptide", joined("ms2", 4).alias("ms2"))


_REVERSED = "substr(peptide, 1, 1) || reverse(substr(peptide, 2, length(peptide) - 2)) || substr(peptide, length(peptide))"


@add(
    "charged_forms",
    "P11",
    "G4",
    "J7",
    needs=("memberships",),
    sql=f"""WITH targets AS (SELECT DISTINCT peptide FROM memberships),
rows AS (SELECT peptide, false AS decoy FROM targets UNION ALL SELECT d, true FROM (SELECT {_REVERSED} AS d FROM targets) WHERE d NOT IN (SELECT peptide FROM targets))
SELECT replace(peptide, 'C', 'C[UNIMOD:4]') AS proforma, decoy, z::BIGINT AS charge, round(({sql_mass('peptide')} + {SQL_WATER} +
  (length(peptide) - length(replace(peptide, 'C', ''))) * 57.021463723::DOUBLE + z * {SQL_PROTON}) / z, 6) AS mz FROM rows CROSS JOIN range(2, 4) r(z)""",
)
def charged_forms(spark, sf):
    """Target and decoy precursors of the whole proteome with their m/z."""
    options = plan.LibraryOptions(rules=DigestRules(min_charge=2, max_charge=3))
    targets = materialise(views.memberships(spark, sf).select("peptide").distinct())
    rows = plan.precursor_frame(targets, options)
    return rows.select(
        "proforma", "decoy", "charge", chemistry.charged_mz(F.col("neutral_mass"), F.col("charge")).alias("mz")
    )


_LIBRARY_SQL = f"""targets AS (SELECT DISTINCT peptide FROM memberships),
forms AS (SELECT peptide, false AS decoy FROM targets UNION ALL SELECT d, true FROM (SELECT {_REVERSED} AS d FROM targets) WHERE d NOT IN (SELECT peptide FROM targets)),
sites AS (SELECT peptide, decoy, unnest(range(0, length(peptide) - 1)) AS site FROM forms),
masses AS (SELECT peptide, decoy, {sql_mass("replace(substr(peptide, 1, site + 1), 'C', 'CG')")} AS b, {sql_mass("replace(substr(peptide, site + 2), 'C', 'CG')")} AS y FROM sites),
cells AS (SELECT peptide, decoy, z, unnest([0.5 * (1 + sin(b / 37.0 + z)), 0.5 * (1 + sin(y / 37.0 + z)), 0.5 * (1 + sin(b / 74.0 + z)), 0.5 * (1 + sin(y / 74.0 + z))])::FLOAT AS v
  FROM masses CROSS JOIN range(2, 4) r(z)),
tops AS (SELECT *, max(v) OVER (PARTITION BY peptide, decoy, z) AS top FROM cells)"""


@add(
    "library_build",
    "P18",
    "P19",
    "W8",
    "F1",
    "T4",
    needs=("memberships",),
    sql=f"""WITH {_LIBRARY_SQL}, n AS (SELECT peptide, decoy, z, count(*) FILTER (v / top >= 0.01) AS kept FROM tops GROUP BY 1, 2, 3)
SELECT z::BIGINT AS charge, decoy, count(*) AS precursors, sum(kept)::BIGINT AS fragments FROM n GROUP BY 1, 2""",
)
def library_build(spark, sf):
    """A whole library: digest, groups, forms, decoys, labels, validation, every peak above the floor."""
    return _library_totals(spark, sf, None)


def _library_totals(spark, sf, max_fragments):
    options = plan.LibraryOptions(rules=DigestRules(min_charge=2, max_charge=3), max_fragments=max_fragments)
    rows = plan.build_library(views.proteome(spark, sf), options)
    return rows.groupBy("charge", "decoy").agg(
        F.count(F.lit(1)).alias("precursors"), F.sum("n_peaks").alias("fragments")
    )


@add(
    "library_build_capped",
    "W8",
    needs=("memberships",),
    sql=f"""WITH {_LIBRARY_SQL}, n AS (SELECT peptide, decoy, z, least(count(*) FILTER (v / top >= 0.01), 15) AS kept FROM tops GROUP BY 1, 2, 3)
SELECT z::BIGINT AS charge, decoy, count(*) AS precursors, sum(kept)::BIGINT AS fragments FROM n GROUP BY 1, 2""",
)
def library_build_capped(spark, sf):
    """The same library with at most fifteen peaks a spectrum, the strongest."""
    return _library_totals(spark, sf, 15)


_SCORED_SQL = f"""cells AS (SELECT residues, charge, CASE ion WHEN 'b' THEN ordinal - 1 ELSE 8 - ordinal END AS site,
  CASE ion WHEN 'b' THEN 0 ELSE 1 END + 2 * (fragment_charge - 1) AS col, max(intensity::FLOAT::DOUBLE) AS v FROM library_lines
  WHERE NOT decoy AND lossless AND fragment_charge <= 2 AND ordinal BETWEEN 1 AND 8 GROUP BY 1, 2, 3, 4),
heads AS (SELECT DISTINCT residues, charge FROM cells),
marked AS (SELECT *, replace(replace(residues, 'C', 'CG'), 'M', 'Mo') AS full_text FROM heads),
sites AS (SELECT residues, charge, unnest(range(0, 8)) AS site FROM marked),
masses AS (SELECT residues, charge, site, {sql_mass('substr(residues, 1, site + 1)')}
  + (length(substr(residues, 1, site + 1)) - length(replace(substr(residues, 1, site + 1), 'M', ''))) * 15.994914622::DOUBLE
  + (length(substr(residues, 1, site + 1)) - length(replace(substr(residues, 1, site + 1), 'C', ''))) * 57.021463723::DOUBLE AS b,
  {sql_mass('substr(residues, site + 2)')} + (length(substr(residues, site + 2)) - length(replace(substr(residues, site + 2), 'M', ''))) * 15.994914622::DOUBLE
  + (length(substr(residues, site + 2)) - length(replace(substr(residues, site + 2), 'C', ''))) * 57.021463723::DOUBLE AS y FROM sites),
waves AS (SELECT residues, charge, site, col, 0.5 * (1 + sin(CASE col % 2 WHEN 0 THEN b ELSE y END / (37.0 * (1 + col // 2)) + charge)) AS p FROM masses CROSS JOIN range(0, 4) r(col)),
scored AS (SELECT w.residues, w.charge, 1 - 2 * acos(greatest(least(sum(p * coalesce(v, 0)) / (sqrt(sum(p * p)) * sqrt(sum(coalesce(v, 0) * coalesce(v, 0)))), 1), -1)) / pi() AS angle
  FROM waves w LEFT JOIN cells c ON c.residues = w.residues AND c.charge = w.charge AND c.site = w.site AND c.col = w.col GROUP BY 1, 2)"""


_FILE_RULES = DigestRules(missed_cleavages=0, min_length=7, max_length=8, min_charge=2, max_charge=3)

_FILE_SQL = f"""names AS (SELECT piece AS peptide, string_agg(DISTINCT protein_id, ';' ORDER BY protein_id) AS proteins,
  string_agg(DISTINCT 'DECOY_' || protein_id, ';' ORDER BY 'DECOY_' || protein_id) AS decoy_proteins FROM numbered WHERE length(piece) BETWEEN 7 AND 8 GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY replace(peptide, 'C', 'C[UNIMOD:4]')) - 1 AS place FROM names),
forms AS (SELECT peptide AS source, peptide, false AS decoy, proteins, place FROM placed
  UNION ALL SELECT peptide, d, true, decoy_proteins, place FROM (SELECT *, {_REVERSED} AS d FROM placed) LEFT JOIN (SELECT peptide AS taken FROM names) ON taken = d WHERE taken IS NULL),
sites AS (SELECT source, peptide, decoy, unnest(range(0, length(peptide) - 1)) AS site FROM forms),
masses AS (SELECT source, peptide, decoy, site, {sql_mass("replace(substr(peptide, 1, site + 1), 'C', 'CG')")} AS b, {sql_mass("replace(substr(peptide, site + 2), 'C', 'CG')")} AS y FROM sites),
cells AS (SELECT source, decoy, z, site, unnest([0, 1, 2, 3]) AS col, unnest([0.5 * (1 + sin(b / 37.0 + z)), 0.5 * (1 + sin(y / 37.0 + z)), 0.5 * (1 + sin(b / 74.0 + z)), 0.5 * (1 + sin(y / 74.0 + z))])::FLOAT AS v
  FROM masses CROSS JOIN range(2, 4) r(z)),
tops AS (SELECT *, max(v) OVER (PARTITION BY source, decoy, z) AS top FROM cells),
kept AS (SELECT source, decoy, z, count(*) AS peaks FROM tops WHERE v / top >= 0.01 GROUP BY 1, 2, 3),
written AS (SELECT f.peptide, f.decoy, f.proteins, k.z, k.peaks, place * 2 + 1 + k.z - 2 AS grp FROM forms f JOIN kept k ON k.source = f.source AND k.decoy = f.decoy)"""


#: The operator's own digest; fewer charges only.
_WHOLE_RULES = DigestRules(min_charge=2, max_charge=3)


def _file_rows(spark, sf, rules=_FILE_RULES):
    return plan.complete_library(views.proteome(spark, sf), plan.LibraryOptions(rules=rules))


def _file_lines(spark, rows):
    folder = f"{run_folder(spark)}/library"
    sink.write_diann(rows, folder)
    return _lines_per_precursor(spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(folder))


def _lines_per_precursor(lines):
    return lines.groupBy(
        F.col("ModifiedPeptide").alias("peptide"), F.col("PrecursorCharge").alias("charge"), F.col("Decoy").alias("decoy"), F.col("ProteinID").alias("proteins")
    ).agg(F.count(F.lit(1)).alias("lines"))


@add(
    "library_file",
    "K3",
    "A3",
    "W9",
    "J7",
    needs=("numbered",),
    sql=f"""WITH {_FILE_SQL} SELECT replace(peptide, 'C', 'C(UniMod:4)') AS peptide, z::VARCHAR AS charge, CASE WHEN decoy THEN '1' ELSE '0' END AS decoy, proteins, peaks AS lines FROM written""",
)
def library_file(spark, sf):
    """Fully cleaved peptides of 7 and 8 residues to tab-separated library files, and lines per precursor read back: the slice SQL states."""
    return _file_lines(spark, _file_rows(spark, sf))


#: Every precursor of the whole proteome as the files hold it: group, names, peaks.
_WHOLE_SQL = f"""names AS (SELECT peptide, string_agg(protein_id, ';' ORDER BY protein_id) AS proteins, string_agg('DECOY_' || protein_id, ';' ORDER BY protein_id) AS decoy_proteins
  FROM (SELECT DISTINCT peptide, protein_id FROM memberships) GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY replace(peptide, 'C', 'C[UNIMOD:4]')) - 1 AS place FROM names),
{_LIBRARY_SQL},
kept AS (SELECT peptide, decoy, z, count(*) FILTER (v / top >= 0.01) AS peaks FROM tops GROUP BY 1, 2, 3),
sources AS (SELECT peptide AS shown, false AS decoy, proteins, place FROM placed UNION ALL SELECT {_REVERSED}, true, decoy_proteins, place FROM placed),
written AS (SELECT k.peptide, k.decoy, k.z, k.peaks, s.proteins, s.place * 2 + 1 + k.z - 2 AS grp FROM kept k JOIN sources s ON s.shown = k.peptide AND s.decoy = k.decoy)"""


def _write_whole(spark, sf, form):
    folder = f"{run_folder(spark)}/library"
    plan.write_library(views.proteome(spark, sf), folder, plan.LibraryOptions(rules=_WHOLE_RULES), form)
    return folder


@add(
    "library_file_whole",
    "K3",
    "A3",
    "W9",
    "J7",
    "F4",
    needs=("memberships",),
    sql=f"""WITH {_WHOLE_SQL} SELECT replace(peptide, 'C', 'C(UniMod:4)') AS peptide, z::VARCHAR AS charge, CASE WHEN decoy THEN '1' ELSE '0' END AS decoy, proteins, peaks AS lines FROM written""",
)
def library_file_whole(spark, sf):
    """The whole proteome (two missed cleavages, 7 to 30 residues) through the library data source, and lines per precursor read back."""
    return _lines_per_precursor(writer.read_diann_lines(spark, _write_whole(spark, sf, "diann")))


@add(
    "library_text",
    "K4",
    "W9",
    needs=("numbered",),
    sql=f"""WITH {_FILE_SQL} SELECT replace(peptide, 'C', 'C[UNIMOD:4]') || '/' || z AS ion, CASE WHEN decoy THEN 1 ELSE 0 END::BIGINT AS decoys, grp AS decoy_group, proteins, peaks FROM written""",
)
def library_text(spark, sf):
    """Fully cleaved peptides of 7 and 8 residues to library text, header beside it, and what is read back from its entries."""
    return _text_entries(spark, _file_rows(spark, sf))


@add(
    "library_text_whole",
    "K4",
    "W9",
    "F4",
    needs=("memberships",),
    sql=f"""WITH {_WHOLE_SQL} SELECT replace(peptide, 'C', 'C[UNIMOD:4]') || '/' || z AS ion, CASE WHEN decoy THEN 1 ELSE 0 END::BIGINT AS decoys, grp AS decoy_group, proteins, peaks FROM written""",
)
def library_text_whole(spark, sf):
    """The whole proteome as library text through the data source, and what is read back from its entries."""
    return _entry_facts(writer.read_entries(spark, _write_whole(spark, sf, "text")))


_SETTINGS_RULES = DigestRules(missed_cleavages=0, min_charge=2, max_charge=2)


@add(
    "library_settings_check",
    "J11",
    "K10",
    "K4",
    needs=("cleaved",),
    sql="""WITH asked(case_name, verdict, differences) AS (VALUES ('same', 'same', 0), ('more cleavages', 'different', 1), ('other charges and floor', 'different', 2))
SELECT case_name, verdict, differences::BIGINT AS differences FROM asked WHERE EXISTS (SELECT 1 FROM cleaved)""",
)
def library_settings_check(spark, sf):
    """A library of the proteome is written with its options; its header is read again and held against three settings."""
    folder = f"{run_folder(spark)}/library"
    made = plan.LibraryOptions(rules=_SETTINGS_RULES, max_fragments=3)
    plan.write_library(views.proteome(spark, sf), folder, made, "text")
    pairs = lambda found: spark.createDataFrame(found, "key string, value string")
    recorded = pairs(writer.recorded_settings(folder) or [])
    cases = {
        "same": made,
        "more cleavages": replace(made, rules=replace(_SETTINGS_RULES, missed_cleavages=1)),
        "other charges and floor": replace(made, rules=replace(_SETTINGS_RULES, max_charge=3), min_intensity=0.5),
    }
    verdicts = [
        check_settings(recorded, pairs(writer.flat_settings(plan.settings_document(options)))).select(F.lit(name).alias("case_name"), "verdict", "differences")
        for name, options in cases.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), verdicts)


@add(
    "library_sidecar_counts",
    "K10",
    "A16",
    needs=("cleaved",),
    sql=f"""WITH targets AS (SELECT DISTINCT peptide FROM cleaved), n AS (SELECT count(*) AS targets,
  count(*) FILTER ({_REVERSED} NOT IN (SELECT peptide FROM targets)) AS decoys, sum(least(3, 4 * (length(peptide) - 1))) AS fragments,
  sum(least(3, 4 * (length(peptide) - 1))) FILTER ({_REVERSED} NOT IN (SELECT peptide FROM targets)) AS decoy_fragments FROM targets)
SELECT (targets + decoys)::BIGINT AS precursors, decoys::BIGINT AS decoys, (fragments + decoy_fragments)::BIGINT AS fragments FROM n""",
)
def library_sidecar_counts(spark, sf):
    """The counts that a build has put into its sidecar, from what its tasks have written."""
    folder = f"{run_folder(spark)}/library"
    plan.write_library(views.proteome(spark, sf), folder, plan.LibraryOptions(rules=_SETTINGS_RULES, max_fragments=3))
    sidecar = spark.read.option("wholetext", True).text(f"{folder}/{writer.SIDECAR}")
    count = lambda name: F.get_json_object("value", f"$.output.counts.{name}").cast("bigint").alias(name)
    return sidecar.select(count("precursors"), count("decoys"), count("fragments"))


def _text_entries(spark, rows):
    folder = f"{run_folder(spark)}/text"
    header = sink.speclib_header("stand-in", "0.1", [("digest.min_length", "7")])
    order = [F.col("decoy_group").asc(), F.col("decoy").asc()]
    sink.write_speclib(rows, order, folder, header)
    entries = spark.read.option("lineSep", "<Spectrum=").text(f"{folder}/spectra")
    return _entry_facts(entries.where(F.length(F.trim(F.col("value"))) > 0))


def _entry_facts(entries):
    entry = F.col("value")
    one = lambda term: F.regexp_extract(entry, term + r"([^\n]*)", 1)
    accessions = F.regexp_extract_all(entry, F.lit(r"MS:1000885\|protein accession=([^\n]*)"), F.lit(1))
    return entries.select(
        one(r"MS:1003270\|proforma peptidoform ion notation=").alias("ion"),
        F.size(F.regexp_extract_all(entry, F.lit("attribute set name=Decoy"), F.lit(0))).alias("decoys"),
        F.regexp_extract(entry, r"ionloom:decoy_group\n\[3\][^=]*=(\d+)", 1).cast("bigint").alias("decoy_group"),
        F.array_join(accessions, ";").alias("proteins"),
        one(r"MS:1003059\|number of peaks=").cast("bigint").alias("peaks"),
    )


@add(
    "peptide_list_library",
    "S5",
    "J8",
    "W10",
    "A21",
    needs=("cleaved",),
    sql=f"""SELECT (count(*) * 2)::BIGINT AS targets, (count(*) * 2)::BIGINT AS listed, (count(*) FILTER (NOT paired) * 2)::BIGINT AS unpaired FROM ({DECOY_SEARCH_SQL})""",
)
def peptide_list_library(spark, sf):
    """Given peptides at given charges with searched decoys: every target is in the library, unpaired ones are counted."""
    placed = with_position(views.cleaved(spark, sf), [F.col("peptide").asc()], "place")
    rows = placed.withColumn("charge", F.explode(F.array(F.lit(2), F.lit(3)))).select(
        (F.col("place") * 2 + F.col("charge")).alias("ordinal"), "peptide", no_sites().alias("sites"), "charge",
        F.lit(False).alias("decoy"), (F.col("place") * 2 + F.col("charge")).alias("decoy_group"), F.array(F.lit("P")).alias("proteins"),
    )
    library_rows, counts = plan.listed_library(rows, plan.LibraryOptions(decoys=True))
    one = F.lit(0).alias("__one")
    listed = library_rows.agg(F.count_if(~F.col("decoy")).alias("listed"), one)
    return counts.select("*", one).join(listed, "__one").select("targets", "listed", "unpaired")


_FACETS_SQL = f"""f AS (SELECT 'charge' AS facet, 'z' || charge AS level, angle FROM scored UNION ALL SELECT 'length', '5-9', angle FROM scored
  UNION ALL SELECT 'mass', (floor(mass / 500)::BIGINT * 500) || '-' || (floor(mass / 500)::BIGINT * 500 + 499), angle FROM (
    SELECT angle, {sql_mass('residues')} + {SQL_WATER} + (length(residues) - length(replace(residues, 'M', ''))) * 15.994914622::DOUBLE
      + (length(residues) - length(replace(residues, 'C', ''))) * 57.021463723::DOUBLE AS mass FROM scored)
  UNION ALL SELECT 'modification', CASE WHEN residues LIKE '%C%' AND residues LIKE '%M%' THEN 'Carbamidomethyl+Oxidation' WHEN residues LIKE '%C%' THEN 'Carbamidomethyl'
    WHEN residues LIKE '%M%' THEN 'Oxidation' ELSE 'unmodified' END, angle FROM scored)"""


def scored_library(spark, sf):
    """A library export scored against the built-in labels, its shifts named by declared aliases."""
    rows = libraries.library_rows(views.library_lines(spark, sf), line=F.col("RelativeIntensity"))
    aliases = spark.createDataFrame(
        [(0, 35, 15.994914622, None), (1, 4, 57.021463723, 57.0215)],
        "alias_order int, accession int, table_mass double, observed_mass double",
    )
    return evaluation.score_library(rows, aliases)


@add(
    "library_scores",
    "S4",
    "P8",
    "J9",
    "A17",
    "P16",
    needs=("library_lines",),
    sql=f"WITH {_SCORED_SQL} SELECT residues AS peptide, charge, round(angle, 6) AS angle FROM scored",
)
def library_scores(spark, sf):
    return scored_library(spark, sf).select("peptide", "charge", "angle")


@add(
    "library_evaluation",
    "A24",
    "P25",
    needs=("library_lines",),
    sql=f"""WITH {_SCORED_SQL}, {_FACETS_SQL}
SELECT facet, level, count(*) AS n, round(avg(angle), 6) AS mean, round(median(angle), 6) AS median FROM f GROUP BY 1, 2""",
)
def library_evaluation(spark, sf):
    return evaluation.library_facets(scored_library(spark, sf))


@add(
    "library_facet_histograms",
    "A24",
    "A8",
    needs=("library_lines",),
    sql=f"""WITH {_SCORED_SQL}, {_FACETS_SQL},
b AS (SELECT facet, level, CASE WHEN angle BETWEEN 0 AND 1 THEN least(floor(angle * 50), 49) END AS bin FROM f),
levels AS (SELECT facet, level, count(bin) AS counted, count(*) AS total FROM b GROUP BY 1, 2)
SELECT l.facet, l.level, s.bin, count(b.bin) AS count, any_value(l.counted) AS counted, any_value(l.total) AS total
FROM levels l CROSS JOIN range(0, 50) s(bin) LEFT JOIN b ON b.facet = l.facet AND b.level = l.level AND b.bin = s.bin GROUP BY 1, 2, 3""",
)
def library_facet_histograms(spark, sf):
    """Angle counts of every facet level on the shared grid."""
    return evaluation.library_facet_histograms(scored_library(spark, sf))


@add(
    "library_distance_median",
    "A24",
    needs=("library_lines",),
    sql=f"""WITH {_SCORED_SQL.replace("AS angle", "AS angle, sqrt(sum(pow(p / sp - coalesce(v, 0) / sv, 2))) AS distance")
    .replace("FROM waves w LEFT JOIN cells c", "FROM (SELECT *, sum(p) OVER (PARTITION BY residues, charge) AS sp FROM waves) w JOIN (SELECT residues AS r2, charge AS z2, sum(v) AS sv FROM cells GROUP BY 1, 2) t ON r2 = w.residues AND z2 = w.charge LEFT JOIN cells c")}
SELECT count(distance) AS n, round(median(distance), 6) AS median FROM scored""",
)
def library_distance_median(spark, sf):
    """Median distance of sum-normalised spectra over the whole library."""
    return evaluation.library_distance(scored_library(spark, sf)).select("n", "median")


@add(
    "library_histogram",
    "A8",
    "A24",
    needs=("library_lines",),
    sql=f"""WITH {_SCORED_SQL}, b AS (SELECT CASE WHEN angle BETWEEN 0 AND 1 THEN least(floor(angle * 50), 49) END AS bin FROM scored)
SELECT s.bin, count(b.bin) AS count, (SELECT count(bin) FROM b) AS counted, (SELECT count(*) FROM b) AS total FROM range(0, 50) s(bin) LEFT JOIN b ON b.bin = s.bin GROUP BY 1""",
)
def library_histogram(spark, sf):
    return evaluation.library_histogram(scored_library(spark, sf)).drop("scope")
