"""Scalar and array column queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.constants import MODIFICATIONS, RESIDUE_ATOMS, RESIDUE_MASS
from ionloom.functions import chemistry, hashing, sequence, spectra, tokens
from ionloom.operators import modforms, resolve
from ionloom.operators.decoys import decoy_candidates, no_sites
from ionloom.operators.evaluate import facet_levels
from ionloom.operators.library import spectrum_rows
from ionloom.plans.library import DEFAULT_DELTAS
from ionloom.queries import views
from ionloom.queries.base import Book, joined
from ionloom.queries.views import SQL_WATER, sql_mass

BOOK = Book()
add = BOOK.add

SQL_PROTON = f"{chemistry.PROTON!r}::DOUBLE"


@add(
    "stripped_sequence",
    "P1",
    needs=("modified",),
    sql=r"""SELECT proforma, regexp_replace(proforma, '\[UNIMOD:\d+\]|-', '', 'g') AS stripped,
  length(peptide)::BIGINT AS stripped_length FROM modified""",
)
def stripped_sequence(spark, sf):
    p = F.col("proforma")
    return views.modified(spark, sf).select(
        p, sequence.stripped_sequence(p).alias("stripped"), sequence.stripped_length(p).alias("stripped_length")
    )


@add(
    "nterm_separator_repair",
    "P2",
    needs=("modified",),
    sql="""SELECT loose, CASE WHEN loose LIKE '[%' AND loose NOT LIKE '[%]-%' THEN replace(loose, '[UNIMOD:1]', '[UNIMOD:1]-')
  ELSE loose END AS repaired FROM (SELECT CASE WHEN length(peptide) % 2 = 0 THEN replace(proforma, ']-', ']') ELSE proforma END AS loose
  FROM modified)""",
)
def nterm_separator_repair(spark, sf):
    loose = F.when(F.length("peptide") % 2 == 0, F.replace("proforma", F.lit("]-"), F.lit("]"))).otherwise(F.col("proforma"))
    return views.modified(spark, sf).select(loose.alias("loose")).select(
        "loose", sequence.repair_nterm(F.col("loose")).alias("repaired")
    )


@add(
    "proforma_sites",
    "P3",
    needs=("modified",),
    sql="""WITH letters AS (SELECT peptide, proforma, unnest(string_split(peptide, '')) AS residue,
  generate_subscripts(string_split(peptide, ''), 1) - 1 AS pos FROM modified)
SELECT proforma, 'r' AS site_kind, pos::BIGINT AS pos, residue, CASE residue WHEN 'M' THEN 'UNIMOD:35' ELSE 'UNIMOD:4' END AS spec
FROM letters WHERE residue IN ('M', 'C')
UNION ALL SELECT proforma, 'n', 0::BIGINT, 'A', 'UNIMOD:1' FROM modified WHERE peptide LIKE 'A%'""",
)
def proforma_sites(spark, sf):
    valid = views.modified(spark, sf).where(sequence.is_valid_proforma(F.col("proforma")))
    return valid.select("proforma", F.explode(sequence.proforma_sites(F.col("proforma"))).alias("s")).select(
        "proforma", "s.*"
    )


@add(
    "proforma_render",
    "P4",
    needs=("cleaved",),
    sql="""SELECT peptide, CASE WHEN peptide LIKE 'S%' THEN '[UNIMOD:737]-' ELSE '' END ||
  replace(replace(peptide, 'K', 'K[UNIMOD:121][UNIMOD:737]'), 'T', 'T[UNIMOD:21][+15.99]') ||
  CASE WHEN peptide LIKE '%R' THEN '-[UNIMOD:35]' ELSE '' END AS canonical FROM cleaved""",
)
def proforma_render(spark, sf):
    """Sites in scrambled order render to the one canonical text."""
    p = F.col("peptide")
    rules = ["T[+15.99]", "K[UNIMOD:737]", "-[UNIMOD:35]", "K[UNIMOD:121]", "T[UNIMOD:21]", "[UNIMOD:737]-"]
    parts = []
    for text in rules:
        rule = sequence.parse_rule(text)
        sites = sequence.rule_sites(p, rule)
        if rule.targets == ("n",):
            sites = F.when(p.startswith("S"), sites).otherwise(no_sites())
        if rule.targets == ("c",):
            sites = F.when(p.endswith("R"), sites).otherwise(no_sites())
        parts.append(sites)
    return views.cleaved(spark, sf).select(
        "peptide", sequence.render_proforma(p, F.concat(*parts)).alias("canonical")
    )


@add(
    "diann_spelling",
    "P5",
    needs=("modified",),
    sql="""SELECT proforma, CASE WHEN peptide LIKE 'A%' THEN '(UniMod:1)' ELSE '' END ||
  replace(replace(replace(peptide, 'M', 'M(UniMod:35)'), 'C', 'C(UniMod:4)'), 'S', 'S(+79.96633)') AS spelled FROM (
  SELECT replace(proforma, 'S', 'S[+79.96633]') AS proforma, peptide FROM modified)""",
)
def diann_spelling(spark, sf):
    p = F.replace("proforma", F.lit("S"), F.lit("S[+79.96633]"))
    return views.modified(spark, sf).select(p.alias("proforma")).select(
        "proforma", sequence.diann_spelling(F.col("proforma")).alias("spelled")
    )


@add(
    "hash_split",
    "P6",
    needs=("cleaved",),
    sql="""SELECT peptide, unit, CASE WHEN unit < 0.8 THEN 'train' WHEN unit < 0.9 THEN 'val' ELSE 'test' END AS split FROM (
  SELECT peptide, round(u, 6) AS unit0, u AS unit_exact, round(u, 6) AS unit FROM (
  SELECT peptide, ('0x' || substr(sha256('pepdistill-v1:' || peptide), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM cleaved))""",
)
def hash_split(spark, sf):
    unit = F.round(hashing.sha_unit(F.col("peptide")), 6)
    return views.cleaved(spark, sf).select("peptide", unit.alias("unit"), hashing.split_label(unit).alias("split"))


@add("blake_split", "P6")
def blake_split(spark, sf):
    """The contract's split: the hash has no SQL function, golden values are in the tests."""
    unit = hashing.blake_unit()(F.col("peptide"))
    return views.cleaved(spark, sf).withColumn("unit", unit).select(
        "peptide", "unit", hashing.split_label(F.col("unit")).alias("split")
    )


@add(
    "blake_split_counts",
    "P6",
    needs=("cleaved",),
    sql="""SELECT length(peptide)::BIGINT AS length, count(*) AS peptides, true AS units_in_range, true AS labels_follow, count(*) > 2000 AS enough,
  count(*) > 2000 AS shares_hold FROM cleaved GROUP BY 1""",
)
def blake_split_counts(spark, sf):
    """Per length: every number lies in [0, 1), labels follow the numbers, and in large groups the shares hold."""
    rows = blake_split(spark, sf)
    u = F.col("unit")
    label = F.when(u < 0.8, "train").when(u < 0.9, "val").otherwise("test")
    train = F.count_if(F.col("split") == "train") / F.count(F.lit(1))
    enough = F.count(F.lit(1)) > 2000
    return rows.groupBy(F.length("peptide").alias("length")).agg(
        F.count(F.lit(1)).alias("peptides"),
        F.bool_and((u >= 0) & (u < 1)).alias("units_in_range"),
        F.bool_and(F.col("split") == label).alias("labels_follow"),
        enough.alias("enough"),
        (enough & train.between(0.74, 0.86)).alias("shares_hold"),
    )


@add(
    "spectrum_identifier_counts",
    "P7",
    needs=("candidates",),
    sql="SELECT raw_file, count(DISTINCT scan_number) AS scans, count(DISTINCT scan_number) AS identifiers FROM candidates GROUP BY 1",
)
def spectrum_identifier_counts(spark, sf):
    """Every scan of a raw file has an identifier of its own."""
    return spectrum_identifier(spark, sf).groupBy("raw_file").agg(
        F.count_distinct("scan_number").alias("scans"), F.count_distinct("spectrum_id").alias("identifiers")
    )


@add("spectrum_identifier", "P7")
def spectrum_identifier(spark, sf):
    rows = views.candidates(spark, sf).select("raw_file", "scan_number").distinct()
    bits = hashing.spectrum_id()(F.lit("stand-in"), "raw_file", "scan_number")
    return rows.withColumn("bits", bits).select("raw_file", "scan_number", hashing.unsigned(F.col("bits")).alias("spectrum_id"))


@add(
    "library_peptide_parse",
    "P8",
    needs=("cleaved",),
    sql="""WITH letters AS (SELECT peptide, unnest(string_split(peptide, '')) AS residue,
  generate_subscripts(string_split(peptide, ''), 1) - 1 AS pos FROM cleaved)
SELECT peptide, 'r' AS site_kind, pos::BIGINT AS pos, CASE residue WHEN 'M' THEN '[+15.9949]' ELSE '(57.02)' END AS spelled,
  CASE residue WHEN 'M' THEN 15.9949::DOUBLE ELSE 57.02::DOUBLE END AS shift FROM letters WHERE residue IN ('M', 'C')
UNION ALL SELECT peptide, 'n', 0::BIGINT, '[+42.0106]', 42.0106::DOUBLE FROM cleaved WHERE peptide LIKE 'A%'""",
)
def library_peptide_parse(spark, sf):
    p = F.col("peptide")
    text = F.replace(F.replace(p, F.lit("M"), F.lit("m[+15.9949]")), F.lit("C"), F.lit("C(57.02)"))
    text = F.concat(F.lit("_"), F.when(p.startswith("A"), F.lit("[+42.0106]")).otherwise(""), text, F.lit("_"))
    # Generated, so that what is parsed once is not parsed again by the filter.
    parsed = views.cleaved(spark, sf).select("peptide", F.inline(F.array(sequence.library_peptide(text))))
    right = parsed.where(F.col("valid") & (F.col("residues") == p))
    return right.select("peptide", F.explode("shifts").alias("s")).select("peptide", "s.*")


@add(
    "optional_fill",
    "P9",
    needs=("candidates",),
    sql="""SELECT raw_file, count(*) AS rows, count(*) FILTER (score IS NULL) AS unscored,
  count(*) AS without_energy, count(*) FILTER (analyzer = '') AS without_analyzer FROM (
  SELECT raw_file, CASE WHEN andromeda_score > 10 THEN andromeda_score END AS score,
  CASE WHEN scan_number % 2 = 0 THEN 'FTMS' ELSE '' END AS analyzer FROM candidates) GROUP BY 1""",
)
def optional_fill(spark, sf):
    sparse = (
        views.candidates(spark, sf)
        .withColumn("andromeda_score", F.when(F.col("andromeda_score") > 10, F.col("andromeda_score")))
        .withColumn("mass_analyzer", F.when(F.col("scan_number") % 2 == 0, "FTMS"))
    )
    filled = resolve.fill_optional(sparse)
    return filled.groupBy("raw_file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.isnan("andromeda_score")).alias("unscored"),
        F.count_if(F.isnan("aligned_collision_energy")).alias("without_energy"),
        F.count_if(F.col("mass_analyzer") == "").alias("without_analyzer"),
    )


@add(
    "fragment_cell",
    "P10",
    needs=("fragments",),
    sql="""SELECT ion_type, no, charge, length::BIGINT AS length, coalesce(site, -1)::BIGINT AS site, coalesce(col, -1)::BIGINT AS col, count(*) AS rows FROM (
  SELECT *, CASE WHEN ok THEN CASE ion_type WHEN 'b' THEN no - 1 ELSE length - 1 - no END END AS site,
  CASE WHEN ok THEN CASE ion_type WHEN 'b' THEN 0 ELSE 1 END + 2 * (charge - 1) END AS col FROM (
  SELECT *, charge <= 2 AND no BETWEEN 1 AND length - 1 AS ok FROM (SELECT *, 3 + scan_number % 5 AS length FROM fragments)))
GROUP BY ALL""",
)
def fragment_cell(spark, sf):
    cell = spectra.fragment_cell(F.col("ion_type"), F.col("no"), F.col("charge"), F.col("length"))
    return (
        views.fragments(spark, sf)
        .withColumn("length", 3 + F.col("scan_number") % 5)
        .withColumn("cell", cell)
        .groupBy(
            "ion_type",
            "no",
            "charge",
            "length",
            F.coalesce("cell.site", F.lit(-1)).alias("site"),
            F.coalesce("cell.col", F.lit(-1)).alias("col"),
        )
        .agg(F.count(F.lit(1)).alias("rows"))
    )


_MOD_SQL = f"""({sql_mass('peptide')} + {SQL_WATER}
  + (length(peptide) - length(replace(peptide, 'M', ''))) * 15.994914622::DOUBLE
  + (length(peptide) - length(replace(peptide, 'C', ''))) * 57.021463723::DOUBLE
  + CASE WHEN peptide LIKE 'A%' THEN 42.0105647::DOUBLE ELSE 0 END)"""


@add(
    "precursor_mz",
    "P11",
    needs=("modified",),
    sql=f"""SELECT proforma, charge::BIGINT AS charge, round(mass, 6) AS mono_mass, round((mass + charge * {SQL_PROTON}) / charge, 6) AS mz
FROM (SELECT proforma, {_MOD_SQL} AS mass FROM modified) CROSS JOIN (VALUES (2), (3), (4)) v(charge)""",
)
def precursor_mz(spark, sf):
    sites = sequence.proforma_sites(F.col("proforma"))
    mass = chemistry.mono_mass(F.col("peptide"), chemistry.mods_mass(sites, DEFAULT_DELTAS))
    rows = views.modified(spark, sf).withColumn("mono_mass", mass)
    return modforms.expand_charges(rows, 2, 4).select(
        "proforma", "charge", "mono_mass", chemistry.charged_mz(F.col("mono_mass"), F.col("charge")).alias("mz")
    )


@add(
    "fragment_mz",
    "P12",
    needs=("cleaved",),
    sql=f"""WITH sites AS (SELECT peptide, unnest(range(0, length(peptide) - 1)) AS site FROM cleaved),
masses AS (SELECT peptide, site, {sql_mass('substr(peptide, 1, site + 1)')} AS b,
  {sql_mass('substr(peptide, site + 2)')} + {SQL_WATER} AS y FROM sites)
SELECT length(peptide)::BIGINT AS length, site::BIGINT AS site, ion, charge::BIGINT AS charge, count(*) AS peptides,
  round(min((neutral + charge * {SQL_PROTON}) / charge), 6) AS min_mz,
  round(max((neutral + charge * {SQL_PROTON}) / charge), 6) AS max_mz,
  round(sum((neutral + charge * {SQL_PROTON}) / charge), 3) AS sum_mz
FROM (SELECT peptide, site, 'b' AS ion, b AS neutral FROM masses UNION ALL SELECT peptide, site, 'y', y FROM masses)
CROSS JOIN (VALUES (1), (2)) v(charge) GROUP BY ALL""",
)
def fragment_mz(spark, sf):
    """Every fragment of every peptide, reported per length, site and ion."""
    grid = chemistry.fragment_grid(chemistry.residue_masses(F.col("peptide")))
    cells = views.cleaved(spark, sf).select(F.length("peptide").alias("length"), F.explode(grid).alias("cell"))
    return cells.groupBy("length", "cell.site", "cell.ion", "cell.charge").agg(
        F.count(F.lit(1)).alias("peptides"),
        F.min("cell.mz").alias("min_mz"),
        F.max("cell.mz").alias("max_mz"),
        F.round(F.sum("cell.mz"), 3).alias("sum_mz"),
    )


def _sql_atoms(index: int) -> str:
    return " + ".join(
        f"(length(peptide) - length(replace(peptide, '{r}', ''))) * {atoms[index]}"
        for r, atoms in sorted(RESIDUE_ATOMS.items())
        if atoms[index]
    )


@add(
    "element_composition",
    "P13",
    needs=("cleaved",),
    sql="SELECT peptide, "
    + ", ".join(f"({_sql_atoms(i)})::BIGINT AS {e}" for i, e in enumerate("CHNOS"))
    + " FROM cleaved",
)
def element_composition(spark, sf):
    counts = chemistry.element_counts(F.col("peptide"))
    return views.cleaved(spark, sf).select("peptide", *[counts[e].alias(e) for e in "CHNOS"])


@add(
    "composition_text",
    "P13",
    "P14",
    sql="""SELECT p_partkey, (p_size + 2)::BIGINT AS carbon, (p_partkey % 20 - 5)::BIGINT AS hydrogen, 1::BIGINT AS oxygen,
  round((p_size * 12.0 + 2 * 13.00335483 + (p_partkey % 20 - 5) * 1.007825035 + 15.99491463)::DOUBLE + 1e-10, 6) AS mass FROM part""",
)
def composition_text(spark, sf):
    """Composition notation with isotopes: parsed, folded on the element, weighed exactly.

    Nuclide masses have nine decimals, so a tiny shift makes exact halves round one way.
    """
    text = F.concat(
        F.lit("C("), F.col("p_size").cast("string"), F.lit(") 13C(2) H("),
        (F.col("p_partkey") % 20 - 5).cast("string"), F.lit(") O"),
    )
    parts = views.table(spark, sf, "part").select("p_partkey", chemistry.composition_terms(text).alias("terms"))
    weighed = parts.withColumn("mass", F.round(chemistry.composition_mass(F.col("terms")) + 1e-10, 6))
    return (
        weighed.select("p_partkey", "mass", F.explode("terms").alias("t"))
        .groupBy("p_partkey", "mass")
        .pivot("t.element", ["C", "H", "O"])
        .agg(F.sum("t.count"))
        .select("p_partkey", "mass", F.col("C").alias("carbon"), F.col("H").alias("hydrogen"), F.col("O").alias("oxygen"))
    )


@add(
    "modification_delta",
    "P14",
    needs=("modified",),
    sql="""SELECT accession, count(*) AS sites, round(sum(delta), 4) AS total, count(*) FILTER (delta IS NULL) AS unknown FROM (
  SELECT unnest(regexp_extract_all(proforma, 'UNIMOD:(\\d+)', 1))::BIGINT AS accession FROM modified) LEFT JOIN
  (VALUES (1, 42.0105647::DOUBLE), (35, 15.994914622::DOUBLE)) t(acc, delta) ON acc = accession GROUP BY 1""".replace("\\\\d", "\\d"),
)
def modification_delta(spark, sf):
    """Deltas by a join to the user's table; accession 4 is missing from it and shows as unknown."""
    table = spark.createDataFrame(
        [(a, d) for a, _, _, d in MODIFICATIONS if a in (1, 35)], "accession int, delta double"
    )
    sites = views.modified(spark, sf).select(
        "proforma", F.explode(sequence.proforma_sites(F.col("proforma"))).alias("s")
    ).select("proforma", "s.*")
    return modforms.site_deltas(sites, table).groupBy("accession").agg(
        F.count(F.lit(1)).alias("sites"),
        F.round(F.sum("delta"), 4).alias("total"),
        F.count_if(F.col("delta").isNull()).alias("unknown"),
    )


@add(
    "ion_mobility",
    "P15",
    needs=("precursors",),
    sql=f"""SELECT spectrum_id, round(ccs * sqrt(m * 28.0 / (m + 28.0)) / charge / 1059.62245, 6) AS mobility FROM (
  SELECT spectrum_id, charge, ccs, ({sql_mass('peptide')} + {SQL_WATER} + charge * {SQL_PROTON}) / charge * charge AS m FROM precursors)""",
)
def ion_mobility(spark, sf):
    mz = chemistry.charged_mz(chemistry.mono_mass(F.col("peptide")), F.col("charge"))
    return views.precursors(spark, sf).select(
        "spectrum_id", chemistry.mobility(F.col("ccs"), F.col("charge"), mz).alias("mobility")
    )


@add(
    "spectral_angle",
    "P16",
    needs=("pair_angles",),
    sql="SELECT spectrum_id, round(cosine, 6) AS cosine, round(angle, 6) AS angle FROM pair_angles",
)
def spectral_angle(spark, sf):
    a, b = F.col("predicted"), F.col("observed")
    return views.pairs(spark, sf).select(
        "spectrum_id", spectra.cosine(a, b).alias("cosine"), spectra.spectral_angle(a, b).alias("angle")
    )


@add(
    "masked_spectral_angle",
    "P16",
    needs=("pair_cells",),
    sql="""SELECT spectrum_id, round(1 - 2 * acos(greatest(least(
  sum(predicted * observed) / (sqrt(sum(predicted * predicted)) * sqrt(sum(observed * observed))), 1), -1)) / pi(), 6) AS angle
FROM pair_cells WHERE cell < 4 * (4 + spectrum_id % 8) GROUP BY 1""",
)
def masked_spectral_angle(spark, sf):
    """Only the backbone sites of each peptide count; the rest is padding."""
    sites = (4 + F.col("spectrum_id") % 8).cast("int")
    return views.pairs(spark, sf).select(
        "spectrum_id", spectra.masked_angle(F.col("predicted"), F.col("observed"), sites).alias("angle")
    )


@add(
    "sum_normalised_l2",
    "P17",
    needs=("pair_cells",),
    sql="""SELECT p.spectrum_id, round(sqrt(sum(pow(predicted / tp - observed / tb, 2))), 6) AS distance FROM pair_cells p JOIN
  (SELECT spectrum_id, sum(predicted) AS tp, sum(observed) AS tb FROM pair_cells GROUP BY 1) t ON t.spectrum_id = p.spectrum_id GROUP BY 1""",
)
def sum_normalised_l2(spark, sf):
    return views.pairs(spark, sf).select(
        "spectrum_id", spectra.sum_normalised_l2(F.col("predicted"), F.col("observed")).alias("distance")
    )


_GRID_SQL = f"""grid AS (SELECT p.spectrum_id, p.charge AS precursor_charge, p.peptide, s.cell, s.cell // 4 AS site,
  CASE WHEN s.cell % 2 = 0 THEN 'b' ELSE 'y' END AS ion, 1 + (s.cell % 4) // 2 AS charge, s.value,
  max(s.value) OVER (PARTITION BY p.spectrum_id) AS top FROM precursors p JOIN spectra s ON s.spectrum_id = p.spectrum_id),
peaks AS (SELECT spectrum_id, precursor_charge, peptide, cell, ion, charge, value / top AS intensity,
  CASE ion WHEN 'b' THEN site + 1 ELSE 16 - site END AS ordinal,
  (CASE ion WHEN 'b' THEN {sql_mass('substr(peptide, 1, site + 1)')} ELSE {sql_mass('substr(peptide, site + 2)')} + {SQL_WATER} END
   + charge * {SQL_PROTON}) / charge AS mz FROM grid)"""


@add(
    "relative_peaks",
    "P18",
    needs=("precursors", "spectra"),
    sql=f"""WITH {_GRID_SQL} SELECT spectrum_id, ion, ordinal::BIGINT AS ordinal, charge::BIGINT AS charge,
  round(mz, 6) AS mz, round(intensity, 6) AS intensity FROM peaks WHERE intensity >= 0.1""",
)
def relative_peaks(spark, sf):
    grid = chemistry.fragment_grid(chemistry.residue_masses(F.col("peptide")))
    peaks = spectra.grid_peaks(F.col("ms2"), grid, 0.1)
    return views.precursors(spark, sf).select("spectrum_id", F.explode(peaks).alias("p")).select(
        "spectrum_id", "p.ion", "p.ordinal", "p.charge", "p.mz", "p.intensity"
    )


@add(
    "spectrum_validation",
    "P19",
    needs=("precursors",),
    sql="""SELECT coalesce(problem, 'none') AS problem, count(*) AS rows FROM (SELECT CASE
  WHEN spectrum_id % 7 = 0 THEN 'non-physical precursor prediction'
  WHEN spectrum_id % 5 = 0 THEN 'invalid fragment' END AS problem FROM precursors) GROUP BY 1""",
)
def spectrum_validation(spark, sf):
    """Faults planted in known rows; a peak beyond the cap still counts."""
    sid = F.col("spectrum_id")
    planted = (
        views.precursors(spark, sf)
        .withColumn("ccs", F.when(sid % 7 == 0, F.lit(float("nan"))).otherwise(F.col("ccs")))
        .withColumn(
            "ms2",
            F.when(sid % 5 == 0, F.transform("ms2", lambda x, i: F.when(i == 3, F.lit(-1.0)).otherwise(x))).otherwise(F.col("ms2")),
        )
        .withColumn("masses", chemistry.residue_masses(F.col("peptide")))
    )
    rows = spectrum_rows(planted, min_intensity=-10.0, max_fragments=5)
    return rows.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("rows"))


@add(
    "energy_bucket",
    "P20",
    needs=("psms",),
    sql="""SELECT coalesce(bucket, -1)::BIGINT AS bucket, count(*) AS rows FROM (SELECT CASE WHEN spectrum_id % 9 <> 0
  THEN round(precursor_intensity / 3.0)::BIGINT END AS bucket FROM psms) GROUP BY 1""",
)
def energy_bucket(spark, sf):
    energy = F.when(F.col("spectrum_id") % 9 != 0, F.col("precursor_intensity")).otherwise(F.lit(float("nan")))
    bucket = F.coalesce(spectra.energy_bucket(energy, 3.0), F.lit(-1))
    return views.psms(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


@add(
    "pseudo_reverse",
    "P21",
    needs=("modified",),
    sql="""SELECT peptide, k::BIGINT AS flank,
  CASE WHEN length(peptide) - 2 * k > 1 THEN substr(peptide, 1, k) || reverse(substr(peptide, k + 1, length(peptide) - 2 * k)) || substr(peptide, length(peptide) - k + 1)
  ELSE peptide END AS reversed FROM modified CROSS JOIN (VALUES (1), (2), (3)) v(k)""",
)
def pseudo_reverse(spark, sf):
    flanks = views.modified(spark, sf).withColumn("flank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return flanks.select(
        "peptide", "flank", sequence.reverse_interior(F.col("peptide"), F.col("flank")).alias("reversed")
    )


@add(
    "reversed_proforma",
    "P21",
    needs=("modified",),
    sql="""SELECT proforma, CASE WHEN peptide LIKE 'A%' THEN '[UNIMOD:1]-' ELSE '' END || replace(replace(
  substr(peptide, 1, 1) || reverse(substr(peptide, 2, length(peptide) - 2)) || substr(peptide, length(peptide)),
  'M', 'M[UNIMOD:35]'), 'C', 'C[UNIMOD:4]') AS decoy FROM modified""",
)
def reversed_proforma(spark, sf):
    """Modifications travel with their residues, terminal ones stay."""
    sites = sequence.move_sites_reversed(sequence.proforma_sites(F.col("proforma")), F.length("peptide"))
    return views.modified(spark, sf).select(
        "proforma", sequence.render_proforma(sequence.reverse_interior(F.col("peptide")), sites).alias("decoy")
    )


def sql_shuffled(seed: int, attempt: str) -> str:
    """The shuffle of a peptide of four residues or more at charge 2."""
    draw = f"md5('{seed}|' || peptide || '|2|' || {attempt} || '|' || i)"
    places = f"list_sort(list_transform(range(1, length(peptide) - 1), lambda i: {{'draw': {draw}, 'place': i}}))"
    inner = f"array_to_string(list_transform({places}, lambda d: substr(peptide, d.place + 1, 1)), '')"
    return f"substr(peptide, 1, 1) || {inner} || substr(peptide, length(peptide))"


@add(
    "shuffled_decoys",
    "P21",
    needs=("cleaved",),
    sql=f"SELECT peptide, {sql_shuffled(7, '0')} AS decoy_peptide, true AS same_letters, true AS same_ends FROM cleaved",
)
def shuffled_decoys(spark, sf):
    """Seeded shuffles; the interior keeps its letters and the ends stay."""
    rows = views.cleaved(spark, sf).select(
        F.xxhash64("peptide").alias("ordinal"), "peptide", no_sites().alias("sites"), F.lit(2).alias("charge")
    )
    tries = decoy_candidates(rows, "shuffle", seed=7, last=0)
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    return tries.select(
        "peptide",
        "decoy_peptide",
        (letters("peptide") == letters("decoy_peptide")).alias("same_letters"),
        (
            (F.substring("peptide", 1, 1) == F.substring("decoy_peptide", 1, 1))
            & (F.substring("peptide", -1, 1) == F.substring("decoy_peptide", -1, 1))
        ).alias("same_ends"),
    )


@add(
    "token_features",
    "P22",
    needs=("modified",),
    sql="""WITH letters AS (SELECT proforma, peptide, unnest(string_split(peptide, '')) AS r, generate_subscripts(string_split(peptide, ''), 1) AS i FROM modified)
SELECT proforma, '27;' || string_agg((ascii(r) - 65)::VARCHAR, ';' ORDER BY i) || ';28' || repeat(';26', 30 - length(peptide)) AS tokens,
  repeat('0', length(peptide) + 2) || repeat('1', 30 - length(peptide)) AS padding,
  '0' || repeat('1', length(peptide) - 1) || repeat('0', 31 - length(peptide)) AS sites,
  CASE WHEN peptide LIKE 'A%' THEN '1' ELSE '0' END || string_agg(CASE WHEN r IN ('M', 'C') THEN '1' ELSE '0' END, '' ORDER BY i)
  || repeat('0', 31 - length(peptide)) AS modified,
  round(sum(CASE r WHEN 'M' THEN 15.994914622::DOUBLE WHEN 'C' THEN 57.021463723::DOUBLE ELSE 0 END)
  + CASE WHEN peptide LIKE 'A%' THEN 42.0105647::DOUBLE ELSE 0 END, 6) AS mod_mass
FROM letters GROUP BY proforma, peptide""",
)
def token_features(spark, sf):
    p = F.col("peptide")
    flags = lambda mask: F.array_join(mask.cast("array<int>").cast("array<string>"), "")
    rows = views.modified(spark, sf).withColumn("s", sequence.proforma_sites(F.col("proforma")))
    mass = tokens.mod_mass_columns(p, F.col("s"), 30, DEFAULT_DELTAS)
    return rows.select(
        "proforma",
        F.array_join(tokens.token_ids(p, 30).cast("array<string>"), ";").alias("tokens"),
        flags(tokens.pad_mask(p, 30)).alias("padding"),
        flags(tokens.site_mask(p, 30)).alias("sites"),
        flags(tokens.mod_present_columns(p, F.col("s"), 30)).alias("modified"),
        spectra.total(mass).alias("mod_mass"),
    )


def _substitution_sql() -> str:
    residues = sorted(RESIDUE_MASS)
    allowed = {r: [o for o in residues if RESIDUE_ATOMS[o] != RESIDUE_ATOMS[r]] for r in residues}
    options = "MAP {" + ", ".join(f"'{r}': {others!r}" for r, others in allowed.items()) + "}"
    masses = "MAP {" + ", ".join(f"'{r}': {m!r}::DOUBLE" for r, m in sorted(RESIDUE_MASS.items())) + "}"
    draw = {k: views.sql_uniform(f"swap-{k}", "peptide") for k in ("row", "site", "new")}
    return f"""WITH eligible AS (SELECT peptide, list_filter(range(0, length(peptide)), lambda i: NOT (length(peptide) % 2 = 0 AND i = 0)) AS e FROM cleaved),
placed AS (SELECT peptide, CASE WHEN {draw['row']} < 0.5 AND len(e) > 0 THEN e[floor({draw['site']} * len(e))::BIGINT + 1] ELSE -1 END AS swap_pos FROM eligible),
old AS (SELECT *, CASE WHEN swap_pos >= 0 THEN substr(peptide, swap_pos + 1, 1) END AS o FROM placed),
opened AS (SELECT *, {options}[o] AS allowed FROM old),
new AS (SELECT *, allowed[floor({draw['new']} * len(allowed))::BIGINT + 1] AS r FROM opened)
SELECT peptide, CASE WHEN swap_pos >= 0 THEN substr(peptide, 1, swap_pos) || r || substr(peptide, swap_pos + 2) ELSE peptide END AS augmented, swap_pos::BIGINT AS swap_pos,
  round(coalesce({masses}[o] - {masses}[r], 0), 6) AS mass_delta, true AS mass_kept FROM new"""


@add("residue_substitution", "P23", needs=("cleaved",), sql=_substitution_sql())
def residue_substitution(spark, sf):
    """One residue swapped with its mass difference stated; the corrected mass is the original."""
    rows = views.cleaved(spark, sf).withColumn(
        "mass_only", F.when(F.length("peptide") % 2 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    )
    swapped = modforms.substitute_residue(rows, 0.5, ["peptide"])
    drift = chemistry.mono_mass(F.col("augmented")) + F.col("mass_delta") - chemistry.mono_mass(F.col("peptide"))
    return swapped.select(
        "peptide", "augmented", "swap_pos", "mass_delta", (F.abs(drift) < 1e-6).alias("mass_kept")
    )


@add(
    "rule_sites",
    "P24",
    needs=("cleaved",),
    sql="""WITH letters AS (SELECT peptide, unnest(string_split(peptide, '')) AS r, generate_subscripts(string_split(peptide, ''), 1) - 1 AS pos FROM cleaved)
SELECT peptide, 'r' AS site_kind, pos::BIGINT AS pos, r AS residue, 'UNIMOD:21' AS spec FROM letters WHERE r IN ('S', 'T', 'Y')
UNION ALL SELECT peptide, 'n', 0::BIGINT, substr(peptide, 1, 1), 'UNIMOD:737' FROM cleaved""",
)
def rule_sites(spark, sf):
    rules = [sequence.parse_rule("STY[UNIMOD:21]"), sequence.parse_rule("[UNIMOD:737]-")]
    return views.cleaved(spark, sf).select(
        "peptide", F.explode(modforms.fixed_sites(F.col("peptide"), rules)).alias("s")
    ).select("peptide", "s.*")


@add(
    "facet_labels",
    "P25",
    needs=("modified",),
    sql=f"""WITH base AS (SELECT length(peptide) AS n, 2 + length(peptide) % 3 AS z, {_MOD_SQL} AS mass,
  (CASE WHEN peptide LIKE 'A%' THEN 1 ELSE 0 END) + (CASE WHEN peptide LIKE '%C%' THEN 1 ELSE 0 END) + (CASE WHEN peptide LIKE '%M%' THEN 1 ELSE 0 END) AS k,
  concat_ws('+', CASE WHEN peptide LIKE 'A%' THEN 'Acetyl' END, CASE WHEN peptide LIKE '%C%' THEN 'Carbamidomethyl' END, CASE WHEN peptide LIKE '%M%' THEN 'Oxidation' END) AS titles FROM modified)
SELECT facet, level, count(*) AS rows FROM (
  SELECT 'modification' AS facet, CASE WHEN k = 0 THEN 'unmodified' WHEN k <= 2 THEN titles ELSE k || ' modifications' END AS level FROM base
  UNION ALL SELECT 'length', (n // 5 * 5) || '-' || (n // 5 * 5 + 4) FROM base
  UNION ALL SELECT 'charge', 'z' || z FROM base
  UNION ALL SELECT 'mass', (floor(mass / 500)::BIGINT * 500) || '-' || (floor(mass / 500)::BIGINT * 500 + 499) FROM base) GROUP BY 1, 2""",
)
def facet_labels(spark, sf):
    titles = chemistry.literal_map({f"UNIMOD:{a}": title for a, title, _, _ in MODIFICATIONS})
    s = sequence.proforma_sites(F.col("proforma"))
    rows = views.modified(spark, sf).select(
        F.length("peptide").alias("length"),
        (2 + F.length("peptide") % 3).alias("charge"),
        chemistry.mono_mass(F.col("peptide"), chemistry.mods_mass(s, DEFAULT_DELTAS)).alias("mass"),
        F.array_sort(F.array_distinct(F.transform(s, lambda x: F.try_element_at(titles, x["spec"])))).alias("titles"),
    )
    return facet_levels(rows, F.col("titles")).groupBy("facet", "level").agg(F.count(F.lit(1)).alias("rows"))


@add(
    "split_detector_filter",
    "P26",
    needs=("prepared",),
    sql="""SELECT spectrum_id, split, detector FROM prepared WHERE split IN ('train', 'val') AND detector = 'FTMS' AND irt IS NOT NULL""",
)
def split_detector_filter(spark, sf):
    return (
        views.prepared(spark, sf)
        .where(F.col("split").isin("train", "val") & (F.col("detector") == "FTMS") & spectra.finite(F.col("irt")))
        .select("spectrum_id", "split", "detector")
    )


@add(
    "sequence_validity",
    "P27",
    sql="""SELECT word, regexp_full_match(word, '[GASPVTCLINDQKEMHFRYW]+') AS valid, count(*) AS rows FROM (
  SELECT unnest(regexp_extract_all(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), '[A-Z]+')) AS word FROM documents) GROUP BY 1, 2""",
)
def sequence_validity(spark, sf):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z ]", ""))
    words = views.table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all(letters, F.lit("([A-Z]+)"), F.lit(1))).alias("word")
    )
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("word", sequence.is_valid_sequence(F.col("word")).alias("valid"), "rows")


@add(
    "dataset_names",
    "P28",
    sql=r"""SELECT archive, 'rec_' || lower(regexp_replace(CASE WHEN archive LIKE 'TUM\_%' ESCAPE '\' THEN substr(archive, 5) ELSE archive END, '_[1-9][0-9]*$', '')) AS dataset,
  regexp_replace(archive, '_[1-9][0-9]*$', '') || '_meta_data.parquet' AS metadata, archive LIKE 'TUM%' AS tagged FROM (
  SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'TUM_' ELSE '' END || replace(p_name, ' ', '_') || '_' || p_size AS archive FROM part)""",
)
def dataset_names(spark, sf):
    name = F.concat(
        F.when(F.col("p_partkey") % 2 == 0, "TUM_").otherwise(""),
        F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"),
    )
    a = F.col("archive")
    return views.table(spark, sf, "part").select(name.alias("archive")).distinct().select(
        "archive",
        sequence.dataset_name(a, "rec", "TUM_").alias("dataset"),
        sequence.metadata_name(a).alias("metadata"),
        a.startswith("TUM").alias("tagged"),
    )


@add(
    "spectrum_quality",
    "P29",
    needs=("prepared", "spectra"),
    sql="""SELECT dataset, proforma, charge, round(quality, 5) AS quality FROM prepared JOIN
  (SELECT spectrum_id AS sid, sum(value) AS quality FROM spectra GROUP BY 1) ON sid = spectrum_id""",
)
def spectrum_quality(spark, sf):
    """Precursor key and total intensity, missing entries not counted."""
    with_gaps = F.concat("ms2", F.array(F.lit(float("nan")).cast("float")))
    return views.prepared(spark, sf).select(
        "dataset", "proforma", "charge", F.round(spectra.nan_total(with_gaps), 5).alias("quality")
    )


@add(
    "grid_text",
    "P12",
    "P18",
    needs=("spectra",),
    sql="""SELECT spectrum_id, string_agg(printf('%.6f', value), ';' ORDER BY cell) AS grid FROM spectra GROUP BY 1""",
)
def grid_text(spark, sf):
    return views.spectra(spark, sf).select("spectrum_id", joined("ms2").alias("grid"))
