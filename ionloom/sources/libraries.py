"""Tab-separated inputs: peptide lists, spectral libraries, reference panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.sequence import is_valid_proforma, library_peptide, stripped_sequence
from ionloom.functions.spectra import fragment_cell
from ionloom.operators.decoys import fill_missing_groups, require_valid_groups
from ionloom.operators.joins import require_empty

# --- Fixed values: column names of the two library exports ------------------------------------
_SHARED = {
    "peptide": "ModifiedPeptide",
    "charge": "PrecursorCharge",
    "normalized_rt": "Tr_recalibrated",
    "mobility": "IonMobility",
    "ion": "FragmentType",
    "fragment_charge": "FragmentCharge",
    "loss": "FragmentLossType",
}
LIBRARY_COLUMNS = {
    "diann": {
        **_SHARED,
        "intensity": "LibraryIntensity",
        "ordinal": "FragmentSeriesNumber",
        "decoy": "decoy",
        "exclude": "ExcludeFromAssay",
    },
    "spectronaut": {
        **_SHARED,
        "intensity": "RelativeIntensity",
        "ordinal": "FragmentNumber",
        "decoy": "Decoy",
    },
}
_DIANN_MARKS = ("FragmentSeriesNumber", "transition_group_id")
_SPECTRONAUT_MARKS = ("FragmentNumber", "ModifiedPeptide")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text with a header, all columns strings; a ragged row stops the job."""
    return (
        spark.read.option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def library_format(columns: list[str]) -> str:
    """Format by header. The richer export is tested first: it also has the other's columns."""
    if all(c in columns for c in _DIANN_MARKS):
        return "diann"
    if all(c in columns for c in _SPECTRONAUT_MARKS):
        return "spectronaut"
    raise ValueError(f"unrecognised spectral library header: {columns}")


def library_rows(
    raw: DataFrame, retention_column: str | None = None, line: Column | None = None
) -> DataFrame:
    """Library fragments under one set of names, whatever the export.

    ``retention_column`` names a column of real retention times; otherwise the normalized one is
    read. Decoys and excluded rows are flagged, not dropped: the counts need them.
    """
    names = LIBRARY_COLUMNS[library_format(raw.columns)]
    retention = retention_column or names["normalized_rt"]
    needed = [names[k] for k in ("peptide", "charge", "intensity", "ion", "ordinal", "fragment_charge")]
    missing = [c for c in [*needed, retention] if c not in raw.columns]
    if missing:
        raise ValueError(f"library is missing columns {missing}")

    def text(key: str) -> Column:
        name = names.get(key)
        return F.trim(F.col(name)) if name in raw.columns else F.lit("")

    flagged = raw.select(
        (F.monotonically_increasing_id() if line is None else line).alias("line"),
        F.col(names["peptide"]).alias("peptide_text"),
        _required(text("charge"), "int", "precursor charge").alias("charge"),
        _required(F.trim(F.col(retention)), "float", "retention time").alias("retention"),
        text("mobility").try_cast("float").alias("mobility"),
        F.substring(text("ion"), 1, 1).alias("ion"),
        F.coalesce(text("ordinal").try_cast("int"), F.lit(0)).alias("ordinal"),
        F.coalesce(text("fragment_charge").try_cast("int"), F.lit(0)).alias("fragment_charge"),
        F.coalesce(text("loss"), F.lit("")).isin("noloss", "", "none").alias("lossless"),
        F.coalesce(text("intensity").try_cast("float"), F.lit(0.0).cast("float")).alias("intensity"),
        (~F.coalesce(text("decoy"), F.lit("")).isin("0", "", "False", "false", "FALSE")).alias("decoy"),
        F.coalesce(text("exclude"), F.lit("")).isin("True", "true", "TRUE", "1").alias("excluded"),
    )
    # Only the residue count is needed per fragment; the peptide is parsed once per precursor.
    bare = F.regexp_replace("peptide_text", r"\[[^\]]*\]|\([^)]*\)|[_\s]", "")
    return flagged.withColumn("length", F.length(bare))


def _required(text: Column, kind: str, what: str) -> Column:
    value = text.try_cast(kind)
    return F.when(value.isNull(), F.raise_error(F.lit(f"unreadable {what}")).cast(kind)).otherwise(value)


def read_speclib(spark: SparkSession, path: str, retention_column: str | None = None) -> DataFrame:
    """Fragment rows of a library file; :func:`parsed_peptides` reads their peptides."""
    return library_rows(read_tsv(spark, path), retention_column)


def parsed_peptides(rows: DataFrame) -> DataFrame:
    """Rows with ``residues`` and ``shifts`` of their ``peptide_text``; unreadable text stops the job.

    Meant for one row per precursor or distinct text, not for every fragment.
    """
    valid = F.when(F.col("parsed.valid"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unreadable modified sequence "), F.col("peptide_text"))).cast("boolean")
    )
    return (
        rows.withColumn("parsed", library_peptide(F.col("peptide_text")))
        .where(valid)
        .select(*rows.columns, "parsed.residues", "parsed.shifts")
    )


def library_shifts(rows: DataFrame) -> DataFrame:
    """Distinct mass shifts of the target rows, with their spelling."""
    return distinct_shifts(parsed_peptides(rows.where(~F.col("decoy")).select("peptide_text").distinct()))


def distinct_shifts(peptides: DataFrame) -> DataFrame:
    """Distinct mass shifts of parsed peptides, with their spelling."""
    return (
        peptides.select(F.explode("shifts").alias("s"))
        .select(F.col("s.spelled").alias("spelled"), F.col("s.shift").alias("shift"))
        .distinct()
    )


def peptide_list_rows(raw: DataFrame, line: Column) -> DataFrame:
    """A peptide list's columns parsed, with a ``problem`` per row (null when there is none).

    ``raw`` has ``proforma, protein_ids`` and optionally ``decoy, decoy_group``.
    """
    for name in ("proforma", "protein_ids"):
        if name not in raw.columns:
            raise ValueError(f"peptide TSV needs a {name} column")
    optional = lambda name: F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in raw.columns else F.lit("")
    notation = F.col("proforma")
    charge_text = F.regexp_extract(notation, r"^(.*)/([^/]*)$", 2)
    peptide = F.regexp_extract(notation, r"^(.*)/([^/]*)$", 1)
    charge = charge_text.try_cast("int")
    proteins = F.transform(F.split(F.col("protein_ids"), ";"), lambda p: F.trim(p))
    decoy, group = optional("decoy"), optional("decoy_group")
    problem = (
        F.when(~F.contains(notation, F.lit("/")), "proforma must include charge")
        .when(charge.isNull() | (charge < 1), "invalid charge")
        .when(~is_valid_proforma(peptide), "invalid proforma")
        .when(F.exists(proteins, lambda p: p == ""), "empty protein id")
        .when(~decoy.isin("", "0", "false", "1", "true"), "invalid decoy flag")
        .when(decoy.isin("1", "true") & (group == ""), "a supplied decoy needs decoy_group")
        .when((group != "") & group.try_cast("bigint").isNull(), "decoy_group must be an integer")
    )
    return raw.select(
        line.alias("line"),
        peptide.alias("proforma"),
        charge.alias("charge"),
        proteins.alias("proteins"),
        decoy.isin("1", "true").alias("decoy"),
        group.try_cast("bigint").alias("decoy_group"),
        problem.alias("problem"),
    )


def read_peptide_list(spark: SparkSession, path: str) -> DataFrame:
    """A checked peptide list with complete group ids, in input order by ``line``."""
    rows = peptide_list_rows(read_tsv(spark, path), F.monotonically_increasing_id())
    require_empty(rows.where("problem is not null").select("line", "problem"), "invalid peptide TSV rows")
    if rows.isEmpty():
        raise ValueError("peptide TSV has no rows")
    filled = fill_missing_groups(rows.drop("problem"), [F.col("line").asc()])
    return require_valid_groups(filled)


def panel_cells(raw: DataFrame, keys: list[str]) -> DataFrame:
    """A reference panel's ``;`` lists as grid cells.

    ``raw`` has ``proforma, annotations, relative_intensity``. Lists of different lengths, or an
    annotation without a place on the grid, stop the job.
    """
    names = F.split("annotations", ";")
    values = F.split("relative_intensity", ";")
    pairs = F.when(
        F.size(names) == F.size(values), F.arrays_zip(names.alias("name"), values.alias("value"))
    ).otherwise(
        F.raise_error(F.lit("annotation and intensity counts differ")).cast("array<struct<name:string,value:string>>")
    )
    rows = raw.withColumn("length", F.length(stripped_sequence(F.col("proforma")))).select(
        *keys, "length", F.posexplode(pairs).alias("peak", "pair")
    )
    name = F.col("pair.name")
    charge = F.regexp_extract(name, r"\^(\d+)$", 1)
    cell = fragment_cell(
        F.substring(name, 1, 1),
        F.regexp_extract(name, r"^[a-zA-Z](\d+)", 1).try_cast("int"),
        F.when(charge == "", F.lit(1)).otherwise(charge.try_cast("int")),
        F.col("length"),
    )
    placed = F.when(
        cell.isNull(), F.raise_error(F.concat(F.lit("no grid cell for "), name)).cast("struct<site:int,col:int>")
    ).otherwise(cell)
    return rows.withColumn("cell", placed).select(
        *keys,
        "length",
        "peak",
        F.col("cell.site").alias("site"),
        F.col("cell.col").alias("col"),
        F.col("pair.value").try_cast("double").alias("intensity"),
    )
