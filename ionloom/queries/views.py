"""Stand-in inputs over the driver tables, in Spark and in SQL.

The tables hold no spectra; these views give them the shape of the real inputs over the whole
tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.constants import RESIDUE_MASS, WATER
from ionloom.operators.digest import DigestRules, digest
from ionloom.operators.ordering import with_group_position
from ionloom.session import spread

RULES = DigestRules()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def proteome(spark: SparkSession, sf: str) -> DataFrame:
    """Letters of each document as one protein; the six non-residue letters are mapped."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return (
        documents.select(
            F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("protein_id"),
            F.translate(letters, "BJOUXZ", "GLSTVE").alias("residues"),
        )
        .where("residues <> ''")
    )


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    return digest(proteome(spark, sf), RULES)


def cleaved(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct fully cleaved peptides."""
    return digest(proteome(spark, sf), DigestRules(missed_cleavages=0)).select("peptide").distinct()


def modified(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaved peptides in ProForma: oxidized M, carbamidomethyl C, acetylated leading A."""
    p = F.replace(F.col("peptide"), F.lit("M"), F.lit("M[UNIMOD:35]"))
    p = F.replace(p, F.lit("C"), F.lit("C[UNIMOD:4]"))
    lead = F.when(F.col("peptide").startswith("A"), F.concat(F.lit("[UNIMOD:1]-"), p)).otherwise(p)
    return cleaved(spark, sf).withColumn("proforma", lead)


def psms(spark: SparkSession, sf: str) -> DataFrame:
    """Events as peptide-spectrum matches."""
    ts = F.col("ts")
    minutes = (
        F.hour(ts) * 60 + F.minute(ts) + F.date_part(F.lit("SECOND"), ts).cast("double") / F.lit(60.0)
    )
    eid = F.col("event_id")
    return table(spark, sf, "events").select(
        eid.alias("spectrum_id"),
        F.concat(F.lit("run"), (F.col("user_id") % 20).cast("string")).alias("raw_file"),
        eid.alias("scan_number"),
        F.col("event_type").alias("proforma"),
        (2 + eid % 2).alias("charge"),
        F.when(eid % 3 == 0, "ITMS").when(eid % 7 != 1, "FTMS").alias("detector"),
        F.when(eid % 11 != 2, "HCD").alias("fragmentation"),
        F.when(eid % 13 != 3, ((eid % 4) * 10).cast("double")).alias("energy"),
        minutes.alias("raw_rt"),
        F.col("value").alias("precursor_intensity"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("andromeda_score"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as candidate assignments of scans."""
    stripped = F.concat(F.lit("P"), (F.col("l_partkey") % 3).cast("string"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("run"), (F.col("l_suppkey") % 10).cast("string")).alias("raw_file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scan_number"),
        stripped.alias("stripped"),
        F.concat(stripped, F.lit("/"), F.col("l_returnflag")).alias("modified_sequence"),
        (2 + F.col("l_suppkey") % 2).alias("precursor_charge"),
        F.col("l_quantity").alias("andromeda_score"),
    )


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as long fragment annotations."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("run"), (F.col("l_suppkey") % 10).cast("string")).alias("raw_file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scan_number"),
        F.when(F.col("l_linestatus") == "F", "b").otherwise("y").alias("ion_type"),
        F.col("l_linenumber").cast("bigint").alias("no"),
        (1 + F.col("l_partkey") % 3).alias("charge"),
        F.col("l_extendedprice").alias("intensity"),
        F.when(F.col("l_tax") > 0.06, "H2O").alias("neutral_loss"),
    )


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as flat grids of 16 sites by 4 ions, one context per label."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("spectrum_id"),
        F.col("label").cast("bigint").alias("context"),
        F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("ms2"),
    )


_DIGITS = ("0123456789", "ACDEFGHIKM")


def coded_peptide(number: Column, length: int) -> Column:
    """A peptide spelled from a number's digits, ending in K."""
    return F.concat(
        F.translate(F.lpad(number.cast("string"), length - 1, "0"), *_DIGITS), F.lit("K")
    )


_HEX = ("0123456789abcdef", "ACDEFGHILMNPQSTV")


def hashed_peptide(number: Column) -> Column:
    """A varied 17-residue peptide spelled from a number's hash, ending in K."""
    head = F.substring(F.md5(number.cast("string")), 1, 16)
    return F.concat(F.translate(head, *_HEX), F.lit("K"))


def precursors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as precursors of varied 17-residue peptides with their grid as prediction."""
    return spectra(spark, sf).select(
        "spectrum_id",
        "context",
        hashed_peptide(F.col("spectrum_id")).alias("peptide"),
        (2 + F.col("spectrum_id") % 2).alias("charge"),
        (F.col("context") * 7.5 + 0.25).alias("rt"),
        (F.lit(300.0) + F.col("spectrum_id") % 50).alias("ccs"),
        "ms2",
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each spectrum with the next one of its label: predicted and observed."""
    placed = with_group_position(
        spectra(spark, sf), ["context"], [F.col("spectrum_id").asc()], "place"
    )
    following = placed.select(
        "context", (F.col("place") - 1).alias("place"), F.col("ms2").alias("observed")
    )
    return placed.join(following, ["context", "place"]).select(
        "spectrum_id", "context", F.col("ms2").alias("predicted"), "observed"
    )


def retention_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as observed and predicted values per priority."""
    predicted = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("predicted")
    )
    return table(spark, sf, "orders").join(predicted, "o_orderkey").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_totalprice").alias("observed"),
        "predicted",
    )


def library_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as lines of a library export, peptides coded from part numbers."""
    text = coded_peptide(F.col("l_partkey"), 9)
    text = F.replace(F.replace(text, F.lit("M"), F.lit("M[+15.9949]")), F.lit("C"), F.lit("C[+57.0215]"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("_"), text, F.lit("_")).alias("ModifiedPeptide"),
        (2 + F.col("l_suppkey") % 2).alias("PrecursorCharge"),
        (F.col("l_partkey") % 120 + 0.5).alias("Tr_recalibrated"),
        (F.lit(0.5) + (F.col("l_partkey") % 10) * 0.1).alias("IonMobility"),
        F.when(F.col("l_linestatus") == "F", "b").otherwise("y").alias("FragmentType"),
        F.col("l_linenumber").cast("bigint").alias("FragmentNumber"),
        (1 + F.col("l_partkey") % 3).alias("FragmentCharge"),
        F.when(F.col("l_tax") > 0.06, "H2O").otherwise("noloss").alias("FragmentLossType"),
        F.col("l_extendedprice").alias("RelativeIntensity"),
        F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("Decoy"),
    )


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings under the prepared contract (signed-bit identifiers)."""
    sid = F.col("spectrum_id")
    return precursors(spark, sf).select(
        sid.alias("spectrum_id"),
        F.concat(F.lit("set"), (F.col("context") % 4).cast("string")).alias("dataset"),
        F.concat(F.lit("run"), (sid % 7).cast("string")).alias("raw_file"),
        sid.alias("scan_number"),
        F.concat(F.lit("[UNIMOD:1]-"), F.col("peptide")).alias("proforma"),
        F.col("charge"),
        F.when(sid % 10 < 6, "train").when(sid % 10 < 9, "val").otherwise("test").alias("split"),
        F.when(sid % 5 != 0, F.col("rt")).otherwise(F.lit(float("nan"))).alias("irt"),
        F.col("rt").alias("raw_rt"),
        F.lit("Lumos").alias("instrument"),
        F.when(sid % 3 == 0, "ITMS").otherwise("FTMS").alias("detector"),
        F.lit("HCD").alias("fragmentation"),
        F.lit(30.0).alias("energy"),
        F.when(sid % 11 != 0, (sid * 37 % 101).cast("double")).otherwise(F.lit(float("nan"))).alias("andromeda_score"),
        F.transform("ms2", lambda x: x.cast("float")).alias("ms2"),
    )


# --- the same views in SQL ---------------------------------------------------------------------

_MASSES = {k: f"{v!r}::DOUBLE" for k, v in RESIDUE_MASS.items()}


def sql_mass(expression: str) -> str:
    """Residue mass of a text expression, as counts times masses."""
    terms = " + ".join(
        f"(length({expression}) - length(replace({expression}, '{r}', ''))) * {m}"
        for r, m in sorted(_MASSES.items())
    )
    return f"({terms})"


SQL_WATER = f"{WATER!r}::DOUBLE"


def sql_coded(number: str, length: int) -> str:
    return f"translate(lpad({number}::VARCHAR, {length - 1}, '0'), '{_DIGITS[0]}', '{_DIGITS[1]}') || 'K'"


SQL = {
    "proteome": """SELECT * FROM (SELECT 'D' || doc_id AS protein_id,
  translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOUXZ', 'GLSTVE') AS residues
  FROM documents) WHERE residues <> ''""",
    "numbered": """SELECT protein_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (
  SELECT protein_id, string_split(rtrim(replace(replace(replace(residues, 'K', 'K|'), 'R', 'R|'), '|P', 'P'), '|'), '|') AS pieces
  FROM proteome)""",
    "joined_pieces": """SELECT protein_id, piece AS p0, lead(piece, 1) OVER w AS p1, lead(piece, 2) OVER w AS p2
  FROM numbered WINDOW w AS (PARTITION BY protein_id ORDER BY i)""",
    "memberships": """SELECT protein_id, peptide FROM (
  SELECT protein_id, p0 AS peptide FROM joined_pieces
  UNION ALL SELECT protein_id, p0 || p1 FROM joined_pieces WHERE p1 IS NOT NULL
  UNION ALL SELECT protein_id, p0 || p1 || p2 FROM joined_pieces WHERE p2 IS NOT NULL)
  WHERE length(peptide) BETWEEN 7 AND 30""",
    "cleaved": "SELECT DISTINCT piece AS peptide FROM numbered WHERE length(piece) BETWEEN 7 AND 30",
    "modified": """SELECT peptide, CASE WHEN peptide LIKE 'A%' THEN '[UNIMOD:1]-' ELSE '' END
  || replace(replace(peptide, 'M', 'M[UNIMOD:35]'), 'C', 'C[UNIMOD:4]') AS proforma FROM cleaved""",
    "psms": r"""SELECT event_id AS spectrum_id, 'run' || (user_id % 20) AS raw_file, event_id AS scan_number,
  event_type AS proforma, 2 + event_id % 2 AS charge,
  CASE WHEN event_id % 3 = 0 THEN 'ITMS' WHEN event_id % 7 <> 1 THEN 'FTMS' END AS detector, CASE WHEN event_id % 11 <> 2 THEN 'HCD' END AS fragmentation,
  CASE WHEN event_id % 13 <> 3 THEN ((event_id % 4) * 10)::DOUBLE END AS energy,
  hour(ts) * 60 + minute(ts) + (microsecond(ts) / 1e6) / 60.0::DOUBLE AS raw_rt,
  value AS precursor_intensity, regexp_extract(props, '(\d+)', 1)::DOUBLE AS andromeda_score FROM events""",
    "candidates": """SELECT 'run' || (l_suppkey % 10) AS raw_file, l_orderkey * 10 + l_linenumber AS scan_number,
  'P' || (l_partkey % 3) AS stripped, 'P' || (l_partkey % 3) || '/' || l_returnflag AS modified_sequence,
  2 + l_suppkey % 2 AS precursor_charge, l_quantity AS andromeda_score FROM lineitem""",
    "fragments": """SELECT 'run' || (l_suppkey % 10) AS raw_file, l_orderkey * 10 + l_linenumber AS scan_number,
  CASE WHEN l_linestatus = 'F' THEN 'b' ELSE 'y' END AS ion_type, l_linenumber::BIGINT AS no,
  1 + l_partkey % 3 AS charge, l_extendedprice AS intensity,
  CASE WHEN l_tax > 0.06 THEN 'H2O' END AS neutral_loss FROM lineitem""",
    "cells": """SELECT vec_id AS spectrum_id, label::BIGINT AS context, unnest(embedding)::DOUBLE AS signed,
  generate_subscripts(embedding, 1) - 1 AS cell FROM embeddings""",
    "spectra": "SELECT spectrum_id, context, cell, abs(signed) AS value FROM cells",
    "precursors": f"""SELECT vec_id AS spectrum_id, label::BIGINT AS context, translate(substr(md5(vec_id::VARCHAR), 1, 16), '{_HEX[0]}', '{_HEX[1]}') || 'K' AS peptide,
  2 + vec_id % 2 AS charge, label * 7.5::DOUBLE + 0.25::DOUBLE AS rt, 300.0::DOUBLE + vec_id % 50 AS ccs FROM embeddings""",
    "pair_ids": """SELECT * FROM (SELECT vec_id AS spectrum_id, label::BIGINT AS context,
  lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS next_id FROM embeddings) WHERE next_id IS NOT NULL""",
    "pair_cells": """SELECT p.spectrum_id, p.context, a.cell, a.value AS predicted, b.value AS observed
  FROM pair_ids p JOIN spectra a ON a.spectrum_id = p.spectrum_id
  JOIN spectra b ON b.spectrum_id = p.next_id AND b.cell = a.cell""",
    "pair_angles": """SELECT spectrum_id, context, 1 - 2 * acos(greatest(least(
  sum(predicted * observed) / (sqrt(sum(predicted * predicted)) * sqrt(sum(observed * observed))), 1), -1)) / pi() AS angle,
  sum(predicted * observed) / (sqrt(sum(predicted * predicted)) * sqrt(sum(observed * observed))) AS cosine
  FROM pair_cells GROUP BY 1, 2""",
    "retention_pairs": """SELECT o_orderkey, o_orderpriority AS dataset, o_totalprice AS observed, predicted
  FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS predicted FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "library_lines": f"""SELECT '_' || replace(replace({sql_coded('l_partkey', 9)}, 'M', 'M[+15.9949]'), 'C', 'C[+57.0215]') || '_' AS text,
  {sql_coded('l_partkey', 9)} AS residues, 2 + l_suppkey % 2 AS charge,
  l_partkey % 120 + 0.5::DOUBLE AS retention, 0.5::DOUBLE + (l_partkey % 10) * 0.1::DOUBLE AS mobility,
  CASE WHEN l_linestatus = 'F' THEN 'b' ELSE 'y' END AS ion, l_linenumber::BIGINT AS ordinal,
  1 + l_partkey % 3 AS fragment_charge, l_tax <= 0.06 AS lossless, l_extendedprice AS intensity,
  l_returnflag = 'R' AS decoy, l_partkey FROM lineitem""",
    "prepared": """SELECT spectrum_id, 'set' || (context % 4) AS dataset, 'run' || (spectrum_id % 7) AS raw_file,
  spectrum_id AS scan_number, '[UNIMOD:1]-' || peptide AS proforma, peptide, charge,
  CASE WHEN spectrum_id % 10 < 6 THEN 'train' WHEN spectrum_id % 10 < 9 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN spectrum_id % 5 <> 0 THEN rt END AS irt, rt AS raw_rt,
  CASE WHEN spectrum_id % 3 = 0 THEN 'ITMS' ELSE 'FTMS' END AS detector,
  CASE WHEN spectrum_id % 11 <> 0 THEN (spectrum_id * 37 % 101)::DOUBLE END AS andromeda_score FROM precursors""",
}

_NEEDS = {
    "numbered": ("proteome",),
    "joined_pieces": ("numbered",),
    "memberships": ("joined_pieces",),
    "cleaved": ("numbered",),
    "modified": ("cleaved",),
    "spectra": ("cells",),
    "pair_cells": ("pair_ids", "spectra"),
    "pair_angles": ("pair_cells",),
    "prepared": ("precursors",),
}


def with_views(needs: tuple[str, ...], body: str) -> str:
    """``body`` with the named views (and theirs) as common table expressions before it.

    A body may bring expressions of its own by starting with ``WITH``.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for inner in _NEEDS.get(name, ()):
            add(inner)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return body
    heads = ",\n".join(f"{name} AS ({SQL[name]})" for name in ordered)
    text = body.strip()
    if text[:5].upper() == "WITH ":
        rest = text[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {heads},\n{rest[10:]}"
        return f"WITH {heads},\n{rest}"
    return f"WITH {heads}\n{text}"


def sql_uniform(seed: str, *parts: str) -> str:
    """The md5-based uniform number of :func:`ionloom.functions.hashing.uniform`."""
    text = " || '|' || ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / {float(16**13)!r}::DOUBLE)"
