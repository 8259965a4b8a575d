"""Ranking, ordering and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import chemistry, spectra
from ionloom.operators import catalog, decoys, ordering, resolve, winners
from ionloom.queries import views
from ionloom.queries.base import Book
from ionloom.queries.q_joins import RESOLVED_SQL, scans

BOOK = Book()
add = BOOK.add


@add(
    "localization_resolve",
    "W1",
    needs=("candidates",),
    sql=f"""WITH {RESOLVED_SQL} SELECT raw_file, scan_number, CASE WHEN peptides = 1 THEN 'resolved' WHEN peptides > 1 THEN 'unidentifiable' ELSE 'unlocalizable' END AS status,
  any_unlocalizable, CASE WHEN peptides = 1 THEN modified_sequence ELSE '' END AS modified_sequence, CASE WHEN peptides = 1 THEN andromeda_score ELSE -1 END AS score FROM scans""",
)
def localization_resolve(spark, sf):
    one = F.col("status") == "resolved"
    return scans(spark, sf).select(
        "raw_file",
        "scan_number",
        "status",
        "any_unlocalizable",
        F.when(one, F.col("best.modified_sequence")).otherwise("").alias("modified_sequence"),
        F.when(one, F.col("best.andromeda_score")).otherwise(-1.0).alias("score"),
    )


@add(
    "resolution_counts",
    "W1",
    needs=("candidates",),
    sql=f"""WITH {RESOLVED_SQL} SELECT count(*) AS scans, count(*) FILTER (peptides = 1) AS resolved, count(*) FILTER (any_unlocalizable) AS unlocalizable,
  count(*) FILTER (peptides > 1) AS unidentifiable FROM scans""",
)
def resolution_counts(spark, sf):
    return resolve.resolution_counts(scans(spark, sf))


@add(
    "unscored_resolution",
    "W1",
    needs=("candidates",),
    sql="""WITH v AS (SELECT raw_file, scan_number, stripped, count(DISTINCT modified_sequence) > 1 AS tied FROM candidates GROUP BY 1, 2, 3),
s AS (SELECT raw_file, scan_number, count(*) FILTER (NOT tied) AS peptides, bool_or(tied) AS tied FROM v GROUP BY 1, 2)
SELECT count(*) AS scans, count(*) FILTER (peptides = 1) AS resolved, count(*) FILTER (tied) AS unlocalizable, count(*) FILTER (peptides > 1) AS unidentifiable FROM s""",
)
def unscored_resolution(spark, sf):
    """Without scores two placements are two placements, whatever the row order."""
    c = views.candidates(spark, sf).select("raw_file", "scan_number", "modified_sequence", "precursor_charge")
    verdicts = resolve.localization_verdicts(
        c, F.substring_index("modified_sequence", "/", 1), score=None, tie=["precursor_charge"]
    )
    return resolve.resolution_counts(resolve.resolve_scans(verdicts))


_WINNERS_SQL = """SELECT dataset, proforma, charge, spectrum_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, proforma, charge
  ORDER BY andromeda_score DESC NULLS LAST, spectrum_id) AS rn FROM prepared_many WHERE split = 'val') WHERE rn = 1"""

_MANY_SQL = """prepared_many AS (SELECT spectrum_id, dataset, 'P' || (spectrum_id % 13) AS proforma, charge, split, andromeda_score FROM prepared)"""


def replicated(spark, sf):
    """Prepared rows where many spectra share a peptidoform."""
    return views.prepared(spark, sf).withColumn(
        "proforma", F.concat(F.lit("P"), (F.col("spectrum_id") % 13).cast("string"))
    )


@add("validation_winners", "W6", "K5", needs=("prepared",), sql=f"WITH {_MANY_SQL} {_WINNERS_SQL}")
def validation_winners(spark, sf):
    return winners.validation_winners(replicated(spark, sf))


@add(
    "best_per_key",
    "W7",
    "F3",
    sql="""SELECT l_partkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
  ORDER BY l_extendedprice * (1 - l_discount) DESC, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def best_per_key(spark, sf):
    """Best row per key by a quality column the caller chooses."""
    rows = views.table(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"
    )
    quality = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    best = winners.best_per_key(rows, ["l_partkey"], quality, ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return best.drop("l_discount")


@add(
    "best_spectrum_per_precursor",
    "W7",
    "P29",
    needs=("prepared", "spectra"),
    sql="""WITH q AS (SELECT spectrum_id AS sid, sum(value::FLOAT::DOUBLE) AS quality FROM spectra GROUP BY 1)
SELECT dataset, charge, spectrum_id FROM (SELECT dataset, charge, spectrum_id, row_number() OVER (PARTITION BY dataset, charge ORDER BY quality DESC, spectrum_id) AS rn
  FROM prepared JOIN q ON sid = spectrum_id) WHERE rn = 1""",
)
def best_spectrum_per_precursor(spark, sf):
    rows = views.prepared(spark, sf).select("dataset", "charge", "spectrum_id", "ms2")
    best = winners.best_per_key(rows, ["dataset", "charge"], spectra.nan_total(F.col("ms2")), ["spectrum_id"])
    return best.drop("ms2")


@add(
    "strongest_peaks",
    "W8",
    needs=("spectra",),
    sql="""WITH top AS (SELECT * FROM spectra QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY value DESC, cell) <= 12)
SELECT spectrum_id, cell, row_number() OVER (PARTITION BY spectrum_id ORDER BY cell) - 1 AS place, round(value, 6) AS value FROM top""",
)
def strongest_peaks(spark, sf):
    peaks = F.transform("ms2", lambda x, i: F.struct(x.alias("intensity"), i.alias("cell")))
    kept = spectra.strongest(peaks, 12)
    return views.spectra(spark, sf).select("spectrum_id", F.posexplode(kept).alias("place", "p")).select(
        "spectrum_id", "place", "p.cell", F.col("p.intensity").alias("value")
    )


@add(
    "decoy_group_numbers",
    "W9",
    needs=("cleaved",),
    sql="""SELECT peptide, charge::BIGINT AS charge, (row_number() OVER (PARTITION BY charge ORDER BY peptide) - 1) * 3 + 1 + charge - 2 AS decoy_group FROM cleaved CROSS JOIN range(2, 5) r(charge)""",
)
def decoy_group_numbers(spark, sf):
    return decoys.number_decoy_groups(views.cleaved(spark, sf), [F.col("peptide").asc()], 2, 4)


@add(
    "missing_groups",
    "W10",
    sql="""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 5 END AS g FROM orders)
SELECT o_orderkey, coalesce(g, (SELECT max(g) FROM r) + row_number() OVER (PARTITION BY g IS NULL ORDER BY o_orderkey)) AS decoy_group FROM r""",
)
def missing_groups(spark, sf):
    rows = views.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 5).alias("decoy_group")
    )
    return decoys.fill_missing_groups(rows, [F.col("o_orderkey").asc()])


@add(
    "balanced_ranges",
    "W11",
    sql="""WITH w AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, sum(greatest(o_custkey % 97, 1)) OVER (ORDER BY o_orderkey) AS s FROM orders),
t AS (SELECT (SELECT max(s) FROM w) AS total), targets AS (SELECT part, total * part / 16.0::DOUBLE AS target FROM range(1, 16) r(part), t),
edges AS (SELECT 0 AS part, 0 AS place, 0 AS s UNION ALL SELECT part, arg_min(place, (abs(s - target), place)) AS place, arg_min(s, (abs(s - target), place)) FROM targets, w GROUP BY part
  UNION ALL SELECT 16, max(place), max(s) FROM w)
SELECT a.part::BIGINT AS part, a.place::BIGINT AS start, b.place::BIGINT AS stop, (b.s - a.s)::BIGINT AS weight FROM edges a JOIN edges b ON b.part = a.part + 1""",
)
def balanced_ranges(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("bytes"))
    return ordering.balanced_ranges(rows, [F.col("o_orderkey").asc()], "bytes", 16)


@add(
    "length_batches",
    "W12",
    needs=("cleaved",),
    sql="""SELECT peptide, length(peptide)::BIGINT AS length, (row_number() OVER (PARTITION BY length(peptide) ORDER BY peptide) - 1) // 256 AS batch FROM cleaved""",
)
def length_batches(spark, sf):
    rows = views.cleaved(spark, sf).withColumn("length", F.length("peptide"))
    return ordering.batches(rows, "length", [F.col("peptide").asc()], 256)


@add(
    "evenly_spaced",
    "W13",
    sql="""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM r WHERE place IN (SELECT floor(i * ((SELECT max(n) FROM r) - 1) / 36.0::DOUBLE)::BIGINT FROM range(0, 37) t(i))""",
)
def evenly_spaced(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey")
    return ordering.evenly_spaced(rows, [F.col("o_orderkey").asc()], 37)


@add(
    "reference_shortlist",
    "W14",
    needs=("prepared", "spectra"),
    sql="""WITH v AS (SELECT * FROM prepared WHERE split = 'val' AND detector = 'FTMS'
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY andromeda_score DESC NULLS LAST, spectrum_id) <= 10),
c AS (SELECT v.dataset, v.spectrum_id, v.andromeda_score, count(DISTINCT cell // 4) FILTER (value::FLOAT::DOUBLE / top >= 0.6) / 16.0::DOUBLE AS coverage FROM v
  JOIN (SELECT *, max(value::FLOAT::DOUBLE) OVER (PARTITION BY spectrum_id) AS top FROM spectra) s ON s.spectrum_id = v.spectrum_id GROUP BY 1, 2, 3),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY coverage DESC, andromeda_score DESC NULLS LAST, spectrum_id) = 1)
SELECT dataset, spectrum_id, round(coverage, 6) AS backbone_coverage, round(andromeda_score, 6) AS andromeda_score FROM best ORDER BY round(coverage, 4) DESC, dataset LIMIT 3""",
)
def reference_shortlist(spark, sf):
    return winners.reference_shortlist(views.prepared(spark, sf), 3, min_intensity=0.6, candidates=10)


@add(
    "task_range",
    "W15",
    sql="""SELECT o_orderkey, ordinal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders) WHERE ordinal >= 100 AND ordinal < 400""",
)
def task_range(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey")
    tasks = ordering.with_position(rows, [F.col("o_orderkey").asc()], "ordinal")
    return catalog.select_range(tasks, 100, 400, tasks.count())


@add(
    "sorted_peptides",
    "W16",
    needs=("cleaved",),
    sql="SELECT peptide, row_number() OVER (ORDER BY peptide) - 1 AS place FROM cleaved",
)
def sorted_peptides(spark, sf):
    return ordering.with_position(views.cleaved(spark, sf), [F.col("peptide").asc()], "place")


@add(
    "residue_prefix_sums",
    "W17",
    needs=("cleaved",),
    sql=f"""SELECT peptide, pos, round({views.sql_mass('substr(peptide, 1, pos + 1)')} + 1e-10, 6) AS prefix_mass FROM (
  SELECT peptide, unnest(range(0, length(peptide))) AS pos FROM cleaved)""",
)
def residue_prefix_sums(spark, sf):
    """Residue masses have nine decimals, so exact halves occur; a tiny shift rounds them one way."""
    sums = chemistry.prefix_sums(chemistry.residue_masses(F.col("peptide")))
    rows = views.cleaved(spark, sf).select("peptide", F.posexplode(sums).alias("pos", "prefix_mass"))
    return rows.withColumn("prefix_mass", F.col("prefix_mass") + 1e-10)
