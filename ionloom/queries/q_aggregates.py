"""Aggregation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.constants import REFUSAL_REASONS
from ionloom.functions import chemistry, spectra
from ionloom.operators import catalog, decoys, evaluate, library, ordering, reports, resolve, winners
from ionloom.operators.curation import REPORT_QUANTILES, SUBSETS, leave_one_out_angles
from ionloom.queries import views
from ionloom.queries.base import Book, joined
from ionloom.queries.q_curation import flagged_spectra
from ionloom.queries.q_joins import RESOLVED_SQL, scans
from ionloom.sources import libraries

BOOK = Book()
add = BOOK.add


def fragment_cells(spark, sf):
    meta = resolve.resolved_metadata(scans(spark, sf)).select("raw_file", "scan_number").withColumn("length", F.lit(8))
    return resolve.fragment_cells(resolve.keep_backbone_fragments(views.fragments(spark, sf)), meta)


_CELLS_SQL = f"""{RESOLVED_SQL},
kept AS (SELECT f.raw_file, f.scan_number, CASE ion_type WHEN 'b' THEN no - 1 ELSE 7 - no END AS site,
  CASE ion_type WHEN 'b' THEN 0 ELSE 1 END + 2 * (charge - 1) AS col, intensity FROM fragments f
  JOIN resolved r ON r.raw_file = f.raw_file AND r.scan_number = f.scan_number
  WHERE charge IN (1, 2) AND neutral_loss IS NULL AND no BETWEEN 1 AND 7),
grid AS (SELECT raw_file, scan_number, site, col, max(intensity) AS intensity FROM kept GROUP BY 1, 2, 3, 4)"""


@add(
    "max_collapse",
    "A1",
    needs=("candidates", "fragments"),
    sql=f"WITH {_CELLS_SQL} SELECT raw_file, scan_number, site::BIGINT AS site, col::BIGINT AS col, intensity FROM grid",
)
def max_collapse(spark, sf):
    return fragment_cells(spark, sf).drop("length")


@add(
    "dense_grid",
    "A2",
    needs=("candidates", "fragments"),
    sql=f"""WITH {_CELLS_SQL}, spine AS (SELECT DISTINCT raw_file, scan_number, unnest(range(0, 28)) AS cell FROM grid)
SELECT s.raw_file, s.scan_number, string_agg(printf('%.1f', coalesce(intensity::FLOAT::DOUBLE, 0)), ';' ORDER BY cell) AS ms2
FROM spine s LEFT JOIN grid g ON g.raw_file = s.raw_file AND g.scan_number = s.scan_number AND g.site * 4 + g.col = s.cell GROUP BY 1, 2""",
)
def dense_grid(spark, sf):
    rows = resolve.dense_spectra(fragment_cells(spark, sf))
    return rows.select("raw_file", "scan_number", joined("ms2", 1).alias("ms2"))


_QUANTILES_SQL = ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in REPORT_QUANTILES.items())


@add(
    "quantile_sets",
    "A7",
    sql=f"""SELECT measure, count(*) AS n, {_QUANTILES_SQL} FROM (SELECT l_returnflag || l_linestatus AS measure, l_extendedprice AS v FROM lineitem) GROUP BY 1""",
)
def quantile_sets(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("measure"), "l_extendedprice"
    )
    return ordering.exact_quantiles(rows, ["measure"], "l_extendedprice", REPORT_QUANTILES)


@add(
    "overall_quantiles",
    "A7",
    sql="SELECT count(v) AS n, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in evaluate.FIVE_QUANTILES.items())
    + " FROM (SELECT CASE WHEN event_id % 13 <> 0 THEN value END AS v FROM events)",
)
def overall_quantiles(spark, sf):
    value = F.when(F.col("event_id") % 13 != 0, F.col("value")).otherwise(F.lit(float("nan")))
    rows = views.table(spark, sf, "events").select(value.alias("v"))
    return ordering.exact_quantiles(rows, [], "v", evaluate.FIVE_QUANTILES)


def pair_scores(spark, sf):
    a, b = F.col("predicted"), F.col("observed")
    return views.pairs(spark, sf).select(
        "spectrum_id", "context", spectra.cosine(a, b).alias("cosine"), spectra.spectral_angle(a, b).alias("angle")
    )


_HISTOGRAM_SQL = """binned AS (SELECT context % 3 AS grp, CASE WHEN v BETWEEN 0 AND 1 THEN least(floor(v * 50), 49) END AS bin FROM (
  SELECT context, CASE WHEN spectrum_id % 17 = 0 THEN 1.0 WHEN spectrum_id % 19 = 0 THEN -0.5 ELSE angle END AS v FROM pair_angles)),
groups AS (SELECT grp, count(*) AS total, count(bin) AS counted FROM binned GROUP BY 1),
hist AS (SELECT g.grp, s.bin, count(b.bin) AS count, any_value(counted) AS counted, any_value(total) AS total FROM groups g
  CROSS JOIN range(0, 50) s(bin) LEFT JOIN binned b ON b.grp = g.grp AND b.bin = s.bin GROUP BY 1, 2)"""


def planted_histogram(spark, sf):
    sid = F.col("spectrum_id")
    value = F.when(sid % 17 == 0, 1.0).when(sid % 19 == 0, -0.5).otherwise(F.col("angle"))
    rows = pair_scores(spark, sf).select((F.col("context") % 3).alias("grp"), value.alias("v"))
    return evaluate.angle_histogram(rows, ["grp"], "v")


@add(
    "angle_histogram",
    "A8",
    needs=("pair_angles",),
    sql=f"WITH {_HISTOGRAM_SQL} SELECT grp, bin, count, counted, total FROM hist",
)
def angle_histogram(spark, sf):
    """Fixed grid with the end point counted and values outside only in the total."""
    return planted_histogram(spark, sf)


@add(
    "merged_histogram",
    "A8",
    needs=("pair_angles",),
    sql=f"WITH {_HISTOGRAM_SQL} SELECT bin, sum(count)::BIGINT AS count FROM hist GROUP BY 1",
)
def merged_histogram(spark, sf):
    return evaluate.merge_histograms(planted_histogram(spark, sf), [])


@add(
    "histogram_summary",
    "A9",
    needs=("pair_angles",),
    sql=f"""WITH {_HISTOGRAM_SQL}, c AS (SELECT grp, bin, count, sum(count) OVER (PARTITION BY grp ORDER BY bin) AS upto,
  sum(count) OVER (PARTITION BY grp) AS n FROM hist)
SELECT grp, max(n)::BIGINT AS n, round(sum(count * (bin + 0.5) * 0.02::DOUBLE) / max(n), 6) AS mean,
  round(max(CASE WHEN upto >= n / 2.0 AND upto - count < n / 2.0 THEN (bin + (n / 2.0 - (upto - count)) / count) * 0.02::DOUBLE END), 6) AS median
FROM c GROUP BY 1""",
)
def histogram_summary(spark, sf):
    return evaluate.histogram_summary(planted_histogram(spark, sf), ["grp"])


@add(
    "sufficient_statistics",
    "A11",
    needs=("prepared",),
    sql="""WITH p AS (SELECT dataset, count(irt) AS n, coalesce(sum(irt), 0) AS s, coalesce(sum(irt * irt), 0) AS q FROM prepared WHERE split = 'train' GROUP BY 1)
SELECT dataset, n, round(s, 4) AS sum, round(q, 4) AS sumsq FROM p""",
)
def sufficient_statistics(spark, sf):
    rows = views.prepared(spark, sf).where("split = 'train'")
    stats = evaluate.sufficient_statistics(rows, ["dataset"], "irt")
    return stats.select("dataset", "n", F.round("sum", 4).alias("sum"), F.round("sumsq", 4).alias("sumsq"))


@add(
    "combined_statistics",
    "A11",
    needs=("prepared",),
    sql="""SELECT count(irt) AS n, round(avg(irt), 6) AS mean, round(stddev_pop(irt), 6) AS std FROM prepared WHERE split = 'train'""",
)
def combined_statistics(spark, sf):
    """Per-dataset statistics added up give the corpus mean and spread."""
    rows = views.prepared(spark, sf).where("split = 'train'")
    return evaluate.combine_statistics(evaluate.sufficient_statistics(rows, ["dataset"], "irt"), [])


@add(
    "split_rows",
    "A12",
    needs=("prepared",),
    sql="SELECT split, count(*) AS rows FROM prepared GROUP BY 1",
)
def split_rows(spark, sf):
    return catalog.split_rows(views.prepared(spark, sf))


@add(
    "split_datasets",
    "A12",
    needs=("prepared",),
    sql="SELECT dataset, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT dataset, split FROM prepared) GROUP BY 1",
)
def split_datasets(spark, sf):
    return catalog.split_datasets(views.prepared(spark, sf)).select("dataset", F.array_join("splits", ",").alias("splits"))


@add(
    "regression",
    "A13",
    needs=("retention_pairs",),
    sql="""SELECT dataset, count(*) AS n, round(coalesce(regr_slope(predicted, observed), 0), 6) AS slope,
  round(avg(predicted) - coalesce(regr_slope(predicted, observed), 0) * avg(observed), 3) AS intercept,
  round(coalesce(regr_r2(predicted, observed), 0), 6) AS r_squared, round(avg(abs(observed - predicted)), 3) AS mae
FROM retention_pairs GROUP BY 1""",
)
def regression(spark, sf):
    fit = evaluate.regression(views.retention_pairs(spark, sf), ["dataset"], "observed", "predicted")
    return fit.withColumn("intercept", F.round("intercept", 3)).withColumn("mae", F.round("mae", 3))


@add(
    "affine_residuals",
    "A14",
    needs=("retention_pairs",),
    sql="""WITH fit AS (SELECT dataset, regr_slope(predicted, observed) AS a, regr_intercept(predicted, observed) AS b, corr(predicted, observed) AS c FROM retention_pairs GROUP BY 1)
SELECT p.dataset, count(*) AS n, round(max(c * c), 6) AS r_squared, round(avg(abs(observed - (predicted - b) / a)) / 1e6, 4) AS residual_mae
FROM retention_pairs p JOIN fit ON fit.dataset = p.dataset GROUP BY 1""",
)
def affine_residuals(spark, sf):
    """Residual in millions: a nearly flat slope magnifies it, and the rounding with it."""
    fit = evaluate.affine_residuals(views.retention_pairs(spark, sf), ["dataset"], "observed", "predicted")
    return fit.withColumn("residual_mae", F.round(F.col("residual_mae") / 1e6, 4))


@add(
    "anchor_check",
    "A15",
    sql="""WITH p AS (SELECT n_regionkey AS scale, CASE WHEN n_nationkey % 2 = 0 THEN 'TFAHTESHISK' ELSE 'SILDYVSLVEK' END AS sequence,
  CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 100 END + (n_nationkey - 12) * 0.15::DOUBLE AS predicted FROM nation)
SELECT scale::BIGINT AS scale, count(DISTINCT sequence) AS anchors, round(max(abs(predicted - CASE sequence WHEN 'TFAHTESHISK' THEN 0 ELSE 100 END)), 6) AS max_abs_error,
  max(abs(predicted - CASE sequence WHEN 'TFAHTESHISK' THEN 0 ELSE 100 END)) <= 2.0 AS on_scale FROM p GROUP BY 1""",
)
def anchor_check(spark, sf):
    even = F.col("n_nationkey") % 2 == 0
    rows = views.table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("scale"),
        F.when(even, "TFAHTESHISK").otherwise("SILDYVSLVEK").alias("sequence"),
        (F.when(even, 0.0).otherwise(100.0) + (F.col("n_nationkey") - 12) * 0.15).alias("predicted"),
    )
    return evaluate.anchor_check(rows)


def library_input(spark, sf):
    """Library rows in an order every engine can repeat: by intensity."""
    return libraries.library_rows(views.library_lines(spark, sf), line=F.col("RelativeIntensity"))


@add(
    "library_precursors",
    "A17",
    "S4",
    needs=("library_lines",),
    sql="""SELECT text AS peptide_text, charge, round(any_value(retention), 6) AS retention, round(any_value(mobility)::FLOAT::DOUBLE, 6) AS mobility,
  count(*) FILTER (ok) AS fragments, sum(n) FILTER (ok)::BIGINT AS fragment_rows, coalesce(sum(n) FILTER (NOT ok), 0)::BIGINT AS fragments_dropped,
  round(sum(top::FLOAT::DOUBLE) FILTER (ok), 2) AS intensity FROM (
  SELECT text, charge, ok, site, col, any_value(retention) AS retention, any_value(mobility) AS mobility, max(intensity) AS top, count(*) AS n FROM (
    SELECT *, CASE WHEN ok THEN CASE ion WHEN 'b' THEN ordinal - 1 ELSE 8 - ordinal END END AS site, CASE WHEN ok THEN ion || fragment_charge END AS col FROM (
    SELECT *, lossless AND fragment_charge <= 2 AND ordinal BETWEEN 1 AND 8 AS ok FROM library_lines WHERE NOT decoy)) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2
  HAVING count(*) FILTER (ok) > 0""",
)
def library_precursors(spark, sf):
    rows = library.library_precursors(library_input(spark, sf)).where(F.size("fragments") > 0)
    return rows.select(
        "peptide_text",
        "charge",
        "retention",
        "mobility",
        F.size("fragments").alias("fragments"),
        "fragment_rows",
        "fragments_dropped",
        F.round(spectra.total(F.transform("fragments", lambda f: f["intensity"])), 2).alias("intensity"),
    )


@add(
    "reader_counts",
    "A16",
    needs=("library_lines",),
    sql="""WITH ok AS (SELECT text, charge, decoy, lossless AND fragment_charge <= 2 AND ordinal BETWEEN 1 AND 8 AS ok FROM library_lines),
p AS (SELECT text, charge, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM ok WHERE NOT decoy GROUP BY 1, 2)
SELECT (SELECT count(*) FROM ok) AS rows, (SELECT count(*) FROM ok WHERE decoy) AS decoys, 0::BIGINT AS excluded,
  count(*) FILTER (kept > 0) AS precursors, count(*) FILTER (kept = 0) AS precursors_without_fragments, sum(dropped)::BIGINT AS fragments_dropped FROM p""",
)
def reader_counts(spark, sf):
    rows = library_input(spark, sf)
    return library.reader_counts(rows, library.library_precursors(rows))


def shard_reports(spark, sf):
    """One curated shard per supplier."""
    s = views.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("set"), (F.col("s_nationkey") % 6).cast("string")).alias("dataset"),
        k.alias("shard"),
        (k * 10 + 5).alias("rows"),
        F.when(k % 8 == 0, 0).otherwise(k * 2).alias("selected_rows"),
        (k % 5).alias("missing_intensity_rows"),
        (k + 3).alias("peptidoform_groups"),
        (k % 4).alias("rejected_peptidoforms"),
        F.lit(2).alias("runs"),
        (k % 3).alias("clamped_runs"),
        F.when(k % 10 == 0, "policy b").otherwise("policy a").alias("policy"),
        F.when(k % 7 != 0, F.lit(2)).alias("policy_version"),
    )


_SUMMARY_COLUMNS = """count(*) AS shards, count(*) FILTER (selected_rows = 0) AS empty_shards, count(DISTINCT policy) AS distinct_policies,
  string_agg(DISTINCT version, ',' ORDER BY version) AS policy_versions, sum(rows)::BIGINT AS rows, sum(selected_rows)::BIGINT AS selected_rows,
  sum(missing)::BIGINT AS missing_intensity_rows, sum(peptidoform_groups)::BIGINT AS peptidoform_groups,
  sum(rejected)::BIGINT AS rejected_peptidoforms, sum(runs)::BIGINT AS runs, sum(clamped)::BIGINT AS clamped_runs,
  round(sum(selected_rows) / sum(rows), 6) AS retention, round(sum(missing) / sum(rows), 6) AS missing_intensity_fraction"""


_CEILING_SQL = """flagged AS (SELECT *, spectrum_id % 3 <> 0 AS win, spectrum_id % 5 = 1 AS sel, value / sqrt(sum(value * value) OVER (PARTITION BY spectrum_id)) AS u FROM spectra),
subsets AS (SELECT 'all' AS subset, spectrum_id, context, cell, u FROM flagged UNION ALL SELECT 'within_apex_window', spectrum_id, context, cell, u FROM flagged WHERE win
  UNION ALL SELECT 'selected', spectrum_id, context, cell, u FROM flagged WHERE sel),
peers AS (SELECT *, sum(u) OVER (PARTITION BY subset, context, cell) - u AS p, count(*) OVER (PARTITION BY subset, context, cell) AS n FROM subsets),
angles AS (SELECT subset, spectrum_id, 1 - 2 * acos(greatest(least(sum(u * p) / sqrt(sum(p * p)), 1), -1)) / pi() AS angle FROM peers WHERE n >= 2 GROUP BY 1, 2),
binned AS (SELECT 'set' || (s_nationkey % 6) AS dataset, subset, CASE WHEN angle BETWEEN 0 AND 1 THEN least(floor(angle * 50), 49) END AS bin FROM angles JOIN supplier ON s_suppkey = spectrum_id % 7 + 1),
both_grains AS (SELECT * FROM binned UNION ALL SELECT '*', subset, bin FROM binned),
ceilings AS (SELECT dataset, """ + ", ".join(
    f"count(bin) FILTER (subset = '{s}') AS ceiling_{s}_replicates, round(avg((bin + 0.5::DOUBLE) / 50) FILTER (subset = '{s}'), 6) AS ceiling_{s}_mean, "
    f"(sum(bin * bin) FILTER (subset = '{s}'))::BIGINT AS ceiling_{s}_digest"
    for s in ("all", "within_apex_window", "selected")
) + " FROM both_grains GROUP BY 1)"


@add(
    "corpus_summary",
    "A18",
    needs=("spectra",),
    sql=f"""WITH {_CEILING_SQL}, shards AS (SELECT 'set' || (s_nationkey % 6) AS dataset, s_suppkey * 10 + 5 AS rows,
  CASE WHEN s_suppkey % 8 = 0 THEN 0 ELSE s_suppkey * 2 END AS selected_rows, s_suppkey % 5 AS missing, s_suppkey + 3 AS peptidoform_groups,
  s_suppkey % 4 AS rejected, 2 AS runs, s_suppkey % 3 AS clamped, CASE WHEN s_suppkey % 10 = 0 THEN 'policy b' ELSE 'policy a' END AS policy,
  CASE WHEN s_suppkey % 7 <> 0 THEN '2' ELSE 'unrecorded' END AS version FROM supplier),
summed AS (SELECT dataset, {_SUMMARY_COLUMNS} FROM shards GROUP BY dataset UNION ALL SELECT '*', {_SUMMARY_COLUMNS} FROM shards)
SELECT summed.*, """
    + ", ".join(f"coalesce(ceiling_{s}_replicates, 0) AS ceiling_{s}_replicates, ceiling_{s}_mean, ceiling_{s}_digest" for s in ("all", "within_apex_window", "selected"))
    + " FROM summed LEFT JOIN ceilings USING (dataset)",
)
def corpus_summary(spark, sf):
    """Totals per source and for the corpus, with three replicate ceilings added up from the shards' histograms.

    The digest covers a histogram: each bin's number squared, times its count.
    """
    flagged = flagged_spectra(spark, sf)
    angles = leave_one_out_angles(flagged.drop("ms2"), flagged.select("spectrum_id", "ms2"), ["context"])
    per_shard = reports.ceiling_states(angles.withColumn("shard", F.col("spectrum_id") % 7 + 1), ["shard"])
    shards = shard_reports(spark, sf).join(per_shard, "shard", "left")
    out = reports.with_ceilings(evaluate.corpus_summary(shards), shards)
    digest = lambda bins: F.aggregate(F.transform(bins, lambda n, i: n * i * i), F.lit(0).cast("bigint"), lambda a, x: a + x)
    plain = [F.col(c) for c in out.columns if not c.endswith("_histogram")]
    return out.select(*plain, *[F.when(F.col(f"ceiling_{s}_replicates") > 0, digest(F.col(f"ceiling_{s}_histogram"))).alias(f"ceiling_{s}_digest") for s in SUBSETS])


def scored_acquisitions(spark, sf):
    sid = F.col("spectrum_id")
    return pair_scores(spark, sf).select(
        F.concat(F.lit("set"), (F.col("context") % 4).cast("string")).alias("dataset"),
        F.when(sid % 3 == 0, "ITMS").otherwise("FTMS").alias("detector"),
        F.when(sid % 2 == 0, "HCD").otherwise("CID").alias("fragmentation"),
        (sid % 5 == 0).alias("labelled"),
        "angle",
    )


_LEVELS_SQL = """rows AS (SELECT 'set' || (context % 4) AS dataset, CASE WHEN spectrum_id % 3 = 0 THEN 'ITMS' ELSE 'FTMS' END || '/' ||
  CASE WHEN spectrum_id % 2 = 0 THEN 'HCD' ELSE 'CID' END AS acq, CASE WHEN spectrum_id % 5 = 0 THEN 'labelled ' ELSE 'label-free ' END AS state, angle FROM pair_angles),
leveled AS (SELECT 'dataset' AS level, dataset AS cell, angle FROM rows UNION ALL SELECT 'acquisition', acq, angle FROM rows
  UNION ALL SELECT 'label_acquisition', state || acq, angle FROM rows UNION ALL SELECT 'overall', 'all', angle FROM rows)"""


@add(
    "distribution_report",
    "A19",
    needs=("pair_angles",),
    sql=f"""WITH {_LEVELS_SQL} SELECT level, cell, count(*) AS scored, round(avg(angle), 6) AS mean, """
    + ", ".join(f"round(quantile_cont(angle, {q}), 6) AS {n}" for n, q in evaluate.FIVE_QUANTILES.items())
    + " FROM leveled GROUP BY 1, 2",
)
def distribution_report(spark, sf):
    return evaluate.distribution_report(scored_acquisitions(spark, sf))


_REPORT_ROWS_SQL = """report_rows AS (SELECT 'set' || (context % 4) AS dataset, CASE WHEN spectrum_id % 3 = 0 THEN 'ITMS' ELSE 'FTMS' END || '/' || CASE WHEN spectrum_id % 2 = 0 THEN 'HCD' ELSE 'CID' END AS acq,
  CASE WHEN spectrum_id % 5 = 0 THEN 'labelled ' ELSE 'label-free ' END AS state, CASE WHEN spectrum_id % 9 <> 4 THEN angle END AS angle,
  CASE WHEN spectrum_id % 9 = 4 THEN CASE WHEN spectrum_id % 2 = 0 THEN 'mass_only_modification' ELSE 'teacher_returned_none' END END AS reason,
  CASE WHEN spectrum_id % 8 <> 3 AND spectrum_id % 9 <> 4 THEN context * 3.5::DOUBLE + spectrum_id % 13 END AS observed, (context * 7 + spectrum_id % 11)::DOUBLE AS predicted FROM pair_angles),
grains AS (SELECT 'dataset' AS level, dataset AS cell, * FROM report_rows UNION ALL SELECT 'acquisition', acq, * FROM report_rows
  UNION ALL SELECT 'label_acquisition', state || acq, * FROM report_rows UNION ALL SELECT 'overall', 'all', * FROM report_rows),
fits AS (SELECT dataset, regr_slope(observed, predicted) AS slope, regr_intercept(observed, predicted) AS intercept FROM report_rows GROUP BY 1),
residuals AS (SELECT 'dataset' AS level, dataset AS cell, avg(abs(observed - slope * predicted - intercept)) AS residual_mae FROM report_rows JOIN fits USING (dataset) GROUP BY 1, 2)"""


@add(
    "multi_grain_report",
    "A19",
    "A14",
    "A27",
    needs=("pair_angles",),
    sql=f"""WITH {_REPORT_ROWS_SQL}, lines AS (SELECT level, cell, count(angle) AS scored, count(reason) AS refused, """
    + ", ".join(f"count(*) FILTER (reason = '{r}') AS refused_{r}" for r in REFUSAL_REASONS)
    + ", round(avg(angle), 6) AS mean, "
    + ", ".join(f"round(quantile_cont(angle, {q}), 6) AS {n}" for n, q in evaluate.FIVE_QUANTILES.items())
    + """, sum(CASE WHEN angle BETWEEN 0 AND 1 THEN pow(least(floor(angle * 50), 49), 2) END)::BIGINT AS histogram_digest,
  CASE WHEN level = 'dataset' THEN round(pow(corr(observed, predicted), 2), 6) END AS r_squared FROM grains GROUP BY 1, 2)
SELECT lines.*, round(residual_mae, 6) AS residual_mae FROM lines LEFT JOIN residuals USING (level, cell)""",
)
def multi_grain_report(spark, sf):
    """One report of angles, quantiles, histogram, refusals and retention fit at four grains, from states of the finest.

    The digest covers the histogram: each bin's number squared, times its count.
    """
    sid, refused = F.col("spectrum_id"), F.col("spectrum_id") % 9 == 4
    scores = pair_scores(spark, sf)
    rows = scores.select(
        F.concat(F.lit("set"), (F.col("context") % 4).cast("string")).alias("dataset"),
        F.when(sid % 3 == 0, "ITMS").otherwise("FTMS").alias("detector"),
        F.when(sid % 2 == 0, "HCD").otherwise("CID").alias("fragmentation"),
        (sid % 5 == 0).alias("labelled"),
        F.when(~refused, F.col("angle")).alias("angle"),
        F.when(refused, F.when(sid % 2 == 0, "mass_only_modification").otherwise("teacher_returned_none")).alias("reason"),
        F.when(sid % 8 != 3, F.col("context") * 3.5 + sid % 13).otherwise(F.lit(float("nan"))).alias("observed"),
        (F.col("context") * 7 + sid % 11).cast("double").alias("predicted"),
    )
    out = reports.multi_grain_report(rows)
    digest = F.aggregate(F.transform("histogram", lambda n, i: n * i * i), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.withColumn("histogram_digest", digest).drop("histogram")


@add(
    "masked_metrics",
    "A20",
    needs=("pair_angles", "prepared"),
    sql="""SELECT dataset, round(avg(angle), 6) AS spectral_angle, count(*) AS n, count(irt) AS irt_rows, round(avg(abs(raw_rt * 1.5::DOUBLE + 1 - irt)), 6) AS irt_mae,
  count(*) AS raw_rt_rows, round(avg(abs(raw_rt + spectrum_id % 3 - raw_rt)), 6) AS raw_rt_mae
FROM prepared JOIN (SELECT spectrum_id AS sid, angle FROM pair_angles) ON sid = spectrum_id GROUP BY 1""",
)
def masked_metrics(spark, sf):
    scored = views.prepared(spark, sf).join(pair_scores(spark, sf).select("spectrum_id", "angle"), "spectrum_id")
    rows = scored.withColumn("irt_predicted", F.col("raw_rt") * 1.5 + 1).withColumn(
        "raw_rt_predicted", F.col("raw_rt") + F.col("spectrum_id") % 3
    )
    return evaluate.masked_metrics(rows, ["dataset"])


@add(
    "masked_mse",
    "A20",
    needs=("prepared",),
    sql="""SELECT split, count(irt) AS labelled, round(coalesce(avg(pow(raw_rt * 1.5::DOUBLE + 1 - irt, 2)), 0), 6) AS mse FROM prepared GROUP BY 1""",
)
def masked_mse(spark, sf):
    rows = views.prepared(spark, sf).withColumn("guess", F.col("raw_rt") * 1.5 + 1)
    return evaluate.masked_mse(rows, ["split"], "guess", "irt")


@add(
    "group_violations",
    "A21",
    sql="""SELECT l_orderkey AS decoy_group, count(*) FILTER (l_returnflag <> 'R') AS targets, count(*) FILTER (l_returnflag = 'R') AS decoys,
  count(DISTINCT l_linenumber % 3) AS charges FROM lineitem GROUP BY 1
HAVING count(*) FILTER (l_returnflag <> 'R') <> 1 OR count(*) FILTER (l_returnflag = 'R') > 1 OR count(DISTINCT l_linenumber % 3) > 1""",
)
def group_violations(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("decoy_group"),
        (F.col("l_returnflag") == "R").alias("decoy"),
        (F.col("l_linenumber") % 3).alias("charge"),
    )
    return decoys.group_violations(rows)


@add(
    "label_moments",
    "A22",
    sql="""SELECT o_orderpriority, round(avg(o_totalprice), 3) AS rt_mean, round(stddev_pop(o_totalprice), 3) AS rt_std, 7.0::DOUBLE AS ccs_mean, 1.0::DOUBLE AS ccs_std FROM orders GROUP BY 1""",
)
def label_moments(spark, sf):
    rows = views.table(spark, sf, "orders").select(
        "o_orderpriority", F.col("o_totalprice").alias("rt"), F.lit(7.0).alias("ccs")
    )
    stats = evaluate.label_moments(rows, ["o_orderpriority"], ["rt", "ccs"])
    return stats.withColumn("rt_mean", F.round("rt_mean", 3)).withColumn("rt_std", F.round("rt_std", 3))


@add(
    "key_null_counts",
    "A23",
    sql="""SELECT count(*) FILTER (l_orderkey % 10 = 0) AS null_raw_file, count(*) FILTER (l_linenumber = 3) AS null_scan_number, 0::BIGINT AS null_charge FROM lineitem""",
)
def key_null_counts(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey")).alias("raw_file"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("scan_number"),
        F.col("l_suppkey").alias("charge"),
    )
    return resolve.key_null_counts(rows, ["raw_file", "scan_number", "charge"])


@add(
    "usable_intensity",
    "A23",
    sql="SELECT count(*) AS rows, count(*) FILTER (event_id % 6 >= 2) AS usable_precursor_intensity FROM events",
)
def usable_intensity(spark, sf):
    kind = F.col("event_id") % 6
    value = F.when(kind == 0, F.lit(float("nan"))).when(kind >= 2, F.col("value"))
    return resolve.usable_counts(
        views.table(spark, sf, "events").select(value.alias("precursor_intensity")), "precursor_intensity"
    )


@add(
    "facet_report",
    "A24",
    needs=("precursors", "pair_angles"),
    sql=f"""WITH rows AS (SELECT angle, p.charge, {views.sql_mass('p.peptide')} + {views.SQL_WATER} AS mass FROM precursors p JOIN pair_angles a ON a.spectrum_id = p.spectrum_id),
f AS (SELECT 'charge' AS facet, 'z' || charge AS level, angle FROM rows UNION ALL SELECT 'length', '15-19', angle FROM rows
  UNION ALL SELECT 'mass', (floor(mass / 500)::BIGINT * 500) || '-' || (floor(mass / 500)::BIGINT * 500 + 499), angle FROM rows
  UNION ALL SELECT 'modification', 'unmodified', angle FROM rows)
SELECT facet, level, count(*) AS n, round(avg(angle), 6) AS mean, round(median(angle), 6) AS median FROM f GROUP BY 1, 2""",
)
def facet_report(spark, sf):
    rows = (
        views.precursors(spark, sf)
        .join(pair_scores(spark, sf).select("spectrum_id", "angle"), "spectrum_id")
        .withColumn("length", F.length("peptide"))
        .withColumn("mass", chemistry.mono_mass(F.col("peptide")))
    )
    return evaluate.facet_report(evaluate.facet_levels(rows, F.array().cast("array<string>")))


@add(
    "pca_lengths",
    "A25",
    sql="""WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS mean FROM c GROUP BY 1)
SELECT vec_id, round(sum((x - mean) * (x - mean)), 6) AS squared_length FROM c JOIN m USING (i) GROUP BY 1""",
)
def pca_lengths(spark, sf):
    """With all components kept the scores are a rotation: their squares add up to the squared centred length."""
    rows = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    placed, _, _ = evaluate.pca_basis(rows, "vec_id", "embedding", 64)
    square = F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + x * x)
    return placed.select("vec_id", square.alias("squared_length"))


@add("pca_scores", "A25")
def pca_scores(spark, sf):
    """Coordinates of every embedding on the two leading components, sign removed."""
    rows = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    placed, _, _ = evaluate.pca_basis(rows, "vec_id", "embedding", 2)
    return placed.select("vec_id", F.abs(F.col("scores")[0]).alias("pc1"), F.abs(F.col("scores")[1]).alias("pc2"))


@add(
    "cosine_objective",
    "A26",
    needs=("pair_angles",),
    sql="SELECT context, count(*) AS n, round(avg(1 - cosine), 6) AS objective FROM pair_angles GROUP BY 1",
)
def cosine_objective(spark, sf):
    return evaluate.cosine_objective(pair_scores(spark, sf), ["context"], "cosine")


@add(
    "upper_median_angle",
    "A26",
    needs=("pair_angles",),
    sql="""SELECT context, n, round(angle, 6) AS angle FROM (SELECT context, angle, count(*) OVER (PARTITION BY context) AS n,
  row_number() OVER (PARTITION BY context ORDER BY angle, spectrum_id) AS rn FROM pair_angles) WHERE rn = n // 2 + 1""",
)
def upper_median_angle(spark, sf):
    return ordering.upper_middle(pair_scores(spark, sf), ["context"], "angle", "spectrum_id", "angle")


@add(
    "refusal_report",
    "A27",
    sql="""WITH r AS (SELECT 'set' || (user_id % 5) AS dataset, CASE event_type WHEN 'error' THEN 'teacher_returned_none' WHEN 'click' THEN 'mass_only_modification' END AS reason FROM events)
SELECT d.dataset, s.reason, count(r.reason) AS refused FROM (SELECT DISTINCT dataset FROM r) d CROSS JOIN (VALUES """
    + ", ".join(f"('{r}')" for r in REFUSAL_REASONS)
    + ") s(reason) LEFT JOIN r ON r.dataset = d.dataset AND r.reason = s.reason GROUP BY 1, 2",
)
def refusal_report(spark, sf):
    reason = F.when(F.col("event_type") == "error", "teacher_returned_none").when(
        F.col("event_type") == "click", "mass_only_modification"
    )
    rows = views.table(spark, sf, "events").select(
        F.concat(F.lit("set"), (F.col("user_id") % 5).cast("string")).alias("dataset"), reason.alias("reason")
    )
    return evaluate.refusal_report(rows)


@add(
    "backbone_coverage",
    "A28",
    needs=("spectra",),
    sql="""SELECT spectrum_id, round(count(DISTINCT cell // 4) FILTER (value / top >= 0.6) / 16.0::DOUBLE, 6) AS coverage FROM (
  SELECT *, max(value) OVER (PARTITION BY spectrum_id) AS top FROM spectra) GROUP BY 1""",
)
def backbone_coverage(spark, sf):
    return views.spectra(spark, sf).select(
        "spectrum_id", winners.backbone_coverage(F.col("ms2"), 0.6).alias("coverage")
    )
