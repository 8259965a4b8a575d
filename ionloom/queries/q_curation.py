"""Curation queries over the events as peptide-spectrum matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions.hashing import unsigned
from ionloom.functions.spectra import finite
from ionloom.operators import curation as cur
from ionloom.operators.catalog import corpus_facts
from ionloom.operators.ordering import with_group_position
from ionloom.plans.prepare import curate_prepared, prepare_spectra
from ionloom.queries import views
from ionloom.queries.base import Book, run_folder
from ionloom.session import materialise
from ionloom.sinks.corpus import write_curation, write_prepared
from ionloom.sinks.manifest_log import ManifestLog

BOOK = Book()
add = BOOK.add

POLICY = cur.CurationPolicy(
    width_anchor_min_psms=2,
    min_in_window_psms=4,
    max_psms_per_context=2,
    energy_bucket_width=10.0,
    max_run_width_minutes=1440.0,
)

_CURATION_SQL = """base AS (SELECT *, round(energy / 10.0)::BIGINT AS bucket, max(precursor_intensity) OVER (PARTITION BY raw_file, proforma) AS apex FROM psms),
supported AS (SELECT *, precursor_intensity / nullif(apex, 0) AS ratio, coalesce(precursor_intensity / nullif(apex, 0) >= 0.5, false) AS supports FROM base),
pep AS (SELECT raw_file, proforma, count(*) AS psms, count(*) FILTER (supports) AS support,
  arg_min(raw_rt, (-precursor_intensity, spectrum_id)) FILTER (supports) AS apex_rt,
  min(raw_rt) FILTER (supports) AS first_rt, max(raw_rt) FILTER (supports) AS last_rt FROM supported GROUP BY 1, 2),
widths0 AS (SELECT raw_file, median(last_rt - first_rt) FILTER (support >= 2 AND last_rt > first_rt) AS anchored,
  median(last_rt - first_rt) FILTER (last_rt > first_rt) AS fallback, count(*) FILTER (support >= 2 AND last_rt > first_rt) AS anchors FROM pep GROUP BY 1),
widths AS (SELECT raw_file, anchors, CASE WHEN coalesce(anchored, fallback) IS NOT NULL THEN greatest(least(coalesce(anchored, fallback), 1440.0::DOUBLE), 0.05::DOUBLE) END AS width,
  coalesce(coalesce(anchored, fallback) < 0.05 OR coalesce(anchored, fallback) > 1440.0, false) AS clamped FROM widths0),
windows AS (SELECT pep.raw_file, pep.proforma, apex_rt, width, apex_rt - width / 2 AS win_start, apex_rt + width / 2 AS win_end FROM pep JOIN widths USING (raw_file)),
placed AS (SELECT s.*, w.apex_rt, w.width, w.win_start, w.win_end, coalesce(raw_rt BETWEEN win_start AND win_end, false) AS within, abs(raw_rt - w.apex_rt) AS distance
  FROM supported s JOIN windows w ON w.raw_file = s.raw_file AND w.proforma = s.proforma),
counted AS (SELECT *, count(*) FILTER (within) OVER (PARTITION BY raw_file, proforma) AS pep_n,
  count(*) FILTER (within) OVER (PARTITION BY raw_file, proforma, charge, detector, fragmentation, bucket) AS ctx_n FROM placed),
eligible AS (SELECT *, within AND pep_n >= 4 AS ok FROM counted),
ranked AS (SELECT *, sum(ok::BIGINT) OVER (PARTITION BY raw_file, proforma, charge, detector, fragmentation, bucket
  ORDER BY ok DESC, andromeda_score DESC NULLS LAST, distance NULLS LAST, precursor_intensity DESC NULLS LAST, spectrum_id ROWS UNBOUNDED PRECEDING)::BIGINT AS rank FROM eligible),
verdicts AS (SELECT *, ok AND rank <= 2 AS selected, CASE WHEN ok AND rank <= 2 THEN 'top_context_psm' WHEN pep_n < 4 THEN 'insufficient_in_window_replication'
  WHEN NOT within THEN 'outside_shared_window' ELSE 'context_cap' END AS reason FROM ranked)"""


def supported(spark, sf):
    rows = cur.with_context_key(views.psms(spark, sf), POLICY.energy_bucket_width)
    return cur.apex_ratio(rows, POLICY.half_max_fraction)


@add(
    "apex_ratio",
    "W2",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL} SELECT spectrum_id, round(ratio, 6) AS intensity_ratio, supports AS supports_half_max FROM supported""",
)
def apex_ratio(spark, sf):
    return supported(spark, sf).select("spectrum_id", "intensity_ratio", "supports_half_max")


@add(
    "peptidoform_summary",
    "A4",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL} SELECT raw_file, proforma, psms, support AS half_max_support_psms, round(apex_rt, 6) AS apex_rt,
  round(first_rt, 6) AS observed_start, round(last_rt, 6) AS observed_end, round(last_rt - first_rt, 6) AS observed_width_minutes FROM pep""",
)
def peptidoform_summary(spark, sf):
    return cur.peptidoform_summary(supported(spark, sf))


@add(
    "run_widths",
    "A5",
    "J3",
    needs=("psms",),
    sql=f"WITH {_CURATION_SQL} SELECT raw_file, round(width, 6) AS run_width_minutes, anchors AS width_anchor_peptidoforms, clamped AS width_clamped FROM widths",
)
def run_widths(spark, sf):
    return cur.run_widths(materialise(cur.peptidoform_summary(supported(spark, sf))), POLICY)


@add(
    "clamped_run_widths",
    "A5",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL} SELECT raw_file, CASE WHEN coalesce(anchored, fallback) IS NOT NULL THEN 0.25::DOUBLE ELSE -1 END AS run_width_minutes,
  anchored IS NOT NULL OR fallback IS NOT NULL AS width_clamped FROM widths0""",
)
def clamped_run_widths(spark, sf):
    """The default limits clamp every measured width; an unmeasured one stays without a value."""
    widths = cur.run_widths(
        materialise(cur.peptidoform_summary(supported(spark, sf))), cur.CurationPolicy(width_anchor_min_psms=2)
    )
    return widths.select(
        "raw_file", F.coalesce("run_width_minutes", F.lit(-1.0)).alias("run_width_minutes"), "width_clamped"
    )


@add(
    "apex_windows",
    "J4",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL} SELECT raw_file, proforma, round(apex_rt, 6) AS apex_rt, round(width, 6) AS run_width_minutes,
  round(win_start, 6) AS apex_window_start, round(win_end, 6) AS apex_window_end FROM windows""",
)
def apex_windows(spark, sf):
    peptidoforms = materialise(cur.peptidoform_summary(supported(spark, sf)))
    return cur.apex_windows(peptidoforms, cur.run_widths(peptidoforms, POLICY))


@add(
    "window_membership",
    "W3",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL} SELECT spectrum_id, within AS within_apex_window, pep_n AS peptidoform_window_psms, ctx_n AS context_window_psms, ok AS eligible FROM eligible""",
)
def window_membership(spark, sf):
    rows = supported(spark, sf)
    peptidoforms = materialise(cur.peptidoform_summary(rows))
    windows = cur.apex_windows(peptidoforms, cur.run_widths(peptidoforms, POLICY))
    members = cur.window_membership(rows, windows, POLICY.min_in_window_psms)
    return members.select(
        "spectrum_id", "within_apex_window", "peptidoform_window_psms", "context_window_psms", "eligible"
    )


@add(
    "context_ranking",
    "W4",
    needs=("psms",),
    sql=f"WITH {_CURATION_SQL} SELECT spectrum_id, rank AS selection_rank, selected, reason AS selection_reason FROM verdicts",
)
def context_ranking(spark, sf):
    return cur.curate(views.psms(spark, sf), POLICY).verdicts.select(
        "spectrum_id", "selection_rank", "selected", "selection_reason"
    )


@add(
    "curation_annotations",
    "W5",
    "K6",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL} SELECT spectrum_id, round(precursor_intensity, 6) AS precursor_intensity, round(ratio, 6) AS intensity_ratio, supports AS supports_half_max,
  round(apex_rt, 6) AS apex_rt, round(width, 6) AS run_width_minutes, round(win_start, 6) AS apex_window_start, round(win_end, 6) AS apex_window_end,
  within AS within_apex_window, pep_n AS peptidoform_window_psms, ctx_n AS context_window_psms, rank AS selection_rank, selected, reason AS selection_reason FROM verdicts""",
)
def curation_annotations(spark, sf):
    """The full pipeline's fourteen columns per spectrum."""
    return cur.curate(views.psms(spark, sf), POLICY).annotations()


@add(
    "group_summaries",
    "A6",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL} SELECT 'peptidoform' AS grain, raw_file, proforma, count(*) AS groups, sum(window_psms)::BIGINT AS window_psms, sum(selected_psms)::BIGINT AS selected_psms FROM (
  SELECT raw_file, proforma, count(*) FILTER (within) AS window_psms, count(*) FILTER (selected) AS selected_psms FROM verdicts GROUP BY 1, 2) GROUP BY ALL
UNION ALL SELECT 'context', raw_file, proforma, count(*), sum(window_psms)::BIGINT, sum(selected_psms)::BIGINT FROM (
  SELECT raw_file, proforma, charge, detector, fragmentation, bucket, count(*) FILTER (within) AS window_psms, count(*) FILTER (selected) AS selected_psms
  FROM verdicts GROUP BY ALL) GROUP BY ALL""",
)
def group_summaries(spark, sf):
    verdicts = cur.curate(views.psms(spark, sf), POLICY).verdicts
    parts = [
        table.groupBy(F.lit(grain).alias("grain"), "raw_file", "proforma").agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("window_psms").alias("window_psms"),
            F.sum("selected_psms").alias("selected_psms"),
        )
        for grain, table in (
            ("peptidoform", cur.peptidoform_groups(verdicts)),
            ("context", cur.context_groups(verdicts)),
        )
    ]
    return parts[0].unionByName(parts[1])


@add(
    "selection_report",
    "K6",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL}, p AS (SELECT raw_file, proforma, count(*) FILTER (within) AS n FROM verdicts GROUP BY 1, 2),
c AS (SELECT count(*) FILTER (selected) AS n FROM verdicts GROUP BY raw_file, proforma, charge, detector, fragmentation, bucket)
SELECT count(*) AS rows, 0::BIGINT AS missing_precursor_intensity_rows, count(*) FILTER (within) AS apex_window_rows, count(*) FILTER (selected) AS selected_rows,
  (SELECT count(*) FROM p) AS peptidoform_groups, (SELECT count(*) FROM p WHERE n >= 4) AS qualifying_peptidoforms, (SELECT count(*) FROM c) AS context_groups,
  (SELECT count(*) FROM c WHERE n > 0) AS selected_contexts, (SELECT count(*) FROM widths) AS runs, (SELECT count(*) FROM widths WHERE clamped) AS clamped_runs,
  (SELECT count(*) FROM p WHERE n < 4) AS rejected_peptidoforms FROM verdicts""",
)
def selection_report(spark, sf):
    return cur.selection_counts(cur.curate(views.psms(spark, sf), POLICY))


@add(
    "curation_report_file",
    "K6",
    "A7",
    "A10",
    needs=("psms", "spectra"),
    sql=f"""WITH {_CURATION_SQL}, p AS (SELECT raw_file, proforma, count(*) AS a, count(*) FILTER (within) AS b, count(*) FILTER (selected) AS c FROM verdicts GROUP BY 1, 2),
m AS (SELECT 'psms_per_peptidoform' AS measure, a AS v FROM p UNION ALL SELECT 'window_psms_per_peptidoform', b FROM p UNION ALL SELECT 'selected_psms_per_peptidoform', c FROM p),
flagged AS (SELECT s.spectrum_id, v.proforma AS context, within AS win, selected AS sel, cell, s.value / sqrt(sum(s.value * s.value) OVER (PARTITION BY s.spectrum_id)) AS u FROM spectra s JOIN verdicts v ON v.spectrum_id = s.spectrum_id),
subsets AS (SELECT 'all' AS subset, spectrum_id, context, cell, u FROM flagged UNION ALL SELECT 'within_apex_window', spectrum_id, context, cell, u FROM flagged WHERE win
  UNION ALL SELECT 'selected', spectrum_id, context, cell, u FROM flagged WHERE sel),
peers AS (SELECT *, sum(u) OVER (PARTITION BY subset, context, cell) - u AS pu, count(*) OVER (PARTITION BY subset, context, cell) AS n FROM subsets),
angles AS (SELECT subset, spectrum_id, 1 - 2 * acos(greatest(least(sum(u * pu) / sqrt(sum(pu * pu)), 1), -1)) / pi() AS angle FROM peers WHERE n >= 2 GROUP BY 1, 2)
SELECT 'input.rows' AS key, count(*)::DOUBLE AS value FROM verdicts UNION ALL SELECT 'selection.selected_rows', count(*) FILTER (selected) FROM verdicts
UNION ALL SELECT 'chromatography.runs', count(*) FROM widths
"""
    + " ".join(f"UNION ALL SELECT 'replication.' || measure || '.{n}', round(quantile_cont(v::DOUBLE, {q}), 6) FROM m GROUP BY measure" for n, q in cur.REPORT_QUANTILES.items())
    + """ UNION ALL SELECT 'ceiling.' || subset || '.mean', round(avg(angle), 6) FROM angles GROUP BY subset
UNION ALL SELECT 'ceiling.' || subset || '.replicates', count(*) FROM angles GROUP BY subset
UNION ALL SELECT 'ceiling.' || subset || '.digest', sum(pow(least(floor(angle * 50), 49), 2)) FROM angles WHERE angle BETWEEN 0 AND 1 GROUP BY subset""",
)
def curation_report_file(spark, sf):
    """The curation report as written and read back: counts, replication quantiles, ceilings with their histograms."""
    folder = run_folder(spark)
    curation = cur.curate(views.psms(spark, sf), POLICY)
    spectra_table = views.spectra(spark, sf).select("spectrum_id", "ms2")
    write_curation(curation, f"{folder}/annotations", f"{folder}/report", spectra_table, ["proforma"])
    text = spark.read.text(f"{folder}/report")
    names = list(cur.REPORT_QUANTILES)
    quantiles = "map<string,struct<" + ",".join(f"{n}:double" for n in names) + ">>"
    ceilings = "map<string,struct<mean:double,replicates_compared:bigint,histogram:struct<counts:array<bigint>>>>"
    schema = f"input struct<rows:bigint>, selection struct<selected_rows:bigint>, chromatography struct<runs:bigint>, replication {quantiles}, achievable_ceiling {ceilings}"
    report = text.select(F.from_json("value", schema).alias("r")).select("r.*")
    pair = lambda key, value: F.struct(key.alias("key"), value.cast("double").alias("value"))
    digest = lambda bins: F.aggregate(F.transform(bins, lambda n, i: n * i * i), F.lit(0).cast("bigint"), lambda a, x: a + x)
    plain = F.array(*[pair(F.lit(k), F.col(k)) for k in ("input.rows", "selection.selected_rows", "chromatography.runs")])
    replication = F.flatten(F.transform(F.map_entries("replication"), lambda e: F.array(*[pair(F.concat(F.lit("replication."), e["key"], F.lit(f".{n}")), e["value"][n]) for n in names])))
    name = lambda e, part: F.concat(F.lit("ceiling."), e["key"], F.lit(part))
    ceiling = F.flatten(
        F.transform(
            F.map_entries("achievable_ceiling"),
            lambda e: F.array(
                pair(name(e, ".mean"), e["value"]["mean"]),
                pair(name(e, ".replicates"), e["value"]["replicates_compared"]),
                pair(name(e, ".digest"), digest(e["value"]["histogram"]["counts"])),
            ),
        )
    )
    return report.select(F.explode(F.concat(plain, replication, ceiling)).alias("p")).select("p.key", "p.value")


@add(
    "replication_quantiles",
    "A7",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL}, g AS (SELECT raw_file, proforma, count(*) AS a, count(*) FILTER (within) AS b, count(*) FILTER (selected) AS c FROM verdicts GROUP BY 1, 2),
m AS (SELECT 'psms_per_peptidoform' AS measure, a AS v FROM g UNION ALL SELECT 'window_psms_per_peptidoform', b FROM g UNION ALL SELECT 'selected_psms_per_peptidoform', c FROM g)
SELECT measure, count(*) AS n, """
    + ", ".join(f"round(quantile_cont(v::DOUBLE, {q}), 6) AS {n}" for n, q in cur.REPORT_QUANTILES.items())
    + " FROM m GROUP BY 1",
)
def replication_quantiles(spark, sf):
    return cur.replication_quantiles(cur.curate(views.psms(spark, sf), POLICY))


def flagged_spectra(spark, sf):
    """Spectra in their label's context with stand-in window and selection flags."""
    sid = F.col("spectrum_id")
    return views.spectra(spark, sf).withColumn("within_apex_window", sid % 3 != 0).withColumn(
        "selected", sid % 5 == 1
    )


@add(
    "consensus_ceiling",
    "A10",
    needs=("spectra",),
    sql="""WITH flagged AS (SELECT *, spectrum_id % 3 <> 0 AS win, spectrum_id % 5 = 1 AS sel,
  value / sqrt(sum(value * value) OVER (PARTITION BY spectrum_id)) AS u FROM spectra),
subsets AS (SELECT 'all' AS subset, spectrum_id, context, cell, u FROM flagged UNION ALL SELECT 'within_apex_window', spectrum_id, context, cell, u FROM flagged WHERE win
  UNION ALL SELECT 'selected', spectrum_id, context, cell, u FROM flagged WHERE sel),
peers AS (SELECT *, sum(u) OVER (PARTITION BY subset, context, cell) - u AS p, count(*) OVER (PARTITION BY subset, context, cell) AS n FROM subsets)
SELECT subset, spectrum_id, round(1 - 2 * acos(greatest(least(sum(u * p) / sqrt(sum(p * p)), 1), -1)) / pi(), 6) AS angle FROM peers WHERE n >= 2 GROUP BY 1, 2""",
)
def consensus_ceiling(spark, sf):
    rows = flagged_spectra(spark, sf)
    return cur.leave_one_out_angles(rows.drop("ms2"), rows.select("spectrum_id", "ms2"), ["context"]).select(
        "subset", "spectrum_id", "angle"
    )


@add(
    "consensus_report",
    "A10",
    needs=("spectra",),
    sql="""WITH flagged AS (SELECT *, spectrum_id % 3 <> 0 AS win, spectrum_id % 5 = 1 AS sel,
  value / sqrt(sum(value * value) OVER (PARTITION BY spectrum_id)) AS u FROM spectra),
subsets AS (SELECT 'all' AS subset, spectrum_id, context, cell, u FROM flagged UNION ALL SELECT 'within_apex_window', spectrum_id, context, cell, u FROM flagged WHERE win
  UNION ALL SELECT 'selected', spectrum_id, context, cell, u FROM flagged WHERE sel),
peers AS (SELECT *, sum(u) OVER (PARTITION BY subset, context, cell) - u AS p, count(*) OVER (PARTITION BY subset, context, cell) AS n FROM subsets),
angles AS (SELECT subset, spectrum_id, 1 - 2 * acos(greatest(least(sum(u * p) / sqrt(sum(p * p)), 1), -1)) / pi() AS angle FROM peers WHERE n >= 2 GROUP BY 1, 2)
SELECT subset, count(*) AS replicates_compared, round(avg(angle), 6) AS mean FROM angles GROUP BY 1""",
)
def consensus_report(spark, sf):
    rows = flagged_spectra(spark, sf)
    angles = cur.leave_one_out_angles(rows.drop("ms2"), rows.select("spectrum_id", "ms2"), ["context"])
    return angles.groupBy("subset").agg(
        F.count(F.lit(1)).alias("replicates_compared"), F.avg("angle").alias("mean")
    )


@add(
    "curated_selection",
    "W5",
    needs=("psms",),
    sql=f"""WITH {_CURATION_SQL} SELECT raw_file, detector, charge, count(*) AS kept, round(max(andromeda_score), 6) AS best FROM verdicts WHERE selected GROUP BY 1, 2, 3""",
)
def curated_selection(spark, sf):
    kept = cur.curate(views.psms(spark, sf), POLICY).verdicts.where("selected")
    return kept.where(finite(F.col("andromeda_score"))).groupBy("raw_file", "detector", "charge").agg(
        F.count(F.lit(1)).alias("kept"), F.max("andromeda_score").alias("best")
    )


@add(
    "replicate_numbers",
    "W4",
    needs=("psms",),
    sql="SELECT spectrum_id, row_number() OVER (PARTITION BY raw_file, proforma ORDER BY raw_rt, spectrum_id) - 1 AS replicate FROM psms",
)
def replicate_numbers(spark, sf):
    """Replicates of a peptidoform numbered by retention time, safe for a hot peptidoform."""
    placed = with_group_position(
        views.psms(spark, sf), cur.PEPTIDOFORM, [F.col("raw_rt").asc(), F.col("spectrum_id").asc()], "replicate"
    )
    return placed.select("spectrum_id", "replicate")


_PREPARED_SQL = f"""source AS (SELECT * FROM ({views.SQL['psms']})),
psms AS (SELECT spectrum_id, raw_file, CASE WHEN spectrum_id % 7 = 0 THEN '[UNIMOD:1]-' ELSE '' END || {views.sql_coded('(spectrum_id % 5)', 8)} AS proforma, charge,
  coalesce(detector, '') AS detector, coalesce(fragmentation, '') AS fragmentation, energy, raw_rt, precursor_intensity::DOUBLE AS precursor_intensity, andromeda_score
  FROM source WHERE spectrum_id % 3 < 2 AND spectrum_id % 11 <> 0 AND precursor_intensity > 0)"""


def prepared_source(spark, sf):
    """Events as a source: metadata with missing labels and energies, and one fragment of each scan."""
    psms = views.psms(spark, sf)
    eid = F.col("spectrum_id")
    metadata = psms.select(
        "raw_file",
        "scan_number",
        F.concat(F.when(eid % 7 == 0, "[UNIMOD:1]").otherwise(""), views.coded_peptide(eid % 5, 8)).alias("modified_sequence"),
        F.col("charge").alias("precursor_charge"),
        F.col("raw_rt").alias("retention_time"),
        F.col("energy").alias("aligned_collision_energy"),
        F.col("detector").alias("mass_analyzer"),
        "fragmentation",
        "andromeda_score",
        "precursor_intensity",
    )
    fragments = psms.select(
        "raw_file",
        "scan_number",
        F.when(eid % 2 == 0, "b").otherwise("y").alias("ion_type"),
        (1 + eid % 5).alias("no"),
        (1 + eid % 3).alias("charge"),
        F.col("precursor_intensity").alias("intensity"),
        F.when(eid % 11 == 0, "H2O").alias("neutral_loss"),
    )
    return metadata, fragments


def prepared_and_curated(spark, sf):
    metadata, fragments = prepared_source(spark, sf)
    spectra = materialise(prepare_spectra(metadata, fragments, "stand-in", "Lumos"))
    return spectra, *curate_prepared(spectra, POLICY)


@add(
    "prepare_pipeline",
    "S2",
    "S3",
    "W5",
    "A2",
    sql=f"""WITH {_PREPARED_SQL}, {_CURATION_SQL} SELECT raw_file, detector, charge, count(*) AS prepared, count(*) FILTER (selected) AS kept,
  round(sum(precursor_intensity) FILTER (selected), 2) AS kept_intensity FROM verdicts GROUP BY 1, 2, 3""",
)
def prepare_pipeline(spark, sf):
    """Candidates and fragments to grids, then curation: prepared and kept spectra per run, detector and charge."""
    spectra, kept, _ = prepared_and_curated(spark, sf)
    chosen = kept.select(F.col("spectrum_id").alias("chosen"))
    marked = spectra.withColumn("unsigned", unsigned(F.col("spectrum_id"))).join(chosen, F.col("unsigned") == F.col("chosen"), "left")
    is_kept = F.col("chosen").isNotNull()
    return marked.groupBy("raw_file", "detector", "charge").agg(
        F.count(F.lit(1)).alias("prepared"),
        F.count_if(is_kept).alias("kept"),
        F.round(F.sum(F.when(is_kept, F.col("precursor_intensity"))), 2).alias("kept_intensity"),
    )


@add(
    "finalize_manifest",
    "K2",
    "K1",
    "W6",
    sql=f"""WITH {_PREPARED_SQL}, {_CURATION_SQL} SELECT 1::BIGINT AS version, count(DISTINCT raw_file) AS chunks, count(*) AS chunk_rows, count(*) AS split_rows,
  'stand-in' AS datasets FROM verdicts WHERE selected""",
)
def finalize_manifest(spark, sf):
    """The same source written as a partitioned corpus, read back, and summed up by its manifest."""
    folder = run_folder(spark)
    _, kept, _ = prepared_and_curated(spark, sf)
    write_prepared(kept.withColumn("source_shard", F.col("raw_file")), f"{folder}/prepared", partition_by=("source_shard",))
    corpus = spark.read.parquet(f"{folder}/prepared")
    chunks = corpus.groupBy("source_shard", "dataset").agg(F.count(F.lit(1)).alias("rows")).select(
        F.concat(F.lit("prepared/source_shard="), "source_shard").alias("uri"), "dataset", "rows", F.col("source_shard").cast("string").alias("source_shard")
    )
    log = ManifestLog(spark, f"{folder}/manifest")
    log.append(chunks, corpus_facts(corpus), "winners", {"config_fingerprint": "f", "policy_version": 2})
    header = log.newest()
    return log.chunks().agg(
        F.lit(header.version).cast("bigint").alias("version"),
        F.count(F.lit(1)).alias("chunks"),
        F.sum("rows").alias("chunk_rows"),
        F.lit(header.total()).cast("bigint").alias("split_rows"),
        F.lit(";".join(header.datasets)).alias("datasets"),
    )
