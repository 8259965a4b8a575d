"""Mergeable histograms, ceilings per source, and the report at several grains."""

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import curation as cur
from ionloom.operators import evaluate, reports
from ionloom.sinks.corpus import write_curation


def histogram(values):
    return np.bincount([min(int(v * 50), 49) for v in values if 0 <= v <= 1], minlength=50).tolist()


def test_states_of_parts_add_up_to_the_whole(spark):
    rng = np.random.default_rng(4)
    values = [*rng.random(300).tolist(), 1.0, 0.0, -0.2, 1.3, None]
    rows = spark.createDataFrame([("a" if i % 3 else "b", i % 7, v) for i, v in enumerate(values)], "dataset string, shard int, angle double")
    parts = reports.histogram_states(rows, ["dataset", "shard"])
    whole = {r["dataset"]: r for r in parts.groupBy("dataset").agg(F.sum("n").alias("n"), reports.added("bins").alias("bins")).collect()}
    for name in ("a", "b"):
        mine = [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == name and v is not None]
        assert whole[name]["bins"] == histogram(mine) and whole[name]["n"] == len(mine)


def test_ceilings_weigh_by_replicates_and_may_be_absent(spark):
    one, many = [0] * 50, [0] * 50
    one[0], many[49] = 1, 9
    shards = spark.createDataFrame(
        [("a", {"all": one, "selected": one}), ("a", {"all": many}), ("b", None), ("c", {"all": [0] * 50})],
        "dataset string, ceilings map<string,array<bigint>>",
    )
    got = {r["dataset"]: r for r in reports.merged_ceilings(shards).collect()}
    assert sorted(got) == ["*", "a", "c"]
    assert got["a"]["ceiling_all_replicates"] == 10 and got["a"]["ceiling_all_mean"] == pytest.approx(0.1 * 0.01 + 0.9 * 0.99)
    assert got["a"]["ceiling_selected_mean"] == pytest.approx(0.01) and got["a"]["ceiling_within_apex_window_mean"] is None
    assert got["*"]["ceiling_all_histogram"] == got["a"]["ceiling_all_histogram"]
    assert got["c"]["ceiling_all_replicates"] == 0 and got["c"]["ceiling_all_mean"] is None
    summary = spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, shards int")
    with_them = {r["dataset"]: r for r in reports.with_ceilings(summary, shards).collect()}
    assert with_them["b"]["ceiling_all_replicates"] == 0 and with_them["b"]["shards"] == 2


def test_report_lines_equal_direct_figures(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        refused = i % 10 == 0
        rows.append((
            None if i % 4 == 0 else f"d{i % 3}", "FTMS" if i % 2 else "ITMS", "HCD", i % 5 == 0, None if refused else float(rng.random()),
            "mass_only_modification" if refused else None, float("nan") if i % 7 == 0 else 3.0 * i + float(rng.normal()), float(i),
        ))
    rows.append(("flat", "FTMS", "HCD", False, 0.5, None, 1.0, 2.0))
    rows.append(("flat", "FTMS", "HCD", False, 0.5, None, 1.0, 2.0))
    frame = spark.createDataFrame(rows, "dataset string, detector string, fragmentation string, labelled boolean, angle double, reason string, observed double, predicted double")
    got = {(r["level"], r["cell"]): r for r in reports.multi_grain_report(frame).collect()}
    assert len(got) == 5 + 2 + 4 + 1
    whole = got["overall", "all"]
    angles = [r[4] for r in rows if r[4] is not None]
    assert whole["scored"] == len(angles) and whole["refused"] == whole["refused_mass_only_modification"] == 40
    assert whole["mean"] == pytest.approx(np.mean(angles)) and whole["histogram"] == histogram(angles)
    assert whole["p25"] == pytest.approx(np.quantile(angles, 0.25)) and whole["r_squared"] is None
    for name in (None, "d1"):
        mine = [r for r in rows if r[0] == name and r[4] is not None and not math.isnan(r[6])]
        x, y = np.array([r[7] for r in mine]), np.array([r[6] for r in mine])
        slope, intercept = np.polyfit(x, y, 1)
        line = got["dataset", name]
        assert line["r_squared"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
        assert line["residual_mae"] == pytest.approx(np.abs(y - slope * x - intercept).mean())
    assert got["dataset", "flat"]["r_squared"] is None and got["dataset", "flat"]["residual_mae"] is None
    empty = reports.multi_grain_report(frame.where("false"))
    assert empty.count() == 0


def test_the_report_file_holds_quantiles_and_ceilings(spark, tmp_path):
    schema = "spectrum_id bigint, raw_file string, proforma string, charge bigint, detector string, fragmentation string, energy double, raw_rt double, andromeda_score double, precursor_intensity double"
    rows = [(i, "run", "PEPTIDE" if i < 6 else "OTHER", 2, "FTMS", "HCD", 30.0, 1.0 + i / 10, float(i), 10.0 + i) for i in range(8)]
    curation = cur.curate(spark.createDataFrame(rows, schema), cur.CurationPolicy(min_in_window_psms=2, width_anchor_min_psms=2, max_run_width_minutes=60.0))
    spectra = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "spectrum_id bigint, ms2 array<double>")
    write_curation(curation, str(tmp_path / "a"), str(tmp_path / "r"), spectra)
    report = json.loads(next(Path(tmp_path / "r").glob("part-*.json")).read_text())
    assert report["input"]["rows"] == 8 and report["replication"]["psms_per_peptidoform"]["p100"] == 6.0
    every = report["achievable_ceiling"]["all"]
    assert every["replicates_compared"] == 8 and sum(every["histogram"]["counts"]) == 8 and 0 < every["mean"] <= 1
    assert report["policy"]["min_in_window_psms"] == 2
