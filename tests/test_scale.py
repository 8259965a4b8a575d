"""Work per row: what the plans and settings of large runs rely on, and that results are as before."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ionloom.functions import sequence as seq
from ionloom.operators import labeler, sampling
from ionloom.operators.digest import window_text, windows
from ionloom.queries.base import joined
from ionloom.queries.registry import QUERIES
from ionloom.sinks.libraries import fixed


def plan_of(df):
    return df._jdf.queryExecution().toString()


def documents(folder):
    texts = ["Make a peptide of this text, or two. " * 5, "MCKSTR" * 9, "", None, "abc", "Zebra zoo wax buzz"]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    pq.write_table(table, folder / "documents.parquet")
    return str(folder)


def test_windows_are_aggregated_without_a_sort(spark, tmp_path):
    df = QUERIES["sequence_windows"].build(spark, documents(tmp_path))
    assert "SortAggregate" not in plan_of(df)
    protein = spark.createDataFrame([("p", "ACDEFGHIKLMNPQRSTVWYA"), ("q", "YYYYYYYYYYY"), ("r", "AC"), ("s", None)], "protein_id string, residues string")
    made = windows(protein, 8, 11, numbered=True).select("window", "width", "number", window_text(F.col("number")).alias("text")).collect()
    assert len(made) == sum(21 - w + 1 for w in range(8, 12)) + sum(11 - w + 1 for w in range(8, 12))
    assert all(r["text"] == r["window"] for r in made)
    for width in range(8, 12):
        of = [r for r in made if r["width"] == width]
        assert [r["window"] for r in sorted(of, key=lambda r: r["number"])] == sorted(r["window"] for r in of)
    with pytest.raises(ValueError):
        windows(protein, 8, 13, numbered=True)


def test_random_peptides_use_every_core_and_draw_once(spark, tmp_path):
    pq.write_table(pa.table({"p_partkey": pa.array([1, 1, None, *range(2, 200)], pa.int64())}), tmp_path / "part.parquet")
    df = QUERIES["random_peptides"].build(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.count() == 201
    seeds = spark.range(1).select(F.lit(1).alias("k"))
    # drawn for the length, for a residue and for the end, in each form of the plan
    assert plan_of(sampling.random_peptides(seeds, "k")).count("random-residue") <= 4


def test_grids_keep_unknown_masses_and_numbers_are_joined_by_arrow(spark, tmp_path):
    rows = [([57.0, 71.0, 99.0], 2), ([57.0, None, 99.0], 2), (None, 2), ([57.0, 71.0], None), ([57.0], 3)]
    df = spark.createDataFrame(rows, "m array<double>, z int").select(labeler.smooth_labels(F.lit("AGV"), F.col("m"), F.lit(1.0), F.col("z"))["ms2"].alias("ms2"))
    whole, holes, none, uncharged, short = [r["ms2"] for r in df.collect()]
    waves = [0.5 * (1 + math.sin(x / w + 2)) for b, y in ((57.0, 170.0), (128.0, 99.0)) for x, w in ((b, 37.0), (y, 37.0), (b, 74.0), (y, 74.0))]
    assert whole == pytest.approx([w / max(waves) for w in waves])
    assert [x is None for x in holes] == [False, True, False, True, True, True, True, True]
    assert none is None and uncharged == [None] * 4 and short == []
    plan = plan_of(QUERIES["label_roundtrip"].build(spark, documents(tmp_path)))
    assert "format_string" not in plan


def test_joined_numbers_read_as_each_formatted_alone(spark):
    values = [None, 0.0, -0.0, 0.00005, 0.00015, -0.00005, 1.5e-7, -1e-9, 123456.78905, 1e15, 1e22, float("nan"), float("inf"), -float("inf"), *np.random.default_rng(3).random(200).tolist()]
    df = spark.createDataFrame([(values,), ([],), (None,)], "v array<double>")
    for digits in (1, 4, 6):
        apart = F.array_join(F.transform("v", lambda x: fixed(x, digits)), ";")
        for r in df.select(joined("v", digits).alias("a"), apart.alias("b")).collect():
            assert r["a"] == r["b"]


def test_rendering_does_not_walk_the_residues(spark):
    sites = [("r", 2, "K", "UNIMOD:4"), ("r", 2, "K", "+1.5"), ("n", 0, "A", "UNIMOD:1"), ("r", 0, "A", "UNIMOD:35"), ("c", 3, "C", "UNIMOD:2"), ("r", 9, "X", "UNIMOD:9")]
    rows = [("AMKC", sites), ("AMKC", []), ("AMKC", None), (None, sites), ("AMKC", [sites[1], sites[0]])]
    df = spark.createDataFrame(rows, f"p string, s {seq.SITE_TYPE}").select(seq.render_proforma(F.col("p"), F.col("s")).alias("text"))
    assert "split(" not in plan_of(df)
    assert [r["text"] for r in df.collect()] == ["[UNIMOD:1]-A[UNIMOD:35]MK[UNIMOD:4][+1.5]C-[UNIMOD:2]", "AMKC", "", None, "AMK[UNIMOD:4][+1.5]C"]
    rule = seq.parse_rule("ST[UNIMOD:21]")
    found = spark.createDataFrame([("ASKT",), ("AAK",), ("",), (None,)], "p string").select(seq.rule_sites(F.col("p"), rule)["pos"].alias("at"))
    assert [r["at"] for r in found.collect()] == [[1, 3], [], [], None]


def test_tasks_that_make_many_rows_get_little_input(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("8m", "8mb", "8388608")
