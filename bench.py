"""Headline timings: one JSON line with wall seconds per query.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_ONLY`` (comma separated) a
subset of the registered queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

HEADLINE = (
    "charged_forms",
    "tryptic_digest",
    "protein_group_membership",
    "sequence_windows",
    "modified_forms",
    "fragment_mz",
    "decoy_collisions",
    "decoy_search",
    "precursor_table",
    "batch_labels",
    "localization_resolve",
    "fragment_metadata_join",
    "max_collapse",
    "dense_grid",
    "curation_annotations",
    "consensus_ceiling",
    "quantile_sets",
    "spectral_angle",
    "distribution_report",
    "facet_report",
    "regression",
    "validation_winners",
    "library_precursors",
    "diann_rows",
    "speclib_entries",
    "fasta_scan",
    "balanced_ranges",
    "library_build",  # last: it fills the heap that the others would meet
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    from pyspark.sql import SparkSession

    from ionloom.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ionloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ionloom-bench-"))  # a local master: one machine sees it
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    seconds: dict[str, float] = {}
    library: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        result = QUERIES[name].build(spark, sf_dir)
        if name == "library_build":  # a few rows of counts, which give the throughput
            rows = result.collect()
            library = {
                "precursors": sum(r["precursors"] for r in rows),
                "kept_fragments": sum(r["fragments"] for r in rows),
            }
        else:
            result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
                **({"library": library} if library else {}),
            }
        )
    )


if __name__ == "__main__":
    main()
