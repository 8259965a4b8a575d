"""Session helpers: runtime settings, durable lineage cuts, spreading of small scans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL settings every job here relies on. All are session-level and may be set again.
#: Forcing the skew-join rewrite matters: most joins put an aggregate back on the rows it came
#: from, and the next step groups by the same key. Without it AQE leaves a hot key in one task
#: rather than add a shuffle.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Work per row is heavy here; small shuffles still use every core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # A row here often becomes dozens (forms, sites, charges): a task that was given the default 64 MB of peptides would
    # sort gigabytes and spill them.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Rows are whole texts or packed numbers of many sets: ten thousand of them are held several times over on their way
    # to and from Python.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for lineage cuts: the one the session names.

    Only a local master may fall back to a temporary folder. On a cluster a path that one
    machine alone can see would lose data with that machine, so that is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="ionloom-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write the rows once as a table in the shared folder and continue from that copy.

    Used where later steps must see the same rows twice (range boundaries, loops) or would
    compute them twice. The copy outlives any executor, so a lost one costs a re-read and never a
    different answer. Parquet rather than a checkpoint: rows are computed once, and later reads
    take only the columns they need. The folder's owner clears old runs. ``compression`` is the session's unless named.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage, in a job of many short steps.

    Only then does Spark learn that broadcast relations, task binaries and shuffle files of finished steps are out of use.
    A driver with room to spare rarely collects by itself: hundreds of steps fill its memory, and the shared disks.
    """
    spark.sparkContext._jvm.System.gc()


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than the cluster has cores a partition per core.

    For steps that make many rows of one. A scan with enough splits is left as it is, so a large
    input is never shuffled for this. ``scan`` must be a plain scan: its splits are known without
    running anything.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= slots else scan.repartition(slots * 4, key)


def spread_rows(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by ``key`` over several tasks per core, for a step that works long on each.

    A stored table is read in about one split per core: one split more than cores and the step takes twice its time.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(spark.sparkContext.defaultParallelism * 4, partitions), key)
