"""Incremental preparation, additive reports, and pushing rows to a caller's sink."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ionloom.functions.spectra import angle_bin
from ionloom.session import materialise


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    step: Callable[[DataFrame], DataFrame],
    output: str,
    state: str,
    fingerprint: str,
    pattern: str = "*.parquet",
    max_files: int = 1000,
    written: Callable[[str, str], None] | None = None,
) -> str:
    """Run ``step`` over files not seen before and add its rows to the output.

    The stream's checkpoint is the record of what is done; it is committed after the data, and a
    batch that ran halfway is written again under its own number instead of twice. Output and
    state live under the settings' fingerprint, so changed settings start afresh. ``written(folder,
    transaction)`` is called after a batch's rows are there, to record them (a manifest log takes a transaction
    once, however often a batch is tried). Returns the output folder.
    """
    target = f"{output.rstrip('/')}/{fingerprint}"

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{target}/batch={number}"
        step(batch).write.mode("overwrite").parquet(folder)
        if written is not None:
            written(folder, f"{fingerprint}:{number}")

    query = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{state.rstrip('/')}/{fingerprint}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target


def maintain_histogram(
    stream: DataFrame, keys: list[str], value: str, output: str, state: str
) -> str:
    """Keep per-group bin counts current as scores arrive.

    The state holds one counter per group and bin, whatever the number of rows. Each trigger
    rewrites the complete small table. Returns the output folder.
    """
    counts = stream.groupBy(*keys, angle_bin(F.col(value)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output.rstrip('/')}/version={number}")

    query = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return output


def latest_version(spark: SparkSession, output: str) -> DataFrame:
    """The newest complete table that :func:`maintain_histogram` wrote."""
    versions = spark.read.parquet(output)
    newest = versions.agg(F.max("version").alias("version"))
    return versions.join(F.broadcast(newest), "version").drop("version")  # one row


def push_rows(rows: DataFrame, open_sink: Callable[[], Callable[[Iterable], object]], receipt: str) -> DataFrame:
    """Hand every partition to a caller's sink as Arrow batches, and return the sink's receipts.

    ``open_sink`` runs in the task and returns a generator function over the partition's batches that yields
    receipt batches under the schema ``receipt``. A retried task calls it again, so a sink has to tolerate a
    repeated partition; the receipts of the task that succeeded are the ones returned.
    """

    def run(batches: Iterable):
        yield from open_sink()(batches)

    return materialise(rows.mapInArrow(run, receipt))
