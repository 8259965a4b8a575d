"""Distributed least-significant-digit radix sort of packed records.

Records lie in blocks: one row per block, the records of it as packed bytes, at most ``BLOCK`` of them. A pass takes one
digit of the composite key (a high and a low word, read as one number of 128 bits):

1. every block counts its digits (one small row per block and digit that it has);
2. the counts of a digit are added up over the blocks in order, and the digits' totals over the digits (at most
   ``2 ** DIGIT`` numbers, the only thing that the driver sees): the place of a block's first record of a digit;
3. every block sorts its records by the digit, stably, and sends each run to the blocks of its places;
4. every new block puts its runs in order.

Each pass keeps the order of records with equal digits, so after the last pass all are in order by the whole key, and
a record's place is its rank. Blocks are full after the first pass, however the digits are spread: a digit that a third of
all records have is many blocks. Every pass is written as a table in the shared folder before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import materialise

#: Records of a block, and bits of a digit at most.
BLOCK, DIGIT = 1 << 16, 10
_BLOCK_DDL = "block long, n long, records binary"


def blocks(rows: DataFrame, record: np.dtype, pack, size: int = BLOCK) -> DataFrame:
    """The rows as blocks, stored. ``pack`` turns an Arrow batch into an array of ``record``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, record)
        number = TaskContext.get().partitionId() << 32  # blocks are in order by scan split, then by place
        for batch in batches:
            held = np.concatenate([held, pack(batch)])
            while len(held) >= size:
                yield _block_rows([number], [held[:size]])
                held, number = held[size:], number + 1
        if len(held):
            yield _block_rows([number], [held])

    return materialise(rows.mapInArrow(run, _BLOCK_DDL))


def _block_rows(numbers: list[int], records: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int64()), pa.array([len(r) for r in records], pa.int64()), pa.array([r.tobytes() for r in records], pa.binary())], names=["block", "n", "records"]
    )


def digit(records: np.ndarray, shift: int, width: int) -> np.ndarray:
    """Bits ``shift`` to ``shift + width`` of the composite key ``high`` ‖ ``low``."""
    low, high = records["low"], records["high"]
    if shift >= 64:
        out = high >> np.uint64(shift - 64)
    else:
        out = low >> np.uint64(shift)
        if shift and shift + width > 64:
            out = out | high << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).astype(np.int64)


def digits(bits_low: int, bits_high: int, most: int = DIGIT) -> list[tuple[int, int]]:
    """``(shift, width)`` of every pass, low digits first; digits of one word are of about equal width."""
    out = []
    for base, bits in ((0, bits_low), (64, bits_high)):
        passes = -(-bits // most)
        at = 0
        for i in range(passes):
            width = (bits - at + passes - i - 1) // (passes - i)
            out.append((base + at, width))
            at += width
    return out


def one_pass(stored: DataFrame, record: np.dtype, shift: int, width: int, size: int = BLOCK, skip: bool = True) -> DataFrame:
    """The blocks after a stable counting sort by one digit, stored; a digit that all records share changes nothing and is skipped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("records").to_pylist()):
                n = np.bincount(digit(np.frombuffer(raw, record), shift, width), minlength=1)
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), block)), pa.array(has), pa.array(n[has].astype(np.int64))], names=["block", "digit", "n"])

    counts = materialise(stored.select("block", "records").mapInArrow(count, "block long, digit long, n long"))
    totals = {r["digit"]: r["n"] for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect()}  # at most 2 ** width rows
    if skip and len(totals) < 2:
        return stored
    start = np.zeros(1 << width, np.int64)
    start[list(totals)] = list(totals.values())
    start = np.cumsum(start) - start

    # The counts of a digit, added up over the blocks: ranges of blocks first, so that no window holds all blocks of a digit.
    ranged = counts.withColumn("range", F.floor(F.col("block") / 512))
    inside = Window.partitionBy("digit", "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("digit").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("digit", "range").agg(F.sum("n").alias("n")).select("digit", "range", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("ranges"))
    places = ranged.withColumn("blocks", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, ["digit", "range"])
    per_block = places.groupBy("block").agg(F.collect_list(F.struct("digit", (F.col("ranges") + F.col("blocks")).alias("place"))).alias("places"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, place in zip(batch.column("records").to_pylist(), batch.column("places").to_pylist()):
                records = np.frombuffer(raw, record)
                key = digit(records, shift, width)
                order = np.argsort(key, kind="stable")
                records, key = records[order], key[order]
                first = np.zeros(1 << width, np.int64)
                for p in place:
                    first[p["digit"]] = start[p["digit"]] + p["place"]
                opens = np.searchsorted(key, key)  # where a record's digit starts in the block
                at = first[key] + np.arange(len(key)) - opens
                cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (at[1:] // size != at[:-1] // size)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[cut] // size), pa.array(at[cut]), pa.array([part.tobytes() for part in np.split(records, cut[1:])], pa.binary())], names=["block", "at", "part"]
                )

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = group.sort_values("at")["part"]
        raw = b"".join(parts)
        return pd.DataFrame({"block": [key[0]], "n": [len(raw) // record.itemsize], "records": [raw]})

    sent = stored.join(per_block, "block").select("records", "places").mapInArrow(send, "block long, at long, part binary")
    return materialise(sent.groupBy("block").applyInPandas(gather, _BLOCK_DDL))


def radix_sort(stored: DataFrame, record: np.dtype, bits_low: int, bits_high: int, size: int = BLOCK) -> DataFrame:
    """The blocks in order of the composite key; block b holds the places from ``b * size`` on.

    Records of equal keys keep the order of the blocks they came in. A digit that all records share costs its count alone.
    """
    moved = False
    for shift, width in digits(bits_low, bits_high):
        after = one_pass(stored, record, shift, width, size)
        moved = moved or after is not stored
        stored = after
    # All keys are equal: the blocks keep their order and are filled.
    return stored if moved else one_pass(stored, record, 0, 0, size, skip=False)
