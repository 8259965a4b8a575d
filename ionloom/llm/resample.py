"""Importance resampling of documents towards the distribution of a target text collection.

A text's features are its words and runs of words (``longest``), each hashed into one of ``buckets`` counters. A
bucket's gain is the scaled log ratio of its smoothed shares in the target and in the documents; a document's weight
is the floored mean gain of its features, summed by array operations over all features of a batch. A fixed draw per
document (Gumbel) is added, and the documents with the highest sums are drawn: sampling without replacement in
proportion to the weights. Ranks come from a distributed radix sort (``radix``) by score, then identifier.

A word is a run of letters a to z, digits and characters from U+0080 on; A to Z count as a to z.

Both count tables have ``buckets`` numbers, whatever the input's size; they are all that reaches the driver.

Defined results
* null text: no words, weight 0; such rows and rows of fewer than ``least_words`` words have a score but are not drawn;
* empty target or documents: counts are 0, gains come from the smoothing alone;
* ties in score: the smaller identifier, null last; rows alike in both are drawn in the order they lie in;
* null identifier: drawn as the text ``null``; repeated rows are drawn one by one, repeated features count each time;
* very long texts and words are whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.radix import BLOCK, blocks, radix_sort
from ionloom.llm.words import PUNCTUATION, row_slices, text_bytes
from ionloom.session import materialise

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Longer features are hashed one by one.
_BYTEWISE = 48


@dataclass(frozen=True)
class Options:
    """``draw`` per cent of the rows with ``least_words`` words; ``seed`` of the draws; ``scale`` of logarithms."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    draw: int = 10
    seed: int = 2024
    scale: int = 1000


def _crc_table() -> np.ndarray:
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ step >> np.uint32(1), step >> np.uint32(1))
    return step


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of many byte ranges at once, a byte of each at a time."""
    order = np.argsort(start - end, kind="stable")  # longest first
    first, length = start[order], (end - start)[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-length, -_BYTEWISE))
    most = int(length[long]) if long < len(length) else 0
    for k in range(most):
        until = int(np.searchsorted(-length, -k))
        part = crc[long:until]
        crc[long:until] = _CRC[(part ^ data[first[long:until] + k]) & np.uint32(255)] ^ part >> np.uint32(8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[first[i] : first[i] + length[i]].tobytes())
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out


def features(texts: pa.Array, options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature, the features before each text (and in all), and the words of each text."""
    raw, offsets = text_bytes(texts)
    rows = len(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64), np.zeros(rows, np.int64)
    inside = ~PUNCTUATION[raw]
    opens = np.zeros(len(raw), bool)
    opens[offsets[:-1][offsets[:-1] < len(raw)]] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | opens[1:]
    ends[:-1] &= ~inside[1:] | opens[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # All words one space apart: a run of words is then a range of bytes.
    size = end - start
    place = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    held = np.ones(len(joined), bool)
    held[place + size] = False
    joined[held] = _LOWER[raw[inside]]
    row = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(row, minlength=rows)
    parts = []
    for n in range(1, options.longest + 1):
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if n > 1 else np.arange(len(row))
        parts.append((row[at], crc32(joined, place[at], place[at + n - 1] + size[at + n - 1])))
    of = np.concatenate([p[0] for p in parts])
    bucket = np.concatenate([p[1] for p in parts]).astype(np.int64) % options.buckets
    if options.longest > 1:
        order = np.argsort(of, kind="stable")
        of, bucket = of[order], bucket[order]
    return bucket, np.searchsorted(of, np.arange(rows + 1)), words


def bucket_counts(texts: DataFrame, options: Options, text: str = "text") -> np.ndarray:
    """How often every bucket occurs. Each task adds up its own; a row per bucket goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(options.buckets, np.int64)
        for batch in batches:
            for part in row_slices(batch, "text"):
                total += np.bincount(features(part.column("text"), options)[0], minlength=options.buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(options.buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray, options: Options) -> np.ndarray:
    """The floored, scaled log ratio of target share and present share of every bucket, smoothed by one."""
    total, wanted = float(have.sum() + options.buckets), float(want.sum() + options.buckets)
    ratio = ((t + 1.0) * total / ((s + 1.0) * wanted) for s, t in zip(have.tolist(), want.tolist()))
    return np.array([math.floor(options.scale * math.log(r)) for r in ratio], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, options: Options, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_features, n_words, weight, score)`` of every row."""
    kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_features", "n_words", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                bucket, before, words = features(part.column("text"), options)
                n = np.diff(before)
                sums = np.r_[0, np.cumsum(gain[bucket])]
                weight = (sums[before[1:]] - sums[before[:-1]]) // np.maximum(n, 1)
                draw = [math.floor(-options.scale * math.log(-math.log((h + 0.5) / 4294967296.0))) for h in part.column("h").to_pylist()]
                columns = [part.column("doc_id"), pa.array(n), pa.array(words), pa.array(weight), pa.array(weight + np.array(draw, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    doc_id = F.col(doc).cast("long")
    drawn = F.sha2(F.concat(F.lit(f"{options.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    source = docs.select(doc_id.alias("doc_id"), F.col(text).alias("text"), F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long").alias("h"))
    return source.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long")


_RECORD = np.dtype([("low", "<u8"), ("high", "<u8"), ("n_features", "<i8"), ("weight", "<i8")])
_RESULT = "doc_id long, n_features long, weight long, score long, rank long"


def ranked(rows: DataFrame, options: Options, size: int = BLOCK) -> DataFrame:
    """The scored rows (stored) with ``rank`` 1, 2, 3… of the drawn ones; null for the others."""
    able = F.col("n_words") >= options.least_words
    number = F.col("doc_id")
    facts = rows.where(able).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.when(number.isNull(), 1)).alias("nameless")).first()
    unable = rows.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not facts["n"]:
        return unable
    top, first = facts["high"], facts["first"] or 0
    spare = int(facts["nameless"] > 0)  # one more bit below the score puts null identifiers last
    base = np.uint64(first % 2**64)
    taken = options.draw * facts["n"] // 100

    def pack(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, _RECORD)
        ids = batch.column("doc_id")
        nameless = ids.is_null().to_numpy(zero_copy_only=False)
        out["low"] = ids.fill_null(first).to_numpy().astype(np.uint64) - base
        out["high"] = ((top - batch.column("score").to_numpy()).astype(np.uint64) << np.uint64(spare)) | nameless
        out["n_features"], out["weight"] = batch.column("n_features").to_numpy(), batch.column("weight").to_numpy()
        return out

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("records").to_pylist()):
                records = np.frombuffer(raw, _RECORD)
                place = block * size + np.arange(len(records))
                nameless = (records["high"] & np.uint64(spare)).astype(bool)
                columns = [
                    pa.array((records["low"] + base).astype(np.int64), mask=nameless),
                    pa.array(records["n_features"]),
                    pa.array(records["weight"]),
                    pa.array(top - (records["high"] >> np.uint64(spare)).astype(np.int64)),
                    pa.array(place + 1, mask=place >= taken),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "weight", "score", "rank"])

    packed = blocks(rows.where(able).select("doc_id", "n_features", "weight", "score"), _RECORD, pack, size)
    bits = ((facts["last"] or 0) - first).bit_length(), (top - facts["low"]).bit_length() + spare
    return radix_sort(packed, _RECORD, *bits, size).select("block", "records").mapInArrow(unpack, _RESULT).unionByName(unable)


def resample(docs: DataFrame, target: DataFrame, options: Options = Options(), doc: str = "doc_id", text: str = "text", target_text: str = "text", size: int = BLOCK) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``; ``rank`` is null where it is not drawn."""
    gain = gains(bucket_counts(docs, options, text), bucket_counts(target, options, target_text), options)
    return ranked(materialise(scored(docs, gain, options, doc, text)), options, size)
