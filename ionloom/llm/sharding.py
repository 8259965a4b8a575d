"""Weighted rendezvous sharding of records by a stable key, in columns only.

Every (key, shard) pair has a fixed draw u in (0, 1) from an MD5 digest; a record goes to the shard
with the smallest ``-ln(u) / weight``. A new shard can only take a record by drawing less than the
present winner, so adding one moves about its share of the records and moves them only into itself.
MD5 rather than an engine's own hash: the placement can be recomputed anywhere.

Defined results
* null key: treated as the text ``null``, so such rows share one shard;
* null text: size is the overhead alone and the checksum is that of no bytes;
* repeated rows and repeated keys: same shard, each row with a slot of its own;
* an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import materialise

#: Hex digits of the digest that make the draw: 52 bits, exact in a double.
_DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """The uniform draw in (0, 1) of a key for one shard."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))
    bits = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double")
    return (bits + 0.5) / float(16**_DIGITS)


def score(key: Column, shard: int, weight: float) -> Column:
    return -F.log(draw(key, shard)) / F.lit(float(weight))


def place(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Add the shard of every row and, if ``grown`` names a column, its shard once one more is added."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    draws = [F.struct(score(F.col(key), i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    best = F.least(*draws) if len(draws) > 1 else draws[0]
    out = df.withColumn("__best", best)
    if grown is not None:
        newer = score(F.col(key), len(weights), grown_weight) < F.col("__best.score")
        out = out.withColumn(grown, F.when(newer, F.lit(len(weights))).otherwise(F.col("__best.shard")))
    return out.withColumn(shard, F.col("__best.shard")).drop("__best")


def number_slots(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without a gap, in the order the rows lie in.

    The rows are written once, so that their place is the same each time it is read. A group of the
    numbering is a shard within one scan split, which is bounded however large the shard; the splits of a
    shard are chained by their counts, one row each.
    """
    rows = materialise(df).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    counts = rows.groupBy("__part", shard).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", shard, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part", shard).orderBy("__at")
    numbered = rows.withColumn("__row", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, ["__part", shard])
        .withColumn(slot, (F.col("__start") + F.col("__row")).cast("long"))
        .drop("__part", "__at", "__start", "__row")
    )
