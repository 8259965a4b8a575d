"""Positions, running totals and exact quantiles without a single-task window.

A window without (or with few) partition keys puts a whole table, or a hot key, into one task.
Here the table is range-sorted once, each row takes its place from its partition, and a carry per
partition makes the places global. The carries number as many as the sort has partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.joins import null_safe
from ionloom.session import materialise

_CHUNK_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def _sorted_chunks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in global order with their chunk (sort partition) and place within it.

    Written once: range boundaries come from sampling, and a second evaluation could cut the
    chunks elsewhere.
    """
    numbered = df.orderBy(*order).withColumn("__sort_mid", F.monotonically_increasing_id())
    return (
        materialise(numbered)
        .withColumn("__sort_chunk", F.shiftright("__sort_mid", _CHUNK_BITS))
        .withColumn("__sort_place", F.col("__sort_mid").bitwiseAND(F.lit((1 << _CHUNK_BITS) - 1)))
    )


def _carries(chunks: DataFrame, amount: Column) -> DataFrame:
    """Per chunk, the total of all chunks before it: one row per sort partition."""
    before = Window.partitionBy(F.lit(0)).orderBy("__sort_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        chunks.groupBy("__sort_chunk")
        .agg(amount.alias("__sort_amount"))
        .select("__sort_chunk", F.coalesce(F.sum("__sort_amount").over(before), F.lit(0)).alias("__sort_carry"))
    )


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Zero-based place of every row in the global order, which must end in a unique key."""
    chunks = _sorted_chunks(df, order)
    carries = _carries(chunks, F.count(F.lit(1)))
    return (
        chunks.join(F.broadcast(carries), "__sort_chunk")
        .withColumn(name, F.col("__sort_carry") + F.col("__sort_place"))
        .drop("__sort_mid", "__sort_chunk", "__sort_place", "__sort_carry")
    )


def with_group_position(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "position"
) -> DataFrame:
    """Zero-based place of every row within its group, safe for a group of any size."""
    placed = with_position(df, [F.col(k).asc_nulls_first() for k in keys] + order, "__sort_global")
    starts = placed.groupBy(*keys).agg(F.min("__sort_global").alias("__sort_start"))
    return (
        null_safe(placed, starts, keys, "left")
        .withColumn(name, F.col("__sort_global") - F.col("__sort_start"))
        .drop("__sort_global", "__sort_start")
    )


def with_running_total(
    df: DataFrame, order: list[Column], weight: Column, name: str = "running", position: str | None = None
) -> DataFrame:
    """Sum of ``weight`` over the rows up to and including each row of the global order.

    ``position`` names a column for the zero-based place, from the same sorted pass.
    """
    chunks = _sorted_chunks(df.withColumn("__sort_weight", weight), order)
    carries = _carries(chunks, F.sum("__sort_weight"))
    inside = Window.partitionBy("__sort_chunk").orderBy("__sort_place").rowsBetween(
        Window.unboundedPreceding, 0
    )
    if position is not None:
        rows_before = _carries(chunks, F.count(F.lit(1))).withColumnRenamed("__sort_carry", "__sort_rows")
        chunks = chunks.join(F.broadcast(rows_before), "__sort_chunk").withColumn(position, F.col("__sort_rows") + F.col("__sort_place"))
    return (
        chunks.withColumn("__sort_inside", F.sum("__sort_weight").over(inside))
        .join(F.broadcast(carries), "__sort_chunk")
        .withColumn(name, F.col("__sort_carry") + F.col("__sort_inside"))
        .drop("__sort_mid", "__sort_chunk", "__sort_place", "__sort_carry", "__sort_weight", "__sort_inside", "__sort_rows")
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, plus ``n``; no values, no row.

    Equal values are counted first, so a group shuffles its distinct values only, and the places
    come from one distributed sort instead of a per-group list.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not keys:
        whole = exact_quantiles(clean.withColumn("__all", F.lit(0)), ["__all"], value, quantiles)
        return whole.drop("__all")
    counts = clean.groupBy(*keys, F.col(value).cast("double").alias("__value")).agg(
        F.count(F.lit(1)).alias("__rows")
    )
    placed = with_running_total(
        counts,
        [F.col(k).asc_nulls_first() for k in keys] + [F.col("__value").asc()],
        F.col("__rows"),
        "__end",
    )
    groups = placed.groupBy(*keys).agg(
        F.min(F.col("__end") - F.col("__rows")).alias("__base"), F.sum("__rows").alias("n")
    )
    rows = null_safe(placed, groups, keys, "left")
    rows = rows.withColumn("__last", F.col("__end") - F.col("__base") - 1).withColumn(
        "__first", F.col("__end") - F.col("__base") - F.col("__rows")
    )

    def at(place: Column) -> Column:
        hit = (F.col("__first") <= place) & (place <= F.col("__last"))
        return F.max(F.when(hit, F.col("__value")))

    out = []
    for name, q in quantiles.items():
        exact = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.floor(exact), F.ceil(exact)
        # one group has one n, so max(n) inside the aggregate only names it
        share = F.max(exact - F.floor(exact))
        out.append((at(low) * (1 - share) + at(high) * share).alias(name))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *out)


def upper_middle(df: DataFrame, keys: list[str], value: str, tie: str, name: str) -> DataFrame:
    """The value at place ``n / 2`` (zero-based) of each group: the upper of two middle ones."""
    ranked = with_group_position(
        df.where(F.col(value).isNotNull()), keys, [F.col(value).asc(), F.col(tie).asc()], "__rank"
    )
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (
        null_safe(ranked, sizes, keys, "inner")
        .where(F.col("__rank") == F.floor(F.col("n") / 2))
        .select(*keys, "n", F.col(value).alias(name))
    )


def evenly_spaced(df: DataFrame, order: list[Column], count: int) -> DataFrame:
    """``count`` rows spread evenly over the order, first and last included."""
    if count < 1:
        raise ValueError("count must be positive")
    placed = with_position(df, order, "__position")
    total = placed.count()
    if count >= total:
        return placed.drop("__position")
    position = F.col("__position")
    if count == 1:
        return placed.where(position == 0).drop("__position")
    # Row p is chosen when some index i has floor(i * step) == p. The step is at least one, so
    # only the index next to p / step can; its neighbour is tried too because of rounding.
    step = (total - 1) / (count - 1)
    near = F.ceil(position / F.lit(step))

    def hits(index: Column) -> Column:
        return (index >= 0) & (index < count - 1) & (F.floor(index * F.lit(step)) == position)

    chosen = hits(near) | hits(near - 1) | (position == total - 1)
    return placed.where(chosen).drop("__position")


def batches(df: DataFrame, length: str, order: list[Column], batch_size: int) -> DataFrame:
    """Batch number within each length: full batches first, the remainder last."""
    placed = with_group_position(df, [length], order, "__in_length")
    return placed.withColumn(
        "batch", F.floor(F.col("__in_length") / F.lit(batch_size)).cast("bigint")
    ).drop("__in_length")


def balanced_ranges(
    df: DataFrame, order: list[Column], weight: str, partitions: int, name: str = "part"
) -> DataFrame:
    """Contiguous ranges of nearly equal weight: ``(part, start, stop, weight)``.

    Boundary ``p`` is the place whose cumulative weight is nearest to ``p`` shares, the earlier on
    a tie, moved just enough that every part holds a row. The places near the targets are found in
    parallel; only ``partitions`` of them reach the driver.
    """
    placed = with_running_total(df, order, F.greatest(F.col(weight), F.lit(1)), "__sum", position="__position")
    size, total = placed.agg(F.count(F.lit(1)), F.max("__sum")).first()
    if not 0 < partitions <= size:
        raise ValueError(f"partitions must be between 1 and {size}")
    marks = placed.select(
        (F.col("__position") + 1).alias("place"),
        F.col("__sum").alias("sum"),
        (F.col("__sum") - F.greatest(F.col(weight), F.lit(1))).alias("before"),
    )
    # A row covers the targets that lie in (before, sum]; it is the first place to reach them.
    share = F.lit(float(total)) / F.lit(float(partitions))
    first = F.floor(F.col("before") / share) + 1
    last = F.least(F.floor(F.col("sum") / share), F.lit(partitions - 1))
    reached = (
        marks.where(first <= last)
        .select("*", F.explode(F.sequence(first, last)).alias("part"))
        .select("part", "place", "sum", "before")
        .orderBy("part")
        .collect()
    )
    boundaries = _boundaries(reached, size, total, partitions, marks)
    spark = df.sparkSession
    rows = [
        (i, int(boundaries[i][0]), int(boundaries[i + 1][0]), int(boundaries[i + 1][1] - boundaries[i][1]))
        for i in range(partitions)
    ]
    return spark.createDataFrame(rows, f"{name} bigint, start bigint, stop bigint, weight bigint")


def _boundaries(reached, size: int, total: int, partitions: int, marks: DataFrame):
    """Nearest allowed place per target, in order. Works on one candidate per part."""
    nearest: dict[int, tuple[int, int]] = {0: (0, 0)}
    fixups: list[tuple[int, int]] = []
    previous = 0
    targets = {row["part"]: row for row in reached}
    for part in range(1, partitions):
        target = total * part / partitions
        low, high = previous + 1, size - (partitions - part)
        row = targets[part]
        options = [(row["place"] - 1, row["before"]), (row["place"], row["sum"])]
        allowed = [o for o in options if low <= o[0] <= high]
        if allowed:
            place, value = min(allowed, key=lambda o: (abs(o[1] - target), o[0]))
            nearest[part] = (place, value)
        else:
            place = low if row["place"] < low else high
            fixups.append((part, place))
        previous = place
    if fixups:
        wanted = [place for _, place in fixups]
        sums = {
            r["place"]: r["sum"] for r in marks.where(F.col("place").isin(wanted)).collect()
        }
        nearest.update({part: (place, sums[place]) for part, place in fixups})
    nearest[partitions] = (size, total)
    return nearest
