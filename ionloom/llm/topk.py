"""Exact top-k by inner product with no random access.

Per block of candidates and dimension there is a list sorted by value, read from its best end: from the
largest value where the query is positive, from the smallest where it is negative. All lists are read to the
same depth, which doubles; nothing is looked up by candidate. What a candidate has shown so far, plus the
worst and the best its unread lists allow, are its lower and upper bound. Once few candidates have an upper
bound that reaches the k-th lower bound, no outsider can qualify, and the few are resolved exactly.

A block answers a whole batch of queries at once: the depths are shared, so the bounds are a few matrix
products, over the candidates that some query still needs. The k-th lower bound is carried between blocks in two rounds:

1. Every block has a box (least and greatest value of each dimension) and a ball (centre and radius), which bound
   the score of all it holds. Each query meets the block of the highest score at its centre: its k-th score there is a floor.
2. A query block meets every other block that, by box and ball, may hold a score that reaches a query's floor; only
   such queries are asked there, and their floors stop the reading early.

Boxes and balls travel as pages of many blocks, so a query block sees 4 numbers a dimension of a block it does not
need. A task cuts its vectors into blocks at the median of the widest dimension, which keeps clusters together.

Defined results
* a vector that is null, empty or holds a null or non-finite component takes no part, as query or candidate;
* vectors of different lengths: the missing components count as zero;
* repeated rows are candidates of their own; a query leaves out rows with its identifier; a null identifier takes no part;
* ties: the smaller identifier first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import materialise

#: Vectors of a block.
CANDIDATES, QUERIES = 4096, 2048
#: Blocks that a task gathers before it cuts them apart, and blocks whose bounds make a page.
GATHERED, PAGE = 16, 1024
#: Candidates left per query at which reading stops, as a multiple of k.
FEW = 8
_BLOCK = "block long, ids binary, values binary, dims int, bounds binary, radius double"
_PAGE = "blocks binary, page binary, radii binary, page_dims int"


def quantised(vector: str, scale: int):
    """``floor(scale * x)`` of every component as whole numbers in doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def usable(df: DataFrame, vec: str, vector: str) -> DataFrame:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(vec).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)


def _cut(values: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The rows in groups of at most ``size``, halved at the median of the dimension of the widest spread."""
    if len(rows) <= size:
        yield rows
        return
    widest = np.ptp(values[rows], axis=0).argmax()
    halves = rows[np.argpartition(values[rows, widest], len(rows) // 2)]
    yield from _cut(values, halves[: len(rows) // 2], size)
    yield from _cut(values, halves[len(rows) // 2 :], size)


def _blocks(size: int):
    """Vectors of a task as blocks of at most ``size``, all of one width (zeros fill shorter ones), with box and ball."""

    def emit(number: int, ids: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
        dims = max(map(len, rows))
        values = np.zeros((len(rows), dims))
        for i, r in enumerate(rows):
            values[i, : len(r)] = r
        groups = list(_cut(values, np.arange(len(rows)), size))
        parts = [values[g] for g in groups]
        centres = [v.mean(axis=0) for v in parts]
        columns = [
            pa.array(np.arange(number, number + len(groups)), pa.int64()),
            pa.array([ids[g].tobytes() for g in groups], pa.binary()),
            pa.array([v.tobytes() for v in parts], pa.binary()),
            pa.array([dims] * len(groups), pa.int32()),
            pa.array([np.stack([v.min(axis=0), v.max(axis=0), c]).tobytes() for v, c in zip(parts, centres)], pa.binary()),
            pa.array([float(np.sqrt(((v - c) ** 2).sum(axis=1).max())) for v, c in zip(parts, centres)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "values", "dims", "bounds", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids: list[int] = []
        rows: list[np.ndarray] = []
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = 0
            for vec, n in zip(batch.column(0).to_pylist(), lists.value_lengths().to_pylist()):
                ids.append(vec)
                rows.append(flat[at : at + n].copy())
                at += n
                if len(ids) == GATHERED * size:
                    out = emit(number, np.array(ids, np.int64), rows)
                    yield out
                    number, ids, rows = number + len(out), [], []
        if ids:
            yield emit(number, np.array(ids, np.int64), rows)

    return run


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bounds of many blocks in one row."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGE):
            part = batch.slice(at, PAGE).to_pydict()
            dims = max(part["dims"])
            page = np.zeros((3, len(part["block"]), dims))
            for i, (raw, d) in enumerate(zip(part["bounds"], part["dims"])):
                page[:, i, :d] = np.frombuffer(raw).reshape(3, d)
            columns = [np.array(part["block"], np.int64).tobytes(), page.tobytes(), np.array(part["radius"]).tobytes(), dims]
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=["blocks", "page", "radii", "page_dims"])


def _met(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The queries and the blocks of a page, and for each of both the score at the centre and the most a member can score."""
    width = max(row["q_dims"], row["page_dims"])
    queries = _read(row["q_values"], row["q_dims"], width)
    blocks = np.frombuffer(row["blocks"], np.int64)
    page = np.pad(np.frombuffer(row["page"]).reshape(3, len(blocks), -1), ((0, 0), (0, 0), (0, width - row["page_dims"])))
    least, most, centre = page
    middle = queries @ centre.T
    norm, far = np.linalg.norm(queries, axis=1)[:, None], np.frombuffer(row["radii"])
    # The rounding of centres and products is far below the part added here.
    ball = middle + norm * (far + 1e-9 * (far + np.linalg.norm(centre, axis=1))) + 1e-6
    box = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    return queries, blocks, middle, np.minimum(ball, box)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each query the block of the page with the highest score at its centre."""
    for batch in batches:
        for row in batch.to_pylist():
            queries, blocks, middle, _ = _met(row)
            best = middle.argmax(axis=1)
            n = len(queries)
            columns = [pa.array(np.full(n, row["q_block"]), pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array(blocks[best], pa.int64()), pa.array(middle[np.arange(n), best], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["q_block", "place", "block", "middle"])


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the page that may hold a score of a query's floor or more."""
    for batch in batches:
        for row in batch.to_pylist():
            queries, blocks, _, bound = _met(row)
            floors = _floors(row, len(queries))[:, None]
            found = blocks[(bound >= floors - _slack(floors)).any(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row["q_block"]), pa.int64()), pa.array(found, pa.int64())], names=["q_block", "block"])


def _floors(row: dict, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    for f in row["floors"] or ():
        out[f["place"]] = f["floor"]
    return out


def _slack(floors: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(floors), 1e-6 * (1 + np.abs(floors)), 0)


def _read(values: bytes, dims: int, width: int) -> np.ndarray:
    m = np.frombuffer(values, np.float64).reshape(-1, dims)
    return m if dims == width else np.pad(m, ((0, 0), (0, width - dims)))


def no_random_access(queries: np.ndarray, query_ids: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query: its place, the identifiers and scores of its best ``k`` that reach its floor, and the depth read."""
    n, dims = values.shape
    order = np.argsort(values, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], (n, dims)), axis=0)
    ordered = np.take_along_axis(values, order, axis=0)
    least, most = ordered[0], ordered[-1]
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    floors = np.full(len(queries), -np.inf) if floors is None else floors.copy()
    left = np.arange(len(queries))
    needed = np.arange(n)  # candidates that some query left may still want
    depth = max(1, n // 16)
    while len(left):
        depth = min(n, depth)
        from_top, from_bottom = rank[needed] >= n - depth, rank[needed] < depth
        top, bottom = ordered[n - depth], ordered[depth - 1]  # the last value read of each list
        u, d, v = up[left], down[left], values[needed]
        # Unread lists: between the worst value of the list and the last one read. Read ones: the value itself.
        seen_low = np.where(from_top, v, least) @ u.T + np.where(from_bottom, v, most) @ d.T
        seen_high = np.where(from_top, v, top) @ u.T + np.where(from_bottom, v, bottom) @ d.T
        rest, wanted = [], np.zeros(len(needed), bool)
        for j, q in enumerate(left.tolist()):
            others = ids[needed] != query_ids[q]
            low = seen_low[others, j]
            if len(low) >= k:
                floors[q] = max(floors[q], np.partition(low, len(low) - k)[len(low) - k])
            alive = others & (seen_high[:, j] >= floors[q] - _slack(floors[q]))
            if alive.sum() <= FEW * k or depth == n:
                at = needed[alive]
                yield q, *_resolve(queries[q], values[at], ids[at], k), depth
            else:
                rest.append(q)
                wanted |= alive
        left, needed = np.array(rest, np.int64), needed[wanted]
        depth *= 2


def _resolve(query: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores = values.astype(np.int64) @ query.astype(np.int64)
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def _answer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = max(row["q_dims"], row["dims"])
                queries, values = _read(row["q_values"], row["q_dims"], width), _read(row["values"], row["dims"], width)
                query_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                least, most, _ = np.pad(np.frombuffer(row["bounds"]).reshape(3, -1), ((0, 0), (0, width - row["dims"])))
                floors = _floors(row, len(queries))
                bound = np.maximum(queries, 0) @ most + np.minimum(queries, 0) @ least
                asked = np.flatnonzero(bound >= floors - _slack(floors))
                found = [(asked[f[0]], *f[1:]) for f in no_random_access(queries[asked], query_ids[asked], values, ids, k, floors[asked])]
                if not found:
                    continue
                size = [len(f[1]) for f in found]
                columns = [
                    pa.array(np.repeat([f[0] for f in found], size), pa.int64()),
                    pa.array(np.repeat([query_ids[f[0]] for f in found], size), pa.int64()),
                    pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                    pa.array(np.concatenate([f[2] for f in found]), pa.int64()),
                ]
                place = pa.array(np.full(sum(size), row["q_block"]), pa.int64())
                yield pa.RecordBatch.from_arrays([place, *columns], names=["q_block", "place", "query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, vec: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, n_candidates: int = CANDIDATES, n_queries: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` candidates of highest integer inner product of each query."""
    def blocks(df: DataFrame, size: int) -> DataFrame:
        narrow = usable(df.select(F.col(vec).cast("long").alias("vec"), F.col(vector).alias("vector")), "vec", "vector")
        return narrow.select("vec", quantised("vector", scale).alias("vector")).mapInArrow(_blocks(size), _BLOCK)

    # Few small query blocks: gather the tasks' part-filled ones by packing them from fewer partitions.
    parts = max(1, -(-queries.count() // (GATHERED * n_queries)))
    q = materialise(blocks(queries.repartition(parts, vec), n_queries))
    q = q.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.col("dims").alias("q_dims"), F.shiftright("block", 33).alias("q_part"))
    c = materialise(blocks(candidates, n_candidates))
    pages = materialise(c.select("block", "dims", "bounds", "radius").mapInArrow(_pages, _PAGE))
    first = materialise(first_visits(q, pages, parts))
    begun = materialise(_scored(first, q.withColumn("floors", F.lit(None).cast(_FLOORS)), c, k))
    floored = q.join(_carried(begun, k), "q_block", "left")
    further = further_visits(floored, pages, parts).join(first, ["q_block", "block"], "left_anti")
    ranked = _best(begun.unionByName(_scored(further, floored, c, k)), k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_FLOORS = "array<struct<place:long,floor:double>>"


def _paged(q: DataFrame, pages: DataFrame, parts: int) -> DataFrame:
    """Each page beside each query block; the pages are repeated per group of query blocks."""
    repeated = pages.withColumn("q_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return repeated.join(q, "q_part")


def first_visits(q: DataFrame, pages: DataFrame, parts: int) -> DataFrame:
    """``(q_block, block)``: for every query the block with the highest score at its centre."""
    near = _paged(q, pages, parts).mapInArrow(_nearest, "q_block long, place long, block long, middle double")
    return near.groupBy("q_block", "place").agg(F.max(F.struct("middle", "block")).alias("best")).select("q_block", F.col("best.block").alias("block")).distinct()


def further_visits(q: DataFrame, pages: DataFrame, parts: int) -> DataFrame:
    """``(q_block, block)`` of all blocks that may hold a score of a query's floor."""
    return _paged(q, pages, parts).mapInArrow(_reaching, "q_block long, block long")


def _scored(visits: DataFrame, q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    met = visits.join(c, "block").join(q, "q_block").repartition(F.col("q_block"), F.col("block"))
    return met.mapInArrow(_answer(k), "q_block long, place long, query_id long, vec_id long, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _carried(scored: DataFrame, k: int) -> DataFrame:
    """The ``k``-th score of each query that has so many, listed by query block: at most a block's queries in a row."""
    kth = _best(scored, k).where(F.col("rank") == k)
    return kth.groupBy("q_block").agg(F.collect_list(F.struct("place", F.col("score").cast("double").alias("floor"))).alias("floors"))
