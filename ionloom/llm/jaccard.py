"""Exact Jaccard join of word-shingle sets by universe-partition pigeonhole.

Two sets with sizes a <= b and similarity t or more differ in at most H(a) shingles. Sets are grouped into
size bands so that a pair lies in one band or in two that meet. For the band of the smaller set the hashed
universe is cut into segments; among any H(a) + 1 of its non-empty segments one is the same in both.
Every eighth segment of a band also gets its one-deletion neighbourhood (the hash of the segment less one
shingle): such a segment covers two differences, as a segment that differs in one shingle is met as well.

1. One pass over the texts makes the signatures: for a set's own band, and as the larger partner for the
   band below. They move as packed numbers, split by signature, and only signatures that two
   different sets share come back as rows.
2. Allocation, for either band. A signature nobody shares covers its difference for nothing. What is
   missing to H + 1 is taken from the cheapest shared segments, the cost being the length of their lists. A set that
   is covered without any has no partner there and leaves all lists. So a common passage alone brings no candidate.
3. Candidates come from the lists taken. Every set is first compared with the leader it shares most lists with, the
   leader of a list being its set with most shared segments. Then only lists count whose sets are in
   different components; of two such sets the one in the smaller component looks for the other (the
   pigeonhole holds from either side). Lists travel as arrays, candidates are met in blocks, a parity sketch
   (one bit flips per shingle, so differing bits bound the difference from below) settles most of them, and the rest
   is verified on whole shingle sets. So no link between components is lost, and no pair of a group becomes a row.

Equal sets are one class from the start. A signature that is frequent already within one task's chunk is spread
over all partitions by set, so its list is not gathered in one task.

Words and shingles are 64-bit hashes, sets are told apart by a 64-bit hash. Of a signature its bucket and 40 bits are
kept, which can only add candidates.

Defined results
* null or empty text: no shingle, linked with nothing, a component of its own;
* fewer words than the width: the whole sequence is the only shingle;
* repeated rows and identifiers: each row is returned; the component is the smallest identifier in it;
* null identifier: it takes part, its component is the smallest identifier that is not null, or null;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.graph import components
from ionloom.llm.words import SLICE, mix, row_slices, shingles, words
from ionloom.operators.joins import null_safe
from ionloom.session import let_go, materialise

#: Sets of up to this many shingles form the lowest band; there every shingle is a segment.
TINY = 64
#: One segment in this many gets a one-deletion neighbourhood.
DELETIONS = 8
#: Sets of a chunk, and signatures of one; a signature this frequent in a chunk is spread.
CHUNK_SETS, CHUNK_SIGNATURES, FREQUENT = 8192, 1 << 20, 128
#: Bytes of input for each bucket of signatures, the buckets of small inputs, and the most a chunk is split into. A set is
#: named once in each bucket that has signatures of it, so more buckets than memory asks for are bytes to move.
BUCKET_BYTES, FEW_BUCKETS, MOST_BUCKETS = 16 << 20, 32, 1 << 16
#: Signatures of a bucket that are looked at in one turn.
TURN_SIGNATURES = 1 << 18
#: Identifiers that are broadcast at most (8 bytes each) to fetch the texts of candidates; beyond, a shuffle join.
BROADCAST_IDS = 2_000_000
#: Places of sets in blocks that are broadcast at most (16 bytes each); beyond, whole sets are shuffled once more.
BROADCAST_PLACES = 1_000_000

#: Sets of a list that travel in one row.
LIST_BLOCK = 4096

OWN, DELETION, SPREAD, MARK = 1, 2, 4, 8
#: Bits kept of a signature within its bucket.
KEPT = np.uint64(40)


@dataclass(frozen=True)
class Bands:
    """Size bands for a threshold of ``num / den``; ``low[k]`` is the least size of band k."""

    num: int = 75
    den: int = 100

    def partner(self, a):
        """The largest size that can link with a set of size ``a`` as the smaller."""
        return a * self.den // self.num

    def differences(self, a):
        """The most shingles in which a linked pair differs whose smaller set has ``a``."""
        return (a + self.partner(a)) * (self.den - self.num) // (self.den + self.num)

    def differences_below(self, b, low):
        """The same for a set of size ``b`` and a smaller partner of less than ``low``."""
        return (np.minimum(b, low - 1) + b) * (self.den - self.num) // (self.den + self.num)

    def low(self, most: int) -> list[int]:
        out = [1, TINY + 1]
        while out[-1] <= most:
            out.append(max(self.partner(out[-1] - 1) + 1, out[-1] + 1))
        return out

    def segments(self, low: int, high: int) -> int:
        """Segments of the band ``[low, high)``: enough that non-empty ones outnumber the differences by far."""
        share = 1.5 if high < 300 else 2.0 if high < 1000 else 2.4
        # The rule holds for thresholds from 0.7; a lower one needs more segments for its differences.
        spare = max(1.0, self.differences(high) / max(1.0, high / 3.0))
        return int(high / share * spare) + 1


class _Signer:
    """Signatures of one set in its own band and the one below."""

    def __init__(self, bands: Bands):
        self.bands, self.lows = bands, bands.low(1 << 12)

    def band(self, n: int) -> int:
        if n >= self.lows[-1]:
            self.lows = self.bands.low(4 * n)
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def sign(self, g: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """``(signatures of segments, those of deletions, the segments of these, cover)``."""
        salt = np.uint64((band + 1) * 0xC2B2AE3D27D4EB4F & (2**64 - 1))
        none = np.zeros(0, np.int64)
        if band == 0:
            return mix(g ^ salt), np.zeros(0, np.uint64), none, len(g)
        count = self.bands.segments(self.lows[band], self.lows[band + 1])
        segment = ((g >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)  # ascending, as g is
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        spread = mix(g)
        sums = np.add.reduceat(spread, first)
        ids = segment[first]
        size = np.diff(np.r_[first, len(g)])
        tagged = mix(ids + salt)
        exact = mix(sums ^ tagged)
        chosen = (ids % np.uint64(DELETIONS) == 0) & (size >= 2)
        if not chosen.any():
            return exact, np.zeros(0, np.uint64), none, len(ids)
        of = np.repeat(np.arange(len(ids)), size)
        less = chosen[of]
        of = of[less]
        deletions = mix((sums[of] - spread[less]) ^ tagged[of])
        # The exact signatures of these segments come first among the deletions, as one item with them.
        own = np.flatnonzero(chosen)
        return (
            exact[~chosen],
            np.r_[exact[own], deletions],
            (np.r_[ids[own], ids[of]] // np.uint64(DELETIONS)).astype(np.int64),
            int(len(ids) + chosen.sum()),
        )


def _let_go() -> None:
    """Give back what Arrow holds in reserve: a worker stays for other stages, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()


def set_id(g: np.ndarray) -> int:
    """The 64-bit identity of a shingle set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(mix(g ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(g))], np.uint64))[0])


_PACKED = (
    "bucket int, sets binary, counts binary, low binary, high binary, tags binary, items binary, homes binary, "
    "doc_ids binary, doc_null binary, doc_sets binary, doc_n binary, doc_cover binary, doc_cover_below binary"
)
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
_SHARED = "kind byte, doc_id long, cid long, n int, cover int, cover_below int, sig long, own boolean, item long, cost int"


def _narrow(values: np.ndarray) -> bytes:
    """The numbers in as few bytes each as the largest needs; a reader knows how many there are."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8).tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_narrow``."""
    return np.frombuffer(packed, f"u{len(packed) // n}").astype(np.uint32) if n else np.zeros(0, np.uint32)


def _halved(tags: np.ndarray) -> bytes:
    """Tags, two to a byte."""
    even = np.r_[tags, np.zeros(len(tags) % 2, np.uint8)]
    return (even[::2] | even[1::2] << 4).tobytes()


def _doubled(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` tags of ``_halved``."""
    pairs = np.frombuffer(packed, np.uint8)
    return np.stack([pairs & 15, pairs >> 4], axis=1).ravel()[:n]


class _Chunk:
    """Signatures of some sets, to be split into buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}
        self.docs: list[tuple] = []
        self.sig, self.ref, self.tag, self.item, self.held = [], [], [], [], 0

    def add(self, doc_id: int | None, g: np.ndarray, signer: _Signer) -> None:
        n = len(g)
        if not n:
            self.docs.append((doc_id, 0, 0, 0, 0))
            return
        cid = set_id(g)
        band = signer.band(n)
        if cid in self.known:
            self.docs.append((doc_id, cid, n, *self.known[cid]))
            return
        place = len(self.known)
        cover = [0, 0]
        for b in (band, band - 1) if band else (band,):
            exact, gone, items, weight = signer.sign(g, b)
            tag = OWN if b == band else 0
            cover[0 if b == band else 1] = weight
            self.sig += [exact, gone]
            self.ref.append(np.full(len(exact) + len(gone), place, np.uint16))
            self.tag += [np.full(len(exact), tag, np.uint8), np.full(len(gone), tag | DELETION, np.uint8)]
            self.item.append(items)
            self.held += len(exact) + len(gone)
        if cover[0] <= signer.bands.differences(n) or band and cover[1] <= signer.bands.differences_below(n, signer.lows[band]):
            raise ValueError("too few segments hold a shingle; raise Bands.segments")
        self.known[cid] = tuple(cover)
        self.docs.append((doc_id, cid, n, *cover))

    def batches(self, flush: int) -> Iterator[pa.RecordBatch]:
        """The rows of the chunk, some at a time."""
        rows = {c: [] for c in _PACKED_NAMES}

        def row(bucket: int, **values) -> None:
            for c in _PACKED_NAMES:
                rows[c].append(bucket if c == "bucket" else bytes(values.get(c, b"")))

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(rows[c], pa.int32() if c == "bucket" else pa.binary()) for c in _PACKED_NAMES]
            for c in _PACKED_NAMES:
                rows[c].clear()
            return pa.RecordBatch.from_arrays(arrays, names=_PACKED_NAMES)

        ids, sets, n, cover, below = zip(*self.docs) if self.docs else ((), (), (), (), ())
        row(
            flush % self.buckets,
            doc_ids=np.array([i or 0 for i in ids], np.int64).tobytes(),
            doc_null=np.array([i is None for i in ids], np.uint8).tobytes(),
            doc_sets=np.array(sets, np.uint64).tobytes(),
            doc_n=np.array(n, np.int32).tobytes(),
            doc_cover=np.array(cover, np.int32).tobytes(),
            doc_cover_below=np.array(below, np.int32).tobytes(),
        )
        if self.held:
            cids = np.array(list(self.known), np.uint64)
            sig = np.concatenate(self.sig)
            home = (sig >> KEPT) % np.uint64(self.buckets)
            sig = home << KEPT | sig & np.uint64((1 << int(KEPT)) - 1)
            ref = np.concatenate(self.ref)
            tag = np.concatenate(self.tag)
            item = np.zeros(len(sig), np.uint32)
            item[(tag & DELETION) > 0] = np.concatenate(self.item).astype(np.uint32)
            bucket = home.astype(np.uint16)
            hot = _frequent(sig)
            if len(hot):
                spread = np.isin(sig, hot)
                tag[spread] |= SPREAD
                bucket[spread] = (mix(sig[spread] ^ cids[ref[spread]]) % np.uint64(self.buckets)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            sig, ref, tag, item, bucket = sig[order], ref[order], tag[order], item[order], bucket[order]
            marks = hot >> KEPT
            edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
            for b in range(self.buckets):
                low, high = edges[b], edges[b + 1]
                marked = hot[marks == b]
                if low == high and not len(marked):
                    continue
                s, r, t, i = sig[low:high], ref[low:high], tag[low:high], item[low:high]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
                held = cids[r[first]]
                counts = np.diff(np.r_[first, len(r)])
                if len(marked):  # the list of a spread signature is not kept here: tell the other chunks
                    s, t = np.r_[s, marked], np.r_[t, np.full(len(marked), MARK, np.uint8)]
                    i = np.r_[i, np.zeros(len(marked), np.uint32)]
                    held, counts = np.r_[held, np.uint64(0)], np.r_[counts, len(marked)]
                row(
                    b,
                    sets=held.tobytes(),
                    counts=_narrow(counts),
                    low=(s & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                    high=(s >> np.uint64(32)).astype(np.uint8).tobytes(),
                    tags=_halved(t),
                    items=_narrow(i[(t & DELETION) > 0]),
                    homes=(s[(t & SPREAD) > 0] >> KEPT).astype(np.uint16).tobytes(),
                )
                if len(rows["bucket"]) >= 16:
                    yield batch()
        if rows["bucket"]:
            yield batch()


def _frequent(sig: np.ndarray) -> np.ndarray:
    """Signatures that occur ``FREQUENT`` times or more."""
    bins = (sig & np.uint64(0xFFFF)).astype(np.int64)
    full = np.bincount(bins, minlength=1 << 16) >= FREQUENT
    if not full.any():
        return np.zeros(0, np.uint64)
    values, counts = np.unique(sig[full[bins]], return_counts=True)
    return values[counts >= FREQUENT]


def _signatures(bands: Bands, width: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(bands)
        flush = (TaskContext.get().partitionId() + 1) * 7919
        chunk = _Chunk(buckets)
        for batch in batches:
            for part in row_slices(batch, "text", SLICE):
                for doc_id, g in zip(part.column("doc_id").to_pylist(), shingles(words(part.column("text")), width)):
                    chunk.add(doc_id, g, signer)
                    if len(chunk.known) >= CHUNK_SETS or chunk.held >= CHUNK_SIGNATURES or len(chunk.docs) >= 16 * CHUNK_SETS:
                        yield from chunk.batches(flush)
                        flush, chunk = flush + 1, _Chunk(buckets)
                        _let_go()
        if chunk.docs:
            yield from chunk.batches(flush)
        _let_go()

    return run


def _listed(some: np.ndarray, low: np.ndarray, high: np.ndarray, tags: np.ndarray, items: np.ndarray, homes: np.ndarray, held: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(sig, cid, own, item, cost)`` of the shared among some signatures of a bucket; all entries of a signature are there."""
    cid, tag, item = held[place[some]], tags[some], items[some]
    sig = low[some].astype(np.uint64) | high[some].astype(np.uint64) << np.uint64(32) | homes[some].astype(np.uint64) << KEPT
    marked = np.unique(sig[(tag & MARK) > 0])
    passed = ((tag & (SPREAD | MARK)) == SPREAD) | (np.isin(sig, marked) & ((tag & MARK) == 0) if len(marked) else np.zeros(len(sig), bool))
    listed = np.flatnonzero(~passed & ((tag & MARK) == 0))
    order = listed[np.argsort(sig[listed])]
    s = sig[order]
    same = np.r_[False, s[1:] == s[:-1]] if len(s) else np.zeros(0, bool)
    shared = same | np.r_[same[1:], False] if len(s) else same
    order = order[shared]
    # One entry per (signature, set): equal sets of other chunks fall together here.
    order = order[np.lexsort((item[order], cid[order], sig[order]))]
    s, c, o = sig[order], cid[order], tag[order] & OWN
    if len(s):
        fresh = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]
        order, s, c, o = order[fresh], s[fresh], c[fresh], o[fresh]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        useful = (size > 1) & (np.add.reduceat(o.astype(np.int64), first) > 0)
        cost = np.repeat(size, size)
        keep = np.repeat(useful, size)
        order, cost = order[keep], cost[keep]
    else:
        cost = np.zeros(0, np.int64)
    frequent = np.flatnonzero(passed)
    if len(frequent):
        order, cost = np.r_[order, frequent], np.r_[cost, np.full(len(frequent), 1 << 20)]
    return sig[order], cid[order], (tag[order] & OWN) > 0, item[order], cost.astype(np.int32)


def _shared(rows: pa.Table) -> pa.Table:
    """Of one bucket: the rows of documents, and the signatures that two sets share."""
    _let_go()  # of the bucket before

    def joined(name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(b, kind) for b in rows.column(name).to_pylist()] or [np.zeros(0, kind)])

    def unpacked(name: str, numbers: list[int], unpack=_wide) -> np.ndarray:
        return np.concatenate([unpack(b, n) for b, n in zip(rows.column(name).to_pylist(), numbers)] or [np.zeros(0, np.uint8)])

    def lengths(name: str) -> np.ndarray:
        return pc.binary_length(rows.column(name)).to_numpy()

    counts = unpacked("counts", (lengths("sets") // 8).tolist())
    held = joined("sets", np.uint64)
    place = np.repeat(np.arange(len(held), dtype=np.uint32), counts)
    low, high = joined("low", np.uint32), joined("high", np.uint8)
    sizes = lengths("high")
    tags = unpacked("tags", sizes.tolist(), _doubled)
    deleted, spread = (tags & DELETION) > 0, (tags & SPREAD) > 0
    before = np.r_[0, np.cumsum(deleted)][np.r_[0, np.cumsum(sizes)]]
    items = np.full(len(low), -1, np.int32)
    items[deleted] = unpacked("items", np.diff(before).tolist())
    homes = np.full(len(low), rows.column("bucket")[0].as_py() if len(rows) else 0, np.uint16)
    homes[spread] = joined("homes", np.uint16)
    # Signatures are taken in turns, so that beside the packed rows only a part of them is spread out at a time.
    turns = min(max(1, -(-len(low) // TURN_SIGNATURES)), 1 << 15)
    turn = (low % np.uint32(turns)).astype(np.uint16)
    parts = [_listed(np.flatnonzero(turn == k), low, high, tags, items, homes, held, place) for k in range(turns)]
    sig, cid, own, item, cost = (np.concatenate(c) for c in zip(*parts))
    doc_n = joined("doc_n", np.int32)
    d, m = len(doc_n), len(sig)

    def column(docs: np.ndarray | None, entries: np.ndarray | None, kind: pa.DataType) -> pa.Array:
        parts = [pa.nulls(d, kind) if docs is None else pa.array(docs, kind), pa.nulls(m, kind) if entries is None else pa.array(entries, kind)]
        return pa.concat_arrays(parts)

    doc_ids = pa.array(joined("doc_ids", np.int64), pa.int64(), mask=joined("doc_null", np.uint8) > 0)
    return pa.table(
        {
            "kind": column(np.zeros(d, np.int8), np.ones(m, np.int8), pa.int8()),
            "doc_id": pa.concat_arrays([doc_ids, pa.nulls(m, pa.int64())]),
            "cid": column(joined("doc_sets", np.uint64).view(np.int64), cid.view(np.int64), pa.int64()),
            "n": column(doc_n, None, pa.int32()),
            "cover": column(joined("doc_cover", np.int32), None, pa.int32()),
            "cover_below": column(joined("doc_cover_below", np.int32), None, pa.int32()),
            "sig": column(None, sig.astype(np.int64), pa.int64()),
            "own": column(None, own, pa.bool_()),
            "item": column(None, item.astype(np.int64), pa.int64()),
            "cost": column(None, cost, pa.int32()),
        }
    )


def _short(entries: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Entries of the roles (set, own band or the one below) whose cover is short, with ``weight`` and ``missing``.

    A role covered by segments nobody shares has no partner there. Join and windows go by the set alone, so the
    entries are shuffled once; a set has no more entries than segments.
    """
    known = entries.join(sets.select("cid", "n", "low", "cover", "cover_below"), "cid")
    role = Window.partitionBy("cid", "own")
    items = F.size(F.collect_set(F.when(F.col("item") >= 0, F.col("item"))).over(role))
    n, den, num = F.col("n"), bands.den, bands.num
    own = F.floor((n + F.floor(n * den / num)) * (den - num) / (den + num)) - F.col("cover")
    below = F.floor((F.least(n, F.col("low") - 1) + n) * (den - num) / (den + num)) - F.col("cover_below")
    weighed = known.withColumn("weight", F.sum(F.when(F.col("item") < 0, 1).otherwise(0)).over(role) + 2 * items)
    missing = F.when(F.col("own"), own).otherwise(below) + 1 + F.col("weight")
    return weighed.withColumn("missing", missing).where("missing > 0").drop("n", "low", "cover", "cover_below")


def _allocate(entries: DataFrame) -> DataFrame:
    """Mark the entries whose lists a set has to look at: in each role the cheapest that complete its cover.

    The segments of an item (one with its deletions) are taken together and cover two differences.
    """
    in_item = Window.partitionBy("cid", "own", "item")
    pair = F.col("item") >= 0
    first = F.row_number().over(in_item.orderBy("sig")) == 1
    entries = entries.withColumn("gain", F.when(~pair, 1).when(first, 2).otherwise(0))
    entries = entries.withColumn("price", F.when(pair, F.sum("cost").over(in_item) / 2).otherwise(F.col("cost").cast("double")))
    so_far = Window.partitionBy("cid", "own").orderBy("price", "item", F.desc("gain"), "sig").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("gain").over(so_far) - F.when(pair, 2).otherwise(1)
    return entries.withColumn("taken", before < F.col("missing"))


def _lists(shared: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """``(sig, cid, weight, taken)`` of the roles that can have a partner: covered ones leave all lists.

    Prices are the lengths that lists had before. One pass by set does for cover and allocation: a list that has become
    shorter, or that nobody else is in any more, is at worst one that brings no candidate.
    """
    return materialise(_allocate(_short(shared, sets, bands)).select("sig", "cid", "weight", "taken"))


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", SLICE):
                made = [(set_id(g), g.tobytes()) for g in shingles(words(part.column("text")), width) if len(g)]
                cid = np.array([c for c, _ in made], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array([b for _, b in made], pa.binary())], names=["cid", "members"])
        _let_go()

    return run


def _fetch_sets(docs: DataFrame, wanted: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """``(cid, members)`` of the wanted sets, from the text of one document of each.

    Documents are chosen by identifier, so that only they are read again; a namesake's set may come along and is met by
    nobody. Rows without an identifier are chosen by their sets.
    """
    ids = materialise(sets.join(wanted, "cid").select(F.col("rep").alias("doc_id")))

    def made(rows: DataFrame) -> DataFrame:
        return rows.select("text").mapInArrow(_set_rows(width), "cid long, members binary")

    known = docs.where(F.col("doc_id").isNotNull())
    chosen = known.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    nameless = docs.where(F.col("doc_id").isNull())
    return materialise(made(chosen).unionByName(made(nameless).join(wanted, "cid", "left_semi")))


def _sketches(members: list[np.ndarray], words_: int) -> np.ndarray:
    """Parity sketches: each shingle flips one bit of its set's row."""
    out = np.zeros((len(members), words_), np.uint64)
    bits = np.uint64(64 * words_)
    for row, g in zip(out, members):
        at = (mix(g) >> np.uint64(16)) % bits
        odd = np.flatnonzero(np.bincount(at.astype(np.int64), minlength=64 * words_) & 1)
        np.bitwise_or.at(row, odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return out


def _links(bands: Bands):
    """Of one block: rows of seekers (with their candidates), of candidates, and of whole sets to links, one per seeker and component."""

    def run(rows: pa.Table) -> pa.Table:
        _let_go()
        whole = pc.is_valid(rows.column("members"))
        sets, rows = rows.filter(whole).select(["cid", "members"]), rows.filter(pc.invert(whole))
        place = {c: i for i, c in enumerate(sets.column("cid").to_pylist())}
        members = [np.frombuffer(b, np.uint64) for b in sets.column("members").to_pylist()]
        wanted = list(zip(*(rows.column(c).to_pylist() for c in ("cid", "label", "seeks"))))
        theirs = {place[c]: label for c, label, seeks in wanted if seeks is None and c in place}
        size = np.array([len(m) for m in members], np.int64)
        most = int(bands.differences(int(size.max()))) if len(size) else 0
        sketch = _sketches(members, max(1, -(-6 * most // 64)))
        out: list[tuple[int, int]] = []
        for c, label, candidates in wanted:
            if candidates is None or c not in place:
                continue
            x = place[c]
            y = np.array([place[k] for k in candidates if place.get(k) in theirs], np.int64)
            y = y[(bands.den * np.minimum(size[y], size[x]) >= bands.num * np.maximum(size[y], size[x]))]
            if not len(y):
                continue
            apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            y = y[apart <= (size[y] + size[x]) * (bands.den - bands.num) // (bands.den + bands.num)]
            done = set()
            for k in y.tolist():
                if theirs[k] in done:
                    continue
                small, large = (members[x], members[k]) if size[x] <= size[k] else (members[k], members[x])
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if bands.den * both >= bands.num * (int(size[x] + size[k]) - both):
                    done.add(theirs[k])
                    out.append((label, theirs[k]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _meet(seekers: DataFrame, members: DataFrame, bands: Bands) -> DataFrame:
    """Links ``(a, b)`` between labels, from rows ``(block, cid, label, seeks)``; ``seeks`` is null for candidates.

    A whole set goes once to each block that names it. Where the names are few they go to the sets, so that sets are
    shuffled by block alone and not for the join as well.
    """
    seekers = materialise(seekers)
    places = materialise(seekers.select("block", "cid").distinct())
    let_go(seekers.sparkSession)
    sent = members.join(F.broadcast(places) if places.count() <= BROADCAST_PLACES else places, "cid").select("block", "cid", "members")
    rows = seekers.unionByName(sent, allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(_links(bands), "a long, b long").distinct()


_SEEKS = "block long, cid long, label long, seeks array<long>"


def _gather(rows: pa.Table) -> pa.Table:
    """Of one block: its lists, each once, and its seekers' rows to one row per seeker and one per candidate."""
    held: dict[int, tuple[np.ndarray, ...]] = {}
    asked: dict[int, list[int]] = {}
    own: dict[int, tuple[int, int]] = {}
    for sig, x, label, size, cids, labels, sizes in zip(*[rows.column(c) for c in ("sig", "cid", "label", "size", "cids", "labels", "sizes")]):
        if cids.is_valid:
            held[sig.as_py()] = tuple(v.values.to_numpy(zero_copy_only=False) for v in (cids, labels, sizes))
        else:
            asked.setdefault(x.as_py(), []).append(sig.as_py())
            own[x.as_py()] = (label.as_py(), size.as_py())
    seeks: list[tuple] = []
    candidates: dict[int, int] = {}
    for x, sigs in asked.items():
        label, size = own[x]
        parts = []
        for sig in sigs:
            y, yl, ys = held[sig]
            larger = (ys > size) | (ys == size) & (yl > label)  # of two components the smaller one seeks
            parts.append(y[larger])
            candidates.update(zip(y[larger].tolist(), yl[larger].tolist()))
        seeks.append((x, label, np.unique(np.concatenate(parts))))
    every = [s for s in seeks if len(s[2])] + [(y, yl, None) for y, yl in candidates.items()]
    columns = list(zip(*every)) if every else ((), (), ())
    block = rows.column("block")[0].as_py() if rows.num_rows else 0
    return pa.table(
        {
            "block": pa.array([block] * len(every), pa.int64()),
            "cid": pa.array(columns[0], pa.int64()),
            "label": pa.array(columns[1], pa.int64()),
            "seeks": pa.array(columns[2], pa.list_(pa.int64())),
        }
    )


def _at_or_below(n: Column, lows: list[int]) -> Column:
    """The greatest of ``lows`` that is not above ``n``."""
    return F.array_max(F.filter(F.array(*[F.lit(x) for x in lows]), lambda x: x <= n))


def _label(cid: Column, label: str) -> Column:
    return F.coalesce(F.col(label), cid)


def _buckets(docs: DataFrame) -> int:
    """Buckets of signatures: each is held, packed, by one Python process, so their number follows the input's bytes."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # rows that were never in a file have no size
    return min(MOST_BUCKETS, max(min(partitions, FEW_BUCKETS), size // BUCKET_BYTES if known else 8 * partitions))


def jaccard_join(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5, buckets: int | None = None, block: int = 256) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    bands = Bands(percent, 100)
    spark = docs.sparkSession
    buckets = buckets or _buckets(docs)
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = source.mapInArrow(_signatures(bands, width, buckets), _PACKED)
    found = materialise(packed.groupBy("bucket").applyInArrow(_shared, _SHARED))
    rows = found.where("kind = 0").select("doc_id", "cid", "n", "cover", "cover_below")
    shared = found.where("kind = 1").select("sig", "cid", "own", "item", "cost")
    sets = rows.where("n > 0").groupBy("cid").agg(*[f("doc_id" if c == "rep" else c).alias(c) for f, c in ((F.min, "rep"), (F.max, "n"), (F.max, "cover"), (F.max, "cover_below"))])
    most = found.where("kind = 0").agg(F.max("n")).first()[0] or 1
    lows = bands.low(int(most))
    sets = materialise(sets.withColumn("low", _at_or_below(F.col("n"), lows)))
    let_go(spark)

    marked = _lists(shared, sets, bands)
    taken = marked.where("taken").select("sig", "cid")
    # Lists that nobody takes cannot bring a candidate.
    lists = materialise(marked.join(taken.select("sig").distinct(), "sig", "left_semi").groupBy("sig", "cid").agg(F.max("weight").alias("weight")))
    let_go(spark)
    members = _fetch_sets(source, lists.select("cid").distinct(), sets, width)
    let_go(spark)

    # Every set against the leader it shares most lists with; a list's leader has the most shared segments.
    leaders = lists.groupBy("sig").agg(F.max_by("cid", F.struct("weight", "cid")).alias("lead"))
    votes = lists.join(leaders, "sig").where("cid <> lead").groupBy("cid", "lead").agg(F.count(F.lit(1)).alias("votes"))
    first = materialise(votes.groupBy("cid").agg(F.max_by("lead", F.struct("votes", "lead")).alias("lead")))
    many = first.groupBy("lead").agg(F.count(F.lit(1)).alias("many"))
    let_go(spark)
    dealt = first.join(many, "lead").withColumn("block", F.xxhash64("lead", F.pmod(F.xxhash64("cid"), F.ceil(F.col("many") / block))))
    seek = dealt.select("block", "cid", F.col("cid").alias("label"), F.array("lead").alias("seeks"))
    heads = dealt.select("block", F.col("lead").alias("cid"), F.col("lead").alias("label"), F.lit(None).cast("array<long>").alias("seeks")).distinct()
    label = materialise(components(_meet(seek.unionByName(heads), members, bands), "a", "b"))
    let_go(spark)

    # Lists whose sets are still apart: the set of the smaller component seeks, block by block.
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    labelled = lists.join(label.join(sizes, "component").withColumnRenamed("node", "cid"), "cid", "left")
    labelled = labelled.select("sig", "cid", _label(F.col("cid"), "component").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.max(F.struct("size", "label")).alias("top"), F.count(F.lit(1)).alias("long"))
    mixed = materialise(mixed.where("a <> z").select("sig", "top", "long"))
    open_ = materialise(labelled.join(mixed, "sig"))
    let_go(spark)
    longest = open_.agg(F.max("long")).first()[0] or 1
    split = F.pmod(F.xxhash64("cid"), F.lit(-(-int(longest) // LIST_BLOCK)))
    arrays = open_.groupBy("sig", split.alias("part")).agg(*[F.collect_list(c).alias(f"{c}s") for c in ("cid", "label", "size")])
    seekers = open_.where((F.col("size") < F.col("top.size")) | (F.col("size") == F.col("top.size")) & (F.col("label") < F.col("top.label")))
    seekers = seekers.join(taken, ["sig", "cid"], "left_semi").select("sig", "cid", "label", "size").join(first, "cid", "left")
    many = seekers.select("lead", "cid").distinct().groupBy("lead").agg(F.count(F.lit(1)).alias("many"))
    seekers = null_safe(seekers, many, ["lead"], "inner")
    arrays = materialise(arrays)
    asked = seekers.join(arrays.select("sig", "part"), "sig")
    asked = materialise(asked.withColumn("block", F.xxhash64("lead", "part", F.pmod(F.xxhash64("cid"), F.ceil(F.col("many") / block)))))
    let_go(spark)
    # A list travels once to each block that asks for it, not once for each seeker.
    sent = asked.select("block", "sig", "part").distinct().join(arrays, ["sig", "part"]).select("block", "sig", "cids", "labels", "sizes")
    both = asked.select("block", "sig", "cid", "label", "size").unionByName(sent, allowMissingColumns=True)
    met = both.groupBy("block").applyInArrow(_gather, _SEEKS)
    joined = components(_meet(met, members, bands), "a", "b").withColumnsRenamed({"node": "label", "component": "whole"})
    label = label.withColumnsRenamed({"node": "cid", "component": "label"})

    of_set = sets.select("cid", "rep").join(label, "cid", "left")
    of_set = of_set.withColumn("label", _label(F.col("cid"), "label")).join(joined, "label", "left").withColumn("label", F.coalesce("whole", "label"))
    of_set = materialise(of_set.select("cid", "rep", "label"))
    let_go(spark)
    smallest = of_set.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = of_set.join(smallest, "label").select("cid", "component_id")
    out = rows.join(named, (rows["cid"] == named["cid"]) & (rows["n"] > 0), "left")
    component = F.when(rows["n"] > 0, named["component_id"]).otherwise(rows["doc_id"])
    return out.select("doc_id", rows["n"].cast("long").alias("n_shingles"), component.alias("component_id"))
