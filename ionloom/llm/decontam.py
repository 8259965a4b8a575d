"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question asked again with other figures or persons has
the same template. Windows of template words of all documents are hash-joined with those of the benchmark.
Parts of one number (``3.5``, ``1,200``, ``12/5``) and adjacent words of a name make one placeholder. Two more
streams: one keeps names and units as words, for texts in capitals; one keeps numbers as well and asks for no
share of other words, for copies of tables and figures.

Slots are judged one by one within a run of aligned windows: a window is dropped if one of its slots contradicts
what the run mostly says of that value. A number may become several, or the same as another; a name or unit needs one
most frequent counterpart of its own; windows with equal values always count.

Items with one template are one class: the same placeholders and other words in the same places, the same slots
equal to each other, and in every window enough other words. A class is searched for once, with the slot values of
its least item and the windows that any member has at a place, so documents meet classes and never each of their
members; ``template_classes`` names these. Items with poorer windows, such as series of numbers, share a class only with
equal texts.

A document is contaminated by a class if the windows left cover a stated share of its windows. Items of
8 to 22 words have a second set of shorter windows, at which one change within the item leaves half; these
count together only within a stretch of about twice the item. Documents keep their windows only where a bitmap of the
benchmark's windows has a bit; the bitmap has a fixed size, whatever the size of the benchmark, and the join decides.

Defined results
* null or empty text, on either side: no window, no hit;
* an item of fewer words than a window: one window of its own length, so a changed word (other than in a slot) is no
  hit below 8 words; under ``LEAST`` words: too short to tell, no hit;
* scripts without spaces: each character is a word, and half a word where ``LEAST`` counts;
* numbers are words that start with a digit (``12``, ``5km``); ``covid19`` is a word like others;
* repeated rows: the same hits once; items with equal texts are one class, and hits of their own where members are named;
* ties in the share: the hit with more windows counts; the class goes by its least identifier, null last;
* null identifiers are carried; an empty table on either side gives no hit;
* whole texts are read, very long ones as well; extra columns are ignored, whatever their names are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.words import PUNCTUATION, SLICE, mix, row_slices, text_bytes, windows, words
from ionloom.session import materialise

WIDTH, LEAST = 8, 4
#: Bits of the window bitmap (8 MB).
BITMAP_BITS = 26
#: Words that count as units.
UNITS = "mm cm m km mg g kg ml l s sec min h hr hours minutes seconds days weeks years miles feet inches pounds ounces dollars euros cents percent degrees mph kmh watts volts".split()

_NUMBER, _UNIT, _NAME = (mix(np.array([x], np.uint64))[0] for x in (11, 12, 13))
_UNIT_HASHES = np.sort(words(pa.array([" ".join(UNITS)])).hash)
_ROWS = "id long, variant byte, width byte, hash long, at long, exact long, slots array<long>, offsets array<byte>"
_ITEM_ROWS = f"{_ROWS}, class long, own long"
TEMPLATE, PLAIN, VERBATIM = 0, 1, 2
#: Added to a variant whose windows are shorter, for short items.
SHORT = 4
#: Scripts written without spaces: each character is a word. Their punctuation separates words.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_WIDE_MARKS = r"[\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF61}-\x{FF65}]+"
_STEPS = np.array([int(x) | 1 for x in mix(np.arange(301, 301 + 64, dtype=np.uint64))], np.uint64)


def _spaced(text: pa.Array) -> pa.Array:
    """The texts with every character of an unspaced script as a word of its own."""
    raw, _ = text_bytes(text)
    # First bytes of U+0E00 to U+1FFF, U+3000 to U+9FFF, U+F000 to U+FFFF and what lies above U+FFFF.
    if not ((raw == 0xE0) | (raw == 0xE1) | (raw >= 0xE3)).any():
        return text
    return pc.replace_substring_regex(pc.replace_substring_regex(text, _WIDE_MARKS, " "), _UNSPACED, r" \1 ")


@dataclass
class _Stream:
    """The symbols of one variant: row, symbol, slot or not, full value, and the value that slots map by."""

    variant: int
    row: np.ndarray
    symbol: np.ndarray
    slot: np.ndarray
    full: np.ndarray
    value: np.ndarray


def _merged(w, variant: int, symbol: np.ndarray, slot: np.ndarray, joined: np.ndarray, number: np.ndarray) -> _Stream:
    """Words that continue the slot before them become one symbol with it."""
    head = np.flatnonzero(~joined)
    if not len(head):
        none = np.zeros(0, np.uint64)
        return _Stream(variant, np.zeros(0, np.int64), none, np.zeros(0, bool), none, none)
    place = np.arange(len(joined)) - np.repeat(head, np.diff(np.r_[head, len(joined)]))
    full = mix(np.add.reduceat(w.hash * _STEPS[place % 64], head))
    last = w.hash[np.r_[head[1:], len(joined)] - 1]  # of a name of several words the last one counts
    odd = number[head]
    value = np.where(odd, full | np.uint64(1), last & ~np.uint64(1))
    return _Stream(variant, w.row[head], symbol[head], slot[head], full, value)


def _streams(part: pa.Array) -> tuple:
    """The words, the three variants of their symbols, and each word's part in the template."""
    w = words(_spaced(part), PUNCTUATION, fold=True)
    if not len(w.hash):
        return w, (), w.hash
    first = w.data[w.start]
    number = (first >= 0x30) & (first <= 0x39)
    second = w.data[np.minimum(w.start + 1, len(w.data) - 1)]
    capital = (first >= 0x41) & (first <= 0x5A) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    unit = np.isin(w.hash, _UNIT_HASHES)
    plain = np.where(number, _NUMBER, w.hash)
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(capital, _NAME, w.hash)))
    near = np.zeros(len(w.hash), bool)  # one byte away from the word before
    near[1:] = (w.start[1:] - w.end[:-1] == 1) & (w.row[1:] == w.row[:-1])
    numbers, names = near.copy(), near.copy()
    numbers[1:] &= number[1:] & number[:-1]
    names[1:] &= (template[1:] == _NAME) & (template[:-1] == _NAME)
    no = np.zeros(len(w.hash), bool)
    return w, (
        _merged(w, TEMPLATE, template, number | unit | capital, numbers | names, number),
        _merged(w, PLAIN, plain, number, numbers, number),
        _Stream(VERBATIM, w.row, w.hash, no, w.hash, w.hash),
    ), mix(template) + (numbers | names)


def _weights(w) -> np.ndarray:
    """Words of each row, characters of unspaced scripts as half a word: the measure of ``LEAST``."""
    if not len(w.hash):
        return np.zeros(w.n_rows, np.int64)
    lone = (w.end - w.start == 3) & (w.data[w.start] >= 0xE0)
    halves = np.bincount(w.row, np.where(lone, 1, 2), w.n_rows)
    return halves.astype(np.int64) // 2


def _own_widths(n: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items of n symbols: the width of their windows, and a shorter one at which one change leaves half (0: none)."""
    short = np.select([n >= 3 * WIDTH - 1, n >= 17, n >= 11, (n >= 8) & ~dense], [0, 6, 4, 3], 0)
    return np.minimum(n, WIDTH), short


def _digests(n_rows: int, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A hash of each row's values in their places."""
    out = np.zeros(n_rows, np.uint64)
    np.add.at(out, row, mix(value ^ mix(place.astype(np.uint64) + np.uint64(1))))
    return out


def _classes(w, template: _Stream, part: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each item: its class, and a hash of its words."""
    place = np.arange(len(w.hash)) - w.bounds()[w.row]
    own = _digests(w.n_rows, w.row, place, mix(w.hash) + part)
    bounds = np.searchsorted(template.row, np.arange(w.n_rows + 1))
    start, length = bounds[template.row], np.diff(bounds)[template.row]
    slots = np.flatnonzero(template.slot)
    _, first, which = np.unique(np.stack([template.row[slots].astype(np.uint64), template.value[slots]], 1), axis=0, return_index=True, return_inverse=True)
    equal_to = slots[first][which.ravel()] - start[slots]  # the first slot of the item with this value
    shape = _digests(w.n_rows, w.row, place, part) + _digests(w.n_rows, template.row[slots], slots - start[slots], mix(equal_to.astype(np.uint64)))
    at, width = np.arange(len(template.row)), wide[template.row]
    filled = np.r_[0, np.cumsum(template.slot)]
    others = width - (filled[np.minimum(at + width, len(at))] - filled[at])
    poor = np.zeros(w.n_rows, bool)
    poor[template.row[(at - start + width <= length) & (others < np.maximum((width + 1) // 2, 2))]] = True
    return np.where(poor, own, shape).view(np.int64), own.view(np.int64)


def _window_rows(pairs: tuple[tuple[int, int], ...] | None, bitmap):
    """Rows of windows of the given (variant, width), only those whose bit is set; without a bitmap those of items, by their own widths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            for part in row_slices(batch, "text", SLICE):
                ids = part.column("id").to_pylist()
                w, streams, shape = _streams(part.column("text"))
                weight = _weights(w)
                out: list[tuple] = []
                classes = own = None
                for s in streams:
                    filled = np.r_[0, np.cumsum(s.slot)]
                    bounds = np.searchsorted(s.row, np.arange(w.n_rows + 1))
                    length = np.diff(bounds)
                    wide, short = _own_widths(length, weight < np.diff(w.bounds()))
                    if bits is None and s.variant == TEMPLATE:
                        classes, own = _classes(w, s, shape, wide)
                    mine = pairs if pairs is not None else [(s.variant + SHORT * k, n) for k, own in enumerate((wide, short)) for n in np.unique(own[own > 0]).tolist()]
                    for variant, width in mine:
                        if variant % SHORT != s.variant:
                            continue
                        h = windows(s.symbol, width)
                        if not len(h):
                            continue
                        fine = s.row[: len(h)] == s.row[width - 1 :]
                        if s.variant != VERBATIM:
                            fine &= width - (filled[width:] - filled[: len(h)]) >= max((width + 1) // 2, 2)
                        if bits is None:  # the benchmark: each item by its own width
                            row = s.row[: len(h)]
                            fine &= ((short if variant >= SHORT else wide)[row] == width) & (weight[row] >= LEAST)
                        else:
                            at = h >> np.uint64(64 - BITMAP_BITS)
                            fine &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
                        if not fine.any():
                            continue
                        exact = windows(s.full, width).view(np.int64)
                        for j in np.flatnonzero(fine).tolist():
                            row = int(s.row[j])
                            offsets = np.flatnonzero(s.slot[j : j + width])
                            values = s.value[j + offsets].view(np.int64).tolist()
                            key = int((h[j] ^ np.uint64(variant * 64 + width)).view(np.int64))
                            known = () if bits is not None else (int(classes[row]), int(own[row]))
                            out.append((ids[row], variant, width, key, j - int(bounds[row]), int(exact[j]), values, offsets.tolist(), *known))
                kinds = [pa.int64(), pa.int8(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8())]
                names = ["id", "variant", "width", "hash", "at", "exact", "slots", "offsets"]
                if bits is None:
                    kinds += [pa.int64()] * 2
                    names += ["class", "own"]
                columns = list(zip(*out)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _bitmap(windows_: DataFrame) -> np.ndarray:
    """One bit per hash prefix that occurs; at most 2^20 words reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    word = F.shiftright(place, 6).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63 as int))")
    rows = windows_.groupBy(word).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for r in rows:
        out[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    return out


def _agreeing(slots: set[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """The (item value, document value) that do not contradict what the slots (place, item value, document value) mostly say.

    A number may become several or the same as another: only values rarer than its most frequent ones contradict.
    Names and units need one most frequent value, and no other as frequent that becomes the same.
    """
    votes = Counter((b, d) for _, b, d in slots)
    to, back = defaultdict(list), defaultdict(list)
    for (b, d), n in votes.items():
        to[b].append(n)
        back[d].append(n)

    def leads(counts: list[int], n: int) -> bool:
        return n == max(counts) and counts.count(n) == 1

    return {(b, d) for (b, d), n in votes.items() if b == d or (n == max(to[b]) if b & 1 else leads(to[b], n) and leads(back[d], n))}


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of aligned windows the places whose slots agree, and those whose words are equal."""
    for batch in batches:
        good, same = [], []
        for found in batch.column("found").to_pylist():
            equal = {f["at"] for f in found if f["equal"]}
            agreeing = set(equal)
            if any(not f["equal"] for f in found):
                triples = [(f, [(f["at"] + o, b, d) for o, b, d in zip(f["offsets"], f["item_slots"], f["slots"])]) for f in found]
                fine = _agreeing({t for _, ts in triples for t in ts})
                agreeing |= {f["at"] for f, ts in triples if all((b, d) in fine for _, b, d in ts)}
            good.append(sorted(agreeing))
            same.append(sorted(equal))
        kept = [batch.column(c) for c in ("doc", "class", "variant", "distance")]
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (good, same)]
        yield pa.RecordBatch.from_arrays([*kept, *lists], names=["doc", "class", "variant", "distance", "good", "same"])


def _item_windows(benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text"))
    return items.mapInArrow(_window_rows(None, None), _ITEM_ROWS)


def _members(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every class with its least item and how many it has, and ``(class, id)`` of its members."""
    rows = known.select("class", "id", "own").distinct()
    least = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "own")).alias("least")
    classes = rows.groupBy("class").agg(least, F.count(F.lit(1)).alias("items"))
    return classes.select("class", F.col("least.id").alias("item"), F.col("least.own").alias("own"), "items"), rows.select("class", "id").distinct()


def template_classes(benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(member, class item)`` as ``(item, class_item)`` of every item that is long enough to be searched for."""
    classes, members = _members(materialise(_item_windows(benchmark, item, item_text)))
    return members.join(classes, "class").select(F.col("id").alias(item), F.col("item").alias(f"class_{item}")).distinct()


def _found(docs: DataFrame, known: DataFrame, doc: str, text: str, least_share: float) -> DataFrame:
    """``(doc, class, best)`` of documents and classes; ``known`` are the stored windows of the items."""
    # The key is the window hash with its variant and width mixed into the low bits; the bitmap goes by the high bits.
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(known))
    pairs = tuple(sorted((r["variant"], r["width"]) for r in known.select("variant", "width").distinct().collect()))
    source = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    hits = source.mapInArrow(_window_rows(pairs, bits), _ROWS).select(F.col("id").alias("doc"), "variant", "hash", F.col("at").alias("doc_at"), F.col("exact").alias("doc_exact"), "slots")
    # A class has the slots of its least item and, at each place, every window that a member has there.
    place = ["class", "variant", "at"]
    classes, _ = _members(known)
    lead = known.join(classes.select("class", "own"), ["class", "own"]).select(*place, "width", F.col("slots").alias("item_slots"), "offsets").dropDuplicates(place)
    totals = lead.groupBy("class", "variant").agg(F.count("at").alias("windows"), F.max(F.col("at") + F.col("width")).alias("size"))
    bench = materialise(known.select(*place, "hash").distinct().join(lead.drop("width"), place))
    exact = known.select(*place, F.col("exact").alias("doc_exact")).distinct().withColumn("equal", F.lit(True))
    met = hits.join(bench, ["hash", "variant"]).join(exact, [*place, "doc_exact"], "left")
    # Aligned windows share the distance between the two places.
    window = F.struct("at", F.coalesce("equal", F.lit(False)).alias("equal"), "offsets", "item_slots", "slots")
    runs = met.groupBy("doc", "class", "variant", (F.col("doc_at") - F.col("at")).alias("distance")).agg(F.collect_set(window).alias("found"))
    judged = runs.mapInArrow(_judged, "doc long, class long, variant byte, distance long, good array<long>, same array<long>")
    # Short windows count together only within one stretch of the document; stretches overlap by half.
    placed = judged.where(F.size("good") > 0).join(totals, ["class", "variant"])
    stretch = F.array(F.floor(F.col("distance") / F.col("size")) * 2, F.floor(F.col("distance") / F.col("size") + 0.5) * 2 + 1)
    near = placed.withColumn("stretch", F.explode(F.when(F.col("variant") < SHORT, F.array(F.lit(0).cast("long"))).otherwise(stretch)))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    whole = near.groupBy("doc", "class", "variant", "stretch").agg(distinct("good").alias("matched"), distinct("same").alias("equal"), F.first("windows").alias("windows"))
    shares = whole.withColumn("share", F.col("matched") / F.col("windows")).withColumn("same", F.col("equal") == F.col("matched"))
    best = shares.groupBy("doc", "class").agg(F.max(F.struct("share", "matched", "windows", "same")).alias("best"))
    return best.where(F.col("best.share") >= least_share)


def _named(found: DataFrame, doc: str, item: str, *more: str) -> DataFrame:
    return found.select(
        F.col("doc").alias(doc),
        F.col("item").alias(item),
        *more,
        F.col("best.share").alias("share"),
        F.col("best.matched").cast("long").alias("matched_windows"),
        F.col("best.windows").cast("long").alias("item_windows"),
        F.col("best.same").alias("verbatim"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least_share: float = 0.5) -> DataFrame:
    """``(doc, item, items, share, matched_windows, item_windows, verbatim)`` of every document and class of items found in it.

    ``item`` is the least item of the class and ``items`` how many it has.
    """
    known = materialise(_item_windows(benchmark, item, item_text))
    classes, _ = _members(known)
    return _named(_found(docs, known, doc, text, least_share).join(classes, "class"), doc, item, "items")


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least_share: float = 0.5) -> DataFrame:
    """``(doc, item, share, matched_windows, item_windows, verbatim)``: as ``contaminated``, with a row for each member of a class."""
    known = materialise(_item_windows(benchmark, item, item_text))
    _, members = _members(known)
    hits = _found(docs, known, doc, text, least_share).join(members.withColumnRenamed("id", "item"), "class")
    return _named(hits.groupBy("doc", "item").agg(F.max("best").alias("best")), doc, item)
