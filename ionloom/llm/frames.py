"""Fill-in-middle transformation over seekable compressed frames.

A text is kept as independent Zstandard frames of about ``FRAME`` code points. Beside each frame stands how many
units and code points come before it, so the place after unit u is found by one bisection and by opening the one
frame that holds it. What goes out is a list of ranges, streamed frame by frame in order; digests are taken from that
stream. The output is itself kept as frames, and the exact text is rebuilt from them and the form alone: the marks
are found in the stream, and the parts are read back by range.

A unit is a line: ``[^\\n]*\\n|[^\\n]+``. Two draws a document say after how many units the prefix and the middle end.
With a space of n + 1 places, parts may be empty. Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix,
middle) and ``spm`` (suffix, prefix, middle), each part after its mark.

``transform`` gives the output text, ``digests`` its checks, ``store`` the frames of a table as rows of their own,
``read`` texts from such rows, ``select`` the code points of a unit range from the frames that hold it alone.

Defined results
* null text: as the empty text; an empty text, or one that holds a mark, stays plain;
* null identifier: drawn as the text ``null``; rows with the same identifier have the same draws, each with its own text;
* very long texts: whole, a frame at a time beside the text itself; a line may span frames;
* a text of one line: prefix and middle end before or after it;
* an empty table gives an empty result; ``transform`` keeps other columns and refuses a result name that exists, the
  other operators do not look at them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of a frame.
FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Rules:
    """``seed`` of the draws, per cent of documents that are transformed, per cent of these in suffix-first form."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50


class Frames:
    """One text as frames; ``units`` and ``chars`` are counts before each frame, and the totals at the end."""

    def __init__(self, parts: Iterable[str] = (), size: int = FRAME, level: int = 1):
        self.data: list[bytes] = []
        self.units, self.chars = [0], [0]
        self._size = size
        self._pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self._open = zstandard.ZstdDecompressor().decompress
        self._held, self._held_size, self._ended = [], 0, True
        for part in parts:
            self.add(part)
        self.close()

    def add(self, text: str) -> None:
        for at in range(0, len(text), self._size):
            part = text[at : at + self._size]
            if self._held_size + len(part) > self._size:
                self._flush()
            self._held.append(part)
            self._held_size += len(part)

    def _flush(self) -> None:
        if not self._held_size:
            return
        text = "".join(self._held)
        self._held, self._held_size = [], 0
        self.data.append(self._pack(text.encode()))
        # A frame's ended lines; the line that is open at its end counts where it ends.
        self.units.append(self.units[-1] + text.count("\n"))
        self.chars.append(self.chars[-1] + len(text))
        self._ended = text[-1] == "\n"

    def close(self) -> None:
        self._flush()

    @property
    def n_units(self) -> int:
        return self.units[-1] + (not self._ended)

    @property
    def n_chars(self) -> int:
        return self.chars[-1]

    def frame(self, i: int) -> str:
        return self._open(self.data[i]).decode()

    def after(self, units: int) -> int:
        """Code points of the first ``units`` units; opens one frame at most."""
        if units <= 0:
            return 0
        if units > self.units[-1]:  # beyond the last line that ends
            return self.n_chars
        i = bisect_left(self.units, units, 1) - 1  # the first frame with so many ended lines
        text, at = self.frame(i), -1
        for _ in range(units - self.units[i]):
            at = text.index("\n", at + 1)
        return self.chars[i] + at + 1

    def stream(self, start: int, end: int) -> Iterator[str]:
        """The code points from ``start`` to ``end``, one frame's share at a time."""
        i = bisect_right(self.chars, start) - 1
        while start < end and i < len(self.data):
            text, low = self.frame(i), self.chars[i]
            yield text[start - low : end - low]
            i += 1
            start = self.chars[i]


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the digest of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


@dataclass
class Cut:
    """How a text is taken apart: its form, and where prefix and middle end in code points."""

    form: str
    prefix: int = 0
    middle: int = 0


def choose(frames: Frames, marked: bool, doc_id: int | None, rules: Rules) -> Cut:
    h1, h2, h3, h4 = draws(doc_id, rules.seed)
    if not frames.n_chars or marked or h3 % 100 >= rules.rate:
        return Cut("plain")
    places = frames.n_units + 1
    low, high = sorted((h1 % places, h2 % places))
    return Cut("spm" if h4 % 100 < rules.suffix_first else "psm", frames.after(low), frames.after(high))


def arrange(frames: Frames, cut: Cut) -> Iterator[str]:
    """The output in order, a frame's share at a time."""
    prefix = (PREFIX, 0, cut.prefix)
    middle = (MIDDLE, cut.prefix, cut.middle)
    suffix = (SUFFIX, cut.middle, frames.n_chars)
    order = {"plain": [("", 0, frames.n_chars)], "psm": [prefix, suffix, middle], "spm": [suffix, prefix, middle]}
    for mark, start, end in order[cut.form]:
        yield mark
        yield from frames.stream(start, end)


def restore(output: Frames, form: str) -> Iterator[str]:
    """The text of an output, from the output and its form alone."""
    if form == "plain":
        yield from output.stream(0, output.n_chars)
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    found: dict[str, int] = {}
    tail, at = "", 0  # marks may lie across frames: two code points are carried on
    for part in output.stream(0, output.n_chars):
        text = tail + part
        for mark in order:
            if mark not in found and (place := text.find(mark)) >= 0:
                found[mark] = at - len(tail) + place
        at += len(part)
        tail = text[-2:]
    ends = [found[m] for m in order[1:]] + [output.n_chars]
    bounds = {m: (found[m] + len(m), end) for m, end in zip(order, ends)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*bounds[mark])


def _digest(parts: Iterable[str], into: Frames | None = None) -> str:
    out = hashlib.sha256()
    for part in parts:
        out.update(part.encode())
        if into is not None:
            into.add(part)
    if into is not None:
        into.close()
    return out.hexdigest()


def _marked(text: str) -> bool:
    return any(m in text for m in MARKS)


_DIGEST = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
)


def digests(docs: DataFrame, rules: Rules = Rules(), doc: str = "doc_id", text: str = "text", size: int = FRAME) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`` of every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                frames = Frames([value or ""], size)
                cut = choose(frames, _marked(value or ""), doc_id, rules)
                output = Frames(size=size)
                sha = _digest(arrange(frames, cut), output)
                again = _digest(restore(output, cut.form))
                plain = cut.form == "plain"
                rows.append((doc_id, frames.n_units, cut.form, None if plain else cut.prefix, None if plain else cut.middle - cut.prefix, sha, again))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, _DIGEST)


def transform(docs: DataFrame, rules: Rules = Rules(), doc: str = "doc_id", text: str = "text", output: str = "output", form: str = "form") -> DataFrame:
    """The rows with the output text and its form."""
    if taken := {output, form} & set(docs.columns):
        raise ValueError(f"columns that exist: {sorted(taken)}")
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.StringType()), T.StructField(form, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts, forms = [], []
            for doc_id, value in zip(column[doc].to_pylist(), column[text].to_pylist()):
                frames = Frames([value or ""])
                cut = choose(frames, _marked(value or ""), doc_id, rules)
                texts.append("".join(arrange(frames, cut)))
                forms.append(cut.form)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(forms, pa.string())], names=[*batch.schema.names, output, form])

    return docs.mapInArrow(run, schema)


_STORE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("frame", pa.int64()), ("units_before", pa.int64()), ("units", pa.int64()), ("chars_before", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])


def store(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = FRAME) -> DataFrame:
    """The frames of all texts as rows: identifier, row, place, counts before and within, compressed bytes.

    ``row`` tells rows with the same identifier apart: the crc32 and length of the text. Equal rows are stored equally.
    An empty text has one frame without code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                frames = Frames([value or ""], size)
                data = frames.data or [frames._pack(b"")]
                units, chars = (x if len(x) > 1 else [0, 0] for x in (frames.units, frames.chars))
                columns = [[doc_id] * len(data), [row] * len(data), range(len(data)), units[:-1], _steps(units), chars[:-1], _steps(chars), data]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _STORE)], schema=_STORE)

    value = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(value, F.length(value)).alias("row"), value.alias("text"))
    return source.mapInArrow(run, "doc_id long, row long, frame long, units_before long, units long, chars_before long, chars long, data binary")


def _steps(counts: list[int]) -> list[int]:
    return [b - a for a, b in zip(counts, counts[1:])]


def _opened(frames: DataFrame, name: str = "part") -> DataFrame:
    """The frames with their text in place of the compressed bytes."""
    schema = T.StructType([f for f in frames.schema.fields if f.name != "data"] + [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            at = batch.schema.get_field_index("data")
            texts = pa.array([unpack(x).decode() for x in batch.column(at).to_pylist()], pa.string())
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in others], texts], names=[*[batch.schema.names[i] for i in others], name])

    return frames.mapInArrow(run, schema)


def _in_order(parts: DataFrame, text: str) -> DataFrame:
    ordered = F.array_sort(F.collect_set(F.struct("frame", "part")))
    return parts.groupBy("doc_id", "row").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias(text))


def read(frames: DataFrame) -> DataFrame:
    """``(doc_id, row, text)`` of stored frames."""
    return _in_order(_opened(frames.select("doc_id", "row", "frame", "data")), "text")


def select(frames: DataFrame, first: int, last: int) -> DataFrame:
    """``(doc_id, row, text)``: units ``first`` to ``last`` (from 0, end exclusive) of every stored text.

    Frames without these units are left out by their counts, before anything is opened. A line that spans frames is in
    all of them; a text that ends earlier gives what it has.
    """
    if not 0 <= first <= last:
        raise ValueError("first to last, from 0")
    whole = frames.select("doc_id", "row", "frame", "units_before", "units", "data")
    held = whole.where((F.col("units_before") < last) & (F.col("units_before") + F.col("units") >= first))
    parts = _opened(held)
    # Lines first to last of a frame that starts within line ``units_before``; a line's end goes with it.
    lines = F.split("part", "\n")
    low = F.greatest(F.lit(first) - F.col("units_before"), F.lit(0)).cast("int")
    high = F.least(F.lit(last) - F.col("units_before"), F.size(lines)).cast("int")
    kept = F.array_join(F.slice(lines, low + 1, F.greatest(high - low, F.lit(0))), "\n")
    end = F.when((high < F.size(lines)) & (high > low), "\n").otherwise("")
    found = _in_order(parts.withColumn("part", F.concat(kept, end)), "text")
    every = frames.select("doc_id", "row").distinct()
    return every.alias("a").join(found.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row")), "left").select("a.doc_id", "a.row", F.coalesce("b.text", F.lit("")).alias("text"))
