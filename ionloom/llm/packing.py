"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document's ids are cut into whole sequences and a remainder. Remainders, longest first, go to the open
sequence of least estimated cost (linear plus quadratic in the piece lengths, as attention costs) that
still has room; the number of open sequences is the least that holds all ids, and a piece that fits
nowhere whole is cut to fill the sequences of least cost. So only the last ids of a chunk leave padding.

The work is one pass over the scan, chunk by chunk, without a shuffle of texts or ids. A chunk is a bounded
number of ids within one task. The one part-filled sequence a chunk may leave is packed again with
those of other chunks, so many small inputs do not leave many part-filled sequences.

Token ids: byte-level BPE from a tokenizer file (a parameter). Splitting a text before a single space
between two other characters never crosses a token, so such chunks are encoded once per task and kept in a
bounded cache. Strings of special tokens in a text are ordinary text.

Defined results
* null text: empty; an empty text is a document of the end id alone, which may share a sequence;
* repeated rows: packed one by one; ties in length keep the input order;
* very long texts give many whole sequences; an empty table gives an empty result;
* only the id and text columns are read; a null id is carried.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.session import materialise

LENGTH = 2048
END_ID = 1
#: Ids a chunk holds before it is packed (16 MB).
CHUNK_IDS = 4 << 20
#: Entries of the cache of encoded chunks of a text (some 200 bytes each); it starts again when full, and with each task.
CACHE = 300_000
#: Cost of a piece of n tokens: n + QUADRATIC * n^2, with the quadratic share equal at this length.
QUADRATIC = 1.0 / 4096
#: Part-filled sequences that are packed together again.
TAILS = 1024

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r" \s|\s ")
#: The pre-tokenisation pattern of the byte-level BPE files (a fixed value of that format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The format's spelling of bytes as printable letters, by its rule: printable Latin-1 stays, others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE file, without its special tokens."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", [])}
    letters = _byte_letters()
    return {bytes(letters[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}


class Encoder:
    """Texts to ids as little-endian 32-bit bytes, chunks of a text cached."""

    def __init__(self, path: str, cache: int = CACHE):
        import regex
        import tiktoken

        encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=load_vocabulary(path), special_tokens={})
        self._encode, self._encode_piece = encoding.encode_ordinary, encoding._encode_single_piece
        self._letters = regex.compile(r" ?\p{L}+").match
        self._cache: dict[str, bytes] = {}
        self._size = cache

    def _missing(self, chunk: str) -> bytes:
        """Encode a chunk. A letter run at its start is one piece of the pattern, so the rest is on its own."""
        if len(self._cache) >= self._size:
            self._cache.clear()
        run = self._letters(chunk)
        if run is None:
            got = array("I", self._encode(chunk)).tobytes()
        elif run.end() == len(chunk):
            got = array("I", self._encode_piece(chunk)).tobytes()
        else:
            word, rest = run.group(), chunk[run.end() :]
            got = (self._cache.get(word) or self._missing(word)) + (self._cache.get(rest) or self._missing(rest))
        self._cache[chunk] = got
        return got

    def forget(self) -> None:
        self._cache.clear()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = _SINGLE_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        if len(chunks) > 1:
            chunks = [chunks[0], *[" " + c for c in chunks[1:]]]
            if text[0] == " " or text[-1] == " ":  # a space at an end has only one neighbour
                chunks = _rejoin_ends(chunks)
        get, missing = self._cache.get, self._missing
        return b"".join([get(c) or missing(c) for c in chunks])


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by the Python worker from task to task; what a task cached goes with it.

    Functions travel with their task, so a module variable would start empty each time; a module of the
    worker's own holds the encoders instead.
    """
    held = sys.modules.setdefault("ionloom_worker_encoders", ModuleType("ionloom_worker_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _rejoin_ends(chunks: list[str]) -> list[str]:
    if chunks[0] == "":
        chunks = chunks[1:]
    if len(chunks) > 1 and chunks[-1] == " ":
        chunks = [*chunks[:-2], chunks[-2] + " "]
    return chunks


def balance(lengths: np.ndarray, capacity: int = LENGTH, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Pieces ``(item, from, length, sequence)`` of items no longer than ``capacity``.

    Longest first, each to the cheapest sequence with room. Sequences too full for an item are set aside:
    later items are shorter, so a set-aside sequence is looked at again once its room suffices.
    """
    total = int(lengths.sum())
    if not total:
        return []
    room = [capacity] * -(-total // capacity)
    room[-1] = total - capacity * (len(room) - 1)  # what is left is one part-filled sequence, not many
    cost = [0.0] * len(room)
    open_: list[tuple[float, int]] = [(0.0, s) for s in range(len(room))]
    aside: list[tuple[int, int]] = []  # (-room, sequence)
    out: list[tuple[int, int, int, int]] = []

    def put(item: int, start: int, n: int, s: int) -> None:
        out.append((item, start, n, s))
        room[s] -= n
        cost[s] += n + quadratic * n * n

    for item in np.argsort(-lengths, kind="stable").tolist():
        n, start = int(lengths[item]), 0
        while aside and -aside[0][0] >= n:
            s = heapq.heappop(aside)[1]
            heapq.heappush(open_, (cost[s], s))
        while open_ and room[open_[0][1]] < n:
            s = heapq.heappop(open_)[1]
            if room[s]:
                heapq.heappush(aside, (-room[s], s))
        if open_:
            s = heapq.heappop(open_)[1]
            put(item, start, n, s)
            if room[s]:
                heapq.heappush(open_, (cost[s], s))
            continue
        while n:  # fits nowhere whole: fill the roomiest sequences
            s = heapq.heappop(aside)[1]
            m = min(n, room[s])
            put(item, start, m, s)
            start, n = start + m, n - m
            if room[s]:
                heapq.heappush(aside, (-room[s], s))
    return out


_PIECE = pa.schema(
    [
        ("doc", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence", pa.int64()),
        ("offset", pa.int64()),
        ("tail", pa.bool_()),
        ("ids", pa.binary()),
    ]
)
_PIECE_DDL = "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, tail boolean, ids binary"


class _Chunk:
    """Documents of one chunk: their ids, then their pieces."""

    def __init__(self, with_ids: bool):
        self.with_ids, self.items, self.held = with_ids, [], 0

    def add(self, doc, ids: memoryview, start: int, doc_tokens: int) -> None:
        self.items.append((doc, ids, start, doc_tokens))
        self.held += len(ids) // 4

    def pack(self, first: int, last_is_final: bool) -> tuple[pa.RecordBatch, int]:
        """The pieces as a batch and the number of sequences; numbers start at ``first``."""
        rows: list[tuple] = []
        rest: list[tuple] = []
        n_seq = 0
        width = 4 * LENGTH
        for doc, ids, start, tokens in self.items:
            whole = len(ids) // width
            for k in range(whole):
                rows.append((doc, ids[k * width : (k + 1) * width], start + k * LENGTH, tokens, n_seq, 0))
                n_seq += 1
            if len(ids) > whole * width:
                rest.append((doc, ids[whole * width :], start + whole * LENGTH, tokens))
        lengths = np.array([len(r[1]) // 4 for r in rest], np.int64)
        placed = balance(lengths)
        offsets: dict[int, int] = {}
        for item, at, n, s in placed:
            doc, ids, start, tokens = rest[item]
            offset = offsets.get(s, 0)
            offsets[s] = offset + n
            rows.append((doc, ids[4 * at : 4 * (at + n)], start + at, tokens, n_seq + s, offset))
        open_tail = n_seq + len(offsets) - 1 if offsets and min(offsets.values()) < LENGTH else -1
        if open_tail >= 0:
            open_tail = n_seq + min(offsets, key=offsets.get)
        columns = list(zip(*rows)) if rows else [[]] * 6
        tail = [not last_is_final and s == open_tail for s in columns[4]]
        arrays = [
            pa.array(columns[0], pa.int64()),
            pa.array(columns[2], pa.int64()),
            pa.array([len(i) // 4 for i in columns[1]], pa.int64()),
            pa.array([zlib.crc32(i) for i in columns[1]], pa.int64()),
            pa.array(columns[3], pa.int64()),
            pa.array([first + s for s in columns[4]], pa.int64()),
            pa.array(columns[5], pa.int64()),
            pa.array(tail, pa.bool_()),
            pa.array([bytes(i) if t or self.with_ids else None for i, t in zip(columns[1], tail)], pa.binary()),
        ]
        self.items, self.held = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=_PIECE), n_seq + len(offsets)


def _first_pass(path: str, with_ids: bool, chunk_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        number = TaskContext.get().partitionId() << 33
        chunk = _Chunk(with_ids)
        try:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    ids = memoryview(encode(text.as_py() or "") + end)
                    chunk.add(doc.as_py(), ids, 0, len(ids) // 4)
                    if chunk.held >= chunk_ids:
                        out, n = chunk.pack(number, False)
                        number += n
                        yield out
            if chunk.items:
                yield chunk.pack(number, False)[0]
        finally:
            encode.forget()

    return run


def _again(with_ids: bool):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        chunk = _Chunk(with_ids)
        rows = rows.sort_by([("sequence", "ascending"), ("offset", "ascending")])
        for doc, start, tokens, ids in zip(*[rows.column(c).to_pylist() for c in ("doc", "start", "doc_tokens", "ids")]):
            chunk.add(doc, memoryview(ids), start, tokens)
        first = (1 << 62) + (key[0].as_py() << 22)
        return pa.Table.from_batches([chunk.pack(first, True)[0]])

    return run


def pack(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", with_ids: bool = False, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """One row per piece: document, start, length, checksum of its ids, document tokens, sequence and offset there.

    ``with_ids`` also returns the ids of each piece (little-endian 32-bit), for :func:`sequences`.
    Sequence numbers are unique, not gapless: they hold the partition that made them.
    """
    source = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    pieces = materialise(source.mapInArrow(_first_pass(path, with_ids, chunk_ids), _PIECE_DDL))
    tails = pieces.where("tail")
    group = F.shiftright("sequence", 33) / F.lit(TAILS)
    again = tails.withColumn("group", F.floor(group).cast("long")).groupBy("group").applyInArrow(_again(with_ids), _PIECE_DDL)
    out = pieces.where("not tail").unionByName(again).drop("tail")
    if not with_ids:
        out = out.drop("ids")
    return out.withColumnsRenamed({"doc": doc, "sequence": "sequence_id"})


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids)``: the pieces of each sequence joined in order and padded; a sequence is at most ``length`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    pad = F.lit(np.array([pad_id], "<u4").tobytes())
    missing = (length * 4 - F.octet_length("ids")) / 4
    whole = pieces.groupBy("sequence_id").agg(joined.alias("ids"))
    return whole.withColumn("ids", F.aggregate(F.array_repeat(pad, missing.cast("int")), F.col("ids"), lambda acc, p: F.concat(acc, p)))
