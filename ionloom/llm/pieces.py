"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is one flat numpy array of symbols, a character each. It falls into segments: between two characters that
stand side by side in no piece nothing can ever merge, so a segment boundary goes there (before every space after
a letter, for one). A round takes each segment's lowest pair rank (``minimum.reduceat``), merges that pair wherever
it stands in the segment, leftmost first, at once, drops the consumed symbols and the segments that have no pair
left, and looks up only the pairs beside a merge. Rounds go on until no pair is left.

Merging one pair in several places at once is the same as one place after another if the new symbol cannot start
or end a piece of the same or a better rank. Where it can, or where two pieces share a rank, a round merges the
leftmost place alone. Segments of more than ``LONG`` symbols (digits or letters without a break) merge one pair at
a time from a heap, by the same order: there each round would read the whole segment for few merges.

Tables come from the model file on the driver; their size is that of the vocabulary. Texts are read in blocks that
end at a segment boundary, so memory does not grow with a text's length.

Models: byte-pair pieces with byte fallback, no normalisation rules, no user-defined pieces; others are refused.

Defined results
* null or empty text: no ids, and the empty text back; a null list of ids decodes to null;
* a character without a piece becomes the byte pieces of its UTF-8 form; U+2581 comes back as a space, as in the
  library; bytes that make no character come back as U+FFFD; control ids decode to nothing,
  the unknown id to the model's mark for it;
* very long texts are whole; repeated rows each give a row; an empty table gives an empty result;
* ties between pairs go to the leftmost; other columns of the input are not looked at by ``digests``, and kept by
  ``encode`` and ``decode``, which refuse a result name that exists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Code points that are encoded at a time.
BLOCK = 1 << 18
#: Symbols of a segment from which on pairs are merged one at a time.
LONG = 2048
_NONE = np.int64(2**63 - 1)
_FREE = np.int64(-1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Pairs:
    """Pairs of symbols to codes: open addressing in two flat arrays, looked up many at a time."""

    def __init__(self, entries: dict[tuple[int, int], int]):
        self._bits = max(4, (4 * len(entries)).bit_length())
        self._keys = np.full(1 << self._bits, _FREE)
        self._codes = np.full(1 << self._bits, _NONE)
        left, right = (np.array([p[i] for p in entries], np.int64) for i in (0, 1))
        key = left << 32 | right
        code = np.fromiter(entries.values(), np.int64, len(entries))
        slot = self._slot(key)
        while len(key):  # of those that want one free slot the first takes it, the others try the next
            wants, first = np.unique(slot, return_index=True)
            first = first[self._keys[wants] == _FREE]
            self._keys[slot[first]], self._codes[slot[first]] = key[first], code[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, code, slot = key[rest], code[rest], (slot[rest] + 1) & (len(self._keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - self._bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of every pair, and whether the pair is known; a negative symbol is in no pair."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        held = self._keys[slot]
        known = held == key
        code = np.where(known, self._codes[slot], _NONE)
        open_ = np.flatnonzero(~known & (held != _FREE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self._keys) - 1)
            held = self._keys[slot[open_]]
            same = held == key[open_]
            code[open_[same]] = self._codes[slot[open_[same]]]
            known[open_[same]] = True
            open_ = open_[~same & (held != _FREE)]
        usable = (left >= 0) & (right >= 0)
        return np.where(usable, code, _NONE), known & usable


@dataclass(repr=False)
class Pieces:
    """What a model file says, as tables.

    Symbols are piece ids; a character that occurs in pieces without being one gets a number above them, any other
    character is -1. A pair's code is its rank (0 best) in the upper and its piece in the lower half.
    """

    texts: list[bytes]  # by id, spaces as spaces; empty for control ids
    opens: np.ndarray  # whether the piece starts with the space mark
    byte_ids: np.ndarray
    byte_of: np.ndarray  # by id, -1 if it is no byte piece
    character: np.ndarray  # symbol by code point
    pairs: dict[tuple[int, int], int]
    careful: np.ndarray  # by rank: one place at a time

    @cached_property
    def lookup(self) -> _Pairs:
        return _Pairs(self.pairs)

    @cached_property
    def _pieces(self) -> pa.Array:
        return pa.array(self.texts, pa.large_binary())

    @cached_property
    def _decimals(self) -> pa.Array:
        return pa.array([b"%d," % i for i in range(len(self.texts))], pa.large_binary())

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kinds = model.normalizer_spec, model.SentencePiece
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or not plain or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must be byte-pair pieces with byte fallback, a leading space and no normalisation")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        return cls.of(
            [p.piece for p in model.pieces],
            [p.score for p in model.pieces],
            [p.type == kinds.NORMAL for p in model.pieces],
            [p.type == kinds.BYTE for p in model.pieces],
            {i: model.trainer_spec.unk_surface for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN},
        )

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], normal: list[bool], byte: list[bool], shown: dict[int, str] | None = None) -> Pieces:
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        ranks = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        rank = {p: ranks[scores[i]] for p, i in ids.items()}
        symbols = dict(ids)
        for c in sorted(set("".join(ids))):
            symbols.setdefault(c, len(pieces) + len(symbols) - len(ids))
        pairs: dict[tuple[int, int], int] = {}
        members = np.bincount(list(rank.values()), minlength=len(ranks))
        careful = members > 1
        for p, i in ids.items():
            for a, b in zip(p, p[1:]):  # side by side in a piece: no boundary, though perhaps no pair
                pairs.setdefault((symbols[a], symbols[b]), int(_NONE))
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                for part in (a, b):
                    if len(part) > 1 and part in rank and rank[p] <= rank[part]:
                        careful[rank[part]] = True
                if a in symbols and b in symbols:
                    pairs[symbols[a], symbols[b]] = rank[p] << 32 | i
        character = np.full(max((ord(c) for c in symbols if len(c) == 1), default=0) + 2, -1, np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                character[ord(c)] = s
        byte_of = np.full(len(pieces), -1, np.int16)
        byte_ids = np.full(256, -1, np.int32)
        for i in np.flatnonzero(byte):
            value = int(pieces[i][3:5], 16)
            byte_of[i], byte_ids[value] = value, i
        if (byte_ids < 0).any():
            raise ValueError("every byte must be a piece")
        texts = [bytes([byte_of[i]]) if byte[i] else p.replace(SPACE, " ").encode() if normal[i] else b"" for i, p in enumerate(pieces)]
        for i, surface in (shown or {}).items():
            texts[i] = surface.encode()
        return cls(texts, np.array([n and p.startswith(SPACE) for n, p in zip(normal, pieces)]), byte_ids, byte_of, character, pairs, careful)

    # Encoding

    def symbols(self, points: np.ndarray) -> np.ndarray:
        return self.character[np.minimum(points, len(self.character) - 1)]

    def merge(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of the texts that start at ``starts``, and the place each one began at."""
        first = self.symbols(points)
        code = np.full(len(points), _NONE)
        cut = np.ones(len(points), bool)
        if len(points) > 1:
            code[:-1], known = self.lookup(first[:-1], first[1:])
            cut[1:] = ~known
        cut[starts] = True
        code[np.flatnonzero(cut[1:])] = _NONE
        begin = np.flatnonzero(cut)
        size = np.diff(begin, append=len(points))
        out, kept = first.copy(), np.ones(len(points), bool)
        for s in np.flatnonzero(size > LONG).tolist():
            low, high = int(begin[s]), int(begin[s] + size[s])
            out[low:high], kept[low:high] = self._one_by_one(first[low:high])
        # Segments of one symbol, or of symbols without a pair, are done.
        best = np.minimum.reduceat(code, begin) if len(begin) else code
        live = (best != _NONE) & (size <= LONG)
        rounds = np.repeat(live, size)
        place = np.flatnonzero(rounds)
        self._rounds(first[place], code[place], size[live], place, out, kept)
        place = np.flatnonzero(kept)
        return out[place], place

    def _rounds(self, symbol: np.ndarray, code: np.ndarray, size: np.ndarray, place: np.ndarray, out: np.ndarray, kept: np.ndarray) -> None:
        """Merge rounds over whole segments of ``size`` symbols; results go to ``out`` and ``kept`` by place."""
        while len(size):
            begin = np.cumsum(size) - size
            best = np.minimum.reduceat(code, begin) >> 32
            hit = np.flatnonzero(code >> 32 == np.repeat(best, size))
            segment = np.searchsorted(begin, hit, "right") - 1
            # Of neighbours that share a symbol every second one merges, counted from the left; careful ranks one a segment.
            run = np.ones(len(hit), bool)
            run[1:] = hit[1:] != hit[:-1] + 1
            even = (hit - hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]) & 1 == 0
            leftmost = np.ones(len(hit), bool)
            leftmost[1:] = segment[1:] != segment[:-1]
            chosen = np.where(self.careful[best[segment]], leftmost, even)
            hit, segment = hit[chosen], segment[chosen]
            symbol[hit] = code[hit] & 0x7FFFFFFF
            stays = np.ones(len(symbol), bool)
            stays[hit + 1] = False
            kept[place[hit + 1]] = False
            last = np.zeros(len(symbol), bool)
            last[begin + size - 1] = True
            last[hit] = last[hit + 1]
            merged = hit - np.arange(len(hit))  # places after the consumed symbols are gone
            symbol, code, place, last = symbol[stays], code[stays], place[stays], last[stays]
            size = size - np.bincount(segment, minlength=len(size))
            before = merged[(merged > 0)] - 1
            touched = np.concatenate([merged, before[~last[before]]])
            code[touched] = _NONE
            inner = touched[~last[touched]]
            code[inner] = self.lookup(symbol[inner], symbol[inner + 1])[0]
            begin = np.cumsum(size) - size
            done = np.minimum.reduceat(code, begin) == _NONE
            if done.any():
                gone = np.repeat(done, size)
                out[place[gone]] = symbol[gone]
                symbol, code, place, size = symbol[~gone], code[~gone], place[~gone], size[~done]

    def _one_by_one(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segment by a heap of pairs, best rank first, then leftmost."""
        n = len(first)
        symbol, pairs = first.tolist(), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = int(_NONE)
        heap = []
        for i in range(n - 1):
            code = pairs.get((symbol[i], symbol[i + 1]), none)
            if code != none:
                heap.append((code >> 32, i, code & 0x7FFFFFFF, symbol[i], symbol[i + 1]))
        heapify(heap)
        while heap:
            _, i, piece, left, right = heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = piece, -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    code = pairs.get((symbol[a], symbol[b]), none)
                    if code != none:
                        heappush(heap, (code >> 32, a, code & 0x7FFFFFFF, symbol[a], symbol[b]))
        out = np.array(symbol, np.int32)
        return out, out != -2

    def ids(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that start at ``starts``, and the number of ids before each text."""
        symbol, place = self.merge(points, starts)
        count = np.ones(len(symbol), np.int64)
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.texts)))
        if len(odd):
            spelled = points[place[odd]]
            count[odd] = 1 + (spelled >= 0x80) + (spelled >= 0x800) + (spelled >= 0x10000)
            raw = np.frombuffer(spelled.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            bytewise = np.zeros(len(symbol), bool)
            bytewise[odd] = True
            out = np.repeat(symbol, count)
            out[np.repeat(bytewise, count)] = self.byte_ids[raw]
        else:
            out = symbol
        ends = np.cumsum(count)
        at = np.searchsorted(place, starts)
        return out, np.r_[0, ends][at]

    def _cut(self, points: np.ndarray) -> int:
        """The last place in the points where a segment starts, 0 if there is none."""
        step = 4096
        for high in range(len(points), 1, -step):
            low = max(high - step, 1)
            s = self.symbols(points[low - 1 : high])
            cuts = np.flatnonzero(~self.lookup(s[:-1], s[1:])[1])
            if len(cuts):
                return low + int(cuts[-1])
        return 0

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """The ids of one text in runs, each a run of whole segments."""
        carry, at, step = _points(SPACE if text else ""), 0, BLOCK
        while at < len(text):
            points = np.concatenate([carry, _points(text[at : at + step].replace(" ", SPACE))])
            at += step
            cut = len(points) if at >= len(text) else self._cut(points)
            step = BLOCK if cut else 2 * step
            if cut:
                yield self.ids(points[:cut], np.zeros(1, np.int64))[0]
            carry = points[cut:]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text. Short texts share arrays; a long one is read in blocks."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        group: list[int] = []
        held = 0

        def flush() -> None:
            points = _points("".join([SPACE + texts[i].replace(" ", SPACE) for i in group]))
            sizes = np.array([len(texts[i]) + 1 for i in group])
            got, before = self.ids(points, np.cumsum(sizes) - sizes)
            for i, part in zip(group, np.split(got, before[1:])):
                out[i] = part

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) >= BLOCK:
                out[i] = np.concatenate(list(self.blocks(text)))
                continue
            if held + len(text) > BLOCK and group:
                flush()
                group, held = [], 0
            group.append(i)
            held += len(text) + 1
        if group:
            flush()
        return out

    # Decoding

    def decode(self, ids: np.ndarray, first: bool = True) -> bytes:
        """The UTF-8 text of ids. ``first`` tells that they start a text, where the leading space goes."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.texts):
            raise ValueError("an id outside the vocabulary")
        raw = _joined(self._pieces, ids)
        if (self.byte_of[ids] >= 0).any():
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                raw = self._with_replacements(ids)
        if first:  # leading pieces without text are passed over, as control ids are
            at = next((i for i in ids.tolist() if self.texts[i] or self.opens[i]), None)
            if at is not None and self.opens[at]:
                raw = raw[1:]
        return raw

    def _with_replacements(self, ids: np.ndarray) -> bytes:
        """Runs of byte pieces that are no text keep their whole characters; any other byte is U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids.tolist(), None]:
            if i is not None and self.byte_of[i] >= 0:
                run.append(self.byte_of[i])
                continue
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        bytes(run[at : at + n]).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    out.append(bytes(run[at : at + n]))
                    break
                else:
                    n = 1
                    out.append("�".encode())
                at += n
            run.clear()
            if i is not None:
                out.append(self.texts[i])
        return b"".join(out)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each followed by a comma."""
        return _joined(self._decimals, ids)


def _joined(parts: pa.Array, ids: np.ndarray) -> bytes:
    """The byte strings of the ids, one after another."""
    taken = parts.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(ids) + 1]
    return memoryview(data)[ends[0] : ends[-1]].tobytes() if data is not None else b""


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row: ids in decimal joined by commas, and the text
    that these ids decode to. One pass without a shuffle; a long text is never held as ids.
    """
    pieces = Pieces.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in _parts(batch.column("text").to_pylist()):
                if len(part) == 1 and part[0] and len(part[0]) >= BLOCK:
                    rows.append(_streamed(pieces, part[0]))
                else:
                    rows += [_streamed(pieces, ids) for ids in pieces.encode_batch(part)]
            n, ids_sha, decoded = (list(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded)], schema=_DIGEST)

    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about a block, long ones alone."""
    run: list[str | None] = []
    held = 0
    for text in texts:
        n = len(text or "")
        if run and held + n > BLOCK:
            yield run
            run, held = [], 0
        run.append(text)
        held += n
    if run:
        yield run


def _streamed(pieces: Pieces, ids: np.ndarray | str) -> tuple[int, str, str]:
    total, written, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for run in pieces.blocks(ids) if isinstance(ids, str) else [ids]:
        if len(run):
            decoded.update(pieces.decode(run, first=not total))
            spelled = pieces.decimals(run)
            written.update(b"," + spelled[:-1] if total else spelled[:-1])
            total += len(run)
    return total, written.hexdigest(), decoded.hexdigest()


def _column_map(df: DataFrame, column: str, result: str, kind: T.DataType, arrow: pa.DataType, work) -> DataFrame:
    if result in df.columns:
        raise ValueError(f"the column {result} exists")
    schema = T.StructType([*df.schema.fields, T.StructField(result, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = work(batch.column(batch.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], names=[*batch.schema.names, result])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the ids of a text column; a null or empty text has none."""
    pieces = Pieces.load(path)
    return _column_map(df, text, ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda column: [x.astype(np.int32) for x in pieces.encode_batch(column.to_pylist())])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of a column of ids; null for null."""
    pieces = Pieces.load(path)
    return _column_map(df, ids, text, T.StringType(), pa.string(), lambda column: [None if x is None else pieces.decode(np.array(x, np.int64)).decode() for x in column.to_pylist()])
