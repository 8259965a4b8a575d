"""Words of many texts at once: 64-bit hashes of every word of an Arrow string array.

A word is a run of characters other than space and U+0009 to U+000D; A to Z count as a to z. Hashes come
from running sums over the bytes, so the cost is a few array operations per byte, without a Python loop
over words. Equal words have equal hashes everywhere; different words collide with odds of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time.
BLOCK = 1 << 18
#: Bytes of text worked on at a time where each byte costs many arrays; a worker keeps what its largest slice took.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def inverse(value: int) -> int:
    """The multiplicative inverse of an odd number modulo 2^64."""
    return pow(value, -1, 1 << 64)


#: Separators for words of ASCII letters and digits and all other scripts: every other ASCII byte.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_RAW_TO_LETTER = _LETTER[_LOWER]


class _Powers:
    """Powers of the base and of its inverse, made longer when a longer block asks."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(0, np.uint64), np.ones(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()  # a task makes its own

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 4096)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
            back = np.uint64(inverse(int(_BASE)))
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, back)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


@dataclass
class Words:
    """Words in order: hash, the row of the text, first byte and end byte within ``data``."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    n_rows: int

    def bounds(self) -> np.ndarray:
        """For row i its words are ``bounds[i]`` to ``bounds[i + 1]``."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts joined, and the offsets of each; a null text has no bytes."""
    array = array.cast(pa.large_binary()) if pa.types.is_large_string(array.type) else array.cast(pa.string()).cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def fold_latin(raw: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes with the capitals of Latin-1 (U+00C0 to U+00DE) as small letters."""
    if len(raw) < 2:
        return raw
    capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    if not capital.any():
        return raw
    out = raw.copy()
    out[1:][capital] += 0x20
    return out


def words(array: pa.Array, separators: np.ndarray = _SEPARATOR, fold: bool = False) -> Words:
    """Words of the texts. ``separators`` tells by byte what parts words; ``fold`` also lowers Latin-1 capitals."""
    raw, offsets = text_bytes(array)
    folded = fold_latin(raw) if fold else raw
    n = len(raw)
    rows = len(array)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, raw, rows)
    inside = ~separators[raw]
    first = np.zeros(n, bool)  # bytes at which a text starts
    first[offsets[:-1][offsets[:-1] < n]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(ends) + 1
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # a block is whole words: BLOCK bytes, or one longer word
        until = max(int(np.searchsorted(end, start[at] + BLOCK, "right")), at + 1)
        low, high = int(start[at]), int(end[until - 1])
        up, down = _powers(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_RAW_TO_LETTER[folded[low:high]] * up, dtype=np.uint64, out=sums[1:])
        s, e = start[at:until] - low, end[at:until] - low
        out[at:until] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = until
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(mix(out), row, start, end, raw, rows)


def row_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most_bytes`` of text each, one row at least."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if i > at and total + n > most_bytes:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


_STEP = [int(x) | 1 for x in mix(np.arange(101, 101 + 64, dtype=np.uint64))]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words, by the place of its first word; empty if there are fewer."""
    size = len(hashes) - width + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(width):
        out += hashes[i : i + size] * np.uint64(_STEP[i])
    return mix(out)


def shingles(w: Words, width: int = 5) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, ascending; a text of fewer words gives one, no words none."""
    every = windows(w.hash, width)
    bounds = w.bounds()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = high - low
        if n >= width:
            got = np.sort(every[low : high - width + 1])
            if len(got) > 1:
                keep = np.empty(len(got), bool)
                keep[0] = True
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                if not keep.all():
                    got = got[keep]
            yield got
        elif n:
            yield mix(windows(w.hash[low:high], n) + np.uint64(width - n))
        else:
            yield np.zeros(0, np.uint64)
