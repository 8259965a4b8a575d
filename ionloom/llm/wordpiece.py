"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie. A node's failure link says where matching goes on when no edge fits: the node of
what is left once the longest pieces that match there are cut off; beside it stands how many pieces that
cuts off. So the number of greedy longest-match pieces of a word comes from one walk over its bytes, without
going back and without building a piece.

Words are runs between white space (space and U+0009 to U+000D); a word is matched with one space before it, as the
vocabulary writes the start of words. All 256 bytes are pieces, so every word has a count.

Defined results
* null text, empty text or white space only: 0 words, 0 tokens;
* very long texts and words are read whole; repeated rows are counted one by one;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.packing import load_vocabulary

_SPACE = re.compile("[\x20\x09-\x0d]+")
#: Words whose count is kept; the cache starts again when full. Longer words are not kept.
CACHE, CACHED_LENGTH = 600_000, 64


class Automaton:
    """Trie with failure links and popped-piece counts, as flat lists by node; node 0 is the root."""

    def __init__(self, pieces: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                nxt = self.edges[node].get(byte)
                if nxt is None:
                    nxt = self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = nxt
            final[node] = True
        if any(not (b in self.edges[0] and final[self.edges[0][b]]) for b in range(256)):
            raise ValueError("every byte must be a piece")
        # Breadth first: the links of shorter prefixes are known. A whole piece is cut off whole; otherwise
        # the parent's link is followed by this node's byte, cutting off more pieces as long as it does not fit.
        self.link, self.popped = [0] * len(final), [0] * len(final)
        level = [(0, 0, 0)]
        while level:
            following = []
            for node, parent, byte in level:
                if node:
                    if final[node]:
                        self.link[node], self.popped[node] = 0, 1
                    else:
                        at, popped = self.link[parent], self.popped[parent]
                        while byte not in self.edges[at]:
                            popped += self.popped[at]
                            at = self.link[at]
                        self.link[node], self.popped[node] = self.edges[at][byte], popped
                following += [(child, node, b) for b, child in self.edges[node].items()]
            level = following

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match; each byte moves forward once, each failure pops a piece."""
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for byte in word:
            nxt = edges[node].get(byte)
            while nxt is None:
                total += popped[node]
                node = link[node]
                nxt = edges[node].get(byte)
            node = nxt
        while node:
            total += popped[node]
            node = link[node]
        return total


def automaton(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a vocabulary file kept by the Python worker, and its cache of word counts, emptied with each task."""
    held = sys.modules.setdefault("ionloom_worker_automata", ModuleType("ionloom_worker_automata")).__dict__
    if path not in held:
        held[path] = (Automaton(load_vocabulary(path)), {})
    return held[path]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(path)

        def missing(word: str) -> int:
            n = machine.count(b" " + word.encode("utf-8", "surrogatepass"))
            if len(word) <= CACHED_LENGTH:
                if len(known) >= CACHE:
                    known.clear()
                known[word] = n
            return n

        try:
            for batch in batches:
                n_words, n_tokens, longest = [], [], []
                for text in batch.column("text").to_pylist():
                    words = [w for w in _SPACE.split(text) if w] if text else []
                    each = [known.get(w) or missing(w) for w in words]
                    n_words.append(len(words))
                    n_tokens.append(sum(each))
                    longest.append(max(each, default=0))
                arrays = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_words, n_tokens, longest)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_tokens", "most_tokens_of_a_word"])
        finally:
            known.clear()

    return run


def token_counts(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens, most_tokens_of_a_word)`` of every row; one pass, no shuffle."""
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(_counts(path), "doc_id long, n_words long, n_tokens long, most_tokens_of_a_word long")


def greedy_pieces(word: bytes, pieces: set[bytes]) -> list[bytes]:
    """The pieces of a word by trying the longest first; what the automaton's counts are held against."""
    out, at = [], 0
    while at < len(word):
        end = next(e for e in range(len(word), at, -1) if word[at:e] in pieces)
        out.append(word[at:end])
        at = end
    return out
