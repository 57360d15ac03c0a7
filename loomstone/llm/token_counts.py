"""Token counts by a linear longest-match automaton.

The vocabulary is a trie in which every node has a failure link and the number
of pieces that following it pops, computed once. Scanning a word then gives the
number of its greedy word pieces without building them. Pieces that start a
word and pieces that continue one are taken from a byte-level vocabulary: the
former carry its space mark, the latter don't. The bare space mark is itself a
piece: a word whose start no longer marked piece covers begins with it.

Defined results: null and empty texts have no words and no tokens; a word that
no sequence of pieces covers counts as one unknown token; whole texts are read
whatever their length; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from loomstone.llm.text_bytes import bounded

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SPACE_MARK = "Ġ"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CACHED_WORDS = 300_000
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary, back to bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stand_in = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return stand_in | {chr(256 + n): b for n, b in enumerate(others)}


def read_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces that start a word, the bare space mark as an empty one, and pieces that continue one."""
    with open(path, encoding="utf-8") as file:
        pieces = json.load(file)["model"]["vocab"]
    back = byte_alphabet()
    first, later = set(), set()
    for piece in pieces:
        if all(c in back for c in piece):
            begins = piece.startswith(SPACE_MARK)
            raw = bytes(back[c] for c in (piece[1:] if begins else piece))
            if (raw or begins) and not WORD.sub(b"", raw):
                (first if begins else later).add(raw)
    return first, later


class LongestMatch:
    """Greedy longest-match piece counts in one pass over a word's bytes.

    Node 0 is the root of the first pieces, node 1 that of the later ones. For
    a node v that spells s, ``fail[v]`` is the node reached once the longest
    pieces have been popped off s until the rest is spelled by a later node, and
    ``popped[v]`` is their number; no link (-1) means that the word is unknown.
    An empty first piece links node 0 to node 1.
    """

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        final: list[bool] = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in self.next[node]:
                        self.next[node][byte] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    node = self.next[node][byte]
                final[node] = True
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        if final[0]:
            self.fail[0], self.popped[0] = 1, 1
        level = [0, 1]
        while level:
            below = []
            for parent in level:
                for byte, node in self.next[parent].items():
                    below.append(node)
                    if final[node]:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    link, count = self.fail[parent], self.popped[parent]
                    while link != -1 and byte not in self.next[link]:
                        link, count = self.fail[link], count + self.popped[link]
                    if link != -1:
                        self.fail[node], self.popped[node] = self.next[link][byte], count
            level = below

    def count(self, word: bytes) -> int:
        """Number of pieces, or -1 if the word is unknown."""
        node, total = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for byte in word:
            while byte not in step[node]:
                total += popped[node]
                node = fail[node]
                if node == -1:
                    return -1
            node = step[node][byte]
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node == -1:
                return -1
        return total


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """The automaton of a vocabulary file, built once in a worker."""
    return LongestMatch(*read_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Words, tokens and unknown words of each document.

    Counts of words are kept in a dictionary that is emptied when it holds
    ``CACHED_WORDS``, so a worker's memory is bounded; results don't depend on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cache = automaton(vocabulary).count, {}
        for batch in bounded(batches):
            rows = ([], [], [])
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                words = WORD.findall(text or b"")
                for word in set(words).difference(cache):
                    cache[word] = count(word)
                counts = list(map(cache.__getitem__, words))
                unknown = counts.count(-1)
                for column, value in zip(rows, (len(words), sum(counts) + 2 * unknown, unknown), strict=True):
                    column.append(value)
                if len(cache) > CACHED_WORDS:
                    cache.clear()
            arrays = [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in rows)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
