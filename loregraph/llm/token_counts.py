"""Token counts of a byte-level BPE without making identifiers.

A word starts as its bytes in a linked list. A heap holds the adjacent pairs
that the vocabulary can merge; the pair of lowest rank, leftmost first, is
popped and merged until none is left. The count is the number of bytes less the
number of merges. Words that a task has counted before are looked up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm import _pretokens, _scan

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class MergeRules:
    """Ranks of mergeable pairs, and the special strings, of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _pretokens.require_byte_level(spec)
        vocab = spec["model"]["vocab"]
        self.specials = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.byte = [vocab[c] for c in byte_letters()]
        #: pair of ids as one number -> rank, and id that they merge into
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))

    def count(self, word: bytes) -> int:
        """Symbols left of a word when no pair can be merged."""
        size = left = len(word)
        if size < 2:
            return size
        pairs, byte = self.pairs, self.byte
        ids = [byte[b] for b in word]
        heap = []
        for i in range(size - 1):
            found = pairs.get(ids[i] << 32 | ids[i + 1])
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i, new = pop(heap)
            j = after[i] if ids[i] >= 0 else size
            if j >= size:
                continue
            found = pairs.get(ids[i] << 32 | ids[j])
            if found is None or found[0] != rank:
                continue  # the pair has changed since
            ids[i], ids[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = pairs.get(new << 32 | ids[k])
                if found:
                    push(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = pairs.get(ids[h] << 32 | new)
                if found:
                    push(heap, (found[0], h, found[1]))
        return left


class _Counter:
    def __init__(self, path: str):
        self.rules = MergeRules(path)
        self.known = _pretokens.WordTable()

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = _pretokens.cut(data, offsets, self.rules.specials)
        h = words.hashes()
        out = self.known.find(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            at, back = _pretokens.distinct(h[new])
            own = h[new[at]]
            values = np.array([self._count(words, k) for k in new[at].tolist()], dtype=np.int32)
            if not self.known.room(len(own)):
                self.known.clear()
            self.known.add(own, values)
            out[new] = values[back]
        total = np.zeros(len(out) + 1, dtype=np.int64)
        np.cumsum(out, out=total[1:])
        return total[words.first[1:]] - total[words.first[:-1]]

    def _count(self, words: _pretokens.Words, k: int) -> int:
        return 1 if words.special[k] >= 0 else self.rules.count(words.text(k).encode())


@lru_cache(maxsize=2)
def _counter(path: str) -> _Counter:
    return _Counter(path)


def _count_batches(name: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path or vocabulary_path(name))
        for batch in batches:
            n, sizes = [], []
            for _, _, data, offsets in _scan.pieces(batch.column("text"), 4 << 20):
                n.append(counter.counts(data, offsets))
                sizes.append(np.diff(offsets))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, flat)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, vocabulary: str = VOCABULARY, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens. Special strings of the
    vocabulary inside a text are one token each. Every row is counted by itself,
    so repeated rows and ids get equal counts. ``path`` is the vocabulary's
    file on every node; by default it is the installed one of that name.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count_batches(vocabulary, path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
