"""Cutting texts into the words of a byte-level BPE, on whole arrays of code points.

The words are those of the library's byte-level pre-tokeniser. Which code
points are letters, numbers or spaces is asked of the library itself, once for
each code point that occurs; only the rules for joining runs are here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from loregraph.llm import _scan

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Endings that the pattern cuts off as words of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    return np.zeros(0x110000, dtype=np.uint8)


def kinds(points: np.ndarray) -> np.ndarray:
    table = _kinds()
    out = table[points]
    if not out.all():
        from tokenizers import pre_tokenizers

        cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        for p in np.unique(points[out == 0]).tolist():
            c = chr(p)
            table[p] = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(x + c)) == 1), SPACE)
        out = table[points]
    return out


def require_byte_level(spec: dict) -> None:
    """Raises an error unless a tokenizers file is the plain byte-level BPE that ``cut`` follows."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain_tokens = all(not t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    plain_model = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain_pre = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if spec.get("normalizer") or not (plain_pre and plain_model and plain_tokens):
        raise ValueError("not a plain byte-level BPE: its normalizer, pre-tokenizer, model or added tokens have other settings")


@dataclass
class Words:
    data: np.ndarray  # UTF-8 bytes of the piece
    at: np.ndarray  # byte where each code point starts, one more at the end
    points: np.ndarray  # code points of the piece
    starts: np.ndarray  # of each word, in code points
    ends: np.ndarray
    first: np.ndarray  # per text the index of its first word, one more at the end
    special: np.ndarray  # per word: -1, or which special string it is

    def hashes(self) -> np.ndarray:
        """Two independent hashes of each word."""
        starts, ends = self.at[self.starts], self.at[self.ends]
        return np.stack([_scan.span_hashes(self.data, starts, ends, lane) for lane in (0, 1)], axis=1)

    def text(self, k: int) -> str:
        return self.points[self.starts[k] : self.ends[k]].tobytes().decode("utf-32-le")


def cut(data: np.ndarray, offsets: np.ndarray, specials: tuple[str, ...] = ()) -> Words:
    """Words of texts given as UTF-8 bytes with offsets; special strings are words of their own."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    at = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    texts = at[offsets]
    bounds, marks = [texts], []
    for k, s in enumerate(specials):
        b, lo = s.encode(), raw.find(s.encode())
        while lo >= 0:
            # a special string lies within one text
            if offsets[np.searchsorted(offsets, lo, side="right")] >= lo + len(b):
                marks.append((int(at[lo]), int(at[lo + len(b)]), k))
                lo = raw.find(b, lo + len(b))
            else:
                lo = raw.find(b, lo + 1)
    if marks:
        bounds.append(np.array([m[:2] for m in marks]).reshape(-1))
    edge = np.zeros(n + 1, dtype=bool)
    edge[np.concatenate(bounds)] = True
    edge[n] = True
    kind = kinds(points)
    start = np.empty(n + 1, dtype=bool)
    start[n] = True
    if n:
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        start |= edge
        run = start.copy()
        space = kind == SPACE
        # the last of some spaces before a word stands alone or, a blank, leads the word
        leads = space[:-1] & ~space[1:] & ~edge[1:n]
        start[:-2] |= leads
        start[1:n] &= ~(leads & (points[:-1] == 32))
        quote = np.flatnonzero((points == 39) & start[:n] & run[1:])
        if len(quote):
            _cut_contractions(points, kind, edge, start, quote)
        for s, e, _ in marks:
            start[s + 1 : e] = False
            start[s] = True
    where = np.flatnonzero(start[:n])
    special = np.full(len(where), -1, dtype=np.int64)
    for s, _, k in marks:
        special[np.searchsorted(where, s)] = k
    return Words(data, np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)), points, where, np.append(where[1:], n), np.searchsorted(where, texts), special)


def _cut_contractions(points: np.ndarray, kind: np.ndarray, edge: np.ndarray, start: np.ndarray, quote: np.ndarray) -> None:
    n = len(points)
    for ending in CONTRACTIONS:
        size = len(ending)
        own = quote[quote + size <= n]
        for k, c in enumerate(ending[1:], 1):
            own = own[(points[own + k] == ord(c)) & ~edge[own + k]]
        start[own + 1] = False
        more = own[own + size < n] + size
        start[more] |= kind[more] == LETTER


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct pair of hashes, which of these each row is)."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]).any(1)
    back = np.empty(len(h), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


class WordTable:
    """Bounded open-addressing table from words to numbers; it is emptied when it fills up.

    A slot holds two independent hashes of its word. Those of up to eight bytes tell words of
    one length apart without fail; of longer words 128 bits have to agree.
    """

    PROBES = 8

    def __init__(self, bits: int = 20):
        self.bits, self.used = bits, 0
        self.keys = np.zeros((1 << bits, 2), dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def _slots(self, h: np.ndarray, probe: int) -> np.ndarray:
        return ((h[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64) + probe * probe) & ((1 << self.bits) - 1)

    def _holds(self, slots: np.ndarray, h: np.ndarray) -> np.ndarray:
        keys = self.keys[slots]
        return (self.values[slots] >= 0) & (keys[:, 0] == h[:, 0]) & (keys[:, 1] == h[:, 1])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words with the two hashes ``h``; -1 where there is none."""
        out = np.full(len(h), -1, dtype=np.int32)
        left = np.arange(len(h))
        for probe in range(self.PROBES):
            if not len(left):
                break
            slots = self._slots(h[left], probe)
            hit = self._holds(slots, h[left])
            out[left[hit]] = self.values[slots[hit]]
            left = left[~hit]
        return out

    def room(self, n: int) -> bool:
        return self.used + n <= 0.6 * len(self.keys)

    def clear(self) -> None:
        self.values[:] = -1
        self.used = 0

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct new words with numbers of 0 or more; one that finds no slot is simply not kept."""
        self.used += len(h)
        left = np.arange(len(h))
        for probe in range(self.PROBES):
            slots = self._slots(h[left], probe)
            free = np.flatnonzero(self.values[slots] < 0)
            # of several words for one free slot the last one gets it
            self.keys[slots[free]] = h[left[free]]
            self.values[slots[free]] = values[left[free]]
            left = left[~self._holds(slots, h[left])]
            if not len(left):
                break
