"""Array helpers over the raw UTF-8 bytes of an Arrow string column.

All functions work on whole texts. A column is cut at text boundaries into
pieces of a few MB so that working arrays stay small; one text larger than a
piece is a piece of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_MASK = (1 << 64) - 1
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_HASH_KEY = b"loregraph words"


def pieces(texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) for runs of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, off_buf, data_buf = texts.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + piece_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: The low k bytes of a block.
_FULL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


@lru_cache(maxsize=1)
def space_words() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, dtype=bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return t


@lru_cache(maxsize=1)
def alnum_words() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = True
    t[0x61:0x7B] = True
    t[0x80:] = True
    return t


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; different lanes are independent hashes.

    Blocks of eight bytes are mixed one after the other, so no relation between the
    letters of two words carries over to their hashes. Of up to eight bytes, no two spans
    of one length share a hash: each step is a bijection of the block.
    """
    size = ends - starts
    key = np.random.default_rng([20240117, lane]).integers(1, 1 << 63, 2, dtype=np.uint64)
    h = mix(size.astype(np.uint64) ^ key[0])
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    short = size <= LONG_WORD
    left, k = (np.flatnonzero(short & (size > 0)) if not short.all() else np.flatnonzero(size > 0)), 0
    while len(left):
        rest = size[left] - k
        block = blocks[starts[left] + k] & _FULL[np.minimum(rest, 8)]
        h[left] = mix((h[left] ^ block) * np.uint64(0xD6E8FEB86659FD93) + key[1])
        left, k = left[rest > 8], k + 8
    for i in np.flatnonzero(~short).tolist():
        own = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=_HASH_KEY, salt=bytes([lane])).digest()
        h[i] = np.frombuffer(own, "<u8")[0]
    return h


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) in order, and per text the index of its first word (one more at the end)."""
    data = lower_table()[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = table[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start = inside[1:-1] & ~inside[:-2]
    start[inner] |= inside[1:-1][inner]
    end = inside[1:-1] & ~inside[2:]
    end[inner - 1] |= inside[1:-1][inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)
