"""Token ids in a succinct file format: one wavelet matrix per shard.

Texts are encoded in ascending id order. A shard is a run of whole documents;
its ids are stored as bit-planes, from the highest bit down, each one stably
sorted by the bits above, with counts of ones per block. Planes and counts
give access to a token, counts of a token in a prefix and the place of its
k-th occurrence without decoding the shard. A row of the Parquet file holds a
shard with its document index.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.llm import _pretokens, _scan
from loregraph.llm._scratch import scratch_dir
from loregraph.llm.token_counts import VOCABULARY, byte_letters, vocabulary_path

END_ID = 2
SHARD_TOKENS = 1 << 20
#: Bits whose ones are counted together.
BLOCK = 512

FORMAT = (
    "part int, shard int, before long, n long, levels int, zeros array<long>, planes binary, ones binary, "
    "doc_ids array<long>, doc_tokens array<long>"
)
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("levels", pa.int32()), ("zeros", pa.list_(pa.int64())),
     ("planes", pa.binary()), ("ones", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))]
)


class WaveletMatrix:
    """Ids of one shard as bit-planes with block counts."""

    def __init__(self, n: int, levels: int, zeros: list[int], planes: np.ndarray, ones: np.ndarray):
        self.n, self.levels, self.zeros = n, levels, zeros
        self.planes = planes  # levels x bytes, bits in little order
        self.ones = ones  # levels x (blocks + 1): ones before each block

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        n = len(ids)
        wide = -(-n // BLOCK) * BLOCK // 8
        planes = np.zeros((levels, wide), dtype=np.uint8)
        ones = np.zeros((levels, wide * 8 // BLOCK + 1), dtype=np.uint32)
        zeros = []
        current = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for k in range(levels):
            bit = (current & current.dtype.type(1 << (levels - 1 - k))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[k, : len(packed)] = packed
            np.cumsum(np.bitwise_count(planes[k].view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32), out=ones[k, 1:])
            low = np.compress(~bit, current)
            zeros.append(len(low))
            current = np.concatenate([low, np.compress(bit, current)])
        return cls(n, levels, zeros, planes, ones)

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        rest = np.unpackbits(self.planes[level, block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(self.ones[level, block]) + int(rest.sum())

    def access(self, i: int) -> int:
        """Id at position i."""
        value = 0
        for k in range(self.levels):
            bit = (self.planes[k, i >> 3] >> (i & 7)) & 1
            value = value << 1 | int(bit)
            one = self._rank1(k, i)
            i = self.zeros[k] + one if bit else i - one
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for k in range(self.levels):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before position ``end``."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane, by a binary search among its blocks."""
        ones = self.ones[level]
        counts = (lambda b: int(ones[b])) if bit else (lambda b: b * BLOCK - int(ones[b]))
        block = bisect_right(range(len(ones)), k, key=counts) - 1
        bits = np.unpackbits(self.planes[level, block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - counts(block)])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``; -1 where there is none."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        """Positions of all occurrences of ``token``, ascending."""
        lo, hi = self._range(token, self.n)
        if hi - lo <= self.n // (BLOCK * 4):
            return np.array([self.select(token, k) for k in range(hi - lo)], dtype=np.int64)
        at = np.arange(lo, hi, dtype=np.int64)
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            own = np.flatnonzero(np.unpackbits(self.planes[level], count=self.n, bitorder="little") == bit)
            at = own[at - self.zeros[level] if bit else at]
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        current = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for k in reversed(range(self.levels)):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            out = np.empty_like(current)
            np.place(out, bit, current[self.zeros[k] :] | current.dtype.type(1 << (self.levels - 1 - k))) if self.zeros[k] < self.n else None
            np.place(out, ~bit, current[: self.zeros[k]]) if self.zeros[k] else None
            current = out
        return current


class Encoder:
    """Ids of whole texts by the tokenizers library; each distinct word is given to it once while it is remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        _pretokens.require_byte_level(json.loads(self.tokenizer.to_str()))
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = {t.content: k for k, t in added.items()}
        self.levels = max(1, (max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, END_ID)).bit_length())
        self.letters = np.array([ord(c) for c in byte_letters()], dtype="<u4")
        self._reset()

    def _reset(self) -> None:
        self.known = _pretokens.WordTable()
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.words = 0

    def _ids(self, words: _pretokens.Words, which: np.ndarray) -> list[list[int]]:
        """Ids of some words; the letters of their bytes are looked up for the whole piece at once."""
        text = self.letters[words.data].tobytes().decode("utf-32-le")
        tokenize = self.tokenizer.model.tokenize
        spans = zip(words.at[words.starts[which]].tolist(), words.at[words.ends[which]].tolist(), strict=True)
        out = [[t.id for t in tokenize(text[a:b])] for a, b in spans]
        for i in np.flatnonzero(words.special[which] >= 0).tolist():
            out[i] = [self.specials[words.text(which[i])]]
        return out

    def _remember(self, ids: list[list[int]]) -> None:
        flat = [x for own in ids for x in own]
        lo, used = self.words, int(self.first[self.words])
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while lo + len(ids) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[used : used + len(flat)] = flat
        self.first[lo + 1 : lo + len(ids) + 1] = used + np.cumsum([len(x) for x in ids])
        self.words += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts, each with the end id, and how many each text has)."""
        words = _pretokens.cut(data, offsets, tuple(self.specials))
        h = words.hashes()
        out = self.known.find(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            at, back = _pretokens.distinct(h[new])
            own = h[new[at]]
            if not self.known.room(len(own)):
                self._reset()
                return self.encode(data, offsets) if len(own) < len(self.known.keys) // 2 else self._plain(data, offsets)
            values = np.arange(self.words, self.words + len(own), dtype=np.int32)
            self._remember(self._ids(words, new[at]))
            self.known.add(own, values)
            out[new] = values[back]
        count = self.first[out + 1] - self.first[out]
        before = np.zeros(len(out) + 1, dtype=np.int64)
        np.cumsum(count, out=before[1:])
        flat = self.ids[np.repeat(self.first[out] - before[:-1], count) + np.arange(before[-1])]
        ends = before[words.first[1:]]
        n = np.diff(np.concatenate([[0], ends]))
        return np.insert(flat, ends, END_ID), n + 1

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = [[*self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, END_ID] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.array([x for own in ids for x in own], dtype=np.uint32), np.array([len(x) for x in ids])


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _write_shards(name: str, path: str | None, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path or vocabulary_path(name))
        part = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        doc_ids: list = []
        sizes: list[int] = []
        before = number = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, sizes, before, number, held
            m = WaveletMatrix.build(np.concatenate(ids), encoder.levels)
            row = {
                "part": part, "shard": number, "before": before, "n": m.n, "levels": m.levels, "zeros": m.zeros, "planes": m.planes.tobytes(),
                "ones": m.ones.tobytes(), "doc_ids": doc_ids, "doc_tokens": sizes,
            }
            before, number, held, ids, doc_ids, sizes = before + m.n, number + 1, 0, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for lo, _, data, offsets in _scan.pieces(batch.column("text")):
                flat, count = encoder.encode(data, offsets)
                at = np.concatenate([[0], np.cumsum(count)])
                k = 0
                while k < len(count):
                    # whole documents, until the shard is full
                    e = int(np.searchsorted(at, at[k] + max(shard_tokens - held, 1), side="right")) - 1
                    e = min(max(e, k + (not held)), len(count))
                    ids.append(flat[at[k] : at[e]])
                    doc_ids += keys[lo + k : lo + e]
                    sizes += count[k:e].tolist()
                    held += int(at[e] - at[k])
                    k = e
                    if held and k < len(count):
                        yield flush()
        if doc_ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 vocabulary_file: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, with the end id after it, and write the shards under ``path``.

    Rows go in ascending id order, null ids first, rows of one id by their text
    hash and text. Null and empty texts are the end id alone. A shard holds whole
    documents and at most ``shard_tokens`` ids, or one longer document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ordered.mapInArrow(_write_shards(vocabulary, vocabulary_file, shard_tokens), FORMAT).write.option("compression", "zstd").parquet(path)


def read_shard(row) -> tuple[WaveletMatrix, list, list]:
    """Wavelet matrix, document ids and their numbers of ids, from a row of the format."""
    get = row.__getitem__
    n, levels = get("n"), get("levels")
    planes = np.frombuffer(get("planes"), dtype=np.uint8).reshape(levels, -1)
    ones = np.frombuffer(get("ones"), dtype=np.uint32).reshape(levels, -1)
    return WaveletMatrix(n, levels, list(get("zeros")), planes, ones), list(get("doc_ids")), list(get("doc_tokens"))


def _decode_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            m, doc_ids, sizes = read_shard(row)
            flat = m.decode().astype("<u4")
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            cols = [pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + row["start"]), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the ids of all shards before them."""
    shards = spark.read.schema(FORMAT).parquet(path)
    # one row per written partition, of which there are as many as tasks wrote files
    parts = shards.groupBy("part").agg(F.sum("n").alias("total"))
    parts = parts.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("part_start"))
    return shards.join(F.broadcast(parts), "part").select(
        (F.col("part_start") + F.col("before")).alias("start"), "n", "levels", "zeros", "planes", "ones", "doc_ids", "doc_tokens"
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    return _placed_shards(spark, path).mapInArrow(_decode_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _each_shard(answer, names: list[str], types: list[pa.DataType]):
    """Rows that ``answer`` gives for each shard (start, matrix, document ids, their first positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m, doc_ids, sizes = read_shard(row)
                cols = answer(row["start"], m, doc_ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of ``tokens`` stands in the files, by rank within each shard; nothing is decoded. A token that is named twice counts once."""
    tokens = sorted(set(tokens))

    def answer(start: int, m: WaveletMatrix, doc_ids: list, first: np.ndarray) -> tuple:
        return tokens, [m.rank(t) for t in tokens]

    found = _placed_shards(spark, path).mapInArrow(_each_shard(answer, ["token", "n"], [pa.int64(), pa.int64()]), "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, doc_id, position, offset): every occurrence of each of ``tokens``, among all ids and within its document, by select."""
    tokens = sorted(set(tokens))

    def answer(start: int, m: WaveletMatrix, doc_ids: list, first: np.ndarray) -> tuple:
        at = [m.occurrences(t) for t in tokens]
        every = np.concatenate(at) if at else np.zeros(0, np.int64)
        doc = np.searchsorted(first, every, side="right") - 1
        return np.repeat(tokens, [len(x) for x in at]), [doc_ids[d] for d in doc.tolist()], start + every, every - first[doc]

    names = ["token", "doc_id", "position", "offset"]
    return _placed_shards(spark, path).mapInArrow(_each_shard(answer, names, [pa.int64()] * 4), "token long, doc_id long, position long, offset long")


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, token) of those of ``positions`` that exist; each is read from its shard by access."""
    wanted = np.unique(np.array(positions, dtype=np.int64))

    def answer(start: int, m: WaveletMatrix, doc_ids: list, first: np.ndarray) -> tuple:
        own = wanted[np.searchsorted(wanted, start) : np.searchsorted(wanted, start + m.n)]
        return own, [m.access(int(p - start)) for p in own]

    return _placed_shards(spark, path).mapInArrow(_each_shard(answer, ["position", "token"], [pa.int64(), pa.int64()]), "position long, token long")


def token_report(docs: DataFrame, **options) -> DataFrame:
    """Writes the files to the shared folder and reads them back; see read_tokens."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(spark, path)
