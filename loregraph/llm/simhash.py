"""Near-duplicates by SimHash, compared exactly in tiles.

A fingerprint has 64 bits; a bit is set if more than half of the XXH64 hashes of
a text's word shingles have it. Equal fingerprints are one node. Two fingerprints
whose numbers of set bits differ by more than the radius differ in more than that
many bits, so nodes are dealt to classes by that number, and a class of many nodes
to several tiles by a hash. Each pair of tiles that may hold a link is one group:
there the fingerprints are sorted by the bits set in each of their quarters, cut into
small tiles once more, and pairs of small tiles whose counts differ beyond the radius
are skipped. The rest is compared by exclusive-or and a count of bits. A
group returns a forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm import _scan
from loregraph.llm._components import components
from loregraph.llm._scratch import stage

N = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Nodes of a tile of a class; a group holds two tiles.
TILE = 1 << 17
#: Nodes of the small tiles within a group.
SMALL = 512
#: Comparisons for which a task of its own is worth while.
TASK_PAIRS = 1_000_000_000
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 512
#: Hashes whose bits are added in one byte each.
RUN = 255

#: Multipliers of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
#: What the four lanes start from, beside the seed.
_LANES = np.array([(int(_P1) + int(_P2)) % 2**64, int(_P2), 0, -int(_P1) % 2**64], dtype=np.uint64)
#: For each byte a word of eight bytes, one for each of its bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start:end] for each span, all spans at a time."""
    size = ends - starts
    seed_ = np.full(1, seed, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    h = np.repeat(seed_ + _P5, len(size))
    pos = starts.copy()
    short = size <= LONG_SPAN
    big = np.flatnonzero((size >= 32) & short)
    if len(big):
        v = [np.repeat(seed_ + x, len(big)) for x in _LANES]
        stripes, at, k = size[big] // 32, np.arange(len(big)), 0
        while len(at):
            for lane in range(4):
                v[lane][at] = _round(v[lane][at], eight[starts[big[at]] + 32 * k + 8 * lane])
            k += 1
            at = at[stripes[at] > k]
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            acc = (acc ^ _round(np.zeros_like(x), x)) * _P1 + _P4
        h[big] = acc
        pos[big] += 32 * stripes
    h += size.astype(np.uint64)
    left = np.flatnonzero(short & (ends - pos >= 8))
    while len(left):
        block = eight[pos[left]]
        h[left] = _rotl(h[left] ^ _round(np.zeros_like(block), block), 27) * _P1 + _P4
        pos[left] += 8
        left = left[ends[left] - pos[left] >= 8]
    left = np.flatnonzero(short & (ends - pos >= 4))
    h[left] = _rotl(h[left] ^ (four[pos[left]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    pos[left] += 4
    left = np.flatnonzero(short & (ends - pos > 0))
    while len(left):
        h[left] = _rotl(h[left] ^ (padded[pos[left]].astype(np.uint64) * _P5), 11) * _P1
        pos[left] += 1
        left = left[ends[left] > pos[left]]
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): lower-cased words with one space after each, and per text the index of its first word."""
    data = _scan.lower_table()[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _scan.space_words()[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    start[inner] |= inside[1:-1][inner]
    end[inner - 1] |= inside[1:-1][inner - 1]
    at, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(at, offsets)
    size = ends - at
    new_ends = np.cumsum(size + 1) - 1
    out = np.full(int(new_ends[-1]) + 1 if len(at) else 0, 32, dtype=np.uint8)
    target = np.ones(len(out), dtype=bool)
    target[new_ends] = False
    out[target] = data[inside[1:-1]]
    return out, new_ends - size, new_ends, first


def shingle_spans(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): spans of the shingles in the joined words, and per text the index of its first shingle."""
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(words)), count)
    word = np.arange(at[-1]) - at[text] + first[text]
    last = np.minimum(word + n, first[text + 1]) - 1
    return starts[word], ends[last], at


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, number of shingles) of each text; without words the fingerprint is 0."""
    out, starts, ends, first = joined_words(data, offsets)
    lo, hi, at = shingle_spans(starts, ends, first, n)
    h = xxh64(out, lo, hi)
    total = np.diff(at)
    counts = np.zeros((len(total), BITS), dtype=np.int64)
    if len(h):
        # runs of at most RUN hashes of a text, whose bits are added byte by byte
        runs = -(-total // RUN)
        run_first = np.concatenate([[0], np.cumsum(runs)])
        text = np.repeat(np.arange(len(total)), runs)
        begin = at[text] + RUN * (np.arange(run_first[-1]) - run_first[text])
        sums = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], begin, axis=0).view(np.uint8).reshape(-1, BITS)
        some = np.flatnonzero(runs)
        counts[some] = np.add.reduceat(sums, run_first[some], axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total[:, None], axis=1, bitorder="little")
    return bits.reshape(-1).view("<u8"), total


def _scan_texts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _scan.pieces(batch.column("text")):
                f, total = fingerprints(data, offsets, n)
                cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array(f.view(np.int64)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "n_shingles"])

    return run


def _quarters(f: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f[:, None].view("<u2")).astype(np.int16)


class _Forest:
    """Disjoint sets over positions; only joins that connect are kept as edges."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: list[int], b: list[int]) -> None:
        for i, j in zip(a, b, strict=True):
            p, q = self.root(i), self.root(j)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.edges.append((i, j))

    def roots(self, lo: int, hi: int) -> np.ndarray:
        return np.fromiter((self.root(i) for i in range(lo, hi)), dtype=np.int64, count=hi - lo)


def _sorted(f: np.ndarray) -> np.ndarray:
    q = _quarters(f)
    return f[np.lexsort((f, q[:, 3], q[:, 2], q[:, 1], q[:, 0]))]


def _boxes(f: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest counts of each quarter in each small tile."""
    at, q = np.arange(0, len(f), small), _quarters(f)
    return np.minimum.reduceat(q, at, axis=0), np.maximum.reduceat(q, at, axis=0)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what fingerprints at ``radius`` or fewer differing bits connect, across two tiles or within one.

    Rows of a comparison that are one set already cost no join: a link is looked at once for
    each pair of sets in a pair of small tiles.
    """
    a = _sorted(left)
    b = a if right is None else _sorted(right)
    both = a if right is None else np.concatenate([a, b])
    shift = 0 if right is None else len(a)
    forest = _Forest(len(both))
    (a_lo, a_hi), (b_lo, b_hi) = _boxes(a, small), _boxes(b, small)
    for i in range(len(a_lo)):
        gap = np.maximum(np.maximum(a_lo[i] - b_hi, b_lo - a_hi[i]), 0).sum(axis=1)
        own = a[i * small : (i + 1) * small, None]
        for j in np.flatnonzero(gap <= radius).tolist():
            if right is None and j < i:
                continue
            other = b[j * small : (j + 1) * small]
            near = np.bitwise_count(own ^ other) <= radius
            if not near.any():
                continue
            p, q = np.divmod(np.flatnonzero(near), len(other))
            if right is None and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                p, q = p + i * small, q + j * small + shift
                lo_p, lo_q = i * small, j * small + shift
                r, s = forest.roots(lo_p, lo_p + len(own)), forest.roots(lo_q, lo_q + len(other))
                sets = np.stack([r[p - lo_p], s[q - lo_q]], axis=1)
                apart = sets[:, 0] != sets[:, 1]
                if apart.any():
                    _, first = np.unique(sets[apart], axis=0, return_index=True)
                    forest.join(p[apart][first].tolist(), q[apart][first].tolist())
    pairs = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
    return both[pairs[:, 0]], both[pairs[:, 1]]


def _compare(radius: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        f = group.column("node").to_numpy().view(np.uint64)
        if key[0].as_py() == key[1].as_py():
            a, b = tile_links(f, None, radius)
        else:
            side = group.column("side").to_numpy() == 0
            a, b = tile_links(f[side], f[~side], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``nodes`` (node) that connect all at ``radius`` or fewer differing bits.

    What reaches the driver is a count for each number of set bits, 65 at most.
    """
    ones = F.bit_count("node").cast("int")
    count = {r["ones"]: r["c"] for r in nodes.groupBy(ones.alias("ones")).agg(F.count(F.lit(1)).alias("c")).collect()}
    tiles = [-(-count.get(p, 0) // tile) for p in range(BITS + 1)]
    first = [sum(tiles[:p]) for p in range(BITS + 2)]
    pairs = [(p, q) for p in range(BITS + 1) for q in range(p, min(p + radius, BITS) + 1) if tiles[p] and tiles[q]]
    work = sum(count[p] * count[q] for p, q in pairs)
    groups = sum(tiles[p] * tiles[q] for p, q in pairs)
    session = nodes.sparkSession
    parts = max(1, min(groups, max(int(session.conf.get("spark.sql.shuffle.partitions")), work // TASK_PAIRS)))
    starts = F.array(*map(F.lit, first))
    own = F.element_at(starts, ones + 1) + F.pmod(F.xxhash64("node"), F.greatest(F.element_at(starts, ones + 2) - F.element_at(starts, ones + 1), F.lit(1))).cast("int")
    to = F.element_at(starts, F.least(ones + radius, F.lit(BITS)) + 2)
    after = F.when(to > F.col("own"), F.sequence("own", to - 1))  # tiles of as many bits or more, itself first
    since = F.element_at(starts, F.greatest(ones - radius, F.lit(0)) + 1)
    before = F.when(since < F.col("own"), F.sequence(since, F.col("own") - 1)).otherwise(F.array().cast("array<int>"))
    placed = nodes.select("node").withColumn("own", own)
    as_left = placed.select("node", F.lit(0).alias("side"), F.col("own").alias("l"), F.explode(after).alias("r"))
    as_right = placed.select("node", F.lit(1).alias("side"), F.explode(before).alias("l"), F.col("own").alias("r"))
    dealt = as_left.union(as_right).repartition(parts, "l", "r")
    return dealt.groupBy("l", "r").applyInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, n_shingles.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; fewer than ``n`` words are one shingle. Null and empty texts
    and texts without words have fingerprint zero, which links like any other. The
    component is the smallest id that is reachable by links; null ids are passed over, and
    where no other is known it is null. Rows that repeat an id keep a row each; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(texts.mapInArrow(_scan_texts(n), "doc_id long, node long, n_shingles long"), "simhash-rows")
    nodes = stage(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = components(stage(links(nodes, radius, tile), "simhash-links"))
    placed = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    placed = stage(placed.join(least, "comp").select("node", "component_id"), "simhash-components")
    return rows.join(placed.hint("merge"), "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id", "n_shingles")
