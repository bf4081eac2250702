"""Benchmark decontamination with suffix arrays over the training texts.

Every shard of training text (a run of rows within a task) gets a suffix array
over its words. Each suffix of each benchmark item, cut to a window, is
binary-searched in it; the ranges found give every verbatim occurrence with its
place. Occurrences of windows of one item that follow each other in both texts are
one longer verbatim match, so every match is told as long as it is, with its
places in the training text and in the item.

The array is sparse and its order goes as deep as a window: a training suffix whose
first words hold one that no benchmark item contains cannot match and gets no
entry, and matches are lengthened beyond a window by the windows after it. Nothing is
shuffled. The benchmark is taken in blocks of bounded size; each is read, held against
all rows and done with before the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregraph.llm import _scan
from loregraph.llm._scratch import fresh, stage

WINDOW = 13
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 32 << 20

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
_PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_MATCHES = T.ArrayType(
    T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("item_start", T.LongType()), T.StructField("length", T.LongType())])
)
_PA_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))


class TestSuffixes:
    """Windows of one benchmark block as fixed-width byte keys over a dense vocabulary."""

    __test__ = False  # not a pytest class

    def __init__(self, item_ids: list[str], texts: list[str], window: int):
        self.window = window
        hashes, first = [], [0]
        kept = []
        for lo, hi, data, offsets in _scan.pieces(pa.array(texts, pa.large_string())):
            h, at = _scan.words(data, offsets, _scan.alnum_words())
            for k in range(hi - lo):
                if at[k + 1] > at[k]:
                    kept.append(item_ids[lo + k])
                    hashes.append(h[at[k] : at[k + 1]])
                    first.append(first[-1] + int(at[k + 1] - at[k]))
        self.items = kept
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.vocab = np.unique(flat)
        self.present = np.zeros(1 << 20, dtype=bool)
        self.present[(self.vocab & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        ids = np.searchsorted(self.vocab, flat) + 1
        keys, lengths, owners, places = [], [], [], []
        for k in range(len(kept)):
            own = ids[first[k] : first[k + 1]]
            size = min(window, len(own))
            rows = np.lib.stride_tricks.sliding_window_view(own, size)
            keys.append(pack(rows, window))
            lengths += [size] * len(rows)
            owners += [k] * len(rows)
            places += range(len(rows))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, f"S{4 * window}")
        self.lengths = np.array(lengths, dtype=np.int64)
        self.owners = np.array(owners, dtype=np.int64)
        self.places = np.array(places, dtype=np.int64)
        # the smallest key above all that start with the window
        raw = self.keys.view(np.uint8).reshape(len(self.keys), 4 * window).copy()
        raw[np.arange(4 * window) >= 4 * self.lengths[:, None]] = 0xFF
        self.upper = raw.reshape(-1).view(f"S{4 * window}") if len(raw) else self.keys
        short = self.lengths < window
        self.shortest = int(self.lengths[short].min()) if short.any() else window
        self.short_first = np.zeros(len(self.vocab) + 1, dtype=bool)
        if short.any():
            heads = np.array([int.from_bytes(raw[i, :4].tobytes(), "big") for i in np.flatnonzero(short)])
            self.short_first[heads] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Dense ids of training words, 0 for words that no item has."""
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.present[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.vocab):
            own = hashes[maybe]
            at = np.minimum(np.searchsorted(self.vocab, own), len(self.vocab) - 1)
            out[maybe] = np.where(self.vocab[at] == own, at + 1, 0)
        return out


def pack(rows: np.ndarray, window: int) -> np.ndarray:
    """Rows of word ids as big-endian byte strings of fixed width, filled up with zeros."""
    out = np.zeros((len(rows), window), dtype=">u4")
    out[:, : rows.shape[1]] = rows
    return out.reshape(-1).view(f"S{4 * window}") if len(rows) else np.zeros(0, f"S{4 * window}")


def suffix_array(ids: np.ndarray, first: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, their word positions) of the shard's suffixes that can match; none crosses a text's end."""
    w, n = tests.window, len(ids)
    ends = np.repeat(first[1:], np.diff(first))
    known = ids > 0
    gap = np.where(known, n, np.arange(n))
    run = np.minimum(np.minimum.accumulate(gap[::-1])[::-1] if n else gap, ends) - np.arange(n)
    can = run >= w
    if tests.shortest < w:
        can |= (run >= tests.shortest) & tests.short_first[ids]
    at = np.flatnonzero(can)
    if not len(at):
        return np.zeros(0, f"S{4 * w}"), at
    take = at[:, None] + np.arange(w)
    inside = take < ends[at][:, None]
    keys = pack(np.where(inside, ids[np.minimum(take, n - 1)], 0), w)
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def occurrences(ids: np.ndarray, first: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word position, window length, item number, place in the item) of every occurrence of every test window in the shard."""
    keys, at = suffix_array(ids, first, tests)
    none = np.zeros(0, np.int64)
    if not len(keys) or not len(tests.keys):
        return none, none, none, none
    lo = np.searchsorted(keys, tests.keys, side="left")
    hi = np.searchsorted(keys, tests.upper, side="right")
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    which = np.repeat(found, count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return at[lo[which] + inner], tests.lengths[which], tests.owners[which], tests.places[which]


def longest(pos: np.ndarray, size: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word position, length, item number, place in the item) of the matches that windows make which follow each other in both texts."""
    order = np.lexsort((pos, pos - place, owner))
    pos, size, owner, place = pos[order], size[order], owner[order], place[order]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (pos[1:] - place[1:] != pos[:-1] - place[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(pos)))
    return pos[at], size[at] + count - 1, owner[at], place[at]


def _scan_shard(hashes: np.ndarray, first: np.ndarray, tests: TestSuffixes, matches: list) -> None:
    """Adds the shard's matches to those of each row."""
    pos, size, owner, place = longest(*occurrences(tests.ids(hashes), first, tests))
    doc = np.searchsorted(first, pos, side="right") - 1
    for d, p, n, k, q in zip(doc.tolist(), (pos - first[doc]).tolist(), size.tolist(), owner.tolist(), place.tolist(), strict=True):
        matches[d].append({"item_id": tests.items[k], "start": p, "item_start": q, "length": n})


def _union(matches: list[dict]) -> list[dict]:
    """Runs of words (start, length) that the matches of a row cover; those that touch are one."""
    out: list[dict] = []
    for s, e in sorted((m["start"], m["start"] + m["length"]) for m in matches):
        if out and s <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], e - out[-1]["start"])
        else:
            out.append({"start": s, "length": e - s})
    return out


def _pass(tests: TestSuffixes, text: str, names: tuple[str, str, str, str], again: bool, shard_words: int):
    n_words, spans_name, items_name, matches_name = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            every: list[list[dict]] = batch.column(matches_name).to_pylist() if again else [[] for _ in range(batch.num_rows)]
            shard: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def flush() -> None:
                nonlocal shard, size
                if not shard:
                    return
                first = [0]
                for _, at in shard:
                    first += (at[1:] + first[-1]).tolist()
                done = len(counts)
                _scan_shard(np.concatenate([h for h, _ in shard]), np.array(first), tests, every[done : done + len(first) - 1])
                counts.extend(np.diff(first).tolist())
                shard, size = [], 0

            for _, _, data, offsets in _scan.pieces(batch.column(text)):
                h, at = _scan.words(data, offsets, _scan.alnum_words())
                if size and size + len(h) > shard_words:
                    flush()
                shard.append((h, at))
                size += len(h)
            flush()
            for row in every:
                row.sort(key=lambda m: (m["start"], m["item_id"], m["item_start"]))
            own = {
                n_words: pa.array(counts, pa.int64()),
                spans_name: pa.array([_union(row) for row in every], _PA_SPANS),
                items_name: pa.array([sorted({m["item_id"] for m in row}) for row in every], pa.list_(pa.string())),
                matches_name: pa.array(every, _PA_MATCHES),
            }
            kept = [c for c in batch.schema.names if c not in own]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + list(own.values()), names=kept + list(own))

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    shard_words: int = SHARD_WORDS,
    names: tuple[str, str, str, str] = ("n_words", "spans", "item_ids", "matches"),
) -> DataFrame:
    """``docs`` with the number of words, matched spans (in words), matching item ids and longest verbatim matches of each row.

    A window is ``window`` consecutive words of an item; an item with fewer
    words, but not none, is one window. Null and empty texts have no words and
    match nothing; benchmark rows without words match nothing; a null item id
    counts as the empty string; items that share an id count once. Each row
    stands alone, so repeated rows and ids get equal answers. A column of
    ``docs`` named like one of ``names`` is replaced.
    """
    docs = docs.drop(*[c for c in names if c in docs.columns])
    bench = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t")
    )
    total = bench.agg(F.sum(F.octet_length("t") + F.octet_length("id") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(1.25 * total / block_bytes)) if total > block_bytes else 1
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], _SPANS), T.StructField(names[2], T.ArrayType(T.StringType())), T.StructField(names[3], _MATCHES)]
    )
    out = docs
    for k in range(blocks):
        block = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k)
        rows = sorted((r["id"], r["t"]) for r in block.toLocalIterator())
        tests = TestSuffixes([r[0] for r in rows], [r[1] for r in rows], window)
        out = out.mapInArrow(_pass(tests, text_col, names, k > 0, shard_words), schema)
        if k < blocks - 1:
            out = stage(out, "contamination")  # so that this block is not needed any more
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``contaminated`` is n_hit > 0 and 20 * n_hit >= n_words.
    """
    found = find_contamination(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose hit words are a twentieth of their words or more; the columns stay."""
    names = tuple(fresh(docs, "n_words", "spans", "item_ids", "matches"))
    found = find_contamination(docs, benchmark, text_col, names=names, **options)
    n_hit = F.aggregate(names[1], F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col(names[0])))).drop(*names)
