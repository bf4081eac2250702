"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most the capacity of a bin. A piece goes to
the bin with the smallest residual that holds it and that has neither a piece of
its source nor one of its duplicate cluster. Bins are kept in order of their
residuals with bitmaps of the sources and clusters in them; the search starts at
the successor of the piece's length and continues until the tightest compatible
bin is found. Pieces are dealt at random, by a hash, to packing groups of bounded
size, which are packed independently, so a source with a third of all rows has
a third of each group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm._scratch import stage

CAPACITY = 8192
GROUP_ROWS = 4096
_CHUNK = 512
#: So many copies of a row are numbered together.
_RUN = 4096

RESULT = "doc_id long, piece int, start long, length long, bin_id string, slot int, bin_used long"


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, slot in the bin) of each piece; sources and clusters are numbers, -1 for none.

    Pieces are taken by falling length, those of one length in the given order.
    Among bins of one residual the oldest comes first.
    """
    n = len(lengths)
    bins, slots = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    source_words = max(1, (int(sources.max(initial=-1)) + 64) // 64)
    # only clusters with two pieces can conflict; they get bits
    ids, back, count = np.unique(clusters, return_inverse=True, return_counts=True)
    shared = (count > 1) & (ids >= 0)
    bit = np.where(shared, np.cumsum(shared) - 1, -1)[back] if n else np.zeros(0, np.int64)
    words = source_words + (int(shared.sum()) + 63) // 64
    maps = np.zeros((1024, words), dtype=np.uint64)
    used = np.zeros(n + 1, dtype=np.int64)
    # residual * 2^32 + number of the bin, ascending
    order = np.zeros(1024, dtype=np.int64)
    open_bins = total = 0
    one = np.uint64(1)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size, s, c = int(lengths[k]), int(sources[k]), int(bit[k])
        at = int(np.searchsorted(order[:open_bins], size << 32))
        found = -1
        while at < open_bins:
            run = order[at : min(at + _CHUNK, open_bins)] & 0xFFFFFFFF
            clash = np.zeros(len(run), dtype=np.uint64)
            if s >= 0:
                clash |= maps[run, s >> 6] & (one << np.uint64(s & 63))
            if c >= 0:
                clash |= maps[run, source_words + (c >> 6)] & (one << np.uint64(c & 63))
            free = int(np.argmin(clash != 0))
            if not clash[free]:
                found = at + free
                break
            at += len(run)
        if found >= 0:
            b = int(order[found] & 0xFFFFFFFF)
            residual = int(order[found] >> 32) - size
            order[found : open_bins - 1] = order[found + 1 : open_bins].copy()
            open_bins -= 1
        else:
            b, residual = total, capacity - size
            total += 1
            if b >= len(maps):
                maps = np.vstack([maps, np.zeros_like(maps)])
        bins[k], slots[k] = b, used[b]
        used[b] += 1
        if s >= 0:
            maps[b, s >> 6] |= one << np.uint64(s & 63)
        if c >= 0:
            maps[b, source_words + (c >> 6)] |= one << np.uint64(c & 63)
        if residual > 0:
            if open_bins >= len(order):
                order = np.concatenate([order, np.zeros_like(order)])
            entry = residual << 32 | b
            at = int(np.searchsorted(order[:open_bins], entry))
            order[at + 1 : open_bins + 1] = order[at:open_bins].copy()
            order[at] = entry
            open_bins += 1
    return bins, slots


def _numbers(values: pd.Series) -> np.ndarray:
    return pd.factorize(values, sort=True)[0].astype(np.int64)


def _pack_group(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "tie", "doc_id", "piece", "start"], ascending=[False, True, True, True, True], kind="stable", na_position="last", ignore_index=True)
        bins, slots = best_fit(rows["length"].to_numpy(np.int64), _numbers(rows["source"]), _numbers(rows["cluster"]), capacity)
        filled = np.bincount(bins, weights=rows["length"], minlength=1).astype(np.int64)
        group = str(rows["grp"].iloc[0])
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"], "piece": rows["piece"], "start": rows["start"], "length": rows["length"],
                "bin_id": [f"{group}-{b}" for b in bins], "slot": slots.astype(np.int32), "bin_used": filled[bins],
            }
        )

    return run


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", source_col: str = "source", cluster: Column | None = None,
         capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces with their bins: doc_id, piece, start, length, bin_id, slot, bin_used.

    ``length`` is a document's length and ``cluster`` names its duplicate
    cluster; without it no two clusters are alike. A document longer than the
    capacity is cut: its full pieces fill bins by themselves, the rest is packed.
    Documents of null or no length have no piece. A null source or cluster
    conflicts with nothing. Rows that are alike in id, length, source and cluster
    are counted and numbered, and each is packed by itself; bins depend on
    the rows alone, not on how they are partitioned.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(length.cast("long"), F.lit(0).cast("long")).alias("size"),
        F.col(source_col).cast("string").alias("source"),
        (F.lit(None) if cluster is None else cluster).cast("long").alias("cluster"),
    ).where("size > 0")
    own = ["doc_id", "size", "source", "cluster"]
    counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("copies"))
    # runs of copies first, so that no task makes all rows of a large group
    runs = counted.select(*own, "copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _RUN))).alias("run"))
    copy = F.explode(F.sequence(F.col("run") * _RUN, F.least((F.col("run") + 1) * _RUN, "copies") - 1)).alias("copy")
    rows = stage(runs.repartition("run", *own).select(*own, copy).withColumn("tie", F.xxhash64(*own, "copy")), "packing-rows")
    full = F.floor(F.col("size") / capacity).cast("int")
    whole = rows.where(F.col("size") >= capacity).select(*own, "copy", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    name = F.concat_ws("-", F.lit("w"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("size", "source", "cluster")), "copy", "piece")
    whole = whole.select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
        name.alias("bin_id"), F.lit(0).alias("slot"), F.lit(capacity).cast("long").alias("bin_used"),
    )
    rest = rows.where(F.col("size") % capacity > 0).select(
        "doc_id", full.alias("piece"), (full.cast("long") * capacity).alias("start"), (F.col("size") % capacity).alias("length"), "source", "cluster", "tie"
    )
    groups = max(1, math.ceil(rest.count() / group_rows))
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("tie"), F.lit(groups)).cast("int"))
    packed = dealt.groupBy("grp").applyInPandas(_pack_group(capacity), RESULT)
    return whole.unionByName(packed)


def packing_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Bins of byte-level sequences: lengths in bytes, with one more for the separator; clusters are texts equal but for white space and case."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return pack(
        docs, F.octet_length(text) + 1, id_col, source_col, F.xxhash64(F.lower(F.regexp_replace(text, "\\s+", " "))), capacity, group_rows
    )
