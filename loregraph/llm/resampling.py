"""Importance resampling of documents towards a target distribution of hashed n-grams.

Features are runs of one and two words, hashed into a fixed number of buckets. One pass counts the
buckets of all documents, one those of the target; the gain of a bucket is the
logarithm of the ratio of its two smoothed shares. A second pass over the documents
takes the mean gain of each text from an array. Adding Gumbel noise that hangs on the
id alone and keeping the highest scores draws without replacement by weight. Scores
are integers of a bounded range, so a histogram of them, summed from the top, gives the rank
at which each score begins and the score at which the draw ends; only documents of
one score are ever ordered among themselves.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.llm import _scan
from loregraph.llm._scratch import stage

BUCKETS = 10_000
#: Documents of fewer words are never drawn.
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    """Of the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def crc32_from(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Crc32 of each span that continues the crc32 ``state`` of what stands before it."""
    crc, size = state ^ _ALL, ends - starts
    short = size <= LONG_WORD
    left, k = np.flatnonzero(short & (size > 0)), 0
    while len(left):
        own = crc[left]
        crc[left] = _CRC[(own ^ data[starts[left] + k]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
        k += 1
        left = left[size[left] > k]
    crc ^= _ALL
    for i in np.flatnonzero(~short).tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]))
    return crc


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, words of each text): a bucket and the number of the text for every feature, repeats included."""
    data = _scan.lower_table()[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _scan.alnum_words()[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    start[inner] |= inside[1:-1][inner]
    end[inner - 1] |= inside[1:-1][inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    text = np.repeat(np.arange(len(words)), words)
    one = crc32_from(np.zeros(len(starts), dtype=np.uint32), data, starts, ends)
    follows = np.flatnonzero(text[1:] == text[:-1]) + 1
    spaced = _CRC[(one ^ _ALL ^ np.uint32(32)) & np.uint32(0xFF)] ^ ((one ^ _ALL) >> np.uint32(8)) ^ _ALL
    two = crc32_from(spaced[follows - 1], data, starts[follows], ends[follows])
    return (np.concatenate([one, two]) % np.uint32(buckets)).astype(np.int64), np.concatenate([text, text[follows]]), words


def _count(buckets: int):
    """Counts of a task's buckets; it holds one array of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in _scan.pieces(batch.column("text")):
                n += np.bincount(features(data, offsets, buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. One number for each bucket reaches the driver."""
    out = np.zeros(buckets, dtype=np.int64)
    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket."""
    buckets, total, wanted = len(documents), float(documents.sum()), float(target.sum())
    ratio = ((target + 1.0) * (total + buckets)) / ((documents + 1.0) * (wanted + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _scan.pieces(batch.column("text")):
                bucket, text, words = features(data, offsets, len(gain))
                n = np.bincount(text, minlength=hi - lo)
                # sums of integers well below 2 ** 53 are exact in doubles
                total = np.bincount(text, weights=gain[bucket], minlength=hi - lo).astype(np.int64)
                cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight (floored mean gain of its features, 0 without any)."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int):
    """Gumbel noise of an id in thousandths, an integer; a null id is the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(scored: DataFrame, eligible: str, percent: int) -> DataFrame:
    """``scored`` (doc_id, score, ...) with ``rank`` 1, 2, 3 ... of the highest ``percent`` of a hundred of the eligible rows.

    Equal scores go by the smaller id, null ids last. The histogram that reaches the driver and goes back to the
    tasks has a row for each integer score: gains and noise span less than 100,000 of them, whatever the input.
    """
    hist = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()
    score, n = hist.column("score").to_numpy(), hist.column("n").to_numpy()
    order = np.argsort(-score)
    score, n = score[order], n[order]
    above = np.cumsum(n) - n  # rows of higher scores
    drawn = percent * int(n.sum()) // 100
    held = above < drawn
    offsets = scored.sparkSession.createDataFrame(pa.table({"score": pa.array(score[held]), "above": pa.array(above[held])}), "score long, above long")
    marked = scored.join(F.broadcast(offsets), "score", "left").withColumn("in", F.col("above").isNotNull() & F.expr(eligible))
    by_id = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    inside = marked.where("in").withColumn("rank", F.col("above") + F.row_number().over(by_id))
    inside = inside.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return inside.unionByName(marked.where("not in").withColumn("rank", F.lit(None).cast("long"))).drop("above", "in")


def resample_report(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank (null if not drawn).

    A-Z is lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null and empty texts
    have no features and weight 0, and are never drawn. Rows that repeat an id have the same noise and are ranked
    one by one. An empty target leaves gains of document shares alone; an empty ``docs`` gives no rows. Other columns are not read.
    """
    scored = weights(docs, target, id_col, text_col, buckets).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = stage(scored, "resampling-scores")
    return ranked(scored, f"n_words >= {min_words}", percent).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows that repeat an id are drawn together if any of them is."""
    drawn = resample_report(docs, target, id_col, text_col, **options).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs[id_col].cast("long").eqNullSafe(drawn["__drawn"]), "left_semi")
