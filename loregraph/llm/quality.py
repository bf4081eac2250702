"""Quality scores from random Fourier features over statistics of whole texts.

Text statistics are standardised and mapped to random Fourier features, whose
inner products approximate a Gaussian kernel. Each task sums its part of the
normal equations of a ridge regression on the labels; the sums are added by row
of the matrix, solved once, and the raw scores are calibrated by isotonic
regression over a histogram of a fold that the regression did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm import _scan
from loregraph.llm._scratch import stage
from loregraph.llm.language_id import fold

N_FEATURES = 192
RIDGE = 1e-3
#: Width of the Gaussian kernel in standardised units, as a multiple of sqrt(number of statistics).
WIDTH = 1.0
BINS = 1024
THRESHOLD = 0.3

_CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "comma", "shout", "bar", "symbol", "quote", "dash", "high", "control"]


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("symbol"), dtype=np.int64)
    t[97:123] = 0
    t[65:91] = 1
    t[48:58] = 2
    t[[32, 9]] = 3
    t[[10, 13]] = 4
    for chars, name in (".", "stop"), (",;:", "comma"), ("!?", "shout"), ("|", "bar"), ("\"'()", "quote"), ("-_", "dash"):
        t[[ord(c) for c in chars]] = _CLASSES.index(name)
    t[128:] = _CLASSES.index("high")
    t[:9] = t[11:13] = t[14:32] = t[127] = _CLASSES.index("control")
    return t


STATISTICS = [
    *(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_mean", "word_spread", "long_words", "short_words",
    "distinct_words", "log_lines", "line_words", "distinct_lines", "capital_words", "symbol_words",
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text; an empty text has zeros."""
    n, d = len(offsets) - 1, len(data)
    out = np.zeros((n, len(STATISTICS)), dtype=np.float64)
    if not d:
        return out
    kinds = _class_table()[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    k = len(_CLASSES)
    by_class = np.bincount(doc * k + kinds, minlength=n * k).reshape(n, k)
    size = np.maximum(np.diff(offsets), 1)
    out[:, :k] = by_class / size[:, None]
    inside = np.zeros(d + 2, dtype=bool)
    inside[1:-1] = _scan.space_words()[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < d)]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    start[inner] |= inside[1:-1][inner]
    end[inner - 1] |= inside[1:-1][inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    w_doc, length = doc[starts], ends - starts
    words = np.bincount(w_doc, minlength=n)
    some = np.maximum(words, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w_doc, weights=mask, minlength=n) / some

    def distinct(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
        both = np.sort(_scan.mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64((1 << 20) - 1) | owner.astype(np.uint64))
        new = np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.zeros(0, bool)
        return np.bincount((both[new] & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=n)[:n]

    mean = np.bincount(w_doc, weights=length, minlength=n) / some
    square = np.bincount(w_doc, weights=length * length, minlength=n) / some
    breaks = np.zeros(d, dtype=bool)
    breaks[data == 10] = True
    last = offsets[1:] - 1
    breaks[last[np.diff(offsets) > 0]] = True
    l_end = np.flatnonzero(breaks) + 1
    l_doc = doc[l_end - 1]
    l_start = np.concatenate([[0], l_end[:-1]])
    lines = np.maximum(np.bincount(l_doc, minlength=n), 1)
    symbol = np.isin(kinds, [_CLASSES.index(x) for x in ("symbol", "shout", "bar")])
    out[:, k:] = np.stack(
        [
            np.log1p(np.diff(offsets)), np.log1p(words), mean, np.sqrt(np.maximum(square - mean * mean, 0)), share(length > 12), share(length < 4),
            distinct(w_doc, _scan.span_hashes(data, starts, ends)) / some, np.log1p(lines), words / lines,
            distinct(l_doc, _scan.span_hashes(data, l_start, l_end)) / lines, share(kinds[starts] == 1), share(symbol[ends - 1]),
        ],
        axis=1,
    )
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(data, offsets) for _, _, data, offsets in _scan.pieces(batch.column("text"))]
        flat = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, len(STATISTICS)), np.float32)
        stats = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("bucket"), stats], names=["doc_id", "bucket", "stats"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column("stats")
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), len(STATISTICS))


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the random features, the last one of the constant
    steps: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated scores there
    seed: int = 7

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, 1 / (WIDTH * np.sqrt(x.shape[1])), (x.shape[1], N_FEATURES))
        b = rng.uniform(0, 2 * np.pi, N_FEATURES)
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / N_FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.levels)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, square = 0, np.zeros(len(STATISTICS)), np.zeros(len(STATISTICS))
    for batch in batches:
        x = _matrix(batch)
        n, total, square = n + len(x), total + x.sum(0), square + (x * x).sum(0)
    names = ["j", "n", "total", "square"]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), n)), pa.array(total), pa.array(square)], names=names)


def _normal_equations(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
        for batch in batches:
            x, y = _matrix(batch), np.asarray(batch.column("y"), dtype=np.float64)
            for lo in range(0, len(x), 4096):
                z = model.features(x[lo : lo + 4096])
                acc += z.T @ np.hstack([z, y[lo : lo + 4096, None]])
        if acc.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc))), pa.array([r.tobytes() for r in acc], pa.binary())], names=["i", "part"])

    return run


def _add_parts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [key[0]], "part": [sum(np.frombuffer(x) for x in rows["part"]).tobytes()]})


def _histogram(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            n += np.bincount(at, minlength=BINS)
            good += np.bincount(at, weights=np.asarray(batch.column("y"), dtype=np.float64), minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(good[at])], names=["bin", "n", "good"])

    return run


def isotonic(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (points, non-decreasing rates) from counts at ascending x."""
    blocks: list[list[float]] = []  # weight, good, weighted x
    for a, w, g in zip(x, n, good, strict=True):
        blocks.append([w, g, w * a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bucket (crc32 of the id modulo 5) and the statistics of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(id_col, 5).cast("int").alias("bucket"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_statistics, "doc_id long, bucket int, stats array<float>")


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Learns from the labelled rows of ``stats`` whose bucket is not 0: bucket 1 calibrates, the others fit.

    A document with several labels counts with the highest; null labels count
    as none. Without labels every score is 0.5.
    """
    labels = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    rows = stage(stats.where("bucket != 0").join(labels, "doc_id").select("bucket", "stats", "y"), "quality-labelled")
    train, check = rows.where("bucket != 1"), rows.where("bucket = 1")
    sums = train.mapInArrow(_moments, "j long, n long, total double, square double").groupBy("j").agg(*(F.sum(c).alias(c) for c in ("n", "total", "square")))
    m = {r["j"]: r for r in sums.collect()}
    n = m[0]["n"] if m else 0
    d = len(STATISTICS)
    if not n:
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(N_FEATURES + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([m[j]["total"] / n for j in range(d)])
    spread = np.sqrt(np.maximum(np.array([m[j]["square"] / n for j in range(d)]) - mean * mean, 0))
    model = QualityModel(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(N_FEATURES + 1), np.array([0.0]), np.array([0.5]))
    parts = train.mapInArrow(_normal_equations(model), "i long, part binary").groupBy("i").applyInPandas(_add_parts, "i long, part binary")
    system = np.stack([np.frombuffer(r["part"]) for r in sorted(parts.collect(), key=lambda r: r["i"])])
    ridge = np.eye(N_FEATURES + 1) * RIDGE * n / N_FEATURES
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(system[:, :-1] + ridge, system[:, -1])
    for part in (check, train):
        bins = part.mapInArrow(_histogram(model), "bin long, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        hist = sorted((r["bin"], r["n"], r["good"]) for r in bins.collect())
        if hist:
            break
    at, count, good = (np.array(c, dtype=float) for c in zip(*hist, strict=True))
    model.steps, model.levels = isotonic((at + 0.5) / BINS * 2 - 0.5, count, good)
    return model


def _score(model: QualityModel, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            cols = [batch.column("doc_id"), pa.array(np.asarray(batch.column("bucket")) == 0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out (crc32 of the id mod 5 is 0), score from 0 to 1, predicted.

    Null texts are empty texts; they are scored from their statistics like all
    others. A null id is in the bucket of the empty text.
    """
    stats = stage(text_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit(stats, labels)
    return stats.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
