"""Language identification by prediction by partial matching (PPM).

Per language a context tree of bytes of depth two is counted over all learning
texts; then the statistics are frozen. A byte costs -log2 of its probability in
the longest known context, with an escape (method C: distinct symbols over
distinct symbols plus occurrences) for every step to a shorter one, down to a
uniform byte. With frozen statistics a cost depends on three bytes only, so the
trees are unrolled into one table per language and code lengths are exact sums
of table entries. Where the tables of all languages would be too large, the
trigrams that occur are looked up instead, with the same costs. The language
with the shortest code for the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregraph.llm import _scan
from loregraph.llm._scratch import fresh

UNDETERMINED = "und"
#: Fixed point of costs, in parts of a bit.
UNIT = 256
#: Unrolled tables take this much at most; where they need more, costs are held by the trigrams that occur.
TABLE_BYTES = 96 << 20
_LETTER = regex.compile(r"\p{L}")
_NEWLINE = 10


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id is the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(modulus))


def _contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bytes before each byte; a text is preceded by newlines."""
    one = np.empty_like(data)
    two = np.empty_like(data)
    one[1:], one[:1] = data[:-1], _NEWLINE
    two[2:], two[:2] = data[:-2], _NEWLINE
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    one[starts] = _NEWLINE
    two[starts] = _NEWLINE
    second = starts + 1
    two[second[second < len(data)]] = _NEWLINE
    return two, one


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(c, at)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in held.items():
            k, c = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(c)], names=["lang", "key", "n"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lo, hi, data, offsets in _scan.pieces(batch.column("text")):
            two, one = _contexts(data, offsets)
            keys = (two.astype(np.uint32) << np.uint32(16)) | (one.astype(np.uint32) << np.uint32(8)) | data
            own = langs[lo:hi]
            for lang in set(own):
                mask = np.repeat(own == lang, np.diff(offsets))
                k = np.sort(keys[mask])
                if not len(k):
                    continue
                at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                ks, cs = held.setdefault(lang, ([], []))
                ks.append(k[at])
                cs.append(np.diff(np.append(at, len(k))))
                if len(ks) >= 16:
                    held[lang] = tuple([x] for x in _summed(ks, cs))
    yield from rows()


def _order(c: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Bits of each symbol from its counts in a context and its bits in the shorter one."""
    n, q = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = -np.log2(c / (n + q))
        escape = np.where(n > 0, -np.log2(q / (n + q)), 0.0)
    return np.where(c > 0, seen, escape + shorter)


def _fixed(bits: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(bits * UNIT), 65535).astype(np.uint16)


class SparseCosts:
    """Costs of one language by the trigrams that occur; others cost the escape of their context and the shorter context's bits."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        by_key = np.argsort(keys)
        self.keys, n = keys[by_key].astype(np.int32), n[by_key].astype(float)
        context = self.keys >> 8
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        q = np.diff(np.append(at, len(n)))
        total = np.add.reduceat(n, at) + q
        self.contexts, self.escapes = context[at], -np.log2(q / total)
        self.seen = _fixed(-np.log2(n / np.repeat(total, q)))
        counts = np.zeros((256, 256))
        np.add.at(counts, (context & 255, self.keys & 255), n)
        one = _order(counts, _order(counts.sum(0), np.full(256, 8.0)))
        # all bytes that are no context have one row
        self.rows, row_of = np.unique(one, axis=0, return_inverse=True)
        self.row_of = row_of.reshape(-1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out, missed = self.seen[at], self.keys[at] != keys
        k = keys[missed]
        at = np.minimum(np.searchsorted(self.contexts, k >> 8), len(self.contexts) - 1)
        escape = np.where(self.contexts[at] == k >> 8, self.escapes[at], 0.0)
        out[missed] = _fixed(escape + self.rows[self.row_of[(k >> 8) & 255], k & 255])
        return out


@dataclass
class LanguageModel:
    """Frozen statistics, unrolled: ``costs[l][(a * size + b) * size + c]`` in 1/UNIT bits, or by trigrams."""

    langs: list[str]
    symbols: np.ndarray  # byte -> symbol
    size: int
    costs: list[np.ndarray | SparseCosts]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return out
        two, one = _contexts(data, offsets)
        s = self.symbols
        if self.costs and isinstance(self.costs[0], SparseCosts):
            key = (two.astype(np.int32) << 16) | (one.astype(np.int32) << 8) | data
            found, at = np.unique(key, return_inverse=True)
            for k, costs in enumerate(self.costs):
                out[full, k] = np.add.reduceat(costs.of(found)[at], offsets[:-1][full], dtype=np.int64) / UNIT
            return out
        key = (s[two] * self.size + s[one]) * self.size + s[data]
        for k, table in enumerate(self.costs):
            out[full, k] = np.add.reduceat(table[key], offsets[:-1][full], dtype=np.int64) / UNIT
        return out


def _tables(counts: np.ndarray) -> np.ndarray:
    """Costs in 1/UNIT bits from counts[a, b, c] of one language; the last symbol is every other byte."""
    size = counts.shape[0]
    zero = _order(counts.sum((0, 1)).astype(float), np.full(size, 8.0))
    one = _order(counts.sum(0).astype(float), zero)
    out = np.empty(counts.shape, dtype=np.uint16)
    for a in range(size):
        out[a] = _fixed(_order(counts[a].astype(float), one))
    return out.reshape(-1)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", table_bytes: int = TABLE_BYTES) -> LanguageModel:
    """Counts over every row with a language and a text. Without any, the model knows no language.

    What reaches the driver are sums of counts by three bytes and language,
    whose number does not grow with the number of texts.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(_count_trigrams, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    lang_of, key, n = (sums.column(c).to_pylist() if c == "lang" else sums.column(c).to_numpy() for c in ("lang", "key", "n"))
    langs = sorted(set(lang_of))
    per_byte = np.bincount(key & 255, weights=n, minlength=256) if len(key) else np.zeros(256)
    known = [b for b in np.argsort(-per_byte, kind="stable") if per_byte[b] or b == _NEWLINE]
    symbols = np.full(256, len(known), dtype=np.int32)
    symbols[known] = np.arange(len(known))
    size = len(known) + 1
    code = np.array([langs.index(x) for x in lang_of], dtype=np.int64) if len(langs) else np.zeros(0, np.int64)
    costs = []
    for k in range(len(langs)):
        own, w = key[code == k], n[code == k]
        if 2 * len(langs) * size**3 > table_bytes:
            costs.append(SparseCosts(own, w))
            continue
        counts = np.zeros((size, size, size), dtype=np.int64)
        np.add.at(counts, (symbols[own >> 16], symbols[(own >> 8) & 255], symbols[own & 255]), w)
        costs.append(_tables(counts))
    return LanguageModel(langs, symbols, size, costs)


def _predict(model: LanguageModel, text_col: str, lang_name: str, score_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            texts = batch.column(text_col)
            for lo, hi, data, offsets in _scan.pieces(texts):
                bits = model.code_lengths(data, offsets) if model.langs else np.zeros((hi - lo, 1))
                size = np.maximum(np.diff(offsets), 1)[:, None]
                weight = np.exp2((bits.min(1, keepdims=True) - bits) / size * np.minimum(size, 64))
                best, share = bits.argmin(1), weight.max(1) / weight.sum(1)
                for k in range(hi - lo):
                    text = texts[lo + k].as_py()
                    known = bool(model.langs) and text is not None and _LETTER.search(text) is not None
                    langs.append(model.langs[best[k]] if known else UNDETERMINED)
                    scores.append(float(share[k]) if known else 0.0)
            own = {lang_name: pa.array(langs, pa.string()), score_name: pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *own.values()], names=[*batch.schema.names, *own])

    return run


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the language whose code for the whole text is shortest, and its share of the weight.

    The weight of a language is 2 to the power of minus its code length, with
    texts of over 64 bytes scaled to 64. Null texts and texts without a letter
    give ``und`` and 0. Ties go to the first language in sorted order. Columns of
    ``docs`` named like the two new ones are replaced.
    """
    docs = docs.drop(*[c for c in (lang_name, score_name) if c in docs.columns])
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return docs.mapInArrow(_predict(model, text_col, lang_name, score_name), schema)


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learns from rows with crc32(doc_id) mod 4 other than 2."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return predict(docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out")), model).drop("text")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """``docs`` without the rows that have no language: ``und``, or a share below ``least`` where one is asked for. Columns stay."""
    model = fit(docs.where(fold(id_col, 4) != 2), text_col, lang_col)
    lang, score = fresh(docs, "lang_pred", "share")
    found = predict(docs, model, text_col, lang, score)
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).drop(lang, score)
