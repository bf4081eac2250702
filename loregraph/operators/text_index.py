"""A stored index of trigrams that rules out texts before a substring search.

Each text's distinct runs of three characters are stored as postings, lists of keys sorted by trigram, so that a search
reads the row groups of its own trigrams alone. A text that holds a token holds every trigram of it; what has the rarest few of
each token's is a candidate. The candidates are then searched as ever, so hits and scores are those of a scan of all texts.
A token of fewer than three characters rules out nothing, and a search with one reads all texts; so does one whose trigrams rule out too few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregraph.operators.search import lexical_search, query_tokens
from loregraph.operators.store import settled

GRAM = 3
#: Of a token's trigrams so many are looked up, the rarest first.
RAREST = 4
#: Up to this many candidates are named in the filter of the scan; more are joined.
NAMED = 2_000
#: Up to this many candidates are broadcast to the texts; for more the texts are shuffled.
BROADCAST_KEYS = 500_000
#: If more than one text in so many has the rarest trigram of a token, looking for candidates saves less than it costs.
ONE_IN = 4
#: Characters of the texts whose postings a task makes at once; a longer text is taken by itself.
PIECE = 4_000_000
#: The lists of a trigram are dealt to so many partitions at most.
SPREAD = 16


def _gram_lists(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(trigrams in order, offsets, places of the texts that hold each) of ``texts``, in several parts if their codes ask for it."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    place = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)
    size, count = len(alphabet), len(texts)
    if count > 1 and size**GRAM * count >= 1 << 63:
        yield from ((g, o, p + lo) for lo, part in ((0, texts[: count // 2]), (count // 2, texts[count // 2 :])) for g, o, p in _gram_lists(part))
        return
    code = (np.cumsum(seen) - 1)[chars]
    inside = place[: 1 - GRAM] == place[GRAM - 1 :]  # all of one text
    pairs = np.sort((((code[:-2] * size + code[1:-1]) * size + code[2:]) * count + place[:-2])[inside])
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    grams, places = np.divmod(pairs, max(count, 1))
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    own = grams[first]
    named = alphabet[np.stack([own // size**2, own // size % size, own % size], axis=1)] if len(own) else np.zeros((0, GRAM))
    named = named.astype(np.uint32).tobytes().decode("utf-32-le")
    yield [named[k : k + GRAM] for k in range(0, len(named), GRAM)], np.append(first, len(pairs)), places


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, keys) of rows (key, text): for each trigram of about PIECE characters of texts the keys of those that hold it."""
    for batch in batches:
        texts = [t.decode("utf-8", "replace") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        ends, lo = np.cumsum([len(t) for t in texts]), 0
        while lo < len(texts):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            for grams, at, places in _gram_lists(texts[lo:hi]):
                keys = pa.ListArray.from_arrays(pa.array(at, pa.int32()), batch.column("key").take(pa.array(places + lo)))
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.diff(at), pa.int64()), keys], names=["gram", "n", "keys"])
            lo = hi


class TextIndex:
    """Texts, their postings and how many texts have each trigram, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.texts = spark.read.parquet(f"{self.path}/texts")
        self.postings = spark.read.parquet(f"{self.path}/postings")
        self.counts = spark.read.parquet(f"{self.path}/counts")

    @classmethod
    def build(cls, texts: DataFrame, path: str) -> TextIndex:
        """Index ``texts`` (key, full_text and what ``lexical_search`` reads); each row counts by its key."""
        spark, path = texts.sparkSession, path.rstrip("/")
        # in the order of keys, so that a search for some of them skips the row groups of others
        texts.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/texts")
        stored = spark.read.schema(texts.schema).parquet(f"{path}/texts")
        schema = T.StructType().add("gram", "string").add("n", "long").add("keys", T.ArrayType(texts.schema["key"].dataType))
        lists = stored.select("key", F.lower(F.coalesce("full_text", F.lit(""))).alias("text")).mapInArrow(_postings, schema)
        # the lists of a frequent trigram go to several files; dealt by ranges they would be made twice
        lists.repartition("gram", F.pmod(F.hash(F.get("keys", F.lit(0))), F.lit(SPREAD))).sortWithinPartitions("gram").write.parquet(f"{path}/postings")
        spark.read.schema(schema).parquet(f"{path}/postings").groupBy("gram").agg(F.sum("n").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
        return cls(spark, path)

    def candidates(self, tokens: list[str]) -> DataFrame | None:
        """Distinct keys of texts that may hold one of the tokens; None if that is every text, or may be more than one in ONE_IN."""
        if any(len(t) < GRAM for t in tokens):
            return None
        own = {t: sorted({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}) for t in set(tokens)}
        every = sorted({g for grams in own.values() for g in grams})
        seen = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(every)).collect()}  # a row for each trigram of the query
        rarest = [sorted(grams, key=lambda g: (seen[g], g))[:RAREST] for grams in own.values() if all(g in seen for g in grams)]  # else no text has them all
        if not rarest:
            return self.texts.select("key").limit(0)
        if ONE_IN * sum(seen[grams[0]] for grams in rarest) > self.texts.count():
            return None
        found = None
        for grams in rarest:
            rows = self.postings.where(F.col("gram").isin(grams)).select("gram", F.explode("keys").alias("key"))
            rows = rows.groupBy("key").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(grams)).select("key")
            found = rows if found is None else found.union(rows)
        return found.distinct()

    def search(self, query: str, limit: int | None = 8, excluded: list[str] | None = None, seen: Observation | None = None) -> DataFrame:
        """``lexical_search`` over the indexed texts; ``seen`` observes ``rows``, how many of them it had to look at."""
        found = self.candidates(query_tokens(self.spark, query, excluded))
        rows = self.texts
        if found is not None:
            found = settled(found)
            count = found.count()
            if count <= NAMED:
                rows = rows.where(F.col("key").isin(found.toArrow().column("key").to_pylist()))
            else:
                rows = rows.join(F.broadcast(found) if count <= BROADCAST_KEYS else found, "key", "left_semi")
        if seen is not None:
            rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        return lexical_search(rows, query, limit, excluded)
