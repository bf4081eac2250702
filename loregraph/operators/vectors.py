"""TF-IDF and bag-of-words weights as sparse rows, and a protocol for other embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.functions import text as tx
from loregraph.functions.values import smoothed_idf
from loregraph.operators.store import settled


#: Vocabularies of a bound up to this are broadcast.
BROADCAST_TERMS = 100_000


class Embedder(Protocol):
    """Anything with ``embed(text) -> list[float]``; it is shipped to the tasks."""

    def embed(self, text: str) -> list[float]: ...


class BlockEmbedder(Embedder, Protocol):
    """An embedder that learns from the texts first: ``fit(texts)`` gives the one that is shipped to the tasks."""

    def fit(self, texts: DataFrame) -> Embedder: ...


class VocabularyEmbedder:
    """Word shares over the most frequent words of the texts that it was fitted on; a table of ``most`` words is all it holds."""

    def __init__(self, words: list[str] | None = None, most: int = 4096):
        self.words, self.most = {w: i for i, w in enumerate(words or [])}, most

    def fit(self, texts: DataFrame) -> VocabularyEmbedder:
        """From ``texts`` (text): words by their frequency, then by name."""
        counts = texts.select(F.explode(tx.word_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        return VocabularyEmbedder([r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(self.most).collect()], self.most)

    def embed(self, text: str) -> list[float]:
        import re

        found = re.findall(tx.WORD_TOKEN, (text or "").lower())
        out = [0.0] * len(self.words)
        for w in found:
            if w in self.words:
                out[self.words[w]] += 1 / len(found)
        return out


def terms_of(docs: DataFrame, tokens: Column, key: str = "key") -> DataFrame:
    """(key, term, n, first): occurrences of each token and the place of the first.

    Tokens are dealt by their text before they are taken apart: texts are shorter than rows of their terms, and what follows by key needs no other shuffle.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(key).alias("key"), tokens.alias("tokens")).repartition(parts, "key")
    # an outer one, since for the inner one Spark would take the tokens of every text once more to leave out those without any
    rows = dealt.select("key", F.posexplode_outer("tokens").alias("pos", "term")).where("pos IS NOT NULL")
    return rows.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("key", "first")).alias("seen"))


def vocabulary(terms: DataFrame, n_docs: int, min_df: int = 1, max_features: int | None = 2048) -> DataFrame:
    """(term, df, idf) of the most frequent terms, those seen first before others of one frequency."""
    df = document_frequency(terms).where(F.col("df") >= min_df)
    if max_features:
        df = df.orderBy(F.desc("df"), "seen", "term").limit(max_features)
    return df.select("term", "df", smoothed_idf(F.lit(n_docs), F.col("df")).alias("idf"))


def tfidf(docs: DataFrame, key: str = "key", text: str = "text", min_df: int = 1, max_features: int | None = 2048, folded: bool = True) -> tuple[DataFrame, DataFrame]:
    """(weights: key, term, weight; vocabulary). Frequencies count all tokens, also those outside the vocabulary.

    Texts are tokenized once: their terms and the vocabulary are written, and totals and weights come from there.
    """
    terms = settled(terms_of(docs, tx.tfidf_tokens(F.col(text), folded), key))
    vocab = settled(vocabulary(terms, docs.count(), min_df, max_features))
    return weigh(terms, F.broadcast(vocab) if max_features and max_features <= BROADCAST_TERMS else vocab), vocab


def weigh(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    total = terms.groupBy("key").agg(F.sum("n").alias("total"))
    return terms.join(vocab, "term").join(total, "key").select("key", "term", (F.col("n") / F.col("total") * F.col("idf")).alias("weight"))


def query_weights(spark, query: str, vocab: DataFrame, folded: bool = True) -> DataFrame:
    """(term, weight) of one text over a vocabulary."""
    one = spark.createDataFrame([("q", query)], "key string, text string")
    return weigh(terms_of(one, tx.tfidf_tokens(F.col("text"), folded)), vocab).select("term", "weight")


def bag_of_words(docs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, term, weight): share of each word in its text."""
    terms = terms_of(docs, tx.word_tokens(F.col(text)), key)
    total = F.sum("n").over(W.partitionBy("key"))
    return terms.select("key", "term", (F.col("n") / total).alias("weight"))


def embed(docs: DataFrame, embedder: Embedder, key: str = "key", text: str = "text", model: str = "custom", least: int = 20) -> DataFrame:
    """(key, embedding_model, vector) of texts of at least ``least`` characters, by any embedder."""
    rows = docs.where(F.length(F.trim(F.col(text))) >= least).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "embedding_model": model, "vector": [embedder.embed(t) for t in frame["text"]]})

    return rows.mapInPandas(run, "key string, embedding_model string, vector array<double>")


def field_rows(issues: DataFrame, least: int = 40) -> DataFrame:
    """(key, field_name, field_kind, text, excerpt): descriptions and comment fields long enough."""
    from loregraph.functions.values import comment_fields

    own = F.array(F.struct(F.lit("description").alias("field_name"), F.lit("description").alias("field_kind"), F.col("description").alias("text")))
    comments = F.transform(
        F.map_entries(comment_fields(F.col("text_fields"))),
        lambda e: F.struct(e["key"].alias("field_name"), F.lit("comment").alias("field_kind"), e["value"].alias("text")),
    )
    rows = issues.select("key", F.inline(F.concat(own, F.coalesce(comments, F.array().cast("array<struct<field_name:string,field_kind:string,text:string>>")))))
    return rows.where(F.length(F.trim("text")) >= least).withColumn("excerpt", F.substring(F.trim("text"), 1, 280))


def with_top_terms(fields: DataFrame, most: int = 6) -> DataFrame:
    """``fields`` (key, field_name, text, ...) with ``top_terms``, the most frequent tokens of the text, first seen before others."""
    from loregraph.operators.mining import top_terms

    own = fields.select(F.struct("key", "field_name").alias("key"), "text")
    found = top_terms(own, limit=most).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top_terms"))
    rows = fields.join(found.select("key.*", "top_terms"), ["key", "field_name"], "left")
    return rows.withColumn("top_terms", F.coalesce("top_terms", F.array().cast("array<string>")))


def choose_embedder(probe: Callable[[], bool], remote: Embedder, fallback: Embedder) -> Embedder:
    """The remote embedder if its probe succeeds, else the fallback."""
    try:
        return remote if probe() else fallback
    except Exception:  # noqa: BLE001  a probe may fail in any way
        return fallback
