"""Daily timelines, topics and domain terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.functions import text as tx
from loregraph.operators.store import settled

# Weights of a label hit and of a text hit.
LABEL_WEIGHT, TEXT_WEIGHT = 6, 1
#: So many issues of the least keys are looked at first for the sample keys of terms.
FIRST_KEYS = 2_000


def daily_timeline(issues: DataFrame, last_days: int = 0) -> DataFrame:
    """day, issue_count, issue_keys (sorted); of the last days only if more than 0 are asked for."""
    days = issues.where("event_day IS NOT NULL").groupBy(F.col("event_day").alias("day")).agg(
        F.count(F.lit(1)).alias("issue_count"), F.sort_array(F.collect_list("key")).alias("issue_keys")
    )
    if last_days > 0:
        # days are few: one row each
        keep = days.select("day").orderBy(F.desc("day")).limit(last_days)
        days = days.join(F.broadcast(keep), "day", "left_semi")
    return days


def daily_topics(issues: DataFrame, max_topics: int = 5, excluded: list[str] | None = None) -> DataFrame:
    """day, topics: the most frequent labels, filled up with the most frequent tokens.

    Ties go to what is seen first, by (seen, position); ``issues`` has ``seen``, the order of issues.
    As many tokens are taken as topics are missing, and those that are labels already are then dropped,
    so there may be fewer.
    """

    def ranked(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("day", "topic").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seen", "pos")).alias("first"))
        order = W.partitionBy("day").orderBy(F.desc("n"), "first")
        return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_topics)

    dated = issues.where("event_day IS NOT NULL").withColumnRenamed("event_day", "day")
    labels = dated.select("day", "seen", F.posexplode("labels").alias("pos", "topic"))
    if excluded:
        normal = tx.exclusion_term(F.col("topic"))
        labels = labels.withColumn("normal", normal).where((F.col("normal") != "") & ~F.col("normal").isin(*excluded)).drop("normal")
    else:
        labels = labels.where(tx.squeeze(tx.plain_term(F.col("topic"))) != "")
    tokens = dated.select("day", "seen", F.posexplode(tx.search_tokens(F.col("full_text"), excluded)).alias("pos", "topic"))
    top = ranked(labels).select("day", "topic", "r")
    fill = ranked(tokens).select("day", "topic", "r")
    chosen = top.groupBy("day").agg(F.count(F.lit(1)).alias("k"), F.collect_list("topic").alias("names"))
    fill = fill.join(chosen, "day", "left").where(F.col("r") <= max_topics - F.coalesce("k", F.lit(0)))
    fill = fill.where(~F.coalesce(F.array_contains("names", F.col("topic")), F.lit(False))).select("day", "topic", (F.col("r") + max_topics).alias("r"))
    every = top.unionByName(fill).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("r", "topic"))).alias("x"))
    return every.select("day", F.transform("x", lambda e: e["topic"]).alias("topics"))


def top_terms(docs: DataFrame, key: str = "key", text: str = "text", limit: int = 6) -> DataFrame:
    """key, rank, term, n: the most frequent tokens of each text, first seen before others."""
    from loregraph.operators.vectors import terms_of

    counts = terms_of(docs, tx.search_tokens(F.col(text)), key)
    order = W.partitionBy("key").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("key", "rank", "term", "n")


def issue_terms(issues: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(key, hits): label, description and comment terms of each issue with their sources and repeats, one row an issue."""
    fields = "text_fields" in issues.columns
    lists = {"labels": F.flatten(F.collect_list("labels")), "texts": F.collect_list("description")} | ({"fields": F.collect_list("text_fields")} if fields else {})
    # issues are shuffled as they are, their terms never
    rows = issues.groupBy("key").agg(*[c.alias(n) for n, c in lists.items()])

    def marked(terms: Column, source: str) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(source).alias("source")))

    hits = [marked(F.flatten(F.transform("labels", lambda x: tx.label_terms(x, excluded))), "label"), marked(F.flatten(F.transform("texts", lambda x: tx.text_terms(x, excluded))), "description")]
    if fields:
        from loregraph.functions.values import comment_fields

        comments = F.flatten(F.transform("fields", lambda m: F.map_values(comment_fields(m))))
        hits.append(marked(F.flatten(F.transform(comments, lambda x: tx.text_terms(x, excluded))), "comment"))
    return rows.select("key", F.concat(*hits).alias("hits"))


def sample_keys(per_issue: DataFrame, terms: DataFrame, n: int = 5) -> DataFrame:
    """(term, sample_issue_keys): the ``n`` least keys of the issues of each term (term, issue_count).

    Most terms have theirs among the least keys of all; only the rows of the others are ranked.
    """

    def least(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        found = rows.select("key", F.explode(F.array_distinct(F.transform("hits", lambda h: h["term"]))).alias("term")).join(wanted, "term", "left_semi")
        found = found.withColumn("r", F.row_number().over(W.partitionBy("term").orderBy("key"))).where(F.col("r") <= n)
        return found.groupBy("term").agg(F.sort_array(F.collect_list("key")).alias("sample_issue_keys"))

    first = settled(least(per_issue.orderBy("key").limit(FIRST_KEYS), terms))
    full = terms.join(first, "term", "left").where(F.coalesce(F.size("sample_issue_keys"), F.lit(0)) < F.least(F.lit(n), "issue_count")).select("term")
    if full.isEmpty():
        return first
    return first.join(full, "term", "left_anti").unionByName(least(per_issue, full))


def domain_terms(issues: DataFrame, min_count: int = 2, limit: int | None = 40, excluded: list[str] | None = None) -> DataFrame:
    """term, count (weighted), issue_count, label_hits, sources, sample_issue_keys, best first."""
    per_issue = issue_terms(issues, excluded)
    # an issue counts once for each of its terms; counts by source are longs, so terms are hashed and never sorted
    once = F.transform(F.array_distinct(F.transform("hits", lambda h: h["term"])), lambda t: F.struct(t.alias("term"), F.lit("issue").alias("source")))
    counts = {n: F.count_if(F.col("source") == s) for n, s in (("label_hits", "label"), ("described", "description"), ("commented", "comment"), ("issue_count", "issue"))}
    terms = per_issue.select(F.inline(F.concat("hits", once))).groupBy("term").agg(*[c.alias(n) for n, c in counts.items()]).withColumn("text_hits", F.col("described") + F.col("commented"))
    terms = terms.withColumn("count", LABEL_WEIGHT * F.col("label_hits") + TEXT_WEIGHT * F.col("text_hits"))
    gates = (F.col("label_hits") > 0) | ((F.col("count") >= min_count + 1) & (F.col("issue_count") >= 2) & (F.col("text_hits") >= min_count))
    terms = terms.where(gates)
    sources = [F.when(F.col(c) > 0, F.lit(s)) for c, s in (("commented", "comment"), ("described", "description"), ("label_hits", "label"))]
    terms = terms.withColumn("sources", F.array_compact(F.array(*sources)))
    if limit:
        terms = terms.orderBy(F.desc("label_hits"), F.desc("count"), F.desc("issue_count"), F.length("term"), "term").limit(limit)
    terms = settled(terms)
    return terms.join(sample_keys(per_issue, terms), "term").select("term", "count", "issue_count", "label_hits", "sources", "sample_issue_keys")
