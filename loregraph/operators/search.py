"""Lexical, vector, hybrid and multi-source retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.functions import text as tx
from loregraph.functions.values import cosine

# Weights of a token in the summary, the description and the whole text.
WEIGHTS = {"summary": 4, "description": 2, "full_text": 1}


def query_tokens(spark, query: str, excluded: list[str] | None = None) -> list[str]:
    """Search tokens of a query; without any, the whole query."""
    row = spark.range(1).select(tx.search_tokens(F.lit(query), excluded).alias("t")).first()
    return list(row["t"]) or [query.strip().lower()]


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def lexical_score(tokens: list[str], weights: dict[str, int] | None = None) -> Column:
    """Weighted substring hits; a repeated token counts again, null columns count nothing."""

    def hits(column: str, weight: int) -> Column:
        def count(text: Column) -> Column:
            return reduce(lambda a, b: a + b, [F.when(text.contains(t), F.lit(weight)).otherwise(F.lit(0)) for t in tokens])

        return _once(F.lower(column), count)

    return reduce(lambda a, b: a + b, [hits(c, w) for c, w in (weights or WEIGHTS).items()]).cast("long")


def lexical_search(issues: DataFrame, query: str, limit: int | None = 8, excluded: list[str] | None = None) -> DataFrame:
    """Issues whose text holds a token of the query, best score first, then newest, then key."""
    tokens = query_tokens(issues.sparkSession, query, excluded)
    found = _once(F.lower("full_text"), lambda text: reduce(lambda a, b: a | b, [text.contains(t) for t in tokens]))
    hits = issues.where(found).withColumn("score", lexical_score(tokens))
    return hits.orderBy(F.desc("score"), F.desc_nulls_last("updated_at"), "key").limit(limit) if limit else hits


def block_search(blocks: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Blocks whose content holds a word of the query, in document order, without scores."""
    words = tx.query_words(query)
    if not words:
        return blocks.limit(0)
    hits = blocks.where(reduce(lambda a, b: a | b, [F.lower("content").contains(w) for w in words]))
    return hits.orderBy("order_index", "block_id").limit(limit) if limit else hits


def similar(vectors: DataFrame, query: list[float], limit: int | None = 8, key: str = "key", vector: str = "vector") -> DataFrame:
    """Positive cosine similarity to a query vector, best first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    hits = vectors.withColumn("score", cosine(F.col(vector), q)).where("score > 0")
    return hits.orderBy(F.desc("score"), key).limit(limit) if limit else hits


def sparse_similar(weights: DataFrame, query: DataFrame, key: str = "key") -> DataFrame:
    """Cosine similarity of sparse rows (key, term, weight) to query rows (term, weight).

    The query is one text, so it is small; it joins on terms and rows are summed
    per key before they are shuffled.
    """
    norm = query.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("q_norm"))
    q = query.select("term", F.col("weight").alias("q_weight"))
    dots = weights.join(q, "term", "left")
    sums = dots.groupBy(key).agg(
        F.sum(F.col("weight") * F.coalesce("q_weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )
    out = sums.crossJoin(F.broadcast(norm))  # one row
    return out.where("norm > 0 AND q_norm > 0").select(key, (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score")).where("score > 0")


def fuse(lexical: DataFrame, semantic: DataFrame, lexical_weight: float = 0.35, semantic_weight: float = 0.65, limit: int | None = 8) -> DataFrame:
    """Full outer join of two hit lists (key, score), each scaled by its largest score."""

    def scaled(hits: DataFrame, name: str) -> DataFrame:
        top = hits.agg(F.max("score").alias("top"))
        share = F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.lit(0.0))
        return hits.crossJoin(F.broadcast(top)).select("key", share.cast("double").alias(name))  # one row

    both = scaled(lexical, "lexical_score").join(scaled(semantic, "semantic_score"), "key", "full_outer")
    both = both.select("key", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lexical_score", "semantic_score")))
    both = both.withColumn("combined_score", lexical_weight * F.col("lexical_score") + semantic_weight * F.col("semantic_score"))
    return both.orderBy(F.desc("combined_score"), "key").limit(limit) if limit else both


def hybrid_search(issues: DataFrame, weights: DataFrame, query: str, query_weights: DataFrame, limit: int = 8) -> DataFrame:
    """Lexical and vector hits, each cut to the larger of 4 * limit and 20, fused."""
    most = max(4 * limit, 20)
    lexical = lexical_search(issues, query, most).select("key", "score")
    semantic = sparse_similar(weights, query_weights).orderBy(F.desc("score"), "key").limit(most)
    return fuse(lexical, semantic, limit=limit)


def field_search(fields: DataFrame, query: list[float], kind: str | None = None, limit: int | None = 8) -> DataFrame:
    """Similar fields (key, field_name, field_kind, vector, ...), of one kind if given."""
    rows = fields if kind is None else fields.where(F.col("field_kind") == kind)
    hits = rows.withColumn("score", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))).where("score > 0")
    return hits.orderBy(F.desc("score"), "key", "field_name").limit(limit) if limit else hits


def field_search_issues(fields: DataFrame, issues: DataFrame, query: list[float], kind: str | None = None, limit: int | None = 8) -> DataFrame:
    """Similar fields of issues that are known, with their summaries."""
    known = fields.join(issues.select("key", "summary"), "key")
    return field_search(known, query, kind, limit)


def retrieval_score(terms: list[str], title: Column, snippet: Column) -> Column:
    """Substring hits of the terms, and a fifth for each that is a whole token."""
    hay = F.lower(F.concat_ws(" ", title, snippet))
    hits = reduce(lambda a, b: a + b, [F.when(hay.contains(t), 1.0).otherwise(0.0) for t in terms]) if terms else F.lit(0.0)
    whole = F.size(F.array_intersect(F.array(*map(F.lit, terms)), tx.retrieval_tokens(hay))) if terms else F.lit(0)
    return hits + 0.2 * whole


#: Rows of a CSV file that support search looks at, and characters of each.
CSV_ROWS, CSV_CHARS = 12, 500


def text_passages(texts: DataFrame, kind: str) -> DataFrame:
    """Passages (source_type, source_id, title, domain, snippet) of files (path, domain, text) of Markdown, PDF or ontologies."""
    name = F.substring_index("path", "/", -1)
    stem = F.coalesce(F.nullif(F.regexp_replace(name, "(?<=.)\\.[^.]*$", ""), F.lit("")), name)
    return texts.select(F.lit(kind).alias("source_type"), F.concat(F.lit(f"{kind}:"), "path").alias("source_id"), stem.alias("title"), "domain", F.explode(tx.chunks(F.col("text"))).alias("snippet"))


def csv_passages(rows: DataFrame) -> DataFrame:
    """Passages of the first rows of each CSV file, from (path, domain, line, cells: an array of name and value): "name: value" of what is not blank."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), "(?<=.)\\.[^.]*$", "")
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy("line"))).where(F.col("r") <= CSV_ROWS)
    filled = F.filter("cells", lambda c: F.trim(F.coalesce(c["value"], F.lit(""))) != "")
    text = F.substring(F.array_join(F.transform(filled, lambda c: F.concat(c["name"], F.lit(": "), c["value"])), " "), 1, CSV_CHARS)
    first = first.select(F.lit("jira").alias("source_type"), F.concat(F.lit("jira:"), "path").alias("source_id"), name.alias("title"), "domain", text.alias("snippet"))
    return first.where("snippet != ''")


def support_search(passages: DataFrame, query: str, limit: int | None = 8, domain: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Passages (source_type, source_id, title, snippet) of several sources, by score, then longer ones.

    With ``domain``, those of that domain (column ``domain``); with ``types``, those of the kinds of source that these names stand for.
    """
    spark = passages.sparkSession
    if not query.strip():
        return passages.limit(0).withColumn("score", F.lit(0.0))
    if domain:
        passages = passages.where(F.col("domain") == domain)
    if types:
        passages = passages.where(F.col("source_type").isin(*source_types(types)))
    terms = sorted(spark.range(1).select(tx.retrieval_tokens(F.lit(query)).alias("t")).first()["t"])
    hits = passages.withColumn("score", F.round(retrieval_score(terms, F.col("title"), F.col("snippet")), 3)).where("score > 0")
    cut = F.when(F.col("source_type") == "jira", F.substring("snippet", 1, 500)).otherwise(F.substring("snippet", 1, 800))
    hits = hits.withColumn("snippet", cut)
    order = [F.desc("score"), F.desc(F.length("snippet")), "source_type", "source_id", "snippet"]
    return hits.orderBy(*order).limit(limit) if limit else hits


# Other names of source types.
SOURCE_ALIASES = {
    "markdown": "md", "md": "md", "csv": "jira", "jira": "jira", "issues": "jira", "pdf": "pdf",
    "ontology": "owl", "owl": "owl", "rdf": "owl", "ttl": "owl", "turtle": "owl",
}


def source_types(names: list[str] | None) -> list[str]:
    found = {SOURCE_ALIASES[n.strip().lower()] for n in names or [] if n.strip().lower() in SOURCE_ALIASES}
    return sorted(found) or ["jira", "md", "owl", "pdf"]


def context_prompt(question: str, hits: DataFrame, graph_hits: DataFrame | None = None) -> DataFrame:
    """One row with the prompt: a context block for each hit (key, summary, full_text, rank), graph hits marked."""
    rows = hits.select("key", "summary", "full_text", "rank", F.lit("").alias("mark"))
    if graph_hits is not None:
        rows = rows.unionByName(graph_hits.select("key", "summary", "full_text", (F.col("rank") + 1000).alias("rank"), F.lit(" [graph]").alias("mark")))
    block = F.format_string("- %s%s: %s\n  %s", "key", "mark", "summary", tx.snippet(F.col("full_text"), 400))
    parts = rows.select("rank", "key", block.alias("block"))
    joined = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "block"))), lambda x: x["block"]), "\n").alias("context"))
    return joined.select(F.concat(F.lit(f"Question: {question}\n\nContext:\n"), F.col("context")).alias("prompt"))


def graph_context(issues: DataFrame, hits: DataFrame, per_seed: int = 3, most: int = 8, limit: int = 4) -> DataFrame:
    """Issues that the graph adds to hits (key, rank), with their rank: key, summary, full_text, rank.

    The heaviest neighbours of the hits by shared labels, first hit first, are searched for by their keys; what
    is no hit yet is added. The neighbours' keys are the words of a query, ``most`` of them.
    """
    from loregraph.operators.graph import expand, related_to

    seeds = hits.select(F.concat(F.lit("issue:"), "key").alias("node_id"), "rank")
    near = expand(related_to(issues, hits), seeds, ["related_label"], per_seed)
    keys = [r["node_id"].removeprefix("issue:") for r in near.orderBy("rank", "r", "node_id").limit(most).collect()]
    if not keys:
        return issues.limit(0).select("key", "summary", "full_text", F.lit(0).alias("rank"))
    found = lexical_search(issues.withColumn("full_text", F.concat_ws(" ", "key", "full_text")), " ".join(keys), limit)
    order = W.orderBy(F.desc("score"), F.desc_nulls_last("updated_at"), "key")  # ``limit`` rows
    found = found.withColumn("rank", F.row_number().over(order)).select("key", "rank")
    return issues.join(found, "key").join(hits.select("key"), "key", "left_anti").select("key", "summary", "full_text", "rank")


def context_issues(issues: DataFrame, question: str, limit: int = 8, weights: DataFrame | None = None, query_weights: DataFrame | None = None) -> DataFrame:
    """Hits (key, rank) that a question is answered from: of the hybrid search where there are vectors, else of the lexical one."""
    hybrid = weights is not None and query_weights is not None
    rows = hybrid_search(issues, weights, question, query_weights, limit) if hybrid else lexical_search(issues, question, limit)
    order = [F.desc("combined_score"), F.asc("key")] if hybrid else [F.desc("score"), F.desc_nulls_last("updated_at"), F.asc("key")]
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("key", "rank")  # ``limit`` rows


def ask(issues: DataFrame, question: str, chat=None, limit: int = 8, weights: DataFrame | None = None, query_weights: DataFrame | None = None, with_graph: bool = True) -> DataFrame:
    """One row: prompt, answer, sources (keys of hits), graph_expanded (keys that the graph added). Without ``chat`` the answer is null."""
    from loregraph.operators.store import settled

    hits = settled(context_issues(issues, question, limit, weights, query_weights))
    found = issues.join(F.broadcast(hits), "key").select("key", "summary", "full_text", "rank")  # ``limit`` rows
    more = settled(graph_context(issues, hits)) if with_graph else found.limit(0)
    prompts = context_prompt(question, found, more)

    def keys(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias(name))

    prompts = prompts.crossJoin(keys(hits, "sources")).crossJoin(keys(more, "graph_expanded"))  # one row each
    return answer(prompts, chat) if chat else prompts.withColumn("answer", F.lit(None).cast("string"))


#: What is said where nothing was found.
NOTHING_FOUND = "No matching sources were found."


def support_answer(question: str, hits: DataFrame, chat) -> DataFrame:
    """One row: prompt, answer, sources. Without hits (title, snippet, source_id, score) the model is not asked."""
    part = F.format_string("[%s] %s: %s", "source_id", "title", "snippet")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "source_id", part.alias("part"))))
    rows = hits.agg(parts.alias("p")).select(
        F.concat(F.lit(f"Question: {question}\n\nSources:\n"), F.array_join(F.transform("p", lambda x: x["part"]), "\n")).alias("prompt"), F.transform("p", lambda x: x["source_id"]).alias("sources")
    )
    asked = answer(rows.where(F.size("sources") > 0), chat)
    return asked.unionByName(rows.where(F.size("sources") == 0).withColumn("answer", F.lit(NOTHING_FOUND)))


def answer(prompts: DataFrame, chat) -> DataFrame:
    """``prompts`` with an answer column; ``chat`` maps a prompt to text and runs in the tasks."""

    def run(frames):
        for frame in frames:
            yield frame.assign(answer=[chat(p) for p in frame["prompt"]])

    return prompts.mapInPandas(run, schema=f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema)}, answer string")


def link_suggestions(blocks: DataFrame, block_id: str, limit: int = 8) -> DataFrame:
    """Blocks of the same source that share a word with the block's title and start."""
    own = blocks.where(F.col("block_id") == block_id).select("source_id", F.concat_ws(" ", "title", F.substring("content", 1, 120)).alias("q")).first()
    if own is None:
        return blocks.limit(0)
    return block_search(blocks.where((F.col("source_id") == own["source_id"]) & (F.col("block_id") != block_id)), own["q"], limit)
