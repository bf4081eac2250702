"""Listings and lookups: filters, the order that a listing shows, and a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import text as tx


def clamped(limit: int | str | None, default: int, least: int = 1, most: int = 500) -> int:
    """A limit as asked for, kept within bounds; the default where it is no number."""
    try:
        return max(least, min(most, int(limit)))
    except (TypeError, ValueError):
        return default


def listed(rows: DataFrame, order: list[Column], limit: int | None = None, **equal) -> DataFrame:
    """``rows`` whose columns have the given values (None: any), in order."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit is not None else rows


def recent_issues(issues: DataFrame, limit: int = 500) -> DataFrame:
    return listed(issues, [F.desc_nulls_last("updated_at"), F.asc("key")], limit)


def sources(rows: DataFrame, source_type: str | None = None) -> DataFrame:
    return listed(rows, [F.desc("updated_at"), F.asc("source_id")], source_type=source_type)


def artifacts(rows: DataFrame, source_id: str | None = None, artifact_type: str | None = None) -> DataFrame:
    return listed(rows, [F.desc("updated_at"), F.asc("artifact_id")], source_id=source_id, artifact_type=artifact_type)


def blocks(rows: DataFrame, limit: int | None = None) -> DataFrame:
    return listed(rows, [F.asc("order_index"), F.asc("created_at"), F.asc("block_id")], limit)


def terms(rows: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    return listed(rows, [F.desc("updated_at"), F.asc("canonical_label"), F.asc("term_id")], limit, status=status)


def jobs(rows: DataFrame, status: str | None = None, job_type: str | None = None, limit: int = 200) -> DataFrame:
    return listed(rows, [F.desc("updated_at"), F.asc("job_id")], limit, status=status, job_type=job_type)


def record_links(links: DataFrame, terms: DataFrame, record_id: str | None = None, limit: int = 200) -> DataFrame:
    """Links with the labels of their terms, newest first, then surest; an unknown term keeps its id as label."""
    labels = terms.select("term_id", F.col("canonical_label").alias("term_label"))
    rows = links.join(labels, "term_id", "left").withColumn("term_label", F.coalesce("term_label", F.col("term_id").cast("string")))
    return listed(rows, [F.desc("updated_at"), F.desc("confidence"), F.asc("link_id")], limit, record_id=record_id)


def term_detail(term_id, terms: DataFrame, facts: DataFrame, relations: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row for a term: its columns, and how many facts, relations and jobs (key) it has."""
    one = terms.where(F.col("term_id") == term_id)
    for name, rows, key in (("facts", facts, "term_id"), ("relations", relations, "source_term_id"), ("jobs", jobs, "key")):
        n = rows.where(F.col(key) == term_id).agg(F.count(F.lit(1)).alias(name))
        one = one.crossJoin(F.broadcast(n))  # one row
    return one


def looked_up(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key: a source, record, artifact, block, term, job or vector."""
    return rows.where(F.col(key) == value)


def browse(source_rows: DataFrame, block_rows: DataFrame, artifact_rows: DataFrame, relations: DataFrame, source_type: str | None = None, source_id: str | None = None, query: str = "", limit: int = 20) -> dict[str, DataFrame]:
    """What a reader of the store sees: sources, the selected one, search_results, and its records, artifacts, nodes and edges.

    Selected is the source that is asked for, else the first of the listing; where there is none, what belongs to it is empty.
    """
    from loregraph.operators.graph import source_subgraph
    from loregraph.operators.search import block_search

    listing = sources(source_rows, None if not source_type or source_type == "(all)" else source_type)
    chosen = (source_id or "").strip()
    if not chosen:
        first = listing.select("source_id").first()
        chosen = first["source_id"] if first else ""
    nodes, edges = source_subgraph(block_rows, relations, chosen, min(max(limit, 1) * 10, 400))
    return {
        "sources": listing,
        "selected": looked_up(source_rows, "source_id", chosen),
        "search_results": block_search(block_rows, query, limit) if query.strip() else block_rows.limit(0),
        "records": listed(block_rows, [F.asc("order_index"), F.asc("block_id")], limit, source_id=chosen),
        "artifacts": artifacts(artifact_rows, source_id=chosen),
        "nodes": nodes,
        "edges": edges,
    }


def job_detail(job_id, jobs: DataFrame, terms: DataFrame, facts: DataFrame, links: DataFrame, n_facts: int = 8, n_links: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the job with the label of its term and the starts of its prompt and error, the newest current facts of the term, the newest links of a record).

    A job's key is a term or a record; what it is not has no rows.
    """
    from loregraph.operators.terms import current_facts

    labels = terms.select(F.col("term_id").alias("key"), F.col("canonical_label").alias("term_label"))
    one = looked_up(jobs, "job_id", job_id)
    texts = {f"{c.split('_')[0]}_preview": tx.job_preview(F.col(c) if c in jobs.columns else F.lit(None).cast("string")) for c in ("prompt_text", "error_message")}
    job = one.join(labels, "key", "left").withColumns(texts)
    key = one.select("key")
    known = terms.select(F.col("term_id").alias("key")).join(key, "key", "left_semi")
    found = current_facts(facts).join(known.withColumnRenamed("key", "term_id"), "term_id", "left_semi").orderBy(F.desc("created_at"), "fact_id").limit(n_facts)
    record = key.join(known, "key", "left_anti").withColumnRenamed("key", "record_id")
    own = links.join(record, "record_id", "left_semi").orderBy(F.desc("updated_at"), F.desc("confidence"), "link_id").limit(n_links)
    return job, found, own


def embedding_counts(embeddings: DataFrame, *kinds: str) -> DataFrame:
    """How many vectors each model has, by further columns where asked."""
    return embeddings.groupBy("embedding_model", *kinds).agg(F.count(F.lit(1)).alias("vectors"))


def embedding_of(embeddings: DataFrame, key, model: str) -> DataFrame:
    return embeddings.where((F.col("key") == key) & (F.col("embedding_model") == model))


def exclusions(rows: DataFrame, kind: str | None = None) -> DataFrame:
    return listed(rows, [F.asc("kind"), F.asc("display_term")], kind=kind)


def exclusion_rows(named: DataFrame, now: Column, seq: str | None = None) -> DataFrame:
    """Rows to upsert by normalized_term, from (display_term, kind); names without a word are left out.

    Of one term the row written last stays: the one of the highest ``seq``, where the rows have an order, else the last by name.
    """
    order = F.col(seq) if seq else F.lit(0)
    rows = named.select(F.trim("display_term").alias("display_term"), F.coalesce("kind", F.lit("exception")).alias("kind"), order.alias("seq"))
    rows = rows.withColumn("normalized_term", tx.exclusion_term(F.col("display_term"))).where("normalized_term != ''")
    last = F.max(F.struct("seq", "display_term", "kind"))
    return rows.groupBy("normalized_term").agg(last.alias("x")).select("normalized_term", "x.display_term", "x.kind", now.alias("created_at"), now.alias("updated_at"))


def without_excluded(found: DataFrame, excluded: DataFrame, term: str = "term") -> DataFrame:
    """Rows whose term is not among the stored exclusions."""
    gone = excluded.select(F.col("normalized_term").alias("__term")).distinct()
    return found.withColumn("__term", tx.exclusion_term(F.col(term))).join(gone, "__term", "left_anti").drop("__term")


def of_sources(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of the sources (source_id) of a domain."""
    return rows.join(allowed.select("source_id").distinct(), "source_id", "left_semi")
