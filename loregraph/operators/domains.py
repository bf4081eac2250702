"""Domains: which sources belong to one, and what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_domain(location: Column, domain: str, roots: list[str], metadata_domain: Column | None = None) -> Column:
    """Below one of the roots, with the domain as a folder, or so named in its metadata."""
    hit = F.coalesce(location.contains(f"/{domain}/"), F.lit(False))
    for root in roots:
        hit = hit | F.coalesce(location.startswith(root.rstrip("/") + "/"), F.lit(False))
    return hit | F.coalesce(metadata_domain == domain, F.lit(False)) if metadata_domain is not None else hit


def created(names: DataFrame, root: str) -> DataFrame:
    """Names of domains (name) as rows: domain, valid, and the folders of its Markdown, issues, ontologies and prompts below ``root``.

    A name without a sign that may stand in one would be the default domain; unless it is called so, it is not valid.
    """
    from loregraph.functions import text as tx

    domain = tx.domain_name(F.coalesce("name", F.lit("")))
    asked = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    rows = names.select("name", domain.alias("domain"), ((asked != "") & ((domain != "default") | (asked == "default"))).alias("valid"))
    folders = {f"{kind}_dir": F.when(F.col("valid"), F.concat(F.lit(root.rstrip("/") + "/"), "domain", F.lit(f"/{kind}"))) for kind in ("markdown", "jira", "ontology", "prompts")}
    return rows.withColumns(folders)


def summary(sources: DataFrame, blocks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per domain of ``sources`` (domain, source_id): sources, records, artifacts."""
    own = sources.select("domain", "source_id").distinct()

    def counts(rows: DataFrame, name: str) -> DataFrame:
        per = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
        return own.join(per, "source_id").groupBy("domain").agg(F.sum(name).alias(name))

    out = own.groupBy("domain").agg(F.count(F.lit(1)).alias("sources"))
    for rows, name in ((blocks, "records"), (artifacts, "artifacts")):
        out = out.join(counts(rows, name), "domain", "left")
    return out.na.fill(0)


def recent(rows: DataFrame, per_domain: int = 8) -> DataFrame:
    order = W.partitionBy("domain").orderBy(F.desc("updated_at"), "source_id")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_domain).drop("r")


def snapshots(versions: DataFrame, per_file: int = 8) -> DataFrame:
    """The newest versions (path, saved_at, content) of each file; one equal to the version before it is left out."""
    order = W.partitionBy("path").orderBy("saved_at")
    changed = versions.withColumn("before", F.lag("content").over(order)).where("before IS NULL OR before != content").drop("before")
    newest = W.partitionBy("path").orderBy(F.desc("saved_at"))
    return changed.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= per_file).drop("r")


def file_tree(files: DataFrame, text: str = "") -> DataFrame:
    """folder, files: file names below each folder, of paths that hold the text."""
    rows = files.where(F.lower("path").contains(text.lower())) if text else files
    name = F.substring_index("path", "/", -1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return rows.groupBy(folder.alias("folder")).agg(F.sort_array(F.collect_list(name)).alias("files"))


def reset(gone: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the rows of the sources (source_id) that go; how many each loses: name, deleted).

    Tables with a source_id lose their own rows, those with a block_id alone the rows of lost blocks, relations (src_id,
    dst_id) those with a lost block at either end.
    """
    gone = gone.select("source_id").distinct()
    lost = tables["blocks"].join(gone, "source_id", "left_semi").select("block_id").distinct()
    kept, counts = {}, None
    for name, rows in tables.items():
        if "source_id" in rows.columns:
            left = rows.join(gone, "source_id", "left_anti")
        elif "block_id" in rows.columns:
            left = rows.join(lost, "block_id", "left_anti")
        else:
            left = rows
            for end in ("src_id", "dst_id"):
                left = left.join(lost.withColumnRenamed("block_id", end), end, "left_anti")
        kept[name] = left
        n = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(left.agg(F.count(F.lit(1)).alias("left"))))  # one row
        n = n.select(F.lit(name).alias("name"), (F.col("n") - F.col("left")).alias("deleted"))
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def states(domains: DataFrame, files: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Per domain (domain): its files, and the rows of each table that has a domain."""
    out = domains.select("domain").distinct()
    for name, rows in {"files": files, **tables}.items():
        out = out.join(rows.groupBy("domain").agg(F.count(F.lit(1)).alias(name)), "domain", "left")
    return out.na.fill(0)
