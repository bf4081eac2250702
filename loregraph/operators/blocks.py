"""Markdown documents as blocks: headings, paragraphs, list items and code.

Lines are rows; fences, sections and paragraphs are found with windows over the
lines of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.functions import text as tx

LEVELS = range(1, 7)


def _stack(level_of: Column, value: Column, position: Column, window) -> tuple[list[Column], list[Column]]:
    """(place of the last heading of each level, value there), null where a later heading of a lower level closed it."""
    places = [F.last(F.when(level_of == k, position), ignorenulls=True).over(window) for k in LEVELS]
    values = [F.last(F.when(level_of == k, value), ignorenulls=True).over(window) for k in LEVELS]
    return places, values


def parse_markdown(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """block_id, path, block_type, parent_id, heading_path, content, order_index of each document (path, text).

    A fence is a line that starts with three backquotes; lines between fences are
    code, as is what follows a fence without an end. Nested lists are flat. A
    document is one group of the windows. Null texts have no blocks.
    """
    lines = docs.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n")).alias("pos", "raw"))
    lines = lines.select("path", "pos", F.trim(F.regexp_replace("raw", "^\\s+|\\s+$", "")).alias("line"))
    upto = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    order = W.partitionBy("path").orderBy("pos")
    fence = F.col("line").startswith("```")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(upto))
    inside = (F.col("fences") % 2 == 1) & ~F.col("fence")
    heading = ~inside & ~F.col("fence") & F.col("line").rlike("^#{1,6}\\s+.*\\S$")
    item = ~inside & ~F.col("fence") & F.col("line").rlike("^([-*+]\\s+|[0-9]+\\.\\s+).+")
    kind = (
        F.when(F.col("fence"), "fence").when(inside, "code_block").when(heading, "heading").when(F.col("line") == "", "blank").when(item, "list_item").otherwise("paragraph")
    )
    lines = lines.withColumn("kind", kind)
    lines = lines.withColumn("level", F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^(#{1,6})", 1))))
    lines = lines.withColumn("title", F.when(F.col("kind") == "heading", F.regexp_extract("line", "^#{1,6}\\s+(.*\\S)$", 1)))
    places, titles = _stack(F.col("level"), F.col("title"), F.col("pos"), upto)
    for k in LEVELS:
        lines = lines.withColumn(f"p{k}", places[k - 1]).withColumn(f"t{k}", titles[k - 1])
    lines = lines.withColumn("heading_path", F.array_join(F.array(*[_open(k, f"t{k}") for k in LEVELS]), " / "))
    # consecutive lines of a paragraph, and lines between two fences, are one block; other kinds are blocks of their own
    new = ~F.col("kind").isin("paragraph", "code_block") | (F.lag("kind").over(order).isNull()) | (F.lag("kind").over(order) != F.col("kind"))
    lines = lines.withColumn("block", F.sum(F.when(new, 1).otherwise(0)).over(upto)).where(~F.col("kind").isin("blank", "fence"))
    text_of = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    blocks = lines.groupBy("path", "block").agg(
        F.min("pos").alias("pos"), F.first("kind").alias("block_type"), text_of.alias("parts"), F.first("level").alias("level"), F.first("title").alias("title"),
        F.min_by("heading_path", "pos").alias("heading_path"),
    )
    content = (
        F.when(F.col("block_type") == "heading", F.col("title"))
        .when(F.col("block_type") == "paragraph", F.array_join("parts", " "))
        .when(F.col("block_type") == "list_item", F.trim(F.regexp_replace(F.col("parts")[0], "^([-*+]\\s+|[0-9]+\\.\\s+)", "")))
        .otherwise(F.regexp_replace(F.array_join("parts", "\n"), "^\\s+|\\s+$", ""))
    )
    blocks = blocks.withColumn("content", content).withColumn("order_index", F.row_number().over(order) - 1)
    blocks = blocks.withColumn("block_id", tx.block_id(F.col("path"), F.col("block_type"), F.col("content"), F.col("order_index")))
    before = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    places, ids = _stack(F.col("level"), F.col("block_id"), F.col("pos"), before)
    for k in LEVELS:
        blocks = blocks.withColumn(f"p{k}", places[k - 1]).withColumn(f"t{k}", ids[k - 1])
    latest = F.last(F.when(F.col("block_type") == "heading", F.col("block_id")), ignorenulls=True).over(before)
    above = F.coalesce(*[F.when(F.col("level") > k, _open(k, f"t{k}")) for k in reversed(LEVELS)])
    blocks = blocks.withColumn("parent_id", F.when(F.col("block_type") == "heading", above).otherwise(latest))
    return blocks.select("block_id", "path", "block_type", "parent_id", "heading_path", "content", F.col("order_index").cast("long").alias("order_index"))


def _open(k: int, value: str) -> Column:
    """``value`` if the last heading of level k is still open: no later one has a lower level."""
    lower = [F.coalesce(F.col(f"p{j}"), F.lit(-1)) for j in range(1, k)]
    closed = F.lit(-1) if not lower else lower[0] if len(lower) == 1 else F.greatest(*lower)
    return F.when(F.col(f"p{k}") > closed, F.col(value))


def of_issues(issues: DataFrame, source_id: str | None = None) -> DataFrame:
    """Issues as blocks: a summary, the description and each text field below it, in that order; empty ones are left out."""
    root = F.concat("key", F.lit(":summary"))

    def block(kind: str, end: Column | None, title: Column, content: Column, order: Column) -> Column:
        own = root if end is None else F.concat("key", F.lit(":"), end)
        path = F.col("key") if end is None else F.concat("key", F.lit(" / "), title if kind == "issue_text_field" else end)
        return F.struct(
            own.alias("block_id"), F.lit(kind).alias("block_type"), title.alias("title"), content.alias("content"), (F.lit(None).cast("string") if end is None else root).alias("parent_id"),
            path.alias("path"), order.cast("long").alias("order_index"),
        )

    parts = F.array(block("issue_summary", None, F.col("key"), F.col("summary"), F.lit(0)), block("issue_description", F.lit("description"), F.col("summary"), F.col("description"), F.lit(1)))
    if "text_fields" in issues.columns:
        fields = F.transform(F.map_entries("text_fields"), lambda e, i: block("issue_text_field", F.concat(F.lit("field:"), e["key"]), e["key"], e["value"], i + 2))
        parts = F.concat(parts, F.coalesce(fields, F.slice(parts, 1, 0)))
    rows = issues.select(F.lit(source_id).alias("source_id") if source_id else F.concat(F.lit("issue:"), "key").alias("source_id"), F.inline(parts))
    return rows.where((F.col("block_type") == "issue_summary") | (F.coalesce("content", F.lit("")) != ""))


def only_types(blocks: DataFrame, allowed: list[str] | None) -> DataFrame:
    """Blocks of the allowed types; headings stay whatever is allowed."""
    return blocks.where(F.col("block_type").isin("heading", *allowed)) if allowed else blocks
