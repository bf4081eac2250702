"""Prompts over issues, and the checklists and templates that prompts are kept in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import text as tx

# What each kind of prompt asks for.
ASKED = {
    "summary": "Summarise this issue in one or two sentences.",
    "tasks": "List every concrete task in this issue, one on each line.",
    "criteria": "Write acceptance criteria for this issue as Given, When, Then.",
}


def issue_prompts(issues: DataFrame, kind: str) -> DataFrame:
    """(key, prompt) of issues (key, summary, description, status, issue_type, and text_fields where they have them).

    Issues without a description have no tasks, so no prompt for these.
    """
    rows = issues.where(F.coalesce(F.trim("description"), F.lit("")) != "") if kind == "tasks" else issues
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("(none)"))) for name, c in (("Key", "key"), ("Type", "issue_type"), ("Status", "status"), ("Summary", "summary"), ("Description", "description"))]
    more: Column = F.lit("")
    if "text_fields" in issues.columns:
        fields = F.transform(F.map_entries("text_fields"), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
        more = F.when(F.size("text_fields") > 0, F.concat(F.lit("\nFurther fields:\n"), F.array_join(fields, "\n"))).otherwise(F.lit(""))
    return rows.select("key", F.concat(F.lit(ASKED[kind] + "\n\n"), F.concat_ws("\n", *lines), more).alias("prompt"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.posexplode(F.split("text", "\\r?\\n")).alias("line_index", "line"))


def backlog(docs: DataFrame) -> DataFrame:
    """Items of checklists: path, line_index, checked, template, question; "name :: question" names a template."""
    item = "^\\s*[-*]\\s+\\[([ xX])\\]\\s+(.*\\S)\\s*$"
    rows = _lines(docs).where(F.col("line").rlike(item)).select("path", "line_index", F.lower(F.regexp_extract("line", item, 1)).alias("mark"), F.regexp_extract("line", item, 2).alias("body"))
    named = F.col("body").contains("::")
    asked = F.trim(F.substring("body", F.instr("body", F.lit("::")) + 2, F.length("body")))
    return rows.select(
        "path", "line_index", (F.col("mark") == "x").alias("checked"), F.when(named, tx.template_name(F.substring_index("body", "::", 1))).otherwise(F.lit("default")).alias("template"),
        F.when(named & (asked != ""), asked).otherwise(F.trim("body")).alias("question"),
    )


def templates(docs: DataFrame) -> DataFrame:
    """Templates of Markdown texts: path, template, content; the last one of a name stays."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), "text"), "\\n\\s*##[ \\t]+(?=\\S)"), lambda x, i: i > 0)
    rows = docs.select("path", F.posexplode(parts).alias("pos", "part"))
    head = tx.template_name(F.regexp_replace(F.substring_index("part", "\n", 1), "\r$", ""))
    body = F.when(F.instr("part", F.lit("\n")) > 0, F.trim(F.regexp_replace(F.substring("part", F.instr("part", F.lit("\n")) + 1, F.length("part")), "^\\s+|\\s+$", ""))).otherwise(F.lit(""))
    rows = rows.select("path", "pos", head.alias("template"), body.alias("content"))
    return rows.groupBy("path", "template").agg(F.max_by("content", "pos").alias("content"))


def filled(backlog: DataFrame, templates: DataFrame, domain: str, fallback: str = "{{question}}") -> DataFrame:
    """Open items with the prompt of their template; an unknown template counts as the one named default."""
    own = templates.select("path", "template", "content")
    default = own.where("template = 'default'").select("path", F.col("content").alias("default"))
    rows = backlog.where(~F.col("checked")).join(own, ["path", "template"], "left").join(default, "path", "left")
    text = F.coalesce(F.nullif("content", F.lit("")), "default", F.lit(fallback))
    prompt = F.replace(F.replace(text, F.lit("{{domain}}"), F.lit(domain)), F.lit("{{question}}"), F.col("question"))
    return rows.select("path", "line_index", "question", prompt.alias("prompt"))


def ticked(docs: DataFrame, done: DataFrame) -> DataFrame:
    """``docs`` (path, text) with the items ``done`` (path, line_index) ticked; texts end in one line break, as after a run."""
    own = done.groupBy("path").agg(F.collect_set("line_index").alias("__done"))
    line = lambda x, i: F.when(F.array_contains("__done", i), F.regexp_replace(x, "\\[ \\](.*)$", "[x]$1")).otherwise(x)
    rows = docs.join(own, "path", "left").withColumn("__done", F.coalesce("__done", F.array().cast("array<int>")))
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\\r?\\n"), line), "\n")
    return rows.withColumn("text", F.concat(F.regexp_replace(text, "^\\s+|\\s+$", ""), F.lit("\n"))).drop("__done")


def run_batch(docs: DataFrame, templates: DataFrame, domain: str, chat, fallback: str = "{{question}}") -> tuple[DataFrame, DataFrame]:
    """(answers: path, line_index, question, prompt, answer; ``docs`` with the answered items ticked). ``chat`` maps a prompt to text, in the tasks."""
    from loregraph.operators.search import answer
    from loregraph.operators.store import settled

    asked = filled(backlog(docs), templates, domain, fallback)
    answers = settled(answer(asked, chat))  # the model is asked once
    return answers, ticked(docs, answers.where("answer IS NOT NULL"))
