"""Issue exports in CSV."""

from __future__ import annotations

import csv
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions import dates
from loregraph.functions import text as tx

# Headers that stand for each column, folded to ASCII letters and digits, in order of preference.
HEADERS = {
    "key": ("issuekey", "issuekeyid", "key", "id", "vorgangsschlussel"),
    "summary": ("summary", "title", "issuesummary", "zusammenfassung"),
    "description": ("description", "issuedescription", "beschreibung"),
    "status": ("status", "statusname"),
    "issue_type": ("issuetype", "type", "vorgangstyp"),
    "assignee": ("assignee", "assigneename", "assigneedisplayname", "bearbeiter"),
    "labels": ("labels", "label", "stichworter"),
    "created_at": ("created", "erstellt"),
    "updated_at": ("updated", "aktualisiert"),
}

DELIMITERS = ",;\t|"


def folded(header: str) -> str:
    plain = unicodedata.normalize("NFKD", header).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]", "", plain)


def detect_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample[:8192], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def header_map(headers: list[str]) -> dict[str, int]:
    """Place of the header for each column; the last of equal headers counts."""
    places = {folded(h): i for i, h in enumerate(headers) if h}
    return {column: places[a] for column, aliases in HEADERS.items() for a in [next((a for a in aliases if a in places), None)] if a}


def labels_of(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[;,]"), F.trim), lambda x: x != "")


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """One issue per record of the files at ``path``; quoted fields may hold line breaks.

    Of equal headers the last column counts. Columns that no header names, if not
    empty, are entries of ``text_fields``. Missing keys, summaries, states and
    types get placeholders.
    """
    head = spark.read.option("lineSep", "\n").text(path).limit(40).collect()
    sample = "\n".join(r["value"] for r in head).lstrip("﻿")
    sep = delimiter or detect_delimiter(sample)
    first = next(csv.reader(sample.splitlines(), delimiter=sep), [])
    headers = [h.strip() for h in first]
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    if not headers:
        return _issues(spark.createDataFrame([], "c0 string"), ["key"])
    rows = spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE")
    return _issues(rows, headers)


def _issues(rows: DataFrame, headers: list[str]) -> DataFrame:
    at = header_map(headers)

    def value(name: str) -> Column:
        return F.nullif(F.trim(F.col(f"c{at[name]}")), F.lit("")) if name in at else F.lit(None).cast("string")

    last = {h: i for i, h in enumerate(headers) if h}
    extra = [(h, i) for h, i in last.items() if i not in at.values()]
    pairs = [x for h, i in extra for x in (F.lit(h), F.trim(F.coalesce(F.col(f"c{i}"), F.lit(""))))]
    fields = F.map_filter(F.create_map(*pairs), lambda _, v: v != "") if pairs else F.create_map().cast("map<string,string>")
    out = rows.select(
        F.coalesce(value("key"), F.lit("(unknown-key)")).alias("key"), F.coalesce(value("summary"), F.lit("(no summary)")).alias("summary"), value("description").alias("description"),
        F.coalesce(value("status"), F.lit("Unknown")).alias("status"), F.coalesce(value("issue_type"), F.lit("Unknown")).alias("issue_type"), value("assignee").alias("assignee"),
        labels_of(value("labels")).alias("labels"), dates.canonical(value("created_at")).alias("created_at"), dates.canonical(value("updated_at")).alias("updated_at"), fields.alias("text_fields"),
    )
    return derived(out)


def derived(issues: DataFrame) -> DataFrame:
    """Issues with their event day and full text."""
    text = tx.full_text(F.col("summary"), F.col("description"), F.col("labels"), F.col("text_fields") if "text_fields" in issues.columns else None)
    return issues.withColumn("event_day", dates.event_day(F.col("updated_at"), F.col("created_at"))).withColumn("full_text", text)
