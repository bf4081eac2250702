"""Ontology concepts: parsing of JSON-LD, RDF/XML and Turtle, ranking, selection, import."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.functions import text as tx
from loregraph.operators import turtle

CONCEPTS = "path string, pos int, concept_id string, label string, definition string, relations array<struct<name:string,target:string>>"

#: Rows of concepts that a task hands on at once.
CONCEPT_ROWS = 1_000

# Local names that hold labels and definitions, and elements that are concepts.
LABELS, DEFINITIONS = ("label", "prefLabel", "name", "title"), ("definition", "comment", "description", "scopeNote")
ELEMENTS = ("class", "concept", "description", "namedindividual")
# Types whose members are concepts whatever else is said of them, and starts of whole ids.
TYPES, WHOLE_IDS = ("Class", "Concept", "UcoObject"), ("http://", "https://", "urn:")


def _tail(name: str) -> str:
    return re.split(r"[#/:}]", name)[-1]


def _plain(value) -> str:
    if isinstance(value, list):
        return next((t for t in map(_plain, value) if t), "")
    if isinstance(value, dict):
        return next((t for t in (_plain(value.get(k)) for k in ("@value", "value", "text", "@id", "id")) if t), "")
    return "" if value is None else str(value).strip()


def _json_ld(text: str) -> Iterator[dict]:
    data = json.loads(text)
    if isinstance(data, dict):
        data = data["@graph"] if isinstance(data.get("@graph"), list) else [data]
    for node in data:
        if not isinstance(node, dict):
            continue
        own = {"id": _plain(node.get("@id") or node.get("id")), "label": "", "definition": "", "relations": []}
        for key, value in node.items():
            name = _tail(key)
            if name in LABELS:
                own["label"] = own["label"] or _plain(value)
            elif name in DEFINITIONS:
                own["definition"] = own["definition"] or _plain(value)
            elif not key.startswith("@") and key != "id":
                for v in value if isinstance(value, list) else [value]:
                    if isinstance(v, dict) and _plain(v.get("@id") or v.get("id")):
                        own["relations"].append((name, _plain(v.get("@id") or v.get("id"))))
        yield own


def _rdf_xml(text: str) -> Iterator[dict]:
    for node in ElementTree.fromstring(text).iter():
        if _tail(node.tag).lower() not in ELEMENTS:
            continue
        about = {_tail(k): v for k, v in node.attrib.items()}
        own = {"id": about.get("about") or about.get("ID") or "", "label": "", "definition": "", "relations": []}
        for part in node:
            name, target = _tail(part.tag), {_tail(k): v for k, v in part.attrib.items()}.get("resource")
            if name in LABELS:
                own["label"] = own["label"] or (part.text or "").strip()
            elif name in DEFINITIONS:
                own["definition"] = own["definition"] or (part.text or "").strip()
            elif target:
                own["relations"].append((name, target))
        yield own


def _turtle(text: str) -> Iterator[dict]:
    """Subjects in the order in which they are first spoken of; what a blank node says is its own, not that of the node that names it."""
    concepts: dict[str, dict] = {}
    for subject, predicate, (value, literal) in turtle.Reader(text).triples():
        own = concepts.setdefault(subject, {"id": subject, "label": "", "definition": "", "relations": [], "typed": False})
        verb = _tail(predicate)
        if verb in LABELS:
            own["label"] = own["label"] or (value.strip() if literal else "")
        elif verb in DEFINITIONS:
            own["definition"] = own["definition"] or (value.strip() if literal else "")
        elif verb == "type":
            own["typed"] = own["typed"] or _tail(value) in TYPES
        elif not literal:
            own["relations"].append((verb, value))
    yield from concepts.values()


def concepts_of(text: str | None) -> list[dict]:
    """Concepts of one document; the format is told by its start, and broken XML is tried as Turtle."""
    t = (text or "").strip()
    if not t:
        return []
    try:
        if t[0] in "{[":
            return [c for c in _json_ld(t) if c["id"]]
        if t[0] == "<" and not re.match(r"<[^>\s]*://[^>]*>\s", t):
            return [c for c in _rdf_xml(t) if c["id"]]
    except ElementTree.ParseError:
        pass
    except (ValueError, RecursionError):
        return []
    try:
        return [c for c in _turtle(t) if c["id"].startswith(WHOLE_IDS) and (c["label"] or c["definition"] or c["relations"] or c["typed"])]
    except (ValueError, RecursionError):
        return []


def parse(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Concept rows (CONCEPTS) of documents; broken documents have none. A task holds a document's concepts and a few more at a time."""

    columns = ["path", "pos", "concept_id", "label", "definition", "relations"]

    def run(frames):
        rows = []
        for frame in frames:
            for p, t0 in zip(frame["path"], frame["text"], strict=True):
                for i, c in enumerate(concepts_of(t0)):
                    rows.append((p, i, c["id"], c["label"] or _tail(c["id"]), c["definition"], [{"name": n, "target": t} for n, t in c["relations"]]))
                    if len(rows) == CONCEPT_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, CONCEPTS)


def quality(label: Column, definition: Column, relations: Column) -> Column:
    n = F.length(F.trim(F.coalesce(definition, F.lit(""))))
    return (
        F.when(F.trim(F.coalesce(label, F.lit(""))) != "", 2).otherwise(0) + F.when(n >= 60, 2).when(n >= 20, 1).otherwise(0) + F.least(F.coalesce(F.size(relations), F.lit(0)), F.lit(4))
    ).cast("long")


def ranked(concepts: DataFrame) -> DataFrame:
    """Concepts with their quality; of several of one id in a document the best, then the first, stays."""
    rows = concepts.withColumn("quality", quality(F.col("label"), F.col("definition"), F.col("relations")))
    best = W.partitionBy("path", "concept_id").orderBy(F.desc("quality"), "pos")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def select(concepts: DataFrame, focus: list[str] | None = None, top_n: int = 50) -> DataFrame:
    """The best concepts of each document with their rank; those that hold a focus term come first."""
    hay = F.lower(F.concat_ws(" ", "concept_id", "label", "definition"))
    hit = F.lit(False)
    for term in focus or []:
        hit = hit | hay.contains(term.lower())
    order = W.partitionBy("path").orderBy(F.desc("focused"), F.desc("quality"), "pos")
    rows = ranked(concepts).withColumn("focused", hit).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= top_n)


def records(selected: DataFrame) -> DataFrame:
    """source_id, block_id, title, content of selected concepts."""
    source = F.concat(F.lit("owl:"), F.regexp_replace("path", "[^A-Za-z0-9._-]+", "-"))
    return selected.select(source.alias("source_id"), F.concat(source, F.lit(":"), "concept_id").alias("block_id"), F.lit("ontology_concept").alias("block_type"), F.col("label").alias("title"), F.concat_ws("\n", "label", "definition").alias("content"), F.col("rank").alias("order_index"))


def relations(selected: DataFrame) -> DataFrame:
    """Relations between two different selected concepts of a document, by id or by the end of an id."""
    rows = selected.select("path", F.col("concept_id").alias("src"), F.explode("relations").alias("x"))
    targets = selected.select("path", F.col("concept_id").alias("dst"), tx.id_tail(F.col("concept_id")).alias("tail"))
    rows = rows.select("path", "src", F.col("x.name").alias("relation"), tx.id_tail(F.col("x.target")).alias("tail"))
    return rows.join(targets, ["path", "tail"]).where("src != dst").select("path", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), "relation").distinct()


def markdown(selected: DataFrame) -> DataFrame:
    """One Markdown text per document with its ranked concepts as numbered headings."""
    part = F.concat(F.lit("## "), F.col("rank"), F.lit(". "), F.col("label"), F.lit("\n\n"), F.coalesce("definition", F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"])
    return selected.groupBy("path").agg(F.array_join(parts, "\n\n").alias("markdown"))


def concept_graph(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of concepts: edges between known concepts of a document by their whole ids, to themselves as well."""
    rows = ranked(concepts)
    label = F.when(F.trim("label") != "", F.col("label")).otherwise(F.col("concept_id"))
    nodes = rows.select("path", F.col("concept_id").alias("node_id"), F.lit("ontology_concept").alias("node_type"), label.alias("label"), "quality")
    links = rows.select("path", F.col("concept_id").alias("src_id"), F.explode("relations").alias("x"))
    links = links.select("path", "src_id", F.trim("x.target").alias("dst_id"), F.substring_index("x.name", ":", -1).alias("relation")).where("relation != ''")
    edges = links.join(nodes.select("path", F.col("node_id").alias("dst_id")), ["path", "dst_id"]).select("path", "src_id", "dst_id", "relation", F.lit(1.0).alias("weight")).distinct()
    return nodes, edges
