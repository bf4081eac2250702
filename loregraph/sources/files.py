"""Markdown, ontology, PDF and YAML files, and text sinks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the Markdown files below a folder."""
    return _texts(spark, path, "*.md")


def read_ontologies(spark: SparkSession, path: str) -> DataFrame:
    return _texts(spark, path, "*.{owl,rdf,ttl,n3,jsonld}")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return _texts(spark, path, "*.json")


def read_yaml_as_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of YAML files; broken ones give null."""

    @F.pandas_udf("string")
    def to_json(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(t):
            try:
                return json.dumps(yaml.safe_load(t), ensure_ascii=False, default=str)
            except yaml.YAMLError:
                return None

        return texts.map(one)

    return _texts(spark, path, "*.{yaml,yml}").select("path", to_json("text").alias("json"))


def page_text(pages: list[str]) -> str:
    """Pages with text under numbered headings."""
    return "\n\n".join(f"## Page {i}\n\n{p.strip()}" for i, p in enumerate(pages, 1) if p and p.strip())


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text, pages, error): ``extract`` gives the texts of a file's pages; its errors and files without text are errors of their rows."""

    def run(frames):
        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    text = page_text(extract(bytes(content)))
                    rows.append((p, text or None, text.count("## Page "), None if text else "no extractable text"))
                except Exception as e:  # noqa: BLE001  a broken file is reported, not raised
                    rows.append((p, None, 0, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").dropDuplicates(["path"]).mapInPandas(run, "path string, text string, pages long, error string")


def page_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.startswith("## Page")))


def pdf_source_id(path: Column, root: str) -> Column:
    return F.concat(F.lit("pdf:"), F.regexp_replace(path, f"^(file:)?/*{root.strip('/')}/", ""))


def write_lines(lines: DataFrame, path: str, order: list[str], column: str = "line") -> None:
    """Lines as text files, in order over the files."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.text(path)


def bundle(blocks: DataFrame) -> DataFrame:
    """(path, json): the blocks of each file as one JSON text."""
    items = F.array_sort(F.collect_list(F.struct("order_index", "block_id", "block_type", "heading_path", "content")))
    return blocks.groupBy("path").agg(items.alias("blocks")).select("path", F.to_json(F.struct("path", "blocks")).alias("json"))


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, markdown) of conversations (conv_id, turn, role, text)."""
    part = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"])
    return turns.groupBy("conv_id").agg(F.array_join(parts, "\n\n").alias("markdown"))
