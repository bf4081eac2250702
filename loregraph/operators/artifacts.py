"""Learning artifacts as rows: flashcards, glossary, quiz, summary note, study guide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.functions import text as tx

# Block types that no artifact uses, and sizes of each kind: most rows, least characters, characters shown.
IGNORED = ("semantic_reference", "quiz_option")
SIZES = {"quiz": (8, 40, 180), "flashcards": (12, 20, 260), "summary": (6, 20, 220), "glossary": (12, 12, 200), "study_guide": (8, 20, 180)}


def usable(records: DataFrame, least: int, record_limit: int | None = None) -> DataFrame:
    """Records (source_id, block_id, block_type, title, path, content, order_index) fit for an artifact, with their label and place ``n`` in the source."""
    order = W.partitionBy("source_id").orderBy("order_index", "block_id")
    if record_limit:
        records = records.withColumn("n", F.row_number().over(order)).where(F.col("n") <= record_limit)
    rows = records.where(~F.col("block_type").isin(*IGNORED) & (F.length(F.trim("content")) >= least))
    empty = F.lit("")
    label = F.coalesce(F.nullif("title", empty), F.nullif("path", empty), F.col("block_type"))
    return rows.withColumn("label", label).withColumn("n", F.row_number().over(order))


def _shown(kind: str) -> Column:
    return tx.snippet(F.col("content"), SIZES[kind][2])


def flashcards(records: DataFrame) -> DataFrame:
    most, least, _ = SIZES["flashcards"]
    rows = usable(records, least).where(F.col("n") <= most)
    return rows.select("source_id", F.concat(F.lit("card_"), "n").alias("card_id"), F.col("label").alias("front"), _shown("flashcards").alias("back"), "block_id")


def summary_note(records: DataFrame) -> DataFrame:
    most, least, _ = SIZES["summary"]
    rows = usable(records, least).where(F.col("n") <= most)
    return rows.select("source_id", F.col("n").cast("long").alias("section"), F.col("label").alias("title"), _shown("summary").alias("summary"), "block_id")


def glossary(records: DataFrame) -> DataFrame:
    """Frequencies count a label over all usable records of its source, also those that are not shown."""
    most, least, _ = SIZES["glossary"]
    rows = usable(records, least).withColumn("frequency", F.count(F.lit(1)).over(W.partitionBy("source_id", "label"))).where(F.col("n") <= most)
    return rows.select("source_id", F.col("n").cast("long").alias("entry"), F.col("label").alias("term"), _shown("glossary").alias("definition"), "frequency", "block_id")


def study_guide(records: DataFrame) -> DataFrame:
    most, least, _ = SIZES["study_guide"]
    rows = usable(records, least).where(F.col("n") <= most)
    prompt = F.concat(F.lit("Erkläre "), "label", F.lit(" in eigenen Worten."))
    return rows.select("source_id", F.col("n").cast("long").alias("item"), F.col("label").alias("topic"), _shown("study_guide").alias("focus"), prompt.alias("prompt"), "block_id")


def quiz(records: DataFrame) -> DataFrame:
    """Question rows; option A is right, the others are the first three other labels of the source."""
    most, least, _ = SIZES["quiz"]
    rows = usable(records, least)
    pool = rows.groupBy("source_id", "label").agg(F.min("n").alias("first"))
    few = pool.withColumn("r", F.row_number().over(W.partitionBy("source_id").orderBy("first"))).where("r <= 4")
    few = few.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]).alias("pool"))
    rows = rows.where(F.col("n") <= most).join(few, "source_id")
    others = F.slice(F.filter("pool", lambda x: x != F.col("label")), 1, 3)
    return rows.select(
        "source_id", F.concat(F.lit("q_"), "n").alias("question_id"), _shown("quiz").alias("question"), F.lit("A").alias("correct_option_id"),
        F.concat(F.array("label"), others).alias("options"), F.concat(F.lit("Der Inhalt stammt aus '"), "label", F.lit("'.")).alias("explanation"), "block_id",
    )


def every(records: DataFrame) -> dict[str, DataFrame]:
    return {"quiz": quiz(records), "flashcards": flashcards(records), "summary": summary_note(records), "glossary": glossary(records), "study_guide": study_guide(records)}


def as_json(rows: DataFrame, kind: str) -> DataFrame:
    """One artifact per source: artifact_id, artifact_type, source_id, source_block_ids, content (JSON)."""
    items = F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "source_id"])))
    out = rows.groupBy("source_id").agg(items.alias("items"))
    return out.select(
        F.concat(F.lit(f"artifact:{kind}:"), tx.file_suffix(F.col("source_id").cast("string"), kind)).alias("artifact_id"), F.lit(kind).alias("artifact_type"), "source_id",
        F.transform("items", lambda x: x["block_id"]).alias("source_block_ids"), F.to_json(F.struct("items")).alias("content"),
    )
