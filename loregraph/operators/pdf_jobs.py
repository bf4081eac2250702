"""Imports of PDF files as rows that change state: pending, processing, done or failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions import text as tx
from loregraph.operators import artifacts, blocks
from loregraph.operators.store import settled

#: What a job row has.
SCHEMA = (
    "job_id string, pdf_path string, domain string, status string, pages_total int, pages_processed int, error_message string, source_id string, artifact_id string, "
    "content_preview string, result_json string, created_at timestamp, started_at timestamp, completed_at timestamp"
)


def job_id(domain: Column, path: Column) -> Column:
    return F.concat(F.lit("pdf_"), F.substring(F.sha1(F.concat_ws(":", domain, path)), 1, 16))


def create(files: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """All jobs after those for ``files`` (pdf_path, domain, pages_total) are asked for.

    A file has one job in a domain. One that waits or runs stays as it is; one that has ended starts anew.
    """
    domain = F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.lit("default"))
    wanted = files.select("pdf_path", domain.alias("domain"), F.coalesce("pages_total", F.lit(0)).alias("pages_total")).groupBy("pdf_path", "domain").agg(F.max("pages_total").alias("pages_total"))
    wanted = wanted.withColumn("job_id", job_id(F.col("domain"), F.col("pdf_path")))
    active = jobs.where(F.col("status").isin("pending", "processing")).select("job_id")
    fresh = wanted.join(active, "job_id", "left_anti").withColumn("status", F.lit("pending")).withColumn("pages_processed", F.lit(0)).withColumn("created_at", now)
    return jobs.join(fresh.select("job_id"), "job_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def _changed(jobs: DataFrame, changes: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``jobs`` with new values in the rows that ``changes`` (job_id, ...) names."""
    own = changes.select(F.col("job_id"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in changes.columns if c != "job_id"])
    rows = jobs.join(own, "job_id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    return rows.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in columns.items()}).select(*jobs.columns)


def start(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return _changed(jobs, ids.select("job_id"), {"status": F.lit("processing"), "started_at": now})


def progress(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages``: job_id, pages_processed."""
    return _changed(jobs, pages.select("job_id", "pages_processed"), {"pages_processed": F.col("__pages_processed")})


def complete(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return _changed(jobs, ids.select("job_id"), {"status": F.lit("done"), "completed_at": now})


def fail(jobs: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """``errors``: job_id, error_message."""
    return _changed(jobs, errors.select("job_id", "error_message"), {"status": F.lit("failed"), "error_message": F.col("__error_message"), "completed_at": now})


def results(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """``found``: job_id, source_id, artifact_id, content_preview, result_json; what is null there stays."""
    names = ["source_id", "artifact_id", "content_preview", "result_json"]
    return _changed(jobs, found.select("job_id", *names), {n: F.coalesce(F.col(f"__{n}"), F.col(n)) for n in names})


#: Characters of a text that a job shows.
PREVIEW = 1800
#: Errors of jobs whose pages hold nothing.
NO_TEXT, NO_BLOCKS = "PDF contains no extractable text", "PDF produced no knowledge blocks"


def texts_of(pages: DataFrame) -> DataFrame:
    """(job_id, n, first_error, text) of pages (job_id, page, text, error): pages read, the first error, and the texts under their pages' headings."""
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("page", "error")))
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "^\\s+|\\s+$", "")
    parts = F.filter(F.array_sort(F.collect_list(F.struct("page", clean.alias("text")))), lambda x: x["text"] != "")
    text = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("## Page "), x["page"], F.lit("\n\n"), x["text"])), "\n\n")
    return pages.groupBy("job_id").agg(F.count_if(F.col("error").isNull()).cast("int").alias("n"), first.alias("first"), text.alias("text")).select("job_id", "n", F.col("first.error").alias("first_error"), "text")


def process(jobs: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Running jobs after their pages (job_id, page, text, error) were read: done with their text's start, or failed with the first error."""
    read = texts_of(pages).withColumn("preview", F.substring(tx.squeeze(F.col("text")), 1, PREVIEW))
    bad = F.col("__first_error").isNotNull()
    return _changed(
        jobs, read.select("job_id", "n", "first_error", "preview"),
        {"pages_processed": F.col("__n"), "status": F.when(bad, "failed").otherwise("done"), "error_message": F.col("__first_error"), "content_preview": F.col("__preview"), "completed_at": now},
    )


def import_text(jobs: DataFrame, pages: DataFrame, now: Column, root: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, blocks, summary notes) after the pages of running jobs were read and imported.

    A job's text becomes blocks of its source, and these a summary note, where they are long enough for one. The job is done with its source, note,
    preview and a report as JSON; it fails with the first error of a page, without any text, or without a block.
    """
    source = F.concat_ws("/", F.lit("pdf:") if not root else F.lit(f"pdf:{root.strip('/')}"), "domain", F.substring_index("pdf_path", "/", -1))
    known = jobs.where(F.col("status") == "processing").select("job_id", "pdf_path", F.regexp_replace(source, "^pdf:/", "pdf:").alias("source_id"))
    # jobs whose files have no page at all fail as well
    read = settled(known.join(texts_of(pages), "job_id", "left"))
    blank = F.coalesce(F.length(F.trim(F.regexp_replace("text", "(?m)^## Page [0-9]+$", ""))), F.lit(0)) == 0
    sound = read.where(F.col("first_error").isNull() & ~blank)
    parsed = blocks.parse_markdown(sound.select(F.col("source_id").alias("path"), "text"))
    title = F.substring_index("heading_path", " / ", -1)
    made = settled(parsed.withColumn("source_id", F.col("path")).withColumn("source_type", F.lit("pdf")).withColumn("title", title))
    notes = settled(artifacts.as_json(artifacts.summary_note(made), "summary_note"))
    counts = made.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    found = read.join(counts, "source_id", "left").join(notes.select("source_id", "artifact_id"), "source_id", "left").withColumn("blank", blank)
    error = F.when(F.col("first_error").isNotNull(), F.col("first_error")).when(F.col("blank"), F.lit(NO_TEXT)).when(F.col("n_blocks").isNull(), F.lit(NO_BLOCKS))
    found = found.withColumn("error", error).withColumn("n", F.coalesce("n", F.lit(0)))
    report = F.to_json(F.struct("job_id", F.lit("done").alias("status"), F.col("n").alias("pages"), F.length("text").alias("text_length"), F.col("pdf_path").alias("file"), F.col("n_blocks").alias("blocks_imported"), "source_id", "artifact_id"))
    fine = F.col("error").isNull()
    found = found.select(
        "job_id", "n", "error", *[F.when(fine, c).alias(a) for c, a in ((F.col("source_id"), "source_id"), (F.col("artifact_id"), "artifact_id"), (F.substring(tx.squeeze(F.col("text")), 1, PREVIEW), "preview"), (report, "report"))]
    )
    done = F.col("__error").isNull()
    after = _changed(
        jobs, found,
        {
            "pages_processed": F.col("__n"), "status": F.when(done, "done").otherwise("failed"), "error_message": F.substring("__error", 1, 500), "completed_at": now,
            "source_id": F.coalesce("__source_id", "source_id"), "artifact_id": F.coalesce("__artifact_id", "artifact_id"), "content_preview": F.coalesce("__preview", "content_preview"), "result_json": F.coalesce("__report", "result_json"),
        },
    )
    return after, made, notes


def clean_up(jobs: DataFrame, now: Column, timeout_s: int = 600, domain: str | None = None) -> DataFrame:
    """Jobs that ran past the timeout failed; of several open jobs of a file in the domain the newest stays."""
    late = (F.col("status") == "processing") & (F.unix_timestamp(now) - F.unix_timestamp("started_at") > max(0, timeout_s))
    rows = jobs.withColumn("__late", F.coalesce(late, F.lit(False)))
    rows = rows.withColumn("error_message", F.when(F.col("__late"), F.lit(f"Timed out after {max(0, timeout_s)}s")).otherwise(F.col("error_message")))
    rows = rows.withColumn("completed_at", F.when(F.col("__late"), now).otherwise(F.col("completed_at"))).withColumn("status", F.when(F.col("__late"), "failed").otherwise(F.col("status"))).drop("__late")
    if not domain:
        return rows
    opened = F.coalesce((F.col("domain") == domain) & F.col("status").isin("pending", "processing"), F.lit(False))
    newest = Window.partitionBy("pdf_path").orderBy(F.desc("created_at"), "job_id")
    kept = rows.where(opened).withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")
    return rows.where(~opened).unionByName(kept)


def process_pending(jobs: DataFrame, read: Callable[[DataFrame], DataFrame], now: Column, timeout_s: int = 600, domain: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(jobs, blocks, summary notes, counts) after a clean-up and the import of every job that waits, of one domain if given.

    ``read`` gives the pages (job_id, page, text, error) of jobs. Counts are one row: claimed, done, failed, timed_out, total_pending.
    """
    cleaned = settled(clean_up(jobs, now, timeout_s, domain))
    mine = F.col("status") == "pending"
    waiting = settled(cleaned.where(mine & (F.col("domain") == domain) if domain else mine))
    late = cleaned.where("status = 'failed'").join(jobs.where("status = 'processing'").select("job_id"), "job_id", "left_semi").agg(F.count(F.lit(1)).alias("timed_out"))
    running = start(waiting, waiting, now)
    after, made, notes = import_text(running, read(running), now)
    after = settled(after)
    counts = after.agg(F.count(F.lit(1)).alias("claimed"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total_pending"))
    rest = cleaned.join(waiting.select("job_id"), "job_id", "left_anti")
    return rest.unionByName(after), made, notes, counts.crossJoin(F.broadcast(late))  # one row each


def listed(jobs: DataFrame, domain: str | None = None, status: str | None = None) -> DataFrame:
    for name, value in (("domain", domain), ("status", status)):
        if value:
            jobs = jobs.where(F.col(name) == value)
    return jobs.orderBy(F.desc("created_at"), "job_id")
