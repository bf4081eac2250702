"""Job queues as tables: enqueueing, claiming, retries, clean-up, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.functions import text as tx
from loregraph.functions.dates import retry_time

MAX_ATTEMPTS = 5
STATUSES = ["pending", "running", "done", "failed"]


def enqueue(keys: DataFrame, jobs: DataFrame, job_type: str, now: Column, block_done: bool = True) -> DataFrame:
    """New pending jobs for the keys (key) without an open one, or a done one where that blocks."""
    open_jobs = jobs.where((F.col("job_type") == job_type) & F.col("status").isin("pending", "running", *(["done"] if block_done else [])))
    fresh = keys.select("key").distinct().join(open_jobs.select("key"), "key", "left_anti")
    seed = F.concat_ws(":", F.col("key").cast("string"), F.lit(job_type), now.cast("string"))
    return fresh.select(
        tx.hashed_id("job:", seed).alias("job_id"), "key", F.lit(job_type).alias("job_type"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        F.lit(None).cast("timestamp").alias("next_retry_at"), F.lit(None).cast("string").alias("error_message"), now.alias("created_at"), now.alias("updated_at"),
    )


def due(jobs: DataFrame, now: Column, job_types: list[str] | None = None) -> DataFrame:
    rows = jobs.where((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    return rows.where(F.col("job_type").isin(*job_types)) if job_types else rows


def claim(jobs: DataFrame, now: Column, batch: int = 10, job_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(claimed jobs, all jobs after it): the longest waiting due jobs are running, with one attempt more."""
    taken = due(jobs, now, job_types).orderBy("updated_at", "job_id").limit(batch).select("job_id", F.lit(True).alias("taken"))
    rows = jobs.join(F.broadcast(taken), "job_id", "left")  # ``batch`` rows
    mine = F.coalesce("taken", F.lit(False))
    rows = rows.withColumn("status", F.when(mine, F.lit("running")).otherwise(F.col("status"))).withColumn("attempts", F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")))
    rows = rows.withColumn("updated_at", F.when(mine, now).otherwise(F.col("updated_at")))
    return rows.where(mine).drop("taken"), rows.drop("taken")


def finish(claimed: DataFrame, outcomes: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Claimed jobs after outcomes (job_id, error): done, pending with a later retry, or failed after enough attempts."""
    rows = claimed.drop("error_message").join(outcomes.select("job_id", F.substring("error", 1, 500).alias("error_message")), "job_id")
    fine, last = F.col("error_message").isNull(), F.col("attempts") >= max_attempts
    rows = rows.withColumn("status", F.when(fine, F.lit("done")).when(last, F.lit("failed")).otherwise(F.lit("pending")))
    return rows.withColumn("next_retry_at", F.when(~fine & ~last, retry_time(now, F.col("attempts")))).withColumn("updated_at", now)


def run(claimed: DataFrame, work) -> DataFrame:
    """(job_id, error) of running ``work`` (a job's dict) on each claimed job, in the tasks."""

    def each(frames):
        import pandas as pd

        for frame in frames:
            errors = []
            for job in frame.to_dict("records"):
                try:
                    work(job)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a job's failure is its outcome
                    errors.append(str(e)[:500])
            yield pd.DataFrame({"job_id": frame["job_id"], "error": pd.Series(errors, dtype=object)})

    return claimed.mapInPandas(each, "job_id string, error string")


def status_pivot(jobs: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    return jobs.groupBy("job_type").pivot("status", statuses or STATUSES).count().na.fill(0)


def clean_stale(jobs: DataFrame, now: Column, timeout_s: int) -> DataFrame:
    """Jobs that ran past the timeout are failed; of several pending ones on a path the newest stays."""
    late = (F.col("status") == "processing") & (F.unix_timestamp(now) - F.unix_timestamp("started_at") > timeout_s)
    rows = jobs.withColumn("error_message", F.when(late, F.lit("timed out")).otherwise(F.col("error_message"))).withColumn("status", F.when(late, F.lit("failed")).otherwise(F.col("status")))
    waiting = F.col("status").eqNullSafe("pending")
    newest = W.partitionBy("path").orderBy(F.desc("created_at"), "job_id")
    kept = rows.where(waiting).withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r")
    return rows.where(~waiting).unionByName(kept)


def deletion_counts(ids: DataFrame, jobs: DataFrame) -> DataFrame:
    """deleted, skipped_active, skipped_missing for ids (job_id) that are asked to go."""
    rows = ids.distinct().join(jobs.select("job_id", "status"), "job_id", "left")
    active = F.col("status").isin("pending", "running", "processing")
    return rows.agg(
        F.count_if(F.col("status").isNotNull() & ~active).alias("deleted"), F.count_if(F.coalesce(active, F.lit(False))).alias("skipped_active"), F.count_if(F.col("status").isNull()).alias("skipped_missing")
    )


def queue_report(jobs: DataFrame, now: Column, stale_minutes: int = 30) -> DataFrame:
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("updated_at")) / 60).cast("long")
    return jobs.withColumn("age", F.greatest(F.lit(0), age)).groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"), F.max("age").alias("oldest_minutes"), F.count_if((F.col("age") >= stale_minutes) & F.col("status").isin("running", "processing")).alias("stale")
    )


def enqueue_gaps(gaps: DataFrame, jobs: DataFrame, now: Column, limit: int = 100, job_type: str = "refine") -> DataFrame:
    """New jobs for the most urgent gaps (term_id, priority_score, fact_count) without an open or finished one of the type."""
    keys = gaps.orderBy(F.desc("priority_score"), "fact_count", "term_id").limit(limit).select(F.col("term_id").alias("key"))
    return enqueue(keys, jobs, job_type, now)


def with_prompts(jobs: DataFrame, prompts: DataFrame, now: Column) -> DataFrame:
    """``jobs`` with the prompts (job_id, prompt) that were sent for them, and their hashes; of a job without a new one the stored one stays."""
    held = F.col("prompt_text") if "prompt_text" in jobs.columns else F.lit(None).cast("string")
    rows = jobs.withColumn("held", held).drop("prompt_text", "prompt_hash").join(prompts.groupBy("job_id").agg(F.max("prompt").alias("sent")), "job_id", "left")
    rows = rows.withColumn("prompt_text", F.coalesce("sent", "held")).withColumn("prompt_hash", F.sha2("prompt_text", 256))
    return rows.withColumn("updated_at", F.when(F.col("sent").isNotNull(), now).otherwise(F.col("updated_at"))).drop("held", "sent")
