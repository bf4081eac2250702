"""Claims on jobs as an append-only table: nobody updates a row, and what a claim is worth is decided on reading.

A worker appends claims (``asked``), lets ``settle`` seconds pass, reads the table and works on what it was granted. Of the
claims on an attempt of a job the first is granted, and a later one only once the lease of the last grant has
run out. Every reader that sees the same claims grants the same, so two workers never hold one job, if a claim
is readable ``settle`` seconds after the time that it carries; that has to cover a write and the difference of clocks. A
worker whose write took longer has to leave its claims alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import text as tx
from loregraph.operators.jobs import due

SCHEMA = "job_id string, attempt int, claimer string, claimed_at timestamp, claim_id string"
LEASE_S, SETTLE_S = 600, 30


def _ago(now: Column, seconds: int) -> Column:
    return now - F.make_dt_interval(secs=F.lit(seconds))


def grants(claims: DataFrame, lease_s: int = LEASE_S) -> DataFrame:
    """(job_id, attempt, claimer, claimed_at, claim_id): the claims that hold or held, in turn, each attempt of a job.

    Claims are taken by time, then id, repeated rows as one; each is granted that comes ``lease_s`` seconds or more after the last grant.
    """
    ordered = F.array_sort(F.collect_set(F.struct("claimed_at", "claim_id", "claimer")))
    free = lambda held, c: (F.size(held) == 0) | (F.element_at(held, -1)["claimed_at"] <= _ago(c["claimed_at"], lease_s))
    none = F.slice("claims", 1, 0)
    granted = F.aggregate("claims", none, lambda held, c: F.when(free(held, c), F.concat(held, F.array(c))).otherwise(held))
    rows = claims.where("claimed_at IS NOT NULL").groupBy("job_id", "attempt").agg(ordered.alias("claims"))
    return rows.select("job_id", "attempt", F.inline(granted)).select("job_id", "attempt", "claimer", "claimed_at", "claim_id")


def live(claims: DataFrame, now: Column, lease_s: int = LEASE_S) -> DataFrame:
    """The grants whose lease has not run out."""
    return grants(claims, lease_s).where(F.col("claimed_at") > _ago(now, lease_s))


def held(claims: DataFrame, claimer: str, now: Column, settle_s: int = SETTLE_S, lease_s: int = LEASE_S) -> DataFrame:
    """What a claimer may work on now."""
    return live(claims, now, lease_s).where((F.col("claimer") == claimer) & (F.col("claimed_at") <= _ago(now, settle_s)))


def asked(jobs: DataFrame, claims: DataFrame, claimer: str, now: Column, batch: int = 10, job_types: list[str] | None = None, lease_s: int = LEASE_S) -> DataFrame:
    """Claims to append: of the longest waiting due jobs that nobody holds, ``batch``."""
    attempt = (F.col("attempts") + 1).cast("int").alias("attempt")
    taken = live(claims, now, lease_s).select("job_id", "attempt")
    rows = due(jobs, now, job_types).select("job_id", attempt, "updated_at").join(taken, ["job_id", "attempt"], "left_anti")
    rows = rows.orderBy("updated_at", "job_id").limit(batch)
    seed = F.concat_ws(":", "job_id", F.col("attempt").cast("string"), F.lit(claimer), now.cast("string"))
    return rows.select("job_id", "attempt", F.lit(claimer).alias("claimer"), now.alias("claimed_at"), tx.hashed_id("claim:", seed).alias("claim_id"))


def with_claims(jobs: DataFrame, claims: DataFrame, now: Column, lease_s: int = LEASE_S) -> DataFrame:
    """``jobs`` as they are with their live claims: a held pending job runs, with one attempt more and its claimer."""
    own = live(claims, now, lease_s).select("job_id", (F.col("attempt") - 1).alias("attempts"), "claimer", F.col("claimed_at").alias("__at"))
    rows = jobs.join(own, ["job_id", "attempts"], "left")
    mine = F.col("__at").isNotNull() & (F.col("status") == "pending")
    rows = rows.withColumn("claimer", F.when(mine, F.col("claimer")))
    return rows.select(
        *[
            F.when(mine, F.lit("running")).otherwise(F.col(c)).alias(c) if c == "status"
            else F.when(mine, F.col(c) + 1).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c == "attempts"
            else F.when(mine, F.col("__at")).otherwise(F.col(c)).alias(c) if c == "updated_at"
            else F.col(c)
            for c in [*jobs.columns, "claimer"]
        ]
    )
