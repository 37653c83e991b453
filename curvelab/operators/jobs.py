"""Extraction jobs as a table of states: append, latest, list, count, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values
STATUSES = ("pending", "processing", "completed", "failed")


def latest(events: DataFrame) -> DataFrame:
    """The newest state of each job (job_id, status, updated_at, ...)."""
    rest = [c for c in events.columns if c != "job_id"]
    newest = events.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "status")).alias("s"))
    return newest.select("job_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def without(jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """The jobs that no tombstone names."""
    return jobs.join(deleted.select("job_id"), "job_id", "left_anti")


def get(jobs: DataFrame, job_id) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def recent(jobs: DataFrame, limit: int = 10, status: str | None = None) -> DataFrame:
    """The newest jobs, and how many there are in all (after the filter, before the limit)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if status is not None and status not in STATUSES:
        raise ValueError(f"status is one of {', '.join(STATUSES)}")
    chosen = jobs if status is None else jobs.where(F.col("status") == status)
    total = chosen.agg(F.count(F.lit(1))).scalar()
    return chosen.orderBy(F.desc("created_at"), "job_id").limit(limit).withColumn("total", total)


def status_counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs per status and in all."""
    return jobs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def elapsed_ms(started, ended):
    return F.timestamp_diff("MILLISECOND", started, ended)


def advance(events: DataFrame, job_id: str, status: str, error: str | None = None) -> DataFrame:
    """``events`` with one more state of a job."""
    if status not in STATUSES:
        raise ValueError(f"status is one of {', '.join(STATUSES)}")
    base = latest(get(events, job_id)).withColumn("status", F.lit(status)).withColumn("updated_at", F.current_timestamp().cast(events.schema["updated_at"].dataType))
    if "error_message" in events.columns:
        base = base.withColumn("error_message", F.lit(error))
    return events.unionByName(base)
