"""The log of long jobs: id, job_type, status, done, total, message, created_at, started_at, finished_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
FINAL = ("completed", "failed", "cancelled")
OPEN = ("pending", "running")
SHOWN = 50


def create(jobs: DataFrame, job_type: str, now: Column) -> DataFrame:
    """``jobs`` with a pending one of the next id."""
    new = jobs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select(
        "id", F.lit(job_type).alias("job_type"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("done"),
        F.lit(0).cast("long").alias("total"), F.lit(None).cast("string").alias("message"), now.alias("created_at"),
        F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    return jobs.unionByName(new)


def update(jobs: DataFrame, job_id: int, status: str, done: int, total: int, message: str | None, now: Column) -> DataFrame:
    """``jobs`` with a new status of one; running sets its start, a final status its end."""
    this = F.col("id") == job_id
    set_ = lambda name, value, when=F.lit(True): F.when(this & when, value).otherwise(F.col(name))
    return jobs.withColumns(
        {
            "status": set_("status", F.lit(status)),
            "done": set_("done", F.lit(done).cast("long")),
            "total": set_("total", F.lit(total).cast("long")),
            "message": set_("message", F.lit(message).cast("string")),
            "started_at": set_("started_at", now, F.lit(status == "running")),
            "finished_at": set_("finished_at", now, F.lit(status in FINAL)),
        }
    )


def newest(jobs: DataFrame, most: int = SHOWN) -> DataFrame:
    """The newest jobs, a page of them."""
    return jobs.orderBy(F.desc("id")).limit(most)


def latest(jobs: DataFrame, job_type: str | None = None, only_open: bool = False) -> DataFrame:
    """The newest job, of a type or not yet ended if asked; no row if there is none."""
    if job_type is not None:
        jobs = jobs.filter(F.col("job_type") == job_type)
    if only_open:
        jobs = jobs.filter(F.col("status").isin(*OPEN))
    return newest(jobs, 1)


def heal(jobs: DataFrame, job_type: str, running: bool, now: Column) -> DataFrame:
    """Jobs of a type that are logged as open but that nothing runs any more have failed."""
    stuck = (F.col("job_type") == job_type) & F.col("status").isin(*OPEN) & F.lit(not running)
    out = jobs.withColumn("finished_at", F.when(stuck, now).otherwise(F.col("finished_at")))
    out = out.withColumn("message", F.when(stuck, F.lit("interrupted")).otherwise(F.col("message")))
    return out.withColumn("status", F.when(stuck, F.lit("failed")).otherwise(F.col("status")))
