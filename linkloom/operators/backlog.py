"""Read-only views of the task backlog, and what becomes of failed tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import cut

# Fixed values of the task life cycle.
CLAIMABLE = ["queued", "failed"]
RETRY_BASE_SECONDS = 15
RETRY_SPREAD = 0.2
LEASE_ERROR = "Lease expired before worker heartbeat"
NO_MESSAGE = "Unknown worker failure"


def ready_tasks(tasks: DataFrame, now: Column, n: int | None = None) -> DataFrame:
    """Tasks that could be claimed, most urgent first; the first ``n`` if given."""
    free = F.col("leased_until").isNull() | (F.col("leased_until") < now)
    ready = tasks.filter(F.col("status").isin(CLAIMABLE) & (F.col("available_at") <= now) & free)
    ordered = ready.orderBy("priority", "created_at", "id")
    return ordered.limit(n) if n else ordered


def retry_delay(attempt: Column, jitter: Column) -> Column:
    """Doubling delay in whole seconds; ``jitter`` in [0, 0.2) stretches it."""
    doubled = RETRY_BASE_SECONDS * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))
    return F.floor(doubled * (1 + jitter)).cast("bigint")


def retry_plan(
    failures: DataFrame,
    now: Column,
    jitter: Column | None = None,
    error_chars: int | None = None,
    job_error_chars: int | None = None,
) -> DataFrame:
    """What a failed attempt does to its task and to the job behind it.

    ``failures``: running tasks with the ``error`` of the attempt. Without a
    given ``jitter`` it is random. Error texts are whole unless limits are given.
    """
    jitter = F.rand() * RETRY_SPREAD if jitter is None else jitter
    dead = F.col("attempt_count") >= F.col("max_attempts")
    delay = F.when(~dead, retry_delay(F.col("attempt_count"), jitter))
    error = F.coalesce(F.nullif("error", F.lit("")), F.lit(NO_MESSAGE))
    attempt = F.concat(
        F.lit("Retrying (attempt "),
        F.col("attempt_count").cast("string"),
        F.lit("/"),
        F.col("max_attempts").cast("string"),
        F.lit("): "),
        cut(F.col("error"), job_error_chars),
    )
    return failures.select(
        "id",
        "crawl_job_id",
        F.when(dead, "dead_letter").otherwise("failed").alias("status"),
        delay.alias("retry_in_seconds"),
        cut(error, error_chars).alias("last_error"),
        F.when(~dead, "pending").alias("job_status"),
        F.when(~dead, attempt).alias("job_error"),
    ).withColumn("available_at", F.timestamp_add("SECOND", F.col("retry_in_seconds"), now))


def expired_leases(tasks: DataFrame, now: Column) -> DataFrame:
    """The task table with every expired lease given back."""
    lost = (F.col("status") == "running") & F.coalesce(F.col("leased_until") < now, F.lit(False))
    error = F.coalesce(F.nullif("last_error", F.lit("")), F.lit(LEASE_ERROR))
    return tasks.withColumn("_lost", lost).withColumns(
        {
            "status": F.when(F.col("_lost"), "failed").otherwise(F.col("status")),
            "available_at": F.when(F.col("_lost"), now).otherwise(F.col("available_at")),
            "lease_owner": F.when(~F.col("_lost"), F.col("lease_owner")),
            "leased_until": F.when(~F.col("_lost"), F.col("leased_until")),
            "last_error": F.when(F.col("_lost"), error).otherwise(F.col("last_error")),
        }
    ).drop("_lost")
