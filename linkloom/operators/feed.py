"""The event feed of crawl jobs, over stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.history import FINISHED, pages_since_job
from linkloom.plans.ordering import SLICE, time_slice

PROGRESS = [
    "pages_found",
    "pages_crawled",
    "pages_changed",
    "pages_added",
    "pages_updated",
    "pages_removed",
    "pages_unchanged",
    "pages_skipped",
]
STATE = [*PROGRESS, "status"]

# Fixed value: silence after which a heartbeat is due.
HEARTBEAT_SECONDS = 15
SLICE_SECONDS = 3600


def page_events(pages: DataFrame) -> DataFrame:
    """Page rows in the shape of feed events."""
    return pages.select(
        "job_id",
        F.lit(0).alias("stage"),
        F.col("id").alias("page_id"),
        F.lit("page_crawled").alias("type"),
        "url",
        "title",
        "description",
        "category",
        F.round("relevance_score", 2).alias("relevance_score"),
        "depth",
    )


def event_replay(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Feed of the finished ones among the jobs passed in.

    In order of (job_id, stage, page_id): its pages, one progress event, the end.
    """
    finished = jobs.filter(F.col("status").isin(FINISHED))
    crawled = page_events(pages_since_job(pages, finished))
    progress = finished.select(
        F.col("id").alias("job_id"), F.lit(1).alias("stage"), F.lit("progress").alias("type"), *PROGRESS, "max_pages"
    )
    end = finished.select(
        F.col("id").alias("job_id"),
        F.lit(2).alias("stage"),
        F.col("status").alias("type"),
        F.when(F.col("status") == "failed", F.col("error_message")).alias("error"),
    )
    return crawled.unionByName(progress, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)


def progress_changes(rows: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Progress rows (job_id, ts, event_id, ...) that differ from the job's row before.

    Neighbours are compared inside time slices; the first row of a slice is
    compared with the last row of the job's slice before, so the longest feed is
    spread over as many tasks as it has slices.
    """
    state = F.struct(*STATE)
    sliced = rows.withColumns({SLICE: time_slice(F.col("ts"), slice_seconds), "_state": state})
    inside = Window.partitionBy("job_id", SLICE).orderBy("ts", "event_id")
    local = sliced.withColumn("_before", F.lag("_state").over(inside))
    ends = sliced.groupBy("job_id", SLICE).agg(F.max_by("_state", F.struct("ts", "event_id")).alias("_end"))
    carried = ends.select(
        "job_id", SLICE, F.lag("_end").over(Window.partitionBy("job_id").orderBy(SLICE)).alias("_carried")
    )
    before = F.coalesce("_before", "_carried")
    changed = local.join(carried, ["job_id", SLICE]).filter(~F.col("_state").eqNullSafe(before))
    return changed.select(*rows.columns)


def bucket_edges(events: DataFrame, gap: int) -> DataFrame:
    """(job_id, _bucket, _first, silent_from): first and last event of each ``gap``-long bucket.

    No silence of ``gap`` seconds can hide between them.
    """
    ts = F.col("ts").cast("timestamp")
    bucketed = events.select("job_id", "ts", F.floor(F.unix_micros(ts) / (gap * 1_000_000)).alias("_bucket"))
    return bucketed.groupBy("job_id", "_bucket").agg(F.min("ts").alias("_first"), F.max("ts").alias("silent_from"))


def silences(edges: DataFrame, gap: int) -> DataFrame:
    """Edges after which nothing comes for ``gap`` seconds, with ``silent_to`` and ``heartbeats``."""
    following = F.lead("_first").over(Window.partitionBy("job_id").orderBy("_bucket"))
    spans = edges.withColumn("silent_to", following)
    micros = F.unix_micros(F.col("silent_to").cast("timestamp")) - F.unix_micros(F.col("silent_from").cast("timestamp"))
    return spans.withColumn("heartbeats", F.floor(micros / (gap * 1_000_000))).filter("heartbeats >= 1")


def heartbeat_gaps(events: DataFrame, gap: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Silent spans of at least ``gap`` seconds between two events (job_id, ts) of a feed.

    Events are first reduced to the edges of each ``gap``-long bucket, where no
    such span can hide; only the edges are put in order.
    """
    return silences(bucket_edges(events, gap), gap).select("job_id", "silent_from", "silent_to", "heartbeats")
