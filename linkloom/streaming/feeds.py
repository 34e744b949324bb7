"""The live feeds of crawl jobs as Structured Streaming queries.

Feeds that only drop repeats keep their keys in the engine's state store. Feeds that compare a
row with the one before are batch operators run on every micro-batch together with what is known of
the jobs (``runner.folded``): a job's rows are spread over tasks as in batch, whatever their
number, and what is known is one row a job that has not ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.feed import HEARTBEAT_SECONDS, STATE, bucket_edges, progress_changes, silences
from linkloom.operators.fetchlog import fetch_counts
from linkloom.operators.history import FINISHED
from linkloom.operators.schedule import idempotency_key
from linkloom.operators.snapshot import KEY, arrival_changes

#: How long a key is remembered after it came first, by the clock of the stream.
REMEMBERED = "7 days"
#: Sites of a micro-batch named one by one in the read of the stored pages; more are read as a range.
NAMED_SITES = 1000


Step = Callable[[DataFrame, "DataFrame | None"], "DataFrame | tuple[DataFrame, DataFrame]"]


def _first_per(stream: DataFrame, keys: list[str], remembered: str | None) -> DataFrame:
    """First row of each key. Event time is the time of arrival, so no row is ever too late:
    what ends after ``remembered`` is the memory of a key, and with it its state."""
    if remembered is None:
        return stream.dropDuplicates(keys)
    arriving = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remembered)
    return arriving.dropDuplicatesWithinWatermark(keys).drop("_arrived")


def page_feed(pages: DataFrame, remembered: str | None = REMEMBERED) -> DataFrame:
    """Each page of a job once, however late it comes.

    A page is forgotten ``remembered`` after it came first, longer than a job takes;
    None never forgets. A page that comes again after that is shown again; none is lost.
    """
    return _first_per(pages, ["job_id", "url"], remembered)


def enqueue_dedup(triggers: DataFrame, remembered: str | None = REMEMBERED) -> DataFrame:
    """One accepted trigger (site_id, ts) per site and minute; ``remembered`` as in ``page_feed``."""
    keyed = triggers.withColumn("idempotency_key", idempotency_key(F.col("site_id"), F.col("ts")))
    return _first_per(keyed, ["idempotency_key"], remembered)


def heartbeat_step(gap: int = HEARTBEAT_SECONDS, ended: Column | None = None) -> Step:
    """Step of ``runner.folded`` over events (job_id, ts) ->
    (job_id, silent_from, silent_to, heartbeats): a beat for each ``gap`` seconds without one.

    Rows without a job are ticks of the clock. The feed beats while a silence lasts, at
    the last tick of a micro-batch: such a row has no ``silent_to``, and its beats are not reported again
    when an event ends the silence. Without ticks a silence is reported at its end. ``ended`` says
    of an event that it is its job's last; the job is forgotten with it. Events older than what is known
    of their job change nothing. Only the edges of ``gap``-long buckets are put in order.
    """
    micros_of_gap = gap * 1_000_000

    def micros(value: str | Column) -> Column:
        return F.unix_micros((F.col(value) if isinstance(value, str) else value).cast("timestamp"))

    def step(batch: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        now = batch.filter("job_id IS NULL").agg(F.max("ts")).first()[0]
        events = batch.filter("job_id IS NOT NULL")
        edges = bucket_edges(events, gap).withColumn("sent", F.lit(0).cast("long"))
        if known is not None:
            # What is known of a job is an edge like any other: its last event, and the beats sent since.
            last = F.col("last")
            edges = edges.join(known.select("job_id", "last"), "job_id", "left").filter(last.isNull() | (F.col("silent_from") >= last))
            bucket = F.floor(micros("last") / micros_of_gap).alias("_bucket")
            before = known.select("job_id", bucket, last.alias("_first"), last.alias("silent_from"), "sent")
            edges = edges.drop("last").unionByName(before).groupBy("job_id", "_bucket").agg(
                F.min("_first").alias("_first"),
                F.max_by("sent", F.struct("silent_from", "sent")).alias("sent"),
                F.max("silent_from").alias("silent_from"),
            )
        over = silences(edges, gap).withColumn("heartbeats", F.col("heartbeats") - F.col("sent"))
        last = edges.groupBy("job_id").agg(F.max("silent_from").alias("last"), F.max_by("sent", "silent_from").alias("sent"))
        if ended is not None:
            last = last.join(events.filter(ended).select("job_id").distinct(), "job_id", "left_anti")
        waited = F.floor((micros(F.lit(now)) - micros("last")) / micros_of_gap)
        last = last.withColumn("_due", F.greatest(F.coalesce(waited, F.lit(0)) - F.col("sent"), F.lit(0)))
        open_ = last.select("job_id", F.col("last").alias("silent_from"), F.lit(None).cast("timestamp").alias("silent_to"), F.col("_due").alias("heartbeats"))
        results = over.select(*open_.columns).unionByName(open_).filter("heartbeats > 0")
        return results, last.select("job_id", "last", (F.col("sent") + F.col("_due")).alias("sent"))

    return step


def fetch_health_feed(log: DataFrame) -> DataFrame:
    """Requests, timeouts and successes per host so far; run it in update mode."""
    return fetch_counts(log)


def newest_per_key(results: DataFrame, keys: list[str]) -> DataFrame:
    """Current value of each key from the batches of an update-mode query."""
    rest = [c for c in results.columns if c not in (*keys, "batch")]
    latest = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v"))
    return latest.select(*keys, "_v.*")


def progress_step(batch: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Step of ``runner.folded``: progress rows (job_id, ts, event_id, ...) that differ from the
    job's row before, across micro-batches. A job is forgotten with its end."""
    rows = batch.withColumn("_known", F.lit(False))
    if known is not None:
        # What is known of a job stands before all that came.
        first = known.withColumns({"ts": F.lit("0001-01-01").cast(batch.schema["ts"].dataType), "_known": F.lit(True)})
        rows = rows.unionByName(first.join(batch.select("job_id").distinct(), "job_id", "left_semi"), allowMissingColumns=True)
    results = progress_changes(rows).filter("NOT _known").drop("_known")
    state = F.struct("ts", "event_id", *STATE)
    last = batch.groupBy("job_id").agg(F.max_by(state, F.struct("ts", "event_id")).alias("_s"))
    after = last.select("job_id", "_s.event_id", *[f"_s.{c}" for c in STATE])
    if known is not None:
        after = after.unionByName(known.join(last, "job_id", "left_anti"))
    running = ~F.coalesce(F.col("status").isin(FINISHED), F.lit(False))
    return results, after.filter(running)


def feed_events(changed: DataFrame) -> DataFrame:
    """Changed progress rows as feed events: progress, and the end where there is one.

    ``phase`` names a phase that shows; a failed job ends with its ``error``.
    """
    phase = F.when(F.col("status") == "generating", F.col("status"))
    kinds = F.when(F.col("status").isin(FINISHED), F.array(F.lit("progress"), F.col("status"))).otherwise(
        F.array(F.lit("progress"))
    )
    error = F.col("error_message") if "error_message" in changed.columns else F.lit(None).cast("string")
    counters = [c for c in STATE if c != "status"]
    events = changed.select("job_id", "ts", "event_id", F.explode(kinds).alias("type"), phase.alias("phase"), error.alias("error"), *counters)
    return events.withColumn("error", F.when(F.col("type") == "failed", F.col("error")))


def of_sites(rows: DataFrame, batch: DataFrame) -> DataFrame:
    """The part of ``rows`` that belongs to the sites of ``batch``, by a filter the scan can use.

    Stored rows lie in the order of their site, so files and row groups of other sites are not read.
    """
    sites = batch.select("site_id").distinct()
    named = [r.site_id for r in sites.limit(NAMED_SITES + 1).collect()]
    if len(named) <= NAMED_SITES:
        return rows.filter(F.col("site_id").isin(named))
    low, high = batch.agg(F.min("site_id"), F.max("site_id")).first()
    return rows.filter(F.col("site_id").between(low, high))


def change_step(stored: DataFrame) -> Step:
    """Step of ``runner.logged`` over the pages of a crawl as they arrive -> (site_id, url, change).

    Each page is compared with its stored row as it comes, and counted once:
    ``snapshot.change_counts`` of the results are the counters so far. Of the stored pages, as of those
    counted before, only the sites of the micro-batch are read; removals wait for the end of the crawl.
    """

    def step(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        # A copy that was fetched says more than one that was not modified.
        found = arrival_changes(of_sites(stored, batch), batch).groupBy(*KEY).agg(F.max("change").alias("change"))
        if before is not None:
            found = found.join(of_sites(before, batch), KEY, "left_anti")
        return found.repartitionByRange("site_id").sortWithinPartitions("site_id")

    return step
