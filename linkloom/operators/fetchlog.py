"""Fetch attempts: outcome, health, timeout streaks, breaker openings.

Counters belong to one crawl, a (host, job_id): the next crawl of a host starts anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.classify import is_challenge
from linkloom.functions.text import cut, strip
from linkloom.plans.ordering import first_per, running, time_slice

# When a run of timeouts stops a crawl.
STREAK = 8
MIN_SAMPLES = 12
RATE = 0.7
STALL_SECONDS = 30
ABORT_REASON = "timeout_circuit_open"
CRAWL = ["host", "job_id"]

# A crawl starts at most 400 fetches a second, so an hour of one host stays
# below 1.5 million rows however long its log is.
SLICE_SECONDS = 3600


def classify_fetch(log: DataFrame, error_chars: int | None = None) -> DataFrame:
    """Add ``outcome`` and ``reason`` (NULL when the page was taken).

    ``log`` has ``timeout, status, content_type, body, has_state, error``.
    """
    kind = F.coalesce("content_type", F.lit(""))
    code = F.col("status").cast("string")

    def result(outcome: str, reason: Column | str | None) -> Column:
        text = F.lit(reason) if not isinstance(reason, Column) else reason
        return F.struct(F.lit(outcome).alias("outcome"), text.cast("string").alias("reason"))

    judged = (
        F.when(F.col("timeout"), result("timeout", "Timeout"))
        .when(F.col("error").isNotNull(), result("error", cut(F.col("error"), error_chars)))
        .when((F.col("status") == 304) & F.col("has_state"), result("not_modified", None))
        .when(F.col("status") == 304, result("no_state", "HTTP 304 without cached page state"))
        .when(F.col("status") == 403, result("blocked", "HTTP 403 (access denied)"))
        .when(F.col("status") != 200, result("bad_status", F.concat(F.lit("HTTP "), code)))
        .when(
            ~F.contains(kind, F.lit("text/html")),
            result("not_html", F.concat(F.lit("Non-HTML ("), strip(F.substring_index(kind, ";", 1)), F.lit(")"))),
        )
        .when(is_challenge("body"), result("challenge", "Bot protection (challenge page)"))
        .otherwise(result("ok", None))
    )
    return log.withColumn("_r", judged).withColumns({"outcome": F.col("_r.outcome"), "reason": F.col("_r.reason")}).drop("_r")


def skip_reasons(outcomes: DataFrame) -> DataFrame:
    """Skipped attempts of each crawl by reason."""
    skipped = outcomes.filter(F.col("reason").isNotNull())
    return skipped.groupBy(*CRAWL, "reason").agg(F.count("*").alias("skipped"))


def counted(log: DataFrame) -> DataFrame:
    """Attempts that count as requests: answers and timeouts, not other errors."""
    return log.filter(F.col("timeout") | F.col("error").isNull())


def timeout_rate(timeouts: Column, requests: Column) -> Column:
    return F.bround(F.coalesce(F.try_divide(timeouts, requests), F.lit(0.0)), 4)


def _tally(log: DataFrame, *extra: str) -> DataFrame:
    """Running requests, timeouts, timeouts at the last answer, successes, last success and first attempt."""
    # No other columns: both uses of the sliced rows then share one shuffle.
    return running(
        counted(log).select(*CRAWL, "ts", "event_id", "timeout", "accepted", *extra),
        keys=CRAWL,
        order=[F.asc("ts"), F.asc("event_id")],
        slice_by=time_slice(F.col("ts"), SLICE_SECONDS),
        sums={
            "requests": F.lit(1),
            "timeouts": F.col("timeout").cast("int"),
            "successes": F.col("accepted").cast("int"),
        },
        marks={"answered_at": (~F.col("timeout"), "timeouts")},
        latest={"last_success": F.when(F.col("accepted"), F.col("ts"))},
        first={"started": F.col("ts")},
    ).withColumn("streak", F.col("timeouts") - F.coalesce("answered_at", F.lit(0)))


def timeout_streak(log: DataFrame) -> DataFrame:
    """Consecutive timeouts up to and including each counted attempt."""
    return _tally(log).select("event_id", *CRAWL, "ts", "timeout", F.col("streak").cast("bigint").alias("streak"))


def _openings(log: DataFrame, *extra: str) -> DataFrame:
    since = F.coalesce("last_success", "started")
    stalled = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1e6
    enough = F.col("requests") >= MIN_SAMPLES
    by_streak = enough & (F.col("streak") >= STREAK)
    by_rate = enough & (F.col("timeouts") / F.col("requests") >= RATE) & (stalled >= STALL_SECONDS)
    tally = _tally(log, *extra).withColumn("stalled", F.greatest(stalled, F.lit(0.0)))
    trigger = F.when(by_streak, "streak").otherwise("rate+stall")
    return tally.withColumn("trigger", trigger).filter(F.col("timeout") & (by_streak | by_rate))


def circuit_openings(log: DataFrame) -> DataFrame:
    """Attempts at which the breaker would open; only a timeout can open it."""
    return _openings(log).select(
        "event_id",
        *CRAWL,
        "ts",
        "trigger",
        F.col("requests").cast("bigint").alias("requests"),
        F.col("timeouts").cast("bigint").alias("timeouts"),
        F.col("streak").cast("bigint").alias("streak"),
    )


def circuit_events(log: DataFrame) -> DataFrame:
    """Openings, the first one of each crawl marked as the one that aborts the crawl."""
    opened = circuit_openings(log)
    first = opened.groupBy(*CRAWL).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("_first"))
    return opened.join(first, CRAWL).withColumn("aborts", F.col("event_id") == F.col("_first")).drop("_first")


def abort_summaries(log: DataFrame, detail_chars: int | None = None) -> DataFrame:
    """Why and in what state each aborted crawl stopped, at its first opening.

    ``log`` needs ``url`` besides the other columns.
    """
    first = first_per(_openings(log, "url"), CRAWL, [F.asc("ts"), F.asc("event_id")])
    detail = F.format_string(
        "trigger=%s url=%s timeouts=%d/%d streak=%d stalled_for=%.1fs",
        "trigger", "url", "timeouts", "requests", "streak", "stalled",
    )
    return first.select(
        *CRAWL,
        F.lit(ABORT_REASON).alias("abort_reason"),
        cut(detail, detail_chars).alias("abort_detail"),
        F.col("requests").alias("request_count"),
        F.col("timeouts").alias("timeout_count"),
        timeout_rate(F.col("timeouts"), F.col("requests")).alias("timeout_rate"),
        F.col("streak").alias("consecutive_timeouts"),
        F.lit(1).alias("circuit_open_count"),
        F.col("successes").alias("pages_crawled_so_far"),
    )


def fallback_crawls(outcomes: DataFrame, log: DataFrame, listed: DataFrame) -> DataFrame:
    """Crawls that fall back to their sitemap's URLs: nothing taken, something blocked,
    not aborted, and some URL listed for the host (``listed`` has ``host``)."""
    tally = outcomes.groupBy(*CRAWL).agg(
        F.count_if(F.col("outcome").isin("ok", "not_modified")).alias("_taken"),
        F.count_if(F.col("outcome").isin("blocked", "challenge")).alias("blocked_count"),
    )
    stuck = tally.filter("_taken = 0 AND blocked_count > 0").drop("_taken")
    aborted = circuit_openings(log).select(*CRAWL).distinct()
    return stuck.join(aborted, CRAWL, "left_anti").join(listed.select("host").distinct(), "host", "left_semi")


def fetch_counts(log: DataFrame) -> DataFrame:
    """Requests, timeouts and successes per crawl; needs no order, so it also runs on a stream."""
    answered = F.col("timeout") | F.col("error").isNull()
    return log.groupBy(*CRAWL).agg(
        F.count_if(answered).alias("request_count"),
        F.count_if(F.col("timeout")).alias("timeout_count"),
        F.count_if(F.col("accepted")).alias("success_count"),
    )


def fetch_health(log: DataFrame) -> DataFrame:
    """Counters per crawl; one whose breaker opened is aborted at that point."""
    opened = circuit_openings(log).select(*CRAWL).distinct().withColumn("_open", F.lit(1))
    return (
        fetch_counts(log)
        .join(opened, CRAWL, "left")
        .select(
            *CRAWL,
            "request_count",
            "timeout_count",
            timeout_rate(F.col("timeout_count"), F.col("request_count")).alias("timeout_rate"),
            "success_count",
            F.coalesce("_open", F.lit(0)).alias("circuit_open_count"),
        )
    )
