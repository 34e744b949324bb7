"""Rewrites of the state tables: each returns the table as it should be next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import sha256
from linkloom.functions.urls import site_key, url_host
from linkloom.operators.history import latest_per_site
from linkloom.operators.schedule import next_fire
from linkloom.plans.ordering import first_per
from linkloom.schemas import table_schema

# Bounds and defaults of a crawl request.
DEPTH_BOUNDS = (1, 5)
PAGE_BOUNDS = (50, 500)
DEFAULT_DEPTH = 3
DEFAULT_PAGES = 200
TASK_PRIORITY = 100
TASK_ATTEMPTS = 5

COUNTERS = [
    "pages_found", "pages_crawled", "pages_changed", "pages_added", "pages_updated", "pages_removed",
    "pages_unchanged", "pages_skipped",
]


def judge_requests(requests: DataFrame) -> DataFrame:
    """Requests with defaults filled in and a ``rejection`` (NULL when fine)."""
    filled = requests.withColumns(
        {
            "max_depth": F.coalesce("max_depth", F.lit(DEFAULT_DEPTH)),
            "max_pages": F.coalesce("max_pages", F.lit(DEFAULT_PAGES)),
        }
    )
    web = F.coalesce(F.col("url").rlike(r"(?i)^\s*https?://[^/?#\s]+"), F.lit(False))
    return filled.withColumn(
        "rejection",
        F.when(~web, "url")
        .when(~F.col("max_depth").between(*DEPTH_BOUNDS), "max_depth")
        .when(~F.col("max_pages").between(*PAGE_BOUNDS), "max_pages"),
    )


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    judged = judge_requests(requests)
    return judged.filter("rejection IS NULL").drop("rejection"), judged.filter("rejection IS NOT NULL")


def registered_url(url: Column) -> Column:
    """A site is known by its URL with scheme and host in lower case, without blanks
    around it, the scheme's own port, and any trailing slash."""
    bare = F.trim(url)
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    head = F.regexp_replace(head, r"^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    return F.concat(head, F.regexp_replace(rest, "/+$", ""))


def register_sites(requests: DataFrame, sites: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New sites and one pending job per request, as full rows.

    ``requests`` (request_id, url, max_pages). Ids are digests, so a repeated
    run registers the same rows and nobody hands out numbers.
    """
    asked = requests.withColumn("url", registered_url(F.col("url")))
    fresh = asked.select("url").distinct().join(sites.select("url"), "url", "left_anti")
    no_text = F.lit(None).cast("string")
    new_sites = fresh.select(
        site_key("url").alias("id"),
        "url",
        url_host("url").alias("domain"),
        no_text.alias("title"),
        no_text.alias("description"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    known = sites.select("url", F.col("id").alias("_known"))
    set_ = {
        "id": site_key("concat('job|', request_id)"),
        "site_id": F.coalesce("_known", site_key("url")),
        "status": F.lit("pending"),
        "max_pages": F.col("max_pages"),
        "index_regenerated": F.lit(False),
        "created_at": now,
        "updated_at": now,
    }
    zero = {c: F.lit(0) for c in COUNTERS}
    jobs = asked.join(known, "url", "left").select(*_row("crawl_jobs", {**zero, **set_}))
    return new_sites, jobs


def _row(table: str, columns: dict[str, Column]) -> list[Column]:
    """All columns of a state table; those not given are NULL."""
    return [
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(table).fields
    ]


def enqueue_tasks(requests: DataFrame, jobs: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """New rows of the task table: one queued task per job, unless its key is there already.

    ``requests`` (request_id, max_depth, max_pages) the jobs were registered for.
    """
    # A key belongs to a request, so it is looked up before a request meets its jobs.
    asked = requests.select(
        site_key("concat('job|', request_id)").alias("_job"), "max_depth", F.col("max_pages").alias("_pages")
    ).withColumns(
        {
            "_task": site_key("concat('task|', _job)"),
            "idempotency_key": F.concat(F.lit("crawl-job-"), F.col("_job").cast("string")),
        }
    )
    # Distinct: keys that are all one constant are no join key, and each pair of rows would be compared.
    queued = tasks.select("idempotency_key").distinct()
    payload = F.struct(F.col("max_depth").cast("int").alias("max_depth"), F.col("_pages").cast("int").alias("max_pages"))
    known = jobs.select(F.col("id").alias("_job"), "site_id")
    return asked.join(queued, "idempotency_key", "left_anti").join(known, "_job").select(
        *_row(
            "crawl_tasks",
            {
                "id": F.col("_task"),
                "site_id": F.col("site_id"),
                "crawl_job_id": F.col("_job"),
                "status": F.lit("queued"),
                "priority": F.lit(TASK_PRIORITY),
                "attempt_count": F.lit(0),
                "max_attempts": F.lit(TASK_ATTEMPTS),
                "available_at": now,
                "idempotency_key": F.col("idempotency_key"),
                "payload": payload,
                "created_at": now,
                "updated_at": now,
            },
        )
    )


def edit_overlay(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (site_id, content) replace the text of each site's newest index."""
    newest = latest_per_site(files.select("site_id", "id", "created_at")).select("site_id", "id")
    edited = edits.select("site_id", F.col("content").alias("_edit"))
    targets = newest.join(edited, "site_id").select("id", "_edit")
    joined = files.join(targets, "id", "left")
    touched = F.col("_edit").isNotNull()
    return joined.withColumns(
        {
            "content": F.coalesce("_edit", "content"),
            "content_hash": F.when(touched, sha256(F.col("_edit"))).otherwise(F.col("content_hash")),
            "is_edited": F.col("is_edited") | touched,
        }
    ).select(*files.columns)


def cascade_delete(
    tables: dict[str, DataFrame], site_ids: DataFrame, job_ids: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All tables without the given sites and everything that hangs on them.

    ``job_ids`` (id) are deleted on their own: their tasks go, too, while their
    rendered indexes stay and lose the reference.
    """
    gone = site_ids.select(F.col("id").alias("site_id")).distinct()
    kept = {
        name: df.join(gone.withColumnRenamed("site_id", "id"), "id", "left_anti")
        if name == "sites"
        else df.join(gone, "site_id", "left_anti")
        for name, df in tables.items()
    }
    if job_ids is not None:
        dropped = job_ids.select(F.col("id").alias("crawl_job_id")).distinct()
        if "crawl_jobs" in kept:
            kept["crawl_jobs"] = kept["crawl_jobs"].join(
                dropped.withColumnRenamed("crawl_job_id", "id"), "id", "left_anti"
            )
        if "crawl_tasks" in kept:
            kept["crawl_tasks"] = kept["crawl_tasks"].join(dropped, "crawl_job_id", "left_anti")
        if "generated_files" in kept:
            files = kept["generated_files"]
            marked = files.join(dropped.withColumn("_dropped", F.lit(True)), "crawl_job_id", "left")
            kept["generated_files"] = marked.withColumn(
                "crawl_job_id", F.when(F.col("_dropped").isNull(), F.col("crawl_job_id"))
            ).select(*files.columns)
    return kept


def schedule_upsert(schedules: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """One schedule per site after the requests (request_id, site_id, cron_expression, is_active).

    Of several requests for a site the last one counts. New rows get a digest as id.
    """
    asked = first_per(requests, ["site_id"], [F.desc("request_id")]).select(
        "site_id", F.col("cron_expression").alias("_cron"), F.col("is_active").alias("_active")
    )
    joined = schedules.join(asked, "site_id", "full_outer").withColumns(
        {
            "_asked": F.col("_cron").isNotNull(),
            "cron_expression": F.coalesce("_cron", "cron_expression"),
            "is_active": F.coalesce("_active", "is_active"),
        }
    )
    upcoming = F.when(F.col("is_active"), next_fire("cron_expression", "_now"))
    fresh = F.col("id").isNull()
    return joined.withColumn("_now", now).withColumns(
        {
            "next_run_at": F.when(F.col("_asked"), upcoming).otherwise(F.col("next_run_at")),
            "created_at": F.when(fresh, F.col("_now")).otherwise(F.col("created_at")),
            "updated_at": F.when(F.col("_asked"), F.col("_now")).otherwise(F.col("updated_at")),
            "id": F.coalesce("id", site_key("concat('schedule|', site_id)")),
        }
    ).select(*schedules.columns)


def delete_schedules(schedules: DataFrame, site_ids: DataFrame) -> DataFrame:
    return schedules.join(site_ids.select("site_id"), "site_id", "left_anti")
