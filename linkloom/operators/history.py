"""Questions about sites, crawl jobs and rendered indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.plans.ordering import first_per, top_per

# List lengths, and the states of a job that is under way.
RECENT_JOBS = 20
RECENT_FILES = 50
RECENT_SITES = 5
UNDER_WAY = ["pending", "running", "generating"]
FINISHED = ["completed", "failed"]


def newest() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def latest_per_site(df: DataFrame) -> DataFrame:
    """Newest row of each site, by time of creation, then id."""
    return first_per(df, ["site_id"], newest())


def recent_jobs(jobs: DataFrame, k: int = RECENT_JOBS) -> DataFrame:
    return top_per(jobs, ["site_id"], newest(), k)


def file_history(files: DataFrame, k: int = RECENT_FILES) -> DataFrame:
    return top_per(files, ["site_id"], newest(), k)


def recent_sites(sites: DataFrame, k: int = RECENT_SITES) -> DataFrame:
    return sites.orderBy(*newest()).limit(k)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows with the given key values; the equalities reach the parquet scan."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def lookup_all(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows asked for by a table of keys; all key columns must agree (a job must belong to the site)."""
    return df.join(wanted.distinct(), wanted.columns, "left_semi")


def site_overview(sites: DataFrame, jobs: DataFrame, files: DataFrame, schedules: DataFrame) -> DataFrame:
    """Every site with its newest job, newest index and schedule.

    Only small columns are read: the text of an index stays in its file.
    """
    job = latest_per_site(
        jobs.select(
            "site_id", "id", "created_at", "status", "pages_crawled", "pages_found", "pages_changed",
            "updated_at", "error_message",
        )
    ).select(
        "site_id",
        F.col("id").alias("latest_crawl_job_id"),
        F.col("status").alias("latest_crawl_status"),
        F.col("pages_crawled").alias("latest_crawl_pages_crawled"),
        F.col("pages_found").alias("latest_crawl_pages_found"),
        F.col("pages_changed").alias("latest_crawl_pages_changed"),
        F.col("updated_at").alias("latest_crawl_updated_at"),
        F.col("error_message").alias("latest_crawl_error_message"),
    )
    file = latest_per_site(files.select("site_id", "id", "created_at", "is_edited")).select(
        "site_id",
        F.lit(True).alias("index_generated"),
        F.col("created_at").alias("index_generated_at"),
        F.col("is_edited").alias("index_edited"),
    )
    schedule = schedules.select(
        "site_id",
        F.col("is_active").alias("schedule_active"),
        F.col("cron_expression").alias("schedule_cron_expression"),
        F.col("next_run_at").alias("schedule_next_run_at"),
    )
    joined = sites.withColumnRenamed("id", "site_id")
    for side in (job, file, schedule):
        joined = joined.join(side, "site_id", "left")
    return joined.fillna(False, ["index_generated", "index_edited", "schedule_active"])


def label_overview(overview: DataFrame) -> DataFrame:
    """Display labels of the crawl, index and schedule columns."""
    status = F.col("latest_crawl_status")
    crawl = (
        F.when(status == "pending", "Queued")
        .when(status == "running", "Crawling")
        .when(status == "generating", "Generating")
        .when(status == "completed", "Completed")
        .when(status == "failed", "Failed")
        .otherwise("Not Crawled")
    )
    index = (
        F.when(F.col("index_generated") & F.col("index_edited"), "Edited")
        .when(F.col("index_generated"), "Ready")
        .when(status.isin(UNDER_WAY), "Pending")
        .when(status == "failed", "Unavailable")
        .otherwise("Not generated")
    )
    schedule = (
        F.when(F.coalesce("schedule_cron_expression", F.lit("")) == "", "Not set")
        .when(F.col("schedule_active"), "Active")
        .otherwise("Paused")
    )
    return overview.withColumns({"crawl_label": crawl, "index_label": index, "schedule_label": schedule})


def site_stats(overview: DataFrame) -> DataFrame:
    status = F.col("latest_crawl_status")
    return overview.agg(
        F.count("*").alias("total"),
        F.count_if(status == "completed").alias("crawled"),
        F.count_if(status.isin(UNDER_WAY)).alias("running"),
        F.count_if("index_generated").alias("ready"),
        F.count_if(status == "failed").alias("failed"),
    )


def active_pages(pages: DataFrame) -> DataFrame:
    """Active pages, site by site, most relevant and shallowest first."""
    order = [F.asc("site_id"), F.desc("relevance_score"), F.asc("depth"), F.asc("url")]
    return pages.filter("is_active").orderBy(*order)


def pages_since_job(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active pages checked since a job of their site began, for each of the jobs passed in."""
    job = jobs.select("site_id", F.col("id").alias("job_id"), F.col("created_at").alias("_since"))
    checked = pages.filter("is_active").join(job, "site_id")
    return checked.filter(F.col("last_checked_at") >= F.col("_since")).drop("_since")


def output_freshness(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Is the newest index of a site the work of its newest job?

    Still awaited: the job is under way, or it is completed and rebuilt the
    index, but the newest index is another job's.
    """
    job = latest_per_site(jobs.select("site_id", "id", "created_at", "status"))
    file = latest_per_site(files.select("site_id", "id", "created_at", "crawl_job_id"))
    current = F.coalesce(F.col("crawl_job_id") == F.col("job_id"), F.lit(False))
    return (
        job.select("site_id", F.col("id").alias("job_id"), "status")
        .join(file.select("site_id", F.col("id").alias("file_id"), "crawl_job_id"), "site_id", "left")
        .withColumn("is_current", (F.col("status") == "completed") & current)
        .withColumn(
            "is_awaited", F.col("status").isin(UNDER_WAY) | ((F.col("status") == "completed") & ~current)
        )
    )


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; 0 when there is nothing to divide by."""
    share = F.floor(F.try_divide(part, whole) * 100 + 0.5)
    return F.when(whole > 0, share).otherwise(0).cast("int")


def progress(jobs: DataFrame) -> DataFrame:
    """Share of the page budget that is used, and the older share of the pages found."""
    budget = F.least(percent(F.col("pages_crawled"), F.col("max_pages")), F.lit(100))
    return jobs.withColumns(
        {"progress_pct": budget, "found_pct": percent(F.col("pages_crawled"), F.col("pages_found"))}
    )


def last_activity(schedules: DataFrame, jobs: DataFrame) -> DataFrame:
    """Later of the last scheduled run and the newest crawl of a scheduled site."""
    crawl = jobs.groupBy("site_id").agg(F.max("created_at").alias("_crawl"))
    return schedules.join(crawl, "site_id", "left").select(
        "site_id", F.greatest("last_run_at", "_crawl").alias("last_activity")
    )
