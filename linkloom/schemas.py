"""Schemas of the stored tables. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RAW_PAGES = "page_id bigint, url string, html string"

TABLES = {
    "sites": (
        "id bigint, url string, domain string, title string, description string,"
        " created_at timestamp, updated_at timestamp"
    ),
    "pages": (
        "id bigint, site_id bigint, url string, canonical_url string, title string, description string,"
        " content_hash string, metadata_hash string, headings_hash string, text_hash string,"
        " links array<string>, etag string, last_modified string, http_status int, is_active boolean,"
        " first_seen_at timestamp, last_seen_at timestamp, last_checked_at timestamp,"
        " category string, relevance_score double, depth int, created_at timestamp, updated_at timestamp"
    ),
    "crawl_jobs": (
        "id bigint, site_id bigint, status string, pages_found int, pages_crawled int, pages_changed int,"
        " pages_added int, pages_updated int, pages_removed int, pages_unchanged int, pages_skipped int,"
        " max_pages int, index_regenerated boolean,"
        " change_summary struct<added:int,updated:int,removed:int,unchanged:int,removed_urls:array<string>,"
        "active_pages:int,request_count:int,timeout_count:int,timeout_rate:double,circuit_open_count:int,"
        "aborted:boolean,abort_reason:string,abort_detail:string>,"
        " error_message string, created_at timestamp, updated_at timestamp"
    ),
    "crawl_tasks": (
        "id bigint, site_id bigint, crawl_job_id bigint, status string, priority int, attempt_count int,"
        " max_attempts int, available_at timestamp, leased_until timestamp, lease_owner string,"
        " idempotency_key string, payload struct<max_depth:int,max_pages:int>, last_error string,"
        " created_at timestamp, updated_at timestamp"
    ),
    "generated_files": (
        "id bigint, site_id bigint, crawl_job_id bigint, content string, content_hash string,"
        " is_edited boolean, created_at timestamp, updated_at timestamp"
    ),
    "monitoring_schedules": (
        "id bigint, site_id bigint, cron_expression string, is_active boolean, last_run_at timestamp,"
        " next_run_at timestamp, created_at timestamp, updated_at timestamp"
    ),
}

# Keys that must be unique among the rows where they are set.
UNIQUE_KEYS = {
    "sites": [["id"], ["url"]],
    "pages": [["id"], ["site_id", "url"]],
    "crawl_jobs": [["id"]],
    "crawl_tasks": [["id"], ["idempotency_key"]],
    "generated_files": [["id"]],
    "monitoring_schedules": [["id"], ["site_id"]],
}

PLAN = (
    "site_description string,"
    " sections array<struct<name:string,pages:array<struct<id:bigint,title:string,description:string>>>>,"
    " optional array<struct<id:bigint,title:string,description:string>>"
)


def table_schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values held by more than one row; parquet itself enforces none."""
    present = df.dropna(subset=key)
    return present.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")
