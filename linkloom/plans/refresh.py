"""The whole job: raw pages of a new crawl in, next state and rendered indexes out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.curation import adopt_descriptions, assemble_plan, usable_plans
from linkloom.operators.dedup import clean_pages
from linkloom.operators.listing import assign_page_ids
from linkloom.operators.render import render_index
from linkloom.operators.snapshot import (
    change_counts, change_summary, job_counters, needs_rebuild, site_refresh, snapshot_merge,
)
from linkloom.plans.ordering import next_ids
from linkloom.schemas import table_schema
from linkloom.session import cut_lineage

ABORTED = "Crawl aborted due to sustained timeout pressure"


@dataclass
class Refresh:
    """``rebuilt`` has the fresh indexes; ``files`` and ``jobs`` are full rows of the state
    tables, there if jobs were passed in."""

    diff: DataFrame
    counts: DataFrame
    pages: DataFrame
    sites: DataFrame
    rebuilt: DataFrame
    files: DataFrame | None = None
    jobs: DataFrame | None = None


def index_sites(sites: DataFrame, pages: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """(site_id, content, content_hash): from a usable plan, else from the scores.

    Only sites with a usable plan have their pages cleaned and numbered, only the
    others are rendered from scores.
    """
    if plans is None:
        return render_index(sites, pages)
    usable = usable_plans(plans)
    by_site = usable.select("site_id").distinct()
    numbered = assign_page_ids(clean_pages(pages.join(by_site, "site_id", "left_semi")))
    chosen = assemble_plan(sites, usable, numbered)
    plain_sites = sites.join(by_site.withColumnRenamed("site_id", "id"), "id", "left_anti")
    return chosen.unionByName(render_index(plain_sites, pages.join(by_site, "site_id", "left_anti")))


def file_rows(rebuilt: DataFrame, jobs: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Fresh indexes as rows of ``generated_files``, with the job that made them."""
    made = rebuilt.join(jobs.select("site_id", F.col("id").alias("crawl_job_id")), "site_id")
    rows = next_ids(made, [F.asc("site_id")], files).withColumns(
        {"is_edited": F.lit(False), "created_at": now, "updated_at": now}
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema("generated_files").fields])


def job_rows(
    jobs: DataFrame,
    diff: DataFrame,
    counts: DataFrame,
    rebuild: DataFrame,
    now: Column,
    skipped: DataFrame | None = None,
    health: DataFrame | None = None,
    aborted_sites: DataFrame | None = None,
) -> DataFrame:
    """The jobs as they end: completed with counters and summary, or failed if aborted."""
    fields = table_schema("crawl_jobs")
    none = jobs.select("site_id").limit(0).withColumn("pages_skipped", F.lit(0))
    done = job_counters(counts, none if skipped is None else skipped, rebuild)
    numbers = [c for c in done.columns if c.startswith("pages_")]
    told = change_summary(diff, health).withColumn(
        "change_summary", F.from_json("change_summary", fields["change_summary"].dataType)
    )
    own = jobs.select("id", "site_id", "max_pages", "created_at")
    rows = own.join(done, "site_id", "left").join(told, "site_id", "left").join(
        rebuild.withColumnRenamed("needs_rebuild", "_rebuild"), "site_id", "left"
    )
    rows = rows.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in numbers},
            "status": F.lit("completed"),
            "index_regenerated": F.coalesce("_rebuild", F.lit(False)),
            "error_message": F.lit(None).cast("string"),
            "updated_at": now,
        }
    )
    if aborted_sites is not None:
        flags = aborted_sites.select("site_id").distinct().withColumn("_aborted", F.lit(True))
        stopped = F.col("_aborted").isNotNull()
        rows = rows.join(flags, "site_id", "left").withColumns(
            {
                "status": F.when(stopped, "failed").otherwise(F.col("status")),
                "index_regenerated": ~stopped & F.col("index_regenerated"),
                "error_message": F.when(stopped, F.lit(ABORTED)),
            }
        )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def refresh(
    sites: DataFrame,
    stored: DataFrame,
    crawled: DataFrame,
    files: DataFrame,
    now: Column,
    plans: DataFrame | None = None,
    aborted_sites: DataFrame | None = None,
    jobs: DataFrame | None = None,
    skipped: DataFrame | None = None,
    health: DataFrame | None = None,
) -> Refresh:
    """Compare, merge, and render only the sites whose index is out of date.

    Stored and new pages are joined once; the merged table is written, and the
    counters, the rebuild decision and the rendering read it from there.
    ``crawled`` are page facts: pass a written table, extraction is the costly part.
    ``jobs`` are the running jobs, one per site: with them, the rows that the state
    tables get are returned, and a site is due if its job found no page at all but no
    index is there. ``skipped`` (site_id, pages_skipped) and ``health`` go into them.
    """
    merged = snapshot_merge(stored, crawled, now, aborted_sites)
    diff = merged.filter("change IS NOT NULL").select("site_id", "url", "change")
    pages = merged.drop("change")
    counts = change_counts(diff)
    if jobs is not None:
        counts = counts.join(jobs.select("site_id").distinct(), "site_id", "full_outer").fillna(0)
    # Merged rows, because a "not modified" page has its title from the stored row.
    seen = merged.filter("change <> 'removed'")
    if aborted_sites is not None:
        seen = seen.join(aborted_sites.select("site_id").distinct(), "site_id", "left_anti")
    renamed = site_refresh(sites, seen)
    rebuild = needs_rebuild(counts, files)
    due = rebuild.filter("needs_rebuild").select(F.col("site_id").alias("id"))
    if aborted_sites is not None:
        due = due.join(aborted_sites.select(F.col("site_id").alias("id")), "id", "left_anti")
    due_sites = renamed.join(due, "id", "left_semi")
    due_pages = pages.filter("is_active").join(due.withColumnRenamed("id", "site_id"), "site_id", "left_semi")
    described = renamed
    if plans is not None:
        # Only a plan that is put to use now describes its site.
        plans = usable_plans(plans.join(due.withColumnRenamed("id", "site_id"), "site_id", "left_semi"))
        described = adopt_descriptions(renamed, plans)
    rebuilt = index_sites(due_sites, due_pages, plans)
    if jobs is None:
        return Refresh(diff, counts, pages, described, rebuilt)
    rebuilt = cut_lineage(rebuilt, "rebuilt")
    ended = job_rows(jobs, diff, counts, rebuild, now, skipped, health, aborted_sites)
    return Refresh(diff, counts, pages, described, rebuilt, file_rows(rebuilt, jobs, files, now), ended)
