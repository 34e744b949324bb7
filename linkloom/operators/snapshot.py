"""Compare a new crawl with the stored pages, count, summarise and merge.

``stored``  rows of the pages table.
``crawled`` page facts with ``site_id, url, depth, page_id, http_status, not_modified, etag, last_modified``.

All sites are compared at once on (site_id, url), a key no hot site can pile up on.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import empty_to_null
from linkloom.operators.extract import score_pages
from linkloom.plans.ordering import first_per, next_ids, top_per
from linkloom.schemas import table_schema
from linkloom.session import cut_lineage

KEY = ["site_id", "url"]
COMPARED = ["content_hash", "metadata_hash", "headings_hash", "text_hash", "canonical_url"]
CONTENT = ["title", "description", *COMPARED, "links", "http_status"]


def _reusable() -> Column:
    hashes = [F.coalesce(h, F.lit("")) != "" for h in ("metadata_hash", "headings_hash", "text_hash")]
    return (F.coalesce(F.size("links"), F.lit(0)) > 0) & hashes[0] & hashes[1] & hashes[2]


def reusable_pages(stored: DataFrame) -> DataFrame:
    """Stored pages complete enough to be reused when the server says "not modified"."""
    return stored.filter(_reusable())


def _line_up(stored: DataFrame, crawled: DataFrame, content: list[str]) -> DataFrame:
    """Stored and crawled state of every URL side by side, as structs ``s`` and ``c``.

    Only ``content`` and what decides is carried along: page text stays behind.
    Redirects may bring the same URL twice: the shallowest, then the oldest copy
    stands. A "not modified" answer for a page without reusable state is no page,
    so of each URL the first copy of either kind is kept until the state is at hand.
    """
    narrow = crawled.select(*KEY, "page_id", *dict.fromkeys(["depth", "not_modified", *content]))
    once = first_per(narrow, [*KEY, "not_modified"], [F.asc("depth"), F.asc("page_id")])
    copy = F.struct(*[c for c in once.columns if c not in KEY])
    place = F.struct("depth", "page_id")
    new = once.groupBy(*KEY).agg(
        F.min_by(copy, place).alias("_any"),
        F.min_by(F.when(~F.col("not_modified"), copy), F.when(~F.col("not_modified"), place)).alias("_fetched"),
    )
    state = [F.col(c) for c in stored.columns if c not in KEY]
    old = stored.select(*KEY, F.struct(*state, _reusable().alias("reusable")).alias("s"))
    both = old.join(new, KEY, "full_outer")
    usable = F.coalesce(F.col("s.reusable"), F.lit(False))
    lined = both.withColumn("c", F.when(usable, F.col("_any")).otherwise(F.col("_fetched"))).drop("_any", "_fetched")
    return lined.filter("s IS NOT NULL OR c IS NOT NULL")


def _change() -> Column:
    blank = F.lit("")
    differs = reduce(
        or_, [F.coalesce(f"s.{c}", blank) != F.coalesce(f"c.{c}", blank) for c in COMPARED]
    )
    return (
        F.when(F.col("s").isNull(), "added")
        .when(F.col("c").isNotNull() & ~F.col("s.is_active"), "reactivated")
        .when(F.col("c.not_modified"), "unchanged")
        .when(F.col("c").isNotNull() & differs, "updated")
        .when(F.col("c").isNotNull(), "unchanged")
        .when(F.col("s.is_active"), "removed")
    )


def _compared(
    stored: DataFrame, crawled: DataFrame, aborted_sites: DataFrame | None, content: list[str]
) -> DataFrame:
    both = _line_up(stored, crawled, content).withColumn("change", _change())
    if aborted_sites is None:
        return both
    # An aborted crawl never gets to the removal pass.
    flags = aborted_sites.select("site_id").distinct().withColumn("_aborted", F.lit(True))
    kept = F.when((F.col("change") == "removed") & F.col("_aborted").isNotNull(), None).otherwise(F.col("change"))
    return both.join(flags, "site_id", "left").withColumn("change", kept).drop("_aborted")


def snapshot_diff(stored: DataFrame, crawled: DataFrame, aborted_sites: DataFrame | None = None) -> DataFrame:
    """(site_id, url, change, not_modified) for every URL whose state was looked at."""
    state = stored.select(*KEY, *COMPARED, "links", "is_active")
    compared = _compared(state, crawled, aborted_sites, COMPARED).filter(F.col("change").isNotNull())
    return compared.select(*KEY, "change", F.coalesce("c.not_modified", F.lit(False)).alias("not_modified"))


def arrival_changes(stored: DataFrame, crawled: DataFrame) -> DataFrame:
    """(site_id, url, change) of crawled rows as they come, also of a stream.

    Nothing is known yet about pages that have not come, so nothing is removed.
    """
    old = stored.select(*KEY, F.struct(*COMPARED, "is_active", _reusable().alias("reusable")).alias("s"))
    new = crawled.select(*KEY, F.struct("not_modified", *COMPARED).alias("c"))
    both = new.join(old, KEY, "left")
    seen = both.filter(~F.col("c.not_modified") | F.coalesce(F.col("s.reusable"), F.lit(False)))
    return seen.select(*KEY, _change().alias("change"))


def removed_pages(stored: DataFrame, crawled: DataFrame, aborted_sites: DataFrame | None = None) -> DataFrame:
    """Active stored pages that this crawl did not see; an aborted crawl removes none."""
    return snapshot_diff(stored, crawled, aborted_sites).filter("change = 'removed'").select(*KEY)


def change_counts(diff: DataFrame) -> DataFrame:
    """Counters per site. A reactivated page counts as added; removals are no "change"."""

    def n(*kinds: str) -> Column:
        return F.count_if(F.col("change").isin(*kinds))

    return diff.groupBy("site_id").agg(
        n("added", "reactivated").alias("added"),
        n("updated").alias("updated"),
        n("removed").alias("removed"),
        n("unchanged").alias("unchanged"),
        n("added", "reactivated", "updated").alias("changed"),
    )


def job_counters(counts: DataFrame, skipped: DataFrame, rebuild: DataFrame) -> DataFrame:
    """Counters of a finished job per site; found pages are the crawled and the skipped ones.

    ``skipped`` (site_id, pages_skipped), ``rebuild`` as ``needs_rebuild`` gives it.
    """
    taken = (F.col("added") + F.col("updated") + F.col("unchanged")).cast("int")
    missed = F.coalesce("pages_skipped", F.lit(0)).cast("int")
    # A site may have skipped pages only.
    joined = counts.join(skipped, "site_id", "full_outer").fillna(0).join(rebuild, "site_id", "left")
    return joined.select(
        "site_id",
        F.lit("completed").alias("status"),
        (taken + missed).alias("pages_found"),
        taken.alias("pages_crawled"),
        F.col("changed").cast("int").alias("pages_changed"),
        F.col("added").cast("int").alias("pages_added"),
        F.col("updated").cast("int").alias("pages_updated"),
        F.col("removed").cast("int").alias("pages_removed"),
        F.col("unchanged").cast("int").alias("pages_unchanged"),
        missed.alias("pages_skipped"),
        F.col("needs_rebuild").alias("index_regenerated"),
    )


def change_summary(diff: DataFrame, health: DataFrame | None = None, removed_shown: int | None = None) -> DataFrame:
    """Counters, active pages and the removed URLs of each site, as one JSON text.

    All removed URLs are named, or the first ``removed_shown``; ``removed_pages``
    gives them as rows, for sites that lose very many.
    ``health`` (site_id, request_count, timeout_count, timeout_rate,
    circuit_open_count) adds the fetch counters.
    """
    gone = diff.filter("change = 'removed'")
    if removed_shown is not None:
        gone = top_per(gone, ["site_id"], [F.asc("url")], removed_shown)
    named = gone.groupBy("site_id").agg(F.sort_array(F.collect_list("url")).alias("removed_urls"))
    counts = change_counts(diff).join(named, "site_id", "left")
    fields = [F.col(c).cast("int").alias(c) for c in ("added", "updated", "removed", "unchanged")]
    fields.append(F.coalesce("removed_urls", F.array().cast("array<string>")).alias("removed_urls"))
    fields.append((F.col("added") + F.col("updated") + F.col("unchanged")).cast("int").alias("active_pages"))
    if health is not None:
        counts = counts.join(health, "site_id", "left")
        fields += [F.col(c) for c in health.columns if c != "site_id"]
    return counts.select("site_id", F.to_json(F.struct(*fields)).alias("change_summary"))


def needs_rebuild(counts: DataFrame, files: DataFrame) -> DataFrame:
    """A site's index is rebuilt if anything changed or was removed, or if it has none yet."""
    have = files.select("site_id").distinct().withColumn("_have", F.lit(True))
    rebuild = (F.col("changed") > 0) | (F.col("removed") > 0) | F.col("_have").isNull()
    return counts.join(have, "site_id", "left").select("site_id", rebuild.alias("needs_rebuild"))


def snapshot_merge(
    stored: DataFrame,
    crawled: DataFrame,
    now: Column,
    aborted_sites: DataFrame | None = None,
    taken: DataFrame | None = None,
) -> DataFrame:
    """The next pages table, plus a last column ``change`` (NULL where nothing was looked at).

    Written once. New pages get the ids after the greatest one of ``taken``, by default
    ``stored``, by (site_id, url).
    """
    compared = _compared(stored, crawled, aborted_sites, [*CONTENT, "etag", "last_modified"])
    seen = F.col("c").isNotNull()
    fresh = seen & ~F.col("c.not_modified")
    gone = F.coalesce(F.col("change") == "removed", F.lit(False))
    checked = seen | gone

    def content(name: str) -> Column:
        kept = F.when(seen, F.lit(304)).otherwise(F.col("s.http_status")) if name == "http_status" else F.col(f"s.{name}")
        return F.when(fresh, F.col(f"c.{name}")).otherwise(kept)

    def header(name: str) -> Column:
        return F.coalesce(empty_to_null(F.col(f"c.{name}")), F.col(f"s.{name}"))

    scored = score_pages(compared.withColumn("depth", F.col("c.depth")))
    columns = {name: content(name) for name in CONTENT} | {
        "id": F.col("s.id"),
        "etag": header("etag"),
        "last_modified": header("last_modified"),
        "is_active": seen | (F.col("s.is_active") & ~gone),
        "first_seen_at": F.coalesce("s.first_seen_at", F.when(F.col("s").isNull(), now)),
        "last_seen_at": F.when(seen, now).otherwise(F.col("s.last_seen_at")),
        "last_checked_at": F.when(checked, now).otherwise(F.col("s.last_checked_at")),
        "category": F.when(seen, F.col("category")).otherwise(F.col("s.category")),
        "relevance_score": F.when(seen, F.col("relevance_score")).otherwise(F.col("s.relevance_score")),
        "depth": F.when(seen, F.col("depth")).otherwise(F.col("s.depth")),
        "created_at": F.coalesce("s.created_at", F.when(F.col("s").isNull(), now)),
        "updated_at": F.when(checked, now).otherwise(F.col("s.updated_at")),
    }
    fields = table_schema("pages").fields
    merged = scored.select(
        *[
            (F.col(f.name) if f.name in KEY else columns[f.name].cast(f.dataType)).alias(f.name)
            for f in fields
        ],
        "change",
    )
    merged = cut_lineage(merged, "merged")
    new = next_ids(merged.filter("id IS NULL"), [F.asc("site_id"), F.asc("url")], stored if taken is None else taken)
    return merged.filter("id IS NOT NULL").unionByName(new)


def site_refresh(sites: DataFrame, crawled: DataFrame) -> DataFrame:
    """Sites with title and description of their first crawled page, where it has any.

    First is the shallowest page, then the least URL.
    """
    first = crawled.groupBy("site_id").agg(
        F.min_by(
            F.struct(
                empty_to_null(F.col("title")).alias("title"),
                empty_to_null(F.col("description")).alias("description"),
            ),
            F.struct("depth", "url"),
        ).alias("_first")
    )
    joined = sites.join(first.withColumnRenamed("site_id", "id"), "id", "left")
    return joined.withColumns(
        {
            "title": F.coalesce("_first.title", "title"),
            "description": F.coalesce("_first.description", "description"),
        }
    ).select(*sites.columns)


def backfill_seen(pages: DataFrame, now: Column) -> DataFrame:
    """Seen and checked times of rows stored before those columns existed."""
    changed = F.coalesce("updated_at", "created_at", now)
    return pages.withColumns(
        {
            "first_seen_at": F.coalesce("first_seen_at", "created_at", now),
            "last_seen_at": F.coalesce(F.col("last_seen_at"), changed),
            "last_checked_at": F.coalesce(F.col("last_checked_at"), changed),
        }
    )
