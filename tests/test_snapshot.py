"""Comparing and merging crawls: the traps, as literal rows."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import snapshot
from linkloom.plans.refresh import refresh
from linkloom.schemas import table_schema
from linkloom.session import cut_lineage

T0, T1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
CRAWL = (
    "site_id bigint, url string, depth int, page_id bigint, not_modified boolean, http_status int, title string,"
    " description string, content_hash string, metadata_hash string, headings_hash string, text_hash string,"
    " canonical_url string, links array<string>, etag string, last_modified string, main_text string"
)


def old(url, h="h", active=True, links=("l",), canonical=None, headings="h", etag="s", site=1):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    return (
        hash(url) % 1000, site, url, canonical, "old", None, h, "h", headings, "h", list(links), etag, None, 200, active,
        t, t, t, "Blog", 0.1, 3, t, t,
    )


def new(url, h="h", same=False, depth=1, page_id=1, canonical=None, etag=None, headings="h", site=1):
    if same:
        return (site, url, depth, page_id, True, 304, None, None, None, None, None, None, None, None, etag, None, None)
    return (site, url, depth, page_id, False, 200, "new", "d", h, "h", headings, "h", canonical, ["l"], etag, None, "text")


@pytest.fixture(scope="module")
def frames(spark):
    stored = [
        old("https://h/same"), old("https://h/blank", canonical=""), old("https://h/changed"),
        old("https://h/nullhash", headings=None), old("https://h/back", active=False), old("https://h/backchanged", active=False),
        old("https://h/304"), old("https://h/304back", active=False), old("https://h/304bare", links=()),
        old("https://h/gone"), old("https://h/longgone", active=False), old("https://a/gone", site=2), old("https://h/etag"),
    ]
    crawled = [
        new("https://h/same"), new("https://h/blank"), new("https://h/changed", h="x"), new("https://h/nullhash"),
        new("https://h/back"), new("https://h/backchanged", h="x"), new("https://h/304", same=True),
        new("https://h/304back", same=True), new("https://h/304bare", same=True), new("https://h/304new", same=True),
        new("https://h/new", h="deep", depth=2, page_id=1), new("https://h/new", h="flat", depth=1, page_id=9),
        new("https://h/etag", etag=""), new("https://a/new", site=2, etag="c"),
    ]
    return (
        spark.createDataFrame(stored, table_schema("pages")),
        spark.createDataFrame(crawled, CRAWL),
        spark.createDataFrame([(2,)], "site_id bigint"),
    )


EXPECTED = {
    "https://h/same": "unchanged", "https://h/blank": "unchanged", "https://h/changed": "updated",
    "https://h/nullhash": "updated", "https://h/back": "reactivated", "https://h/backchanged": "reactivated",
    "https://h/304": "unchanged", "https://h/304back": "reactivated", "https://h/304bare": "removed",
    "https://h/gone": "removed", "https://h/new": "added", "https://h/etag": "unchanged",
    "https://a/gone": "removed", "https://a/new": "added",
}


def test_diff(frames):
    stored, crawled, aborted = frames
    got = {r.url: r.change for r in snapshot.snapshot_diff(stored, crawled).collect()}
    assert got == EXPECTED
    without = {r.url: r.change for r in snapshot.snapshot_diff(stored, crawled, aborted).collect()}
    assert without == {u: c for u, c in EXPECTED.items() if u != "https://a/gone"}


def test_counts(frames):
    stored, crawled, _ = frames
    diff = snapshot.snapshot_diff(stored, crawled)
    counts = {r.site_id: r for r in snapshot.change_counts(diff).collect()}
    one = counts[1]
    assert (one.added, one.updated, one.removed, one.unchanged, one.changed) == (4, 2, 2, 4, 6)
    files = stored.sparkSession.createDataFrame([(1,)], "site_id bigint")
    quiet = snapshot.change_counts(diff.filter("change = 'unchanged'"))
    gate = {r.site_id: r.needs_rebuild for r in snapshot.needs_rebuild(quiet, files).collect()}
    assert gate == {1: False}


def test_merge(frames):
    stored, crawled, aborted = frames
    merged = snapshot.snapshot_merge(stored, crawled, F.lit(T1).cast("timestamp"), aborted)
    rows = {r.url: r for r in merged.collect()}
    assert rows["https://h/new"].content_hash == "flat" and str(rows["https://h/new"].created_at) == T1
    kept = rows["https://h/304"]
    assert (kept.title, kept.http_status, kept.depth, kept.category) == ("old", 304, 1, "Core Pages")
    assert str(kept.last_seen_at) == T1 and str(kept.first_seen_at) == T0
    assert rows["https://h/changed"].title == "new" and rows["https://h/changed"].etag == "s"
    assert rows["https://h/etag"].etag == "s" and rows["https://a/new"].etag == "c"
    gone = rows["https://h/gone"]
    assert not gone.is_active and str(gone.last_checked_at) == T1 and str(gone.last_seen_at) == T0
    assert str(rows["https://h/longgone"].last_checked_at) == T0
    assert rows["https://a/gone"].is_active  # its crawl was aborted
    assert "https://h/304new" not in rows


def test_merging_again_changes_nothing(frames):
    stored, crawled, _ = frames
    fetched = crawled.filter("not not_modified")
    merged = snapshot.snapshot_merge(stored, fetched, F.lit(T1).cast("timestamp")).drop("change")
    changes = {r.change for r in snapshot.snapshot_diff(merged, fetched).collect()}
    assert changes == {"unchanged"}


def test_summary_names_removed_urls(spark):
    rows = [(1, f"https://h/{i:03d}", "removed", False) for i in range(80)] + [(1, "https://h/k", "unchanged", False)]
    diff = spark.createDataFrame(rows, "site_id bigint, url string, change string, not_modified boolean")
    health = spark.createDataFrame([(1, 10, 1, 0.1, 0)], "site_id bigint, request_count int, timeout_count int, timeout_rate double, circuit_open_count int")
    import json

    summary = json.loads(snapshot.change_summary(diff, health).first().change_summary)
    assert summary["removed"] == 80 and summary["removed_urls"] == [f"https://h/{i:03d}" for i in range(80)]
    few = json.loads(snapshot.change_summary(diff, health, removed_shown=50).first().change_summary)
    assert few["removed"] == 80 and few["removed_urls"] == summary["removed_urls"][:50]
    assert (summary["active_pages"], summary["timeout_rate"]) == (1, 0.1)


def test_fallback_pages_count_as_updated(spark, frames):
    stored, crawled, _ = frames
    empty = crawled.filter("url = 'https://h/same'").withColumns({h: F.lit("") for h in snapshot.COMPARED[:4]})
    got = {r.url: r.change for r in snapshot.snapshot_diff(stored, empty).collect()}
    assert got["https://h/same"] == "updated"


def test_page_text_is_not_read(frames):
    stored, crawled, _ = frames
    written = cut_lineage(crawled, "crawled")
    for job in (snapshot.snapshot_diff(stored, written), snapshot.snapshot_merge(stored, written, F.current_timestamp())):
        scans = job._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1:]
        assert scans and not any("main_text" in scan for scan in scans)


def test_refresh_with_a_plan(spark, frames):
    stored, crawled, _ = frames
    sites = spark.createDataFrame(
        [(1, "https://h", "h", "S", "d", None, None), (2, "https://a", "a", "A", "d", None, None)], table_schema("sites")
    )
    text = '{"site_description":"told","sections":[{"name":"A","pages":[{"id":1,"title":"One","description":""}]}],"optional":[]}'
    plans = spark.createDataFrame([(1, text, "stop"), (2, text[:30], "stop")], "site_id bigint, json string, finish_reason string")
    files = spark.createDataFrame([], "site_id bigint")
    done = refresh(sites, stored, crawled, files, F.lit(T1).cast("timestamp"), plans)
    built = {r.site_id: r.content for r in done.rebuilt.collect()}
    assert built[1].startswith("# old\n\n> told\n\n## A\n\n- [One](https://h/")
    assert built[2] == "# new\n\n> d\n\n## Core Pages\n\n- [new](https://a/new): d\n"
    assert {r.id: r.description for r in done.sites.collect()} == {1: "told", 2: "d"}


def test_counters_of_a_site_with_skips_only(spark):
    counts = spark.createDataFrame([(1, 2, 1, 0, 3, 3)], "site_id bigint, added bigint, updated bigint, removed bigint, unchanged bigint, changed bigint")
    skipped = spark.createDataFrame([(1, 4), (2, 5)], "site_id bigint, pages_skipped bigint")
    rebuild = spark.createDataFrame([(1, True)], "site_id bigint, needs_rebuild boolean")
    got = {r.site_id: (r.pages_found, r.pages_crawled, r.pages_skipped) for r in snapshot.job_counters(counts, skipped, rebuild).collect()}
    assert got == {1: (10, 6, 4), 2: (5, 0, 5)}


def test_refresh_renders_only_what_changed(spark, frames):
    stored, crawled, aborted = frames
    sites = spark.createDataFrame(
        [(1, "https://h", "h", "S", None, None, None), (2, "https://a", "a", None, None, None, None), (3, "https://q", "q", "Q", None, None, None)],
        table_schema("sites"),
    )
    files = spark.createDataFrame([(3,)], "site_id bigint")
    done = refresh(sites, stored, crawled, files, F.lit(T1).cast("timestamp"), aborted_sites=aborted)
    # The first page is a "not modified" one: its stored title counts.
    built = {r.site_id: r.content for r in done.rebuilt.collect()}
    assert set(built) == {1}
    assert built[1].startswith("# old\n\n## ") and "https://h/new" in built[1] and "https://h/gone" not in built[1]


def test_good_copy_below_an_unusable_one(spark):
    stored = spark.createDataFrame([], "site_id bigint, url string, content_hash string, metadata_hash string, headings_hash string, text_hash string, canonical_url string, links array<string>, is_active boolean")
    stored = stored.union(spark.createDataFrame([(1, "u", "a", None, None, None, None, [], True)], stored.schema))
    rows = [(1, "u", 7, 0, True, None), (1, "u", 8, 1, False, "b")]
    crawled = spark.createDataFrame(rows, "site_id bigint, url string, page_id int, depth int, not_modified boolean, content_hash string")
    crawled = crawled.withColumns({c: F.lit(None).cast("string") for c in ("metadata_hash", "headings_hash", "text_hash", "canonical_url")})
    assert [r.change for r in snapshot.snapshot_diff(stored, crawled).collect()] == ["updated"]
    only = crawled.filter("not_modified")
    assert [r.change for r in snapshot.snapshot_diff(stored, only).collect()] == ["removed"]
    assert snapshot.removed_pages(stored, only).count() == 1
    aborted = spark.createDataFrame([(1,)], "site_id bigint")
    assert snapshot.removed_pages(stored, only, aborted).count() == 0
