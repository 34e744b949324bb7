"""The laid out pages table gives what the plain merge gives, and moves less."""

import os

import pytest
from pyspark.sql import functions as F

from checks import views as V
from linkloom import session
from linkloom.operators import graph
from linkloom.operators.snapshot import snapshot_diff, snapshot_merge
from linkloom.session import clean_up, cut_into_buckets, cut_lineage
from linkloom.sources import pagestore


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def crawl(spark, sf):
    facts = cut_lineage(V.facts(spark, sf), "facts")
    stored = cut_lineage(V.stored_of(facts), "stored")
    return stored, cut_lineage(V.crawl_of(facts), "crawled")


@pytest.fixture
def place(spark, crawl, tmp_path):
    path = f"{tmp_path}/pages"
    pagestore.write_pages(crawl[0], path, parts=8, buckets=8)
    yield path
    pagestore.forget_pages(spark, path)


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def test_merge_of_all_sites_is_the_plain_merge(spark, crawl, place):
    stored, crawled = crawl
    sites = stored.select("site_id").union(crawled.select("site_id"))
    want = snapshot_merge(stored, crawled, now())
    changes = pagestore.merge_pages(spark, place, crawled, now(), sites, parts=8, buckets=8)
    assert rows_of(pagestore.open_pages(spark, place, 8).drop("part")) == rows_of(want.drop("change"))
    assert rows_of(changes) == rows_of(want.filter("change IS NOT NULL").select("site_id", "url", "change"))


@pytest.mark.parametrize("named", [1000, 0])
def test_only_parts_of_crawled_sites_are_written(spark, crawl, place, monkeypatch, named):
    monkeypatch.setattr(pagestore, "NAMED_SITES", named)
    stored, crawled = crawl
    site = min(r.site_id for r in stored.select("site_id").distinct().collect())
    own = crawled.filter(F.col("site_id") == site)
    part = own.select(pagestore.part_of(F.col("site_id"), 8).alias("part")).first().part
    files = lambda: {p: sorted(os.listdir(f"{place}/{p}")) for p in os.listdir(place) if p.startswith("part=")}
    before = files()
    pagestore.merge_pages(spark, place, own, now(), parts=8, buckets=8)
    after = files()
    assert {p for p in after if after[p] != before.get(p)} == {f"part={part}"}
    # New ids come after the greatest id of the whole table; other sites keep their rows.
    top = stored.agg(F.max("id")).first()[0]
    mine = snapshot_merge(stored.filter(F.col("site_id") == site), own, now(), taken=stored).drop("change")
    want = mine.unionByName(stored.filter(F.col("site_id") != site))
    got = pagestore.open_pages(spark, place, 8).drop("part")
    assert rows_of(got) == rows_of(want) and got.filter(F.col("id") > top).count() == mine.filter(F.col("id") > top).count()
    # Another session finds the folder as it is.
    pagestore.forget_pages(spark, place)
    assert rows_of(pagestore.open_pages(spark, place, 8).drop("part")) == rows_of(want)


def test_a_site_without_pages_loses_them(spark, crawl, place):
    stored, crawled = crawl
    site = stored.filter("is_active").select("site_id").limit(1)
    changes = pagestore.merge_pages(spark, place, crawled.limit(0), now(), site, parts=8, buckets=8)
    gone = stored.filter("is_active").join(site, "site_id", "left_semi").select("site_id", "url", F.lit("removed").alias("change"))
    assert rows_of(changes) == rows_of(gone)


def test_stored_pages_are_not_shuffled(spark, crawl, place):
    stored, crawled = crawl
    pages = pagestore.open_pages(spark, place, 8)
    own = stored.select("site_id").union(crawled.select("site_id"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = pagestore.diff_pages(pages, crawled, own, parts=8)
        assert rows_of(laid) == rows_of(snapshot_diff(stored, crawled))
        plan = plan_of(laid)
        scan = plan.index("Bucketed: true")
        assert plan_of(snapshot_diff(stored, crawled)).count("Exchange") == plan.count("Exchange") + 1
        # Between the join and the stored scan nothing moves.
        branch = plan[plan.index("SortMergeJoin") : scan]
        assert "Exchange" not in branch
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_edges_and_levels_stay_where_they_are(spark):
    edges = spark.range(2000).select((F.col("id") % 3).alias("site_id"), F.col("id").cast("string").alias("url"), F.col("id").alias("n"))
    key = ["site_id", "url"]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links, level = cut_into_buckets(edges, "edges", key), cut_into_buckets(edges.drop("n"), "level", key)
        assert "Exchange" not in plan_of(links.join(level, key))
        assert plan_of(links.join(level, key).select("site_id", F.col("n").cast("string").alias("url")).distinct().join(level, key, "left_anti")).count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_tables_go_with_their_folders(spark):
    seeds = spark.sql("SELECT 1L AS site_id, 'a' AS url, 0 AS depth")
    edges = spark.sql("SELECT 1L AS site_id, 'a' AS src, 'b' AS dst")
    old, session._handed_out[:] = list(session._handed_out), []
    try:
        before = {t.name for t in spark.catalog.listTables()}
        assert {(r.url, r.depth) for r in graph.bfs(edges, seeds).collect()} == {("a", 0), ("b", 1)}
        assert len(spark.catalog.listTables()) > len(before)
        clean_up(spark)
        assert {t.name for t in spark.catalog.listTables()} == before
    finally:
        session._handed_out[:] = old
