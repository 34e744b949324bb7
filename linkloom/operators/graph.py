"""The link graph of the sites: edges, filters, bounded breadth-first walk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import title_case
from linkloom.functions.urls import lower_path, normalize_url, url_host, url_path
from linkloom.operators.extract import score_pages
from linkloom.operators.robots import allowed, robots_rules
from linkloom.plans.ordering import top_per
from linkloom.session import cut_into_buckets

# Endings and path parts that are not crawled, and the limits of a crawl.
SKIPPED_ENDINGS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp",
    ".pdf", ".zip", ".tar", ".gz", ".mp4", ".mp3", ".wav",
    ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
]
SKIPPED_PARTS = ["/login", "/signin", "/signup", "/register", "/admin"]
MAX_DEPTH = 3
MAX_PAGES = 200
PROBE_MAX_DEPTH = 1
PROBE_LOW_LINKS = 1
PROBE_ATTEMPTS = 3
PROBE_PROMOTE_LINKS = 3
PROBE_FAILURES = 2


def distinct_links(links: Column) -> Column:
    """First occurrence of each link, in page order."""
    return F.array_distinct(links)


def link_edges(facts: DataFrame) -> DataFrame:
    """(site_id, src, pos, dst) from the link lists of the pages."""
    return facts.select("site_id", F.col("url").alias("src"), F.posexplode("links").alias("pos", "dst"))


def crawlable_path(url: str) -> Column:
    """False for files that are no pages and for account and admin areas; ``url`` is normalised."""
    endings = " OR ".join(f"endswith(p, '{e}')" for e in SKIPPED_ENDINGS)
    areas = " OR ".join(f"contains(p, '{a}')" for a in SKIPPED_PARTS)
    return lower_path(url, "p", f"NOT ({endings} OR {areas})")


def mark_crawlable(edges: DataFrame, sites: DataFrame, robots: DataFrame) -> DataFrame:
    """Edges with clean targets and a flag ``crawlable``: on the site's own host, a page, and allowed.

    ``sites`` (id, domain), ``robots`` (host, body).
    """
    # A crawlable target is on the site's own host, so each site brings its
    # domain and its rules along and the edges are joined once.
    own = sites.select(F.col("id").alias("site_id"), F.lower("domain").alias("_domain"))
    rules = robots_rules(robots).select(F.lower("host").alias("_domain"), F.col("rules").alias("_rules"))
    target = edges.withColumn("dst", normalize_url("dst"))
    # Judged where it stands: no link of a menu, however often it is there, becomes a key.
    joined = target.join(own.join(rules, "_domain", "left"), "site_id", "left")
    inside = F.coalesce(url_host("dst") == F.col("_domain"), F.lit(False)) & crawlable_path("dst")
    usable = F.when(inside, allowed("dst", F.col("_rules"))).otherwise(F.lit(False))
    return joined.withColumn("crawlable", usable).drop("_domain", "_rules")


def redirected_sites(sites: DataFrame, roots: DataFrame) -> DataFrame:
    """Sites as a crawl takes them: host and root are those that the root URL ended at.

    ``roots`` (site_id, final_url); a site without a web address there stays as it is.
    """
    host = url_host("final_url")
    found = roots.select(F.col("site_id").alias("id"), normalize_url("final_url").alias("final_url"))
    found = found.filter(F.col("final_url").rlike("^https?://[^/]")).select("id", "final_url", host.alias("_host"))
    moved = F.coalesce(F.col("_host") != F.lower("domain"), F.lit(False))
    return sites.join(found, "id", "left").withColumns(
        {
            "url": F.when(moved, F.col("final_url")).otherwise(F.col("url")),
            "domain": F.when(moved, F.col("_host")).otherwise(F.col("domain")),
        }
    ).select(*sites.columns)


def crawlable_links(edges: DataFrame, sites: DataFrame, robots: DataFrame) -> DataFrame:
    """Edges whose target may be crawled."""
    return mark_crawlable(edges, sites, robots).filter("crawlable").drop("crawlable")


def listed_urls(listed: DataFrame, sites: DataFrame, robots: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Sitemap URLs (site_id, place, url) that may be crawled; of each site the first ``max_pages``, if given.

    Duplicates count towards the limit; they fall together when the walk starts.
    """
    usable = crawlable_links(listed.withColumnRenamed("url", "dst"), sites, robots).withColumnRenamed("dst", "url")
    if max_pages is None:
        return usable
    return top_per(usable, ["site_id"], [F.asc("place"), F.asc("url")], max_pages)


def frontier_seed(sites: DataFrame, listed: DataFrame) -> DataFrame:
    """Roots at depth 0 and sitemap URLs at depth 1, each URL once at its least depth."""
    roots = sites.select(F.col("id").alias("site_id"), normalize_url("url").alias("url"), F.lit(0).alias("depth"))
    maps = listed.select("site_id", normalize_url("url").alias("url"), F.lit(1).alias("depth"))
    return roots.unionByName(maps).groupBy("site_id", "url").agg(F.min("depth").alias("depth"))


def unseen_links(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """Targets that were not visited yet, once each."""
    found = edges.select("site_id", F.col("dst").alias("url")).distinct()
    return found.join(visited.select("site_id", "url"), ["site_id", "url"], "left_anti")


def bfs(
    edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int | None = None
) -> DataFrame:
    """Depth of every URL that can be reached within ``max_depth`` steps, all sites at once.

    Seeds (site_id, url, depth) enter at their own depth. One round per level, at most
    ``max_depth`` of them. Edges lie in buckets by source and levels in buckets by URL, all in
    the shared folder: a round moves the URLs it reached, once, and nothing else; the plan
    does not grow, and a lost executor costs the round it was in.
    With ``max_pages`` a site stops admitting URLs, in (depth, url) order; what
    is not admitted is not followed.
    """
    key = ["site_id", "url"]
    links = edges.select("site_id", F.col("src").alias("url"), F.col("dst").alias("_next"))
    links = cut_into_buckets(links, "edges", key)
    levels: list[DataFrame] = []
    for depth in range(max_depth + 1):
        candidates = seeds.filter(F.col("depth") == depth).select(*key)
        if levels:
            reached = links.join(levels[-1], key).select("site_id", F.col("_next").alias("url"))
            candidates = candidates.unionByName(reached)
        fresh = candidates.distinct()
        # One after the other: a union of the levels would not lie in buckets.
        for level in levels:
            fresh = fresh.join(level, key, "left_anti")
        if max_pages is not None:
            fresh = _admit(fresh, levels, max_pages)
        levels.append(cut_into_buckets(fresh, "frontier", key))
    return reduce(DataFrame.unionByName, [level.withColumn("depth", F.lit(d)) for d, level in enumerate(levels)])


def _admit(fresh: DataFrame, levels: list[DataFrame], max_pages: int) -> DataFrame:
    places = top_per(fresh, ["site_id"], [F.asc("url")], max_pages, "_place")
    if not levels:
        return places.drop("_place")
    used = reduce(DataFrame.unionByName, levels).groupBy("site_id").agg(F.count("*").alias("_used"))
    room = F.col("_place") + F.coalesce("_used", F.lit(0)) <= max_pages
    return places.join(used, "site_id", "left").filter(room).drop("_place", "_used")


def crawl_budget(frontier: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """First ``max_pages`` URLs of each site by depth, then URL."""
    return top_per(frontier, ["site_id"], [F.asc("depth"), F.asc("url")], max_pages)


def link_degree(marked: DataFrame) -> DataFrame:
    """Distinct out-links, crawlable out-links and in-links of every URL among marked edges."""
    once = marked.groupBy("site_id", "src", "dst").agg(F.max("crawlable").alias("_c"))
    one, none = F.lit(1), F.lit(0)
    ends = F.array(
        F.struct(F.col("src").alias("url"), one.alias("o"), F.col("_c").cast("int").alias("c"), none.alias("i")),
        F.struct(F.col("dst").alias("url"), none.alias("o"), none.alias("c"), one.alias("i")),
    )
    sides = once.select("site_id", F.inline(ends))
    return sides.groupBy("site_id", "url").agg(
        F.sum("o").alias("out_links"), F.sum("c").alias("crawlable_links"), F.sum("i").alias("in_links")
    )


def low_yield(facts: DataFrame, crawlable: DataFrame) -> DataFrame:
    """Shallow pages with next to no crawlable links: candidates for a rendered fetch."""
    shallow = facts.filter(F.col("depth") <= PROBE_MAX_DEPTH).select("site_id", "url", "depth")
    near = crawlable.select("site_id", F.col("src").alias("url"), "dst").join(shallow, ["site_id", "url"], "left_semi")
    counts = near.distinct().groupBy("site_id", "url").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return (
        shallow.join(counts, ["site_id", "url"], "left")
        .filter(n <= PROBE_LOW_LINKS)
        .select("site_id", "url", "depth", n.cast("bigint").alias("crawlable_links"))
    )


def render_promotion(probes: DataFrame, rendered: DataFrame) -> DataFrame:
    """Sites to switch to rendered fetching.

    ``probes``   low-yield pages (site_id, url, depth).
    ``rendered`` (site_id, url, crawlable_links) of rendered copies; a probe without one failed.

    A site tries its first few low-yield pages and stops at two failures or at
    the first copy with enough links.
    """
    order = [F.asc("depth"), F.asc("url")]
    tried = top_per(probes.select("site_id", "url", "depth"), ["site_id"], order, PROBE_ATTEMPTS, "attempt")
    copies = rendered.select("site_id", "url", F.col("crawlable_links").alias("_n"))
    results = tried.join(copies, ["site_id", "url"], "left")
    before = Window.partitionBy("site_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    failures = F.coalesce(F.count_if(F.col("_n").isNull()).over(before), F.lit(0))
    won = F.coalesce(F.max(F.col("_n")).over(before) >= PROBE_PROMOTE_LINKS, F.lit(False))
    run = results.withColumn("_run", (failures < PROBE_FAILURES) & ~won).filter("_run")
    return run.groupBy("site_id").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("_n").isNull()).alias("failures"),
        F.coalesce(F.max("_n") >= PROBE_PROMOTE_LINKS, F.lit(False)).alias("promoted"),
    )


def title_from_url(url: str) -> Column:
    """Readable title from the last path segment, else the host."""

    def name(path: Column) -> Column:
        last = F.element_at(F.split(path, "/"), -1)
        return title_case(F.translate(last, "-_", "  "))

    path = F.regexp_replace(url_path(url), "^/+|/+$", "")
    return F.when(path != "", name(path)).otherwise(url_host(url))


def sitemap_fallback(listed: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Stand-in pages for a blocked site: listed URLs (site_id, url, pos) that were never
    fetched; of each site the first ``max_pages``, if given."""
    kept = listed if max_pages is None else top_per(listed, ["site_id"], [F.asc("pos"), F.asc("url")], max_pages)
    pages = kept.select("site_id", "url", F.lit(1).alias("depth"), title_from_url("url").alias("title"))
    empty = {h: F.lit("") for h in ("content_hash", "metadata_hash", "headings_hash", "text_hash")}
    return score_pages(pages.withColumns(empty).withColumn("http_status", F.lit(0)))
