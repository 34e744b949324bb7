"""Every operator over the derived inputs, with the SQL that says what it must give."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import sql as S
from checks import views as V
from linkloom.functions import classify, text, urls
from linkloom.operators import (
    backlog, curation, dedup, extract, feed, fetchlog, graph, history, listing, render, rewrites, schedule, snapshot,
)
from linkloom.operators import robots as robots_txt
from linkloom.plans.refresh import refresh
from linkloom.session import cut_lineage, shared_path
from linkloom.sources import pagestore, sinks, sitemaps
from linkloom.sources import state as tables
from linkloom.streaming import feeds, runner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HASHES = ["metadata_hash", "headings_hash", "text_hash", "content_hash"]
FACT_COLUMNS = (
    "page_id, url, title, description, headings, main_text, array_to_string(links, ' ') AS links, canonical_url, "
    + ", ".join(HASHES)
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: plain(fn(spark, sf))
        if oracle is not None:
            ORACLES[name] = S.with_ctes(oracle)
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Time stamps without a zone, as the SQL side has them."""
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else df


# Runs of letters that have case, and what lies between them.
LETTER_RUNS = r"'[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+'"


def words(column: str) -> Column:
    return F.array_join(column, " ").alias(column)


# --- sources and sinks ---------------------------------------------------------------------------


@query("scan_pages", "SELECT page_id, url, html FROM pages")
def _(spark, sf):
    return V.raw_pages(spark, sf)


@query(
    "page_extract",
    f"SELECT {FACT_COLUMNS} FROM facts",
)
def _(spark, sf):
    found = V.facts(spark, sf)
    return found.select(
        "page_id", "url", "title", "description", F.array_join("headings", "||").alias("headings"), "main_text",
        words("links"), "canonical_url", *HASHES,
    )


@query(
    "page_extract_nested",
    """WITH t AS (SELECT page_id, page_id % 45 AS deep, 'Page ' || page_id AS word FROM pages),
            x AS (SELECT page_id, word, lower(array_to_string(list_transform(range(0, deep + 1), lambda i: word || CASE WHEN i < deep THEN ' item' ELSE '' END), ' ')) AS main_text FROM t)
       SELECT page_id, word AS title, word AS headings, lower(word) || ' ' || main_text AS main_text, sha256(word) AS headings_hash,
              sha256(lower(word) || ' ' || main_text) AS text_hash FROM x""",
)
def _(spark, sf):
    # Lists in lists, up to 44 deep: the innermost text comes once at each level, and in its paragraph.
    deep, word = (F.col("page_id") % 45).cast("int"), F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    body = F.concat(F.repeat(F.lit("<ul><li>"), deep), F.lit("<p>"), word, F.lit("</p>"), F.when(deep > 0, " item").otherwise(""), F.repeat(F.lit("</li></ul>"), deep))
    html = F.concat(F.lit("<html><body><h1>"), word, F.lit("</h1>"), body, F.lit("</body></html>"))
    found = extract.extract_pages(V.raw_pages(spark, sf).withColumn("html", html))
    return found.select("page_id", "title", F.array_join("headings", "||").alias("headings"), "main_text", "headings_hash", "text_hash")


@query("sitemap_expand", "SELECT site_id, array_to_string(place, '.') AS place, url FROM listed")
def _(spark, sf):
    docs = V.sitemap_docs(spark, sf)
    roots = docs.select("site_id", F.col("page_id").cast("int").alias("pos"), "url")
    listed = sitemaps.expand_sitemaps(roots, docs)
    return listed.select("site_id", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "url")


@query(
    "sitemap_budget",
    """SELECT site_id, array_to_string(place, '.') AS place, url FROM listed
       QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY place, url) <= 20""",
)
def _(spark, sf):
    docs = V.sitemap_docs(spark, sf)
    roots = docs.select("site_id", F.col("page_id").cast("int").alias("pos"), "url")
    listed = sitemaps.expand_sitemaps(roots, docs, max_pages=20)
    return listed.select("site_id", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "url")


S.CTES["listed_inside"] = rf"""
SELECT l.site_id, l.place, l.url AS dst FROM listed l JOIN page_sites s ON s.id = l.site_id WHERE {S.host_of("l.url")} = s.domain
  AND NOT regexp_matches(lower({S.path_of("l.url")}), '\.(png|jpg|jpeg|gif|svg|ico|webp|pdf|zip|tar|gz|mp4|mp3|wav|css|js|woff|woff2|ttf|eot)$')
  AND NOT regexp_matches(lower({S.path_of("l.url")}), '/(login|signin|signup|register|admin)')"""
S.CTES["blocked_listed"] = S.blocked("listed_inside")


@query(
    "sitemap_urls",
    """SELECT site_id, array_to_string(place, '.') AS place, dst AS url FROM listed_inside WHERE dst NOT IN (SELECT url FROM blocked_listed)""",
)
def _(spark, sf):
    docs = V.sitemap_docs(spark, sf)
    roots = docs.select("site_id", F.col("page_id").cast("int").alias("pos"), "url")
    usable = graph.listed_urls(sitemaps.expand_sitemaps(roots, docs), V.page_sites(spark, sf), _robots(spark, sf))
    return usable.select("site_id", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "url")


@query(
    "robots_sitemaps",
    r"""SELECT host, pos, trim(line[9:]) AS url FROM (SELECT host, pos, trim(line) AS line FROM robot_lines)
        WHERE lower(line) LIKE 'sitemap:%' AND trim(line[9:]) <> ''""",
)
def _(spark, sf):
    return robots_txt.robots_sitemaps(V.robots(spark, sf))


S.CTES["named_maps"] = """
SELECT site_id, pos, trim(l[9:]) AS url FROM (SELECT site_id, pos, trim(line) AS l FROM robot_lines)
WHERE lower(l) LIKE 'sitemap:%' AND trim(l[9:]) <> ''"""


@query(
    "sitemap_roots",
    """SELECT site_id, pos, url FROM named_maps UNION ALL
       SELECT id, 0, regexp_extract(url, '^([^:]+)://', 1) || '://' || domain || '/sitemap.xml' FROM page_sites
       WHERE id NOT IN (SELECT site_id FROM named_maps)""",
)
def _(spark, sf):
    bodies = V.robots(spark, sf)
    named = robots_txt.robots_sitemaps(bodies).join(bodies.select("host", "site_id"), "host")
    return sitemaps.default_roots(V.page_sites(spark, sf), named.select("site_id", "pos", "url"))


@query("read_state", "SELECT id, url, domain, title || '!' AS title, created_at FROM sites")
def _(spark, sf):
    root = shared_path(spark, "state")
    tables.write_state(V.sites(spark, sf), "sites", f"{root}/sites/v=1", check=True)
    first = tables.read_state(spark, "sites", f"{root}/sites/v=1")
    tables.write_state(first.withColumn("title", F.concat("title", F.lit("!"))), "sites", f"{root}/sites/v=2")
    return tables.read_state(spark, "sites", f"{root}/sites/v=2").select("id", "url", "domain", "title", "created_at")


@query(
    "write_state",
    """SELECT id, site_id, url, content_hash, array_to_string(links, ' ') AS links, is_active, category, relevance_score, depth,
              created_at AS first_seen_at FROM stored""",
)
def _(spark, sf):
    path = f"{shared_path(spark, 'state')}/pages/v=1"
    tables.write_state(V.stored(spark, sf), "pages", path, check=True)
    return tables.read_state(spark, "pages", path).select(
        "id", "site_id", "url", "content_hash", words("links"), "is_active", "category", "relevance_score", "depth", "first_seen_at"
    )


S.CTES["all_sites"] = "SELECT id, url FROM sites UNION ALL SELECT id, url FROM sites WHERE id % 100 = 0"


@query(
    "repeated_keys",
    """SELECT * FROM (
       SELECT 'sites' AS tbl, 'id' AS key, id::VARCHAR AS value, count(*) AS copies FROM all_sites GROUP BY id
       UNION ALL SELECT 'sites', 'url', url, count(*) FROM all_sites GROUP BY url
       UNION ALL SELECT 'pages', 'id', id::VARCHAR, count(*) FROM stored GROUP BY id
       UNION ALL SELECT 'pages', 'site_id, url', site_id || ', ' || url, count(*) FROM stored GROUP BY site_id, url
       UNION ALL SELECT 'crawl_jobs', 'id', id::VARCHAR, count(*) FROM jobs GROUP BY id
       UNION ALL SELECT 'crawl_tasks', 'id', id::VARCHAR, count(*) FROM tasks GROUP BY id
       UNION ALL SELECT 'crawl_tasks', 'idempotency_key', k, count(*) FROM (SELECT 'crawl-job-' || (id % 7000) AS k FROM tasks) GROUP BY k
       UNION ALL SELECT 'generated_files', 'id', id::VARCHAR, count(*) FROM files GROUP BY id
       UNION ALL SELECT 'monitoring_schedules', 'id', id::VARCHAR, count(*) FROM schedules GROUP BY id
       UNION ALL SELECT 'monitoring_schedules', 'site_id', site_id::VARCHAR, count(*) FROM schedules GROUP BY site_id) WHERE copies > 1""",
)
def _(spark, sf):
    key = F.concat(F.lit("crawl-job-"), (F.col("id") % 7000).cast("string"))
    sites = V.sites(spark, sf)
    return tables.repeated_keys(
        {
            "sites": sites.select("id", "url").unionByName(sites.filter("id % 100 = 0").select("id", "url")),
            "pages": V.stored(spark, sf),
            "crawl_jobs": V.jobs(spark, sf),
            "crawl_tasks": V.tasks(spark, sf).withColumn("idempotency_key", key),
            "generated_files": V.files(spark, sf),
            "monitoring_schedules": V.schedules(spark, sf),
        }
    )


@query("export_index", "SELECT site_id, content || chr(10) AS content FROM newest_file")
def _(spark, sf):
    out = shared_path(spark, "export")
    sinks.export_index(V.files(spark, sf).withColumn("content", F.concat("content", F.lit("\n"))), out)
    read = spark.read.schema("value string, site_id bigint").text(out, wholetext=True)
    return read.select("site_id", F.col("value").alias("content"))


@query("page_event_source", "SELECT page_id, url FROM pages")
def _(spark, sf):
    stream = V.page_stream(spark, sf).select("page_id", "url")
    return runner.drained(stream, shared_path(spark, "arrivals")).drop("batch")


@query(
    "json_columns",
    """SELECT id, '{"max_depth":' || attempt_count || ',"max_pages":' || (priority + 50) || '}' AS payload,
              attempt_count AS max_depth, priority + 50 AS max_pages FROM tasks""",
)
def _(spark, sf):
    packed = V.tasks(spark, sf).select(
        "id",
        F.to_json(F.struct(F.col("attempt_count").alias("max_depth"), (F.col("priority") + 50).alias("max_pages"))).alias("payload"),
    )
    read = packed.withColumn("_p", F.from_json("payload", "max_depth int, max_pages int"))
    return read.select("id", "payload", "_p.max_depth", "_p.max_pages")


@query("json_links", "SELECT page_id, to_json(links)::VARCHAR AS links_json, len(links) AS links FROM facts")
def _(spark, sf):
    packed = V.facts(spark, sf).select("page_id", F.to_json("links").alias("links_json"))
    return packed.withColumn("links", F.size(F.from_json("links_json", "array<string>")).cast("bigint"))


# --- projections ---------------------------------------------------------------------------------


@query("url_normalize", f"SELECT page_id, {S.nurl('url')} AS url FROM pages")
def _(spark, sf):
    return V.raw_pages(spark, sf).select("page_id", urls.normalize_url("url").alias("url"))


@query(
    "url_parts",
    f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, {S.host_of("url")} AS host, {S.path_of("url")} AS path,
               {S.site_id(S.host_of("url"))} AS site_id FROM pages""",
)
def _(spark, sf):
    cut = V.raw_pages(spark, sf).select("page_id", urls.url_parts("url").alias("p"))
    return cut.select("page_id", "p.scheme", F.col("p.netloc").alias("host"), "p.path", urls.site_key("p.netloc").alias("site_id"))


def _hrefs(page: DataFrame) -> DataFrame:
    """Ways to write a link, tried on every page."""
    n = F.col("page_id").cast("string")
    kinds = F.array(
        F.concat(n, F.lit(".html")),
        F.concat(F.lit("../up/"), n, F.lit("/")),
        F.concat(F.lit("/abs/./x/../"), n, F.lit(";v=1?q#f")),
        F.concat(F.lit("//Other.example/"), n, F.lit("/")),
        F.lit("#top"),
        F.lit("?page=3"),
        F.concat(F.lit("HTTPS://Third.example/A/"), n),
        F.lit("mailto:me@example.com"),
        F.lit("javascript:void(0)"),
    )
    return page.withColumn("hrefs", kinds)


@query(
    "link_resolve",
    rf"""WITH b AS (SELECT page_id, {S.host_of("url")} AS h, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS s, {S.path_of("url")} AS p,
                           {S.nurl("url")} AS own FROM pages),
          d AS (SELECT *, regexp_replace(p, '[^/]*$', '') AS dir FROM b),
          r AS (SELECT page_id, unnest([s || '://' || h || dir || page_id || '.html',
                 s || '://' || h || regexp_replace(dir, '[^/]*/$', '') || 'up/' || page_id, s || '://' || h || '/abs/' || page_id,
                 s || '://other.example/' || page_id, own, own, 'https://third.example/A/' || page_id, NULL, NULL]) AS url,
                 unnest(range(0, 9))::INT AS pos FROM d)
        SELECT page_id, pos, url FROM r""",
)
def _(spark, sf):
    pages = _hrefs(V.raw_pages(spark, sf).select("page_id", "url"))
    resolved = urls.resolve_all("url", "hrefs")
    return pages.select("page_id", F.posexplode(resolved).alias("pos", "url"))


@query("page_category", f"SELECT page_id, url, depth, {S.category('url')} AS category FROM url_variants")
def _(spark, sf):
    pages = V.url_variants(spark, sf)
    return pages.select("page_id", "url", "depth", classify.page_category("url", "depth").alias("category"))


@query(
    "page_relevance",
    f"""SELECT page_id, category, relevance_score, greatest(0::DOUBLE, least(1::DOUBLE, round(raw + 0.1::DOUBLE, 2))) AS listed_score
        FROM (SELECT page_id, category, {S.relevance("url")} AS relevance_score, {S.relevance("url").split("round(", 1)[1].rsplit(", 2)", 1)[0]} AS raw
              FROM (SELECT *, {S.category("url")} AS category FROM url_variants))""",
)
def _(spark, sf):
    scored = extract.score_pages(V.url_variants(spark, sf))
    listed = classify.page_relevance("url", "depth", "category", "true")
    return scored.select("page_id", "category", "relevance_score", listed.alias("listed_score"))


@query("page_fingerprint", "SELECT page_id, metadata_hash, headings_hash, text_hash, content_hash FROM facts")
def _(spark, sf):
    bare = V.facts(spark, sf).select("page_id", "title", "description", "headings", "main_text")
    return extract.fingerprint(bare).select("page_id", *HASHES)


@query(
    "text_normalize",
    r"SELECT doc_id, lower(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS text FROM documents",
)
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query(
    "title_from_url",
    f"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(replace(replace(string_split(trim({S.path_of("url")}, '/'), '/')[-1], '-', ' '), '_', ' '),
          {LETTER_RUNS}), lambda r: upper(r[1]) || lower(r[2:])), '') AS title FROM url_variants""",
)
def _(spark, sf):
    return V.url_variants(spark, sf).select("page_id", graph.title_from_url("url").alias("title"))


@query(
    "sitemap_fallback",
    f"""SELECT site_id, url, title, category, {S.relevance("url", "category", "1")} AS relevance_score, 0 AS http_status FROM (
          SELECT site_id, url, {S.category("url", "1")} AS category,
             array_to_string(list_transform(regexp_extract_all(replace(replace(string_split(trim({S.path_of("url")}, '/'), '/')[-1], '-', ' '), '_', ' '),
             {LETTER_RUNS}), lambda r: upper(r[1]) || lower(r[2:])), '') AS title
          FROM url_variants)""",
)
def _(spark, sf):
    listed = V.url_variants(spark, sf).select("site_id", "url", F.col("page_id").alias("pos"))
    return graph.sitemap_fallback(listed).select("site_id", "url", "title", "category", "relevance_score", "http_status")


@query(
    "site_title_clean",
    """SELECT id, trim(CASE WHEN contains(t, ' - ') THEN string_split(t, ' - ')[1] WHEN contains(t, ' | ') THEN string_split(t, ' | ')[1]
          WHEN contains(t, ' — ') THEN string_split(t, ' — ')[1] WHEN contains(t, ' · ') THEN string_split(t, ' · ')[1]
          WHEN contains(t, ' : ') THEN string_split(t, ' : ')[1] ELSE t END) AS title FROM (SELECT id, coalesce(title, domain) AS t FROM page_sites)""",
)
def _(spark, sf):
    return V.page_sites(spark, sf).select("id", text.strip_tagline(F.coalesce("title", "domain")).alias("title"))


@query("md_link", f"SELECT id, {S.md_link('title', 'u', 'description')} AS line FROM (SELECT *, url || '(' || depth || ')' AS u FROM catalog)")
def _(spark, sf):
    url = F.concat("url", F.lit("("), F.col("depth").cast("string"), F.lit(")"))
    return V.catalog(spark, sf).select("id", text.md_link(F.col("title"), url, F.col("description")).alias("line"))


@query(
    "listing_line",
    """SELECT n.site_id, n.list_id, n.url, '[' || n.list_id || '] ' || n.title || CASE WHEN coalesce(n.description, '') = ''
          OR (coalesce(s.description, '') <> '' AND lower(trim(n.description)) = lower(trim(s.description))) OR lower(trim(n.description)) = lower(trim(n.title)) THEN ''
          ELSE ' — ' || n.description END AS line
       FROM numbered n LEFT JOIN page_sites s ON s.id = n.site_id""",
)
def _(spark, sf):
    return listing.listing_lines(_numbered(spark, sf), V.page_sites(spark, sf))


@query("fetch_outcome", "SELECT event_id, host, outcome, reason FROM reasons")
def _(spark, sf):
    return fetchlog.classify_fetch(V.fetch_log(spark, sf)).select("event_id", "host", "outcome", "reason")


@query(
    "progress_pct",
    """SELECT id, CASE WHEN max_pages > 0 THEN least(floor(pages_crawled::DOUBLE / max_pages * 100 + 0.5::DOUBLE), 100) ELSE 0 END::INT AS progress_pct,
              CASE WHEN pages_found > 0 THEN floor(pages_crawled::DOUBLE / pages_found * 100 + 0.5::DOUBLE) ELSE 0 END::INT AS found_pct FROM jobs""",
)
def _(spark, sf):
    return history.progress(V.jobs(spark, sf)).select("id", "progress_pct", "found_pct")


def _overview(spark, sf):
    return history.site_overview(V.sites(spark, sf), V.jobs(spark, sf), V.files(spark, sf), V.schedules(spark, sf))


@query(
    "status_labels",
    """SELECT site_id, CASE latest_crawl_status WHEN 'pending' THEN 'Queued' WHEN 'running' THEN 'Crawling' WHEN 'generating' THEN 'Generating'
          WHEN 'completed' THEN 'Completed' WHEN 'failed' THEN 'Failed' ELSE 'Not Crawled' END AS crawl_label,
        CASE WHEN index_generated AND index_edited THEN 'Edited' WHEN index_generated THEN 'Ready' WHEN latest_crawl_status = 'running' THEN 'Pending'
          WHEN latest_crawl_status = 'failed' THEN 'Unavailable' ELSE 'Not generated' END AS index_label,
        CASE WHEN schedule_cron_expression IS NULL THEN 'Not set' WHEN schedule_active THEN 'Active' ELSE 'Paused' END AS schedule_label FROM overview""",
)
def _(spark, sf):
    return history.label_overview(_overview(spark, sf)).select("site_id", "crawl_label", "index_label", "schedule_label")


@query(
    "retry_schedule",
    f"""SELECT id, crawl_job_id, CASE WHEN dead THEN 'dead_letter' ELSE 'failed' END AS status, CASE WHEN NOT dead THEN d END AS retry_in_seconds,
          coalesce(nullif(last_error, ''), 'Unknown worker failure') AS last_error, CASE WHEN NOT dead THEN 'pending' END AS job_status,
          CASE WHEN NOT dead THEN 'Retrying (attempt ' || attempt_count || '/' || max_attempts || '): ' || last_error END AS job_error,
          CASE WHEN NOT dead THEN TIMESTAMP '{V.NOW}' + to_seconds(d) END AS available_at
        FROM (SELECT *, attempt_count >= max_attempts AS dead, (15 * pow(2, greatest(attempt_count - 1, 0)))::BIGINT AS d FROM tasks)""",
)
def _(spark, sf):
    failures = V.tasks(spark, sf).withColumn("error", F.col("last_error"))
    return backlog.retry_plan(failures, V.ts(V.NOW), F.lit(0.0))


@query("plan_parse", "SELECT site_id, site_description, section_pos, section, entry_pos, id, title, description FROM entries")
def _(spark, sf):
    return curation.parse_plans(V.plans(spark, sf))


@query(
    "plan_descriptions",
    """SELECT s.id, coalesce(nullif(p.j->>'site_description', ''), s.description) AS description FROM page_sites s LEFT JOIN good_plans p ON p.site_id = s.id""",
)
def _(spark, sf):
    return curation.adopt_descriptions(V.page_sites(spark, sf), V.plans(spark, sf)).select("id", "description")


@query("plan_invalid", "SELECT site_id FROM plans WHERE site_id NOT IN (SELECT site_id FROM good_plans)")
def _(spark, sf):
    return curation.split_plans(V.plans(spark, sf))[1]


@query(
    "index_description",
    r"""SELECT s.id AS site_id, coalesce(nullif(regexp_extract(f.content, '(?m)^> ([^\r\n]+)$', 1), ''), nullif(s.description, '')) AS description
        FROM sites s LEFT JOIN newest_file f ON f.site_id = s.id""",
)
def _(spark, sf):
    return render.index_description(history.latest_per_site(V.files(spark, sf)), V.sites(spark, sf))


# --- filters -------------------------------------------------------------------------------------


def _robots(spark, sf):
    return V.robots(spark, sf).select("host", "body")


def _crawlable(spark, sf, found):
    return graph.crawlable_links(V.edges_of(found), V.page_sites(spark, sf), _robots(spark, sf))


@query("crawlable_links", "SELECT site_id, src, pos, dst FROM crawlable")
def _(spark, sf):
    return _crawlable(spark, sf, V.facts(spark, sf)).select("site_id", "src", "pos", "dst")


@query(
    "redirected_sites",
    f"""SELECT s.id, CASE WHEN m.host IS NOT NULL AND m.host <> s.domain THEN m.url ELSE s.url END AS url, coalesce(m.host, s.domain) AS domain
        FROM page_sites s LEFT JOIN (SELECT id, CASE n % 3 WHEN 0 THEN 'www.' || domain ELSE domain END AS host,
          'https://' || CASE n % 3 WHEN 0 THEN 'www.' || domain ELSE domain END || '/start' AS url FROM page_sites WHERE n % 4 <> 0) m ON m.id = s.id""",
)
def _(spark, sf):
    own = V.page_sites(spark, sf)
    size = F.length("domain")
    host = F.when(size % 3 == 0, F.concat(F.lit("WWW."), "domain")).otherwise(F.col("domain"))
    final = F.when(size % 4 != 0, F.concat(F.lit("https://"), host, F.lit("/start/?from=root"))).otherwise("gone")
    return graph.redirected_sites(own, own.select(F.col("id").alias("site_id"), final.alias("final_url"))).select("id", "url", "domain")


S.CTES["link_urls"] = "SELECT DISTINCT dst FROM tag_links"
S.CTES["blocked_links"] = S.blocked("link_urls")


@query("robots_filter", "SELECT dst AS url FROM link_urls WHERE dst NOT IN (SELECT url FROM blocked_links)")
def _(spark, sf):
    links = V.facts(spark, sf).select(F.explode("links").alias("url")).distinct()
    return robots_txt.robots_filter(links, _robots(spark, sf))


@query(
    "challenge_pages",
    """SELECT page_id FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ACCESS denied' || html WHEN 1 THEN repeat('x', 60000) || 'Access Denied' || html
          WHEN 2 THEN 'Attention Required! |' || chr(10) || ' CLOUDFLARE' || html WHEN 3 THEN 'blocked' || chr(10) || 'bot' || html ELSE html END AS h FROM pages)
       WHERE regexp_matches(h, '(?i)access denied|just a moment[.][.][.]|enable javascript and cookies to continue|challenge-platform|checking your browser|cf-browser-verification|pardon our interruption|please verify you are a human|blocked.*bot')
          OR regexp_matches(h, '(?is)attention required.*cloudflare')""",
)
def _(spark, sf):
    kind = F.col("page_id") % 5
    html = (
        F.when(kind == 0, F.concat(F.lit("ACCESS denied"), "html"))
        .when(kind == 1, F.concat(F.repeat(F.lit("x"), 60000), F.lit("Access Denied"), "html"))
        .when(kind == 2, F.concat(F.lit("Attention Required! |\n CLOUDFLARE"), "html"))
        .when(kind == 3, F.concat(F.lit("blocked\nbot"), "html"))
        .otherwise(F.col("html"))
    )
    return dedup.challenge_pages(V.raw_pages(spark, sf).withColumn("html", html)).select("page_id")


@query("junk_titles", "SELECT id, title FROM no_junk")
def _(spark, sf):
    once = dedup.dedup_url(V.catalog(spark, sf), dedup.input_order())
    return dedup.drop_junk(once).select("id", "title")


@query("conditional_state", "SELECT site_id, url FROM reusable")
def _(spark, sf):
    return snapshot.reusable_pages(V.stored(spark, sf)).select("site_id", "url")


@query("active_pages", "SELECT site_id, id, url, title, category, relevance_score, depth FROM catalog WHERE is_active ORDER BY site_id, relevance_score DESC, depth, url")
def _(spark, sf):
    return history.active_pages(V.catalog(spark, sf)).select("site_id", "id", "url", "title", "category", "relevance_score", "depth")


@query(
    "pages_since_job",
    """SELECT p.id, p.site_id, p.url, j.id AS job_id, p.last_checked_at FROM live_pages p JOIN passed_jobs j ON j.site_id = p.site_id
       WHERE p.is_active AND p.last_checked_at >= j.created_at""",
)
def _(spark, sf):
    found = history.pages_since_job(V.live_pages(spark, sf), history.recent_jobs(V.live_jobs(spark, sf), 3))
    return found.select("id", "site_id", "url", "job_id", "last_checked_at")


@query(
    "lookup_by_key",
    "SELECT j.id, j.site_id, j.status FROM jobs j JOIN orders o ON o.o_orderkey = j.id AND o.o_custkey + (o.o_totalprice > 200000)::INT = j.site_id",
)
def _(spark, sf):
    orders = V.table(spark, sf, "orders")
    wanted = orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") + (F.col("o_totalprice") > 200000).cast("int")).alias("site_id")
    )
    return history.lookup_all(V.jobs(spark, sf), wanted).select("id", "site_id", "status")


@query("request_validation", "SELECT request_id, url, max_depth, max_pages, coalesce(rejection, 'ok') AS verdict FROM judged")
def _(spark, sf):
    ok, rejected = rewrites.validate_requests(V.requests(spark, sf))
    both = ok.withColumn("verdict", F.lit("ok")).unionByName(rejected.withColumnRenamed("rejection", "verdict"))
    return both.select("request_id", "url", "max_depth", "max_pages", "verdict")


S.CTES["low"] = """
SELECT f.site_id, f.url, f.depth, count(DISTINCT c.dst) AS crawlable_links FROM facts f LEFT JOIN crawlable c ON c.site_id = f.site_id AND c.src = f.url
WHERE f.depth <= 1 GROUP BY f.site_id, f.url, f.depth HAVING count(DISTINCT c.dst) <= 1"""


@query("low_yield_pages", "SELECT site_id, url, depth, crawlable_links FROM low")
def _(spark, sf):
    found = cut_lineage(V.facts(spark, sf), "facts")
    return graph.low_yield(found, _crawlable(spark, sf, found))


# --- joins ---------------------------------------------------------------------------------------


def _snapshots(spark, sf):
    """Stored and crawled pages. Both come from one extraction here, so it is
    written once, like the tables of a real deployment."""
    found = cut_lineage(V.facts(spark, sf), "facts")
    return V.stored_of(found), V.crawl_of(found)


def _diff(spark, sf):
    return snapshot.snapshot_diff(*_snapshots(spark, sf))


@query("snapshot_diff", "SELECT site_id, url, change, not_modified FROM diff")
def _(spark, sf):
    return _diff(spark, sf)


@query("site_overview", "SELECT * FROM overview")
def _(spark, sf):
    return _overview(spark, sf)


@query(
    "unseen_links",
    """SELECT DISTINCT g.site_id, g.dst AS url FROM tag_graph g WHERE NOT EXISTS (SELECT 1 FROM page_base p WHERE p.site_id = g.site_id AND p.url = g.dst)""",
)
def _(spark, sf):
    return graph.unseen_links(V.tag_graph(spark, sf), V.page_base(spark, sf))


@query(
    "removed_pages",
    """SELECT p.site_id, p.url FROM stored p WHERE p.is_active AND NOT EXISTS (SELECT 1 FROM seen c WHERE c.site_id = p.site_id AND c.url = p.url)""",
)
def _(spark, sf):
    return snapshot.removed_pages(*_snapshots(spark, sf))


S.CTES["accepted"] = """SELECT request_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) ||
  regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(.*)$', 1), '/+$', '') AS url, max_depth, max_pages FROM judged WHERE rejection IS NULL"""


def _registered(spark, sf):
    ok, _rejected = rewrites.validate_requests(V.requests(spark, sf))
    return rewrites.register_sites(ok, V.sites(spark, sf), V.ts(V.NOW))


@query(
    "register_sites",
    f"""SELECT DISTINCT {S.site_id("a.url")} AS id, a.url, {S.host_of("a.url")} AS domain, TIMESTAMP '{V.NOW}' AS created_at
        FROM accepted a WHERE a.url NOT IN (SELECT url FROM sites)""",
)
def _(spark, sf):
    return _registered(spark, sf)[0].select("id", "url", "domain", "created_at")


@query(
    "register_jobs",
    f"""SELECT {S.site_id("'job|' || a.request_id")} AS id, coalesce(s.id, {S.site_id("a.url")}) AS site_id, 'pending' AS status, {", ".join(f"0 AS {c}" for c in rewrites.COUNTERS)}, a.max_pages, false AS index_regenerated,
               NULL::VARCHAR AS error_message, TIMESTAMP '{V.NOW}' AS created_at, TIMESTAMP '{V.NOW}' AS updated_at FROM accepted a LEFT JOIN sites s ON s.url = a.url""",
)
def _(spark, sf):
    return _registered(spark, sf)[1].drop("change_summary")


@query(
    "enqueue_tasks",
    f"""SELECT {S.site_id("'task|' || j.id")} AS id, j.site_id, j.id AS crawl_job_id, 'queued' AS status, 100 AS priority, 0 AS attempt_count, 5 AS max_attempts,
          TIMESTAMP '{V.NOW}' AS available_at, 'crawl-job-' || j.id AS idempotency_key, j.max_depth, j.max_pages
        FROM (SELECT {S.site_id("'job|' || a.request_id")} AS id, coalesce(s.id, {S.site_id("a.url")}) AS site_id, a.max_depth, a.max_pages, a.request_id
              FROM accepted a LEFT JOIN sites s ON s.url = a.url) j WHERE j.request_id % 4 <> 0""",
)
def _(spark, sf):
    ok, _rejected = rewrites.validate_requests(V.requests(spark, sf))
    jobs = _registered(spark, sf)[1]
    # A quarter of the tasks is there already.
    first = rewrites.enqueue_tasks(ok.filter("request_id % 4 = 0"), jobs, jobs.select(F.lit("").alias("idempotency_key")), V.ts(V.NOW))
    new = rewrites.enqueue_tasks(ok, jobs, first, V.ts(V.NOW))
    return new.select(
        "id", "site_id", "crawl_job_id", "status", "priority", "attempt_count", "max_attempts", "available_at", "idempotency_key",
        "payload.max_depth", "payload.max_pages",
    )


def _stored_catalog(spark, sf):
    """The catalog as the table it would be."""
    return cut_lineage(V.catalog(spark, sf), "catalog")


def _numbered(spark, sf):
    pages = _stored_catalog(spark, sf)
    return listing.assign_page_ids(dedup.clean_pages(pages))


def _resolved(spark, sf):
    return curation.resolve_plan(curation.parse_plans(V.plans(spark, sf)), _numbered(spark, sf))


@query("plan_resolve", "SELECT site_id, section_pos, section, entry_pos, url, title, description FROM resolved")
def _(spark, sf):
    return _resolved(spark, sf)


@query(
    "render_promotion",
    """WITH tried AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY depth, url) AS a FROM low QUALIFY a <= 3),
         res AS (SELECT t.site_id, t.a, CASE WHEN f.page_id % 4 <> 0 THEN len(f.links) END AS n FROM tried t JOIN facts f ON f.site_id = t.site_id AND f.url = t.url),
         run AS (SELECT *, coalesce(sum((n IS NULL)::INT) OVER w, 0) < 2 AND coalesce(max(n) OVER w, 0) < 3 AS go FROM res
                 WINDOW w AS (PARTITION BY site_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT site_id, count(*) AS attempts, count(*) FILTER (n IS NULL) AS failures, coalesce(max(n) >= 3, false) AS promoted FROM run WHERE go GROUP BY site_id""",
)
def _(spark, sf):
    found = cut_lineage(V.facts(spark, sf), "facts")
    rendered = found.withColumn("crawlable_links", F.when(F.col("page_id") % 4 != 0, F.size("links")))
    return graph.render_promotion(graph.low_yield(found, _crawlable(spark, sf, found)), rendered)


@query(
    "output_freshness",
    """SELECT j.site_id, j.id AS job_id, j.status, f.id AS file_id, f.crawl_job_id, j.status = 'completed' AND coalesce(f.crawl_job_id = j.id, false) AS is_current,
          j.status = 'running' OR (j.status = 'completed' AND NOT coalesce(f.crawl_job_id = j.id, false)) AS is_awaited
       FROM newest_job j LEFT JOIN (SELECT * FROM job_files QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, id DESC) = 1) f ON f.site_id = j.site_id""",
)
def _(spark, sf):
    return history.output_freshness(V.jobs(spark, sf), V.job_files(spark, sf))


# --- aggregations --------------------------------------------------------------------------------


@query("change_counts", "SELECT site_id, added, updated, removed, unchanged, changed FROM counts")
def _(spark, sf):
    return snapshot.change_counts(_diff(spark, sf))


@query(
    "change_summary",
    """SELECT c.site_id, '{"added":' || added || ',"updated":' || updated || ',"removed":' || removed || ',"unchanged":' || unchanged || ',"removed_urls":'
          || to_json(coalesce(r.urls, [])) || ',"active_pages":' || (added + updated + unchanged) || '}' AS change_summary
       FROM counts c LEFT JOIN (SELECT site_id, list(url ORDER BY url) AS urls FROM diff WHERE change = 'removed' GROUP BY site_id) r ON r.site_id = c.site_id""",
)
def _(spark, sf):
    return snapshot.change_summary(_diff(spark, sf))


S.CTES["stored_files"] = f"SELECT {S.site_id('domain')} AS site_id FROM page_sites0 WHERE n > 20"


@query(
    "regenerate_gate",
    "SELECT site_id, changed > 0 OR removed > 0 OR site_id NOT IN (SELECT site_id FROM stored_files) AS needs_rebuild FROM counts",
)
def _(spark, sf):
    have = V.page_sites(spark, sf).filter(F.length("domain") > 20).select(F.col("id").alias("site_id"))
    return snapshot.needs_rebuild(snapshot.change_counts(_diff(spark, sf)), have)


@query(
    "job_counters",
    """SELECT coalesce(c.site_id, k.site_id) AS site_id, 'completed' AS status, coalesce(added + updated + unchanged, 0)::INT + coalesce(k.n, 0)::INT AS pages_found,
          coalesce(added + updated + unchanged, 0)::INT AS pages_crawled, coalesce(changed, 0)::INT AS pages_changed, coalesce(added, 0)::INT AS pages_added,
          coalesce(updated, 0)::INT AS pages_updated, coalesce(removed, 0)::INT AS pages_removed, coalesce(unchanged, 0)::INT AS pages_unchanged, coalesce(k.n, 0)::INT AS pages_skipped,
          CASE WHEN c.site_id IS NOT NULL THEN changed > 0 OR removed > 0 OR c.site_id NOT IN (SELECT site_id FROM stored_files) END AS index_regenerated
       FROM counts c FULL JOIN (SELECT site_id, count(*) AS n FROM crawled WHERE (site_id, url) NOT IN (SELECT (site_id, url) FROM seen) GROUP BY site_id) k ON k.site_id = c.site_id""",
)
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    diff = snapshot.snapshot_diff(old, new)
    taken = diff.filter("change <> 'removed'").select("site_id", "url")
    skipped = new.join(taken, ["site_id", "url"], "left_anti").groupBy("site_id").agg(F.count("*").alias("pages_skipped"))
    have = V.page_sites(spark, sf).filter(F.length("domain") > 20).select(F.col("id").alias("site_id"))
    counts = snapshot.change_counts(diff)
    return snapshot.job_counters(counts, skipped, snapshot.needs_rebuild(counts, have))


@query(
    "site_stats",
    """SELECT count(*) AS total, count(*) FILTER (latest_crawl_status = 'completed') AS crawled, count(*) FILTER (latest_crawl_status = 'running') AS running,
          count(*) FILTER (index_generated) AS ready, count(*) FILTER (latest_crawl_status = 'failed') AS failed FROM overview""",
)
def _(spark, sf):
    return history.site_stats(_overview(spark, sf))


@query(
    "fetch_health",
    """SELECT f.host, f.job_id, count(*) FILTER (timeout OR error IS NULL) AS request_count, count(*) FILTER (timeout) AS timeout_count,
          round_even(coalesce(count(*) FILTER (timeout)::DOUBLE / nullif(count(*) FILTER (timeout OR error IS NULL), 0), 0), 4) AS timeout_rate,
          count(*) FILTER (accepted) AS success_count, CASE WHEN f.job_id IN (SELECT job_id FROM openings) THEN 1 ELSE 0 END AS circuit_open_count
       FROM fetch_log f GROUP BY f.host, f.job_id""",
)
def _(spark, sf):
    return fetchlog.fetch_health(V.fetch_log(spark, sf))


@query(
    "fallback_sites",
    """SELECT host, job_id, blocked_count FROM (SELECT host, job_id, count(*) FILTER (outcome IN ('blocked', 'challenge')) AS blocked_count,
          count(*) FILTER (outcome IN ('ok', 'not_modified')) AS taken FROM outcomes GROUP BY host, job_id)
       WHERE taken = 0 AND blocked_count > 0 AND job_id NOT IN (SELECT job_id FROM openings) AND host IN (SELECT 'h' || (p_partkey % 50) FROM part)""",
)
def _(spark, sf):
    log = V.fetch_log(spark, sf)
    listed = V.table(spark, sf, "part").select(F.concat(F.lit("h"), (F.col("p_partkey") % 50).cast("string")).alias("host"))
    return fetchlog.fallback_crawls(fetchlog.classify_fetch(log), log, listed)


@query(
    "category_counts",
    f"""SELECT site_id, section, count(*) AS pages FROM (SELECT site_id, CASE WHEN relevance_score < 0.3 THEN 'Optional' ELSE category END AS section FROM by_url)
        WHERE list_contains({S.SECTIONS}, section) GROUP BY site_id, section""",
)
def _(spark, sf):
    return render.category_counts(V.catalog(spark, sf))


S.CTES["clean_edges"] = f"SELECT site_id, src, {S.nurl('dst')} AS dst FROM edges"


@query(
    "link_degree",
    """SELECT site_id, url, count(*) FILTER (side = 'o') AS out_links, count(*) FILTER (side = 'c') AS crawlable_links, count(*) FILTER (side = 'i') AS in_links FROM (
         SELECT DISTINCT site_id, src AS url, dst AS other, 'o' AS side FROM clean_edges UNION ALL SELECT DISTINCT site_id, src, dst, 'c' FROM crawlable
         UNION ALL SELECT DISTINCT site_id, dst, src, 'i' FROM clean_edges) GROUP BY site_id, url""",
)
def _(spark, sf):
    return graph.link_degree(graph.mark_crawlable(V.edges_of(V.facts(spark, sf)), V.page_sites(spark, sf), _robots(spark, sf)))


@query("skip_reasons", "SELECT host, job_id, reason, count(*) AS skipped FROM reasons WHERE reason IS NOT NULL GROUP BY host, job_id, reason")
def _(spark, sf):
    return fetchlog.skip_reasons(fetchlog.classify_fetch(V.fetch_log(spark, sf)))


@query(
    "latest_crawl_time",
    """SELECT s.site_id, greatest(s.last_run_at, j.t) AS last_activity FROM schedules s
       LEFT JOIN (SELECT site_id, max(created_at) AS t FROM jobs GROUP BY site_id) j ON j.site_id = s.site_id""",
)
def _(spark, sf):
    return history.last_activity(V.schedules(spark, sf), V.jobs(spark, sf))


@query("render_index", S.rendered("catalog", "page_sites"))
def _(spark, sf):
    return render.render_index(V.page_sites(spark, sf), _stored_catalog(spark, sf))


@query(
    "assemble_plan",
    f"""SELECT site_id, content, sha256(content) AS content_hash FROM (
        SELECT g.site_id, {S.head_of("g.title", "g.about")} || coalesce(b.t, '') AS content FROM (
          SELECT p.site_id, trim(regexp_replace(regexp_replace(coalesce(s.title, s.domain), ' - .*$', ''), ' · .*$', '')) AS title,
                 coalesce(nullif(p.j->>'site_description', ''), s.description) AS about FROM good_plans p JOIN page_sites s ON s.id = p.site_id) g
        LEFT JOIN (SELECT site_id, string_agg(t, '' ORDER BY section_pos) AS t FROM (
          SELECT site_id, section_pos, chr(10) || '## ' || section || chr(10) || chr(10) || string_agg({S.md_link("title", "url", "description")} || chr(10), '' ORDER BY entry_pos) AS t
          FROM capped GROUP BY site_id, section_pos, section) GROUP BY site_id) b ON b.site_id = g.site_id)""",
)
def _(spark, sf):
    return curation.assemble_plan(V.page_sites(spark, sf), V.plans(spark, sf), _numbered(spark, sf))


# --- ranks and windows ---------------------------------------------------------------------------


@query("latest_job", "SELECT site_id, id, status, created_at FROM newest_job")
def _(spark, sf):
    return history.latest_per_site(V.jobs(spark, sf)).select("site_id", "id", "status", "created_at")


@query("latest_file", "SELECT site_id, id, content, content_hash, is_edited, created_at FROM newest_file")
def _(spark, sf):
    newest = history.latest_per_site(V.files(spark, sf))
    return newest.select("site_id", "id", "content", "content_hash", "is_edited", "created_at")


@query("dedup_url", "SELECT id, site_id, url FROM by_url")
def _(spark, sf):
    return dedup.dedup_url(V.catalog(spark, sf), dedup.input_order()).select("id", "site_id", "url")


@query("dedup_title", "SELECT id, site_id, url, title FROM clean")
def _(spark, sf):
    return dedup.clean_pages(V.catalog(spark, sf)).select("id", "site_id", "url", "title")


@query("page_ids", "SELECT id, site_id, url, list_id FROM numbered")
def _(spark, sf):
    return _numbered(spark, sf).select("id", "site_id", "url", "list_id")


@query("plan_cap", "SELECT site_id, section_pos, section, entry_pos, url, title, description FROM capped")
def _(spark, sf):
    return curation.plan_cap(_resolved(spark, sf))


@query(
    "link_order_dedup",
    "SELECT page_id, pos, link FROM (SELECT page_id, unnest(list_concat(links, links)) AS link, generate_subscripts(list_concat(links, links), 1)::INT - 1 AS pos FROM facts) WHERE link IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1",
)
def _(spark, sf):
    doubled = V.facts(spark, sf).withColumn("links", F.concat("links", "links"))
    return doubled.select("page_id", F.posexplode(graph.distinct_links(F.col("links"))).alias("pos", "link"))


@query("timeout_streak", "SELECT event_id, host, job_id, ts, timeout, streak FROM tally")
def _(spark, sf):
    return fetchlog.timeout_streak(V.fetch_log(spark, sf))


@query(
    "circuit_events",
    "SELECT *, row_number() OVER (PARTITION BY host, job_id ORDER BY ts, event_id) = 1 AS aborts FROM openings",
)
def _(spark, sf):
    return fetchlog.circuit_events(V.fetch_log(spark, sf))


@query(
    "abort_summary",
    """SELECT o.host, o.job_id, 'timeout_circuit_open' AS abort_reason, 'trigger=' || o.trigger || ' url=https://' || o.host || '/' || o.event_id || ' timeouts=' || o.timeouts
          || '/' || o.requests || ' streak=' || o.streak || ' stalled_for=' || printf('%.1f', (epoch_us(t.ts) - epoch_us(coalesce(t.last_success, t.started))) / 1e6) || 's' AS abort_detail,
          o.requests AS request_count, o.timeouts AS timeout_count, round_even(o.timeouts::DOUBLE / o.requests, 4) AS timeout_rate, o.streak AS consecutive_timeouts,
          1 AS circuit_open_count, (SELECT count(*) FROM fetch_log f WHERE f.job_id = o.job_id AND f.accepted AND (f.ts, f.event_id) <= (o.ts, o.event_id)) AS pages_crawled_so_far
       FROM openings o JOIN tally t ON t.event_id = o.event_id QUALIFY row_number() OVER (PARTITION BY o.job_id ORDER BY o.ts, o.event_id) = 1""",
)
def _(spark, sf):
    return fetchlog.abort_summaries(V.fetch_log(spark, sf))


@query("progress_changes", "SELECT * FROM progress_changed")
def _(spark, sf):
    return feed.progress_changes(V.progress_table(spark, sf))


@query(
    "heartbeat_gaps",
    """SELECT job_id, ts AS silent_from, nxt AS silent_to, (epoch_us(nxt) - epoch_us(ts)) // 15000000 AS heartbeats FROM feed_lead
       WHERE epoch_us(nxt) - epoch_us(ts) >= 15000000""",
)
def _(spark, sf):
    return feed.heartbeat_gaps(V.feed_rows(V.table(spark, sf, "events")))


# --- top-k ---------------------------------------------------------------------------------------


@query("recent_jobs", "SELECT site_id, id, created_at FROM jobs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, id DESC) <= 20")
def _(spark, sf):
    return history.recent_jobs(V.jobs(spark, sf)).select("site_id", "id", "created_at")


@query("file_history", "SELECT site_id, id, content, created_at FROM files QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, id DESC) <= 50")
def _(spark, sf):
    return history.file_history(V.files(spark, sf)).select("site_id", "id", "content", "created_at")


@query("recent_sites", "SELECT id, url, created_at FROM sites ORDER BY created_at DESC, id DESC LIMIT 5")
def _(spark, sf):
    return history.recent_sites(V.sites(spark, sf)).select("id", "url", "created_at")


@query(
    "top_pages",
    """SELECT site_id, url, relevance_score, relevance_score < 0.3 AS optional, row_number() OVER (PARTITION BY site_id, relevance_score < 0.3 ORDER BY relevance_score DESC, depth, url)::INT AS rank
       FROM clean QUALIFY rank <= CASE WHEN relevance_score < 0.3 THEN 5 ELSE 20 END""",
)
def _(spark, sf):
    best = listing.top_pages(dedup.clean_pages(V.catalog(spark, sf)))
    return best.select("site_id", "url", "relevance_score", "optional", "rank")


@query("crawl_budget", "SELECT site_id, url, depth FROM bfs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY depth, url) <= 60")
def _(spark, sf):
    return graph.crawl_budget(_walk(spark, sf), 60)


@query(
    "ready_tasks",
    f"""SELECT id, site_id, priority, available_at FROM tasks WHERE status IN ('queued', 'failed') AND available_at <= TIMESTAMP '{V.NOW}'
        AND (leased_until IS NULL OR leased_until < TIMESTAMP '{V.NOW}') ORDER BY priority, created_at, id LIMIT 100""",
)
def _(spark, sf):
    return backlog.ready_tasks(V.tasks(spark, sf), V.ts(V.NOW), 100).select("id", "site_id", "priority", "available_at")


# --- unions and rewrites -------------------------------------------------------------------------


@query(
    "frontier_seed",
    f"""SELECT site_id, url, min(depth) AS depth FROM (SELECT id AS site_id, {S.nurl("url")} AS url, 0 AS depth FROM page_sites
        UNION ALL SELECT site_id, url, 1 FROM page_base UNION ALL SELECT site_id, regexp_extract(url, '^(https?://[^/]*)', 1) || '/', 1 FROM page_base) GROUP BY site_id, url""",
)
def _(spark, sf):
    base = V.page_base(spark, sf)
    tops = base.select("site_id", F.regexp_extract("url", "^(https?://[^/]*)", 1).alias("url"))
    return graph.frontier_seed(V.page_sites(spark, sf), base.select("site_id", "url").unionByName(tops))


PROGRESS_COLUMNS = ", ".join(feed.PROGRESS)
NO_PROGRESS = ", ".join(f"NULL::INT AS {c}" for c in feed.PROGRESS)
S.CTES["finished"] = "SELECT * FROM passed_jobs WHERE status IN ('completed', 'failed')"


@query(
    "event_replay",
    f"""SELECT j.id AS job_id, 0 AS stage, p.id AS page_id, 'page_crawled' AS type, p.url, p.title, p.description, p.category, round(p.relevance_score, 2) AS relevance_score,
          p.depth, {NO_PROGRESS}, NULL::INT AS max_pages, NULL::VARCHAR AS error FROM live_pages p JOIN finished j ON j.site_id = p.site_id
          WHERE p.is_active AND p.last_checked_at >= j.created_at
        UNION ALL SELECT id, 1, NULL, 'progress', NULL, NULL, NULL, NULL, NULL, NULL, {PROGRESS_COLUMNS}, max_pages, NULL FROM finished
        UNION ALL SELECT id, 2, NULL, status, NULL, NULL, NULL, NULL, NULL, NULL, {", ".join("NULL" for _ in feed.PROGRESS)}, NULL,
          CASE WHEN status = 'failed' THEN error_message END FROM finished""",
)
def _(spark, sf):
    return feed.event_replay(history.recent_jobs(V.live_jobs(spark, sf), 3), V.live_pages(spark, sf))


MERGED_COLUMNS = (
    "id, site_id, url, canonical_url, title, description, content_hash, metadata_hash, headings_hash, text_hash,"
    " array_to_string(links, ' ') AS links, etag, http_status, is_active, first_seen_at, last_seen_at, last_checked_at, category, relevance_score, depth"
)


@query("snapshot_merge", f"SELECT {MERGED_COLUMNS} FROM merged")
def _(spark, sf):
    merged = snapshot.snapshot_merge(*_snapshots(spark, sf), V.ts(V.LATER))
    merged = merged.withColumn("links", words("links"))
    return merged.drop("last_modified", "created_at", "updated_at", "change")


def _laid_out(spark, sf):
    """The stored pages in parts and buckets, the crawl, and the sites of both."""
    old, new = _snapshots(spark, sf)
    path = shared_path(spark, "pages-table")
    sites = old.select("site_id").union(new.select("site_id"))
    return path, pagestore.write_pages(old, path, parts=4, buckets=8), new, sites


@query("pages_table_diff", "SELECT site_id, url, change, not_modified FROM diff")
def _(spark, sf):
    _, stored, new, sites = _laid_out(spark, sf)
    return pagestore.diff_pages(stored, new, sites, parts=4)


@query("pages_table_merge", f"SELECT {MERGED_COLUMNS} FROM merged")
def _(spark, sf):
    path, _, new, sites = _laid_out(spark, sf)
    pagestore.merge_pages(spark, path, new, V.ts(V.LATER), sites, parts=4, buckets=8)
    merged = pagestore.open_pages(spark, path, buckets=8).withColumn("links", words("links"))
    return merged.drop("last_modified", "created_at", "updated_at", "part")


@query("site_refresh", "SELECT id, url, domain, title, description FROM refreshed")
def _(spark, sf):
    return snapshot.site_refresh(V.page_sites(spark, sf), V.crawl_of(V.facts(spark, sf))).select("id", "url", "domain", "title", "description")


@query(
    "edit_overlay",
    """SELECT f.id, f.site_id, coalesce(e.c, f.content) AS content, CASE WHEN e.c IS NULL THEN f.content_hash ELSE sha256(e.c) END AS content_hash,
          f.is_edited OR e.c IS NOT NULL AS is_edited FROM files f LEFT JOIN (SELECT n.id, s.s_name || ' edited' AS c FROM newest_file n
          JOIN supplier s ON s.s_suppkey = n.site_id) e ON e.id = f.id""",
)
def _(spark, sf):
    edited = rewrites.edit_overlay(V.files(spark, sf), V.edits(spark, sf))
    return edited.select("id", "site_id", "content", "content_hash", "is_edited")


S.CTES["gone_sites"] = "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0"
S.CTES["gone_jobs"] = "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 300000"


@query(
    "cascade_delete",
    """SELECT 'sites' AS tbl, id, id AS site_id, NULL::BIGINT AS crawl_job_id FROM sites WHERE id NOT IN (SELECT id FROM gone_sites)
       UNION ALL SELECT 'pages', id, site_id, NULL FROM live_pages WHERE site_id NOT IN (SELECT id FROM gone_sites)
       UNION ALL SELECT 'crawl_jobs', id, site_id, NULL FROM jobs WHERE site_id NOT IN (SELECT id FROM gone_sites) AND id NOT IN (SELECT id FROM gone_jobs)
       UNION ALL SELECT 'crawl_tasks', id, site_id, crawl_job_id FROM tasks WHERE site_id NOT IN (SELECT id FROM gone_sites) AND crawl_job_id NOT IN (SELECT id FROM gone_jobs)
       UNION ALL SELECT 'generated_files', id, site_id, CASE WHEN crawl_job_id NOT IN (SELECT id FROM gone_jobs) THEN crawl_job_id END FROM files WHERE site_id NOT IN (SELECT id FROM gone_sites)
       UNION ALL SELECT 'monitoring_schedules', id, site_id, NULL FROM schedules WHERE site_id NOT IN (SELECT id FROM gone_sites)""",
)
def _(spark, sf):
    tables = {
        "sites": V.sites(spark, sf),
        "pages": V.live_pages(spark, sf),
        "crawl_jobs": V.jobs(spark, sf),
        "crawl_tasks": V.tasks(spark, sf),
        "generated_files": V.files(spark, sf),
        "monitoring_schedules": V.schedules(spark, sf),
    }
    gone = V.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    dropped = V.table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("id"))
    kept = rewrites.cascade_delete(tables, gone, dropped)
    result = None
    for name, df in kept.items():
        site = F.col("id" if name == "sites" else "site_id").alias("site_id")
        job = F.col("crawl_job_id") if "crawl_job_id" in df.columns else F.lit(None).cast("bigint")
        rows = df.select(F.lit(name).alias("tbl"), "id", site, job.alias("crawl_job_id"))
        result = rows if result is None else result.unionByName(rows)
    return result


@query(
    "schedule_upsert",
    f"""SELECT coalesce(s.id, {S.site_id("'schedule|' || r.site_id")}) AS id, coalesce(s.site_id, r.site_id) AS site_id, coalesce(r.cron_expression, s.cron_expression) AS cron_expression, coalesce(r.is_active, s.is_active) AS is_active,
          CASE WHEN r.site_id IS NULL THEN s.next_run_at WHEN r.is_active THEN u.t END AS next_run_at
       FROM schedules s FULL OUTER JOIN (SELECT * FROM schedule_requests QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY request_id DESC) = 1) r ON r.site_id = s.site_id LEFT JOIN upcoming u ON u.cron = r.cron_expression""",
)
def _(spark, sf):
    upserted = rewrites.schedule_upsert(V.schedules(spark, sf), V.schedule_requests(spark, sf), V.ts(V.NOW))
    return upserted.select("id", "site_id", "cron_expression", "is_active", "next_run_at")


@query(
    "schedule_delete",
    "SELECT id, site_id, cron_expression FROM schedules WHERE site_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000)",
)
def _(spark, sf):
    gone = V.table(spark, sf, "supplier").filter("s_acctbal < 3000").select(F.col("s_suppkey").alias("site_id"))
    return rewrites.delete_schedules(V.schedules(spark, sf), gone).select("id", "site_id", "cron_expression")


@query(
    "expired_leases",
    f"""SELECT id, CASE WHEN lost THEN 'failed' ELSE status END AS status, CASE WHEN lost THEN TIMESTAMP '{V.NOW}' ELSE available_at END AS available_at,
          CASE WHEN NOT lost THEN lease_owner END AS lease_owner, CASE WHEN NOT lost THEN leased_until END AS leased_until,
          CASE WHEN lost THEN coalesce(nullif(last_error, ''), 'Lease expired before worker heartbeat') ELSE last_error END AS last_error
        FROM (SELECT *, status = 'running' AND leased_until < TIMESTAMP '{V.NOW}' AS lost FROM tasks)""",
)
def _(spark, sf):
    given_back = backlog.expired_leases(V.tasks(spark, sf), V.ts(V.NOW))
    return given_back.select("id", "status", "available_at", "lease_owner", "leased_until", "last_error")


@query(
    "seen_backfill",
    f"""SELECT id, created_at AS first_seen_at, coalesce(t, created_at) AS last_seen_at FROM (SELECT *, CASE WHEN is_active THEN updated_at END AS t FROM stored)""",
)
def _(spark, sf):
    empty = {c: F.lit(None).cast("timestamp") for c in ("first_seen_at", "last_seen_at", "last_checked_at")}
    empty["updated_at"] = F.when(F.col("is_active"), F.col("updated_at"))
    filled = snapshot.backfill_seen(V.stored(spark, sf).withColumns(empty), V.ts(V.NOW))
    return filled.select("id", "first_seen_at", "last_seen_at")


# --- times ---------------------------------------------------------------------------------------


@query(
    "fire_times",
    """SELECT s.site_id, f.t AS fire_at FROM schedules s JOIN fired f ON f.cron = s.cron_expression
       WHERE s.is_active AND f.t >= TIMESTAMP '2024-01-03 05:00:00' AND f.t < TIMESTAMP '2024-02-20 12:00:00'""",
)
def _(spark, sf):
    return schedule.fire_times(V.schedules(spark, sf), V.ts("2024-01-03 05:00:00"), V.ts("2024-02-20 12:00:00"))


@query(
    "next_run",
    "SELECT s.site_id, CASE WHEN s.is_active THEN u.t END AS next_run_at FROM schedules s JOIN upcoming u ON u.cron = s.cron_expression",
)
def _(spark, sf):
    return schedule.next_run(V.schedules(spark, sf), V.ts(V.NOW))


KEY_SQL = "'site:' || {site} || ':cron:' || strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@query("idempotency_key", f"SELECT event_id, {KEY_SQL.format(site='user_id')} AS idempotency_key FROM events")
def _(spark, sf):
    key = schedule.idempotency_key(F.col("user_id"), F.col("ts"))
    return V.table(spark, sf, "events").select("event_id", key.alias("idempotency_key"))


# --- graph walk ----------------------------------------------------------------------------------


def _walk(spark, sf):
    # Written once: every level of the walk reads the edges.
    return graph.bfs(cut_lineage(V.tag_graph(spark, sf), "edges"), V.roots(spark, sf))


@query("bfs_depth", "SELECT site_id, url, depth FROM bfs")
def _(spark, sf):
    return _walk(spark, sf)


# --- streams -------------------------------------------------------------------------------------


@query("stream_page_feed", "SELECT DISTINCT user_id % 20 AS job_id, props AS url FROM events")
def _(spark, sf):
    arrivals = V.event_stream(spark, sf).select((F.col("user_id") % 20).alias("job_id"), F.col("props").alias("url"), "ts")
    once = feeds.page_feed(arrivals)
    return runner.drained(once, shared_path(spark, "page-feed")).select("job_id", "url")


def _folded(spark, stream, name, step):
    out = shared_path(spark, name)
    return runner.finished(spark, runner.folded(stream, out, step), out).drop("batch")


def _progress(spark, sf):
    return _folded(spark, V.progress_stream(spark, sf), "progress", feeds.progress_step)


@query("stream_progress", "SELECT * FROM progress_changed")
def _(spark, sf):
    return _progress(spark, sf)


@query(
    "stream_feed_events",
    f"""SELECT job_id, ts, event_id, 'progress' AS type, CASE WHEN status = 'generating' THEN status END AS phase, NULL::VARCHAR AS error, {PROGRESS_COLUMNS} FROM progress_changed
        UNION ALL SELECT job_id, ts, event_id, status, NULL, CASE WHEN status = 'failed' THEN error_message END, {PROGRESS_COLUMNS} FROM progress_changed
        WHERE status IN ('completed', 'failed')""",
)
def _(spark, sf):
    return feeds.feed_events(_progress(spark, sf))


@query(
    "stream_heartbeat",
    """SELECT job_id, ts AS silent_from, nxt AS silent_to, (epoch_us(nxt) - epoch_us(ts)) // 15000000 AS heartbeats FROM feed_lead
       WHERE epoch_us(nxt) - epoch_us(ts) >= 15000000""",
)
def _(spark, sf):
    return _folded(spark, V.feed_rows(V.event_stream(spark, sf)), "heartbeats", feeds.heartbeat_step())


@query(
    "stream_heartbeat_live",
    """WITH f AS (SELECT user_id % 5 AS job_id, ts FROM events WHERE event_id % 50 <> 0),
            l AS (SELECT job_id, ts, lead(ts) OVER (PARTITION BY job_id ORDER BY ts) AS nxt FROM f),
            b AS (SELECT job_id, ts, (epoch_us(coalesce(nxt, (SELECT max(ts) FROM events WHERE event_id % 50 = 0))) - epoch_us(ts)) // 15000000 AS n FROM l)
       SELECT job_id, ts AS silent_from, n AS heartbeats FROM b WHERE n > 0""",
)
def _(spark, sf):
    # Beats come at the ticks and at the end of a silence; here they are added up.
    beats = _folded(spark, V.ticking_stream(spark, sf), "live-heartbeats", feeds.heartbeat_step())
    whole = beats.groupBy("job_id", "silent_from").agg(F.sum("heartbeats").alias("heartbeats"))
    return whole.withColumn("silent_from", F.col("silent_from").cast("timestamp_ntz"))


@query(
    "stream_change_counts",
    """SELECT site_id, added, updated, 0::BIGINT AS removed, unchanged, changed FROM counts WHERE added + updated + unchanged > 0""",
)
def _(spark, sf):
    crawl = V.crawl_of(extract.extract_pages(V.with_site(V.page_stream(spark, sf))))
    out = shared_path(spark, "changes")
    stored = V.stored(spark, sf).repartitionByRange("site_id").sortWithinPartitions("site_id")
    return snapshot.change_counts(runner.finished(spark, runner.logged(crawl, out, feeds.change_step(cut_lineage(stored, "stored"))), out))


@query(
    "stream_enqueue_dedup",
    f"SELECT DISTINCT user_id % 20 AS site_id, {KEY_SQL.format(site='(user_id % 20)')} AS idempotency_key FROM events",
)
def _(spark, sf):
    triggers = V.event_stream(spark, sf).select((F.col("user_id") % 20).alias("site_id"), "ts")
    accepted = feeds.enqueue_dedup(triggers)
    return runner.drained(accepted, shared_path(spark, "triggers")).select("site_id", "idempotency_key")


@query(
    "enqueue_dedup",
    f"""SELECT {KEY_SQL.format(site="(user_id % 20)")} AS idempotency_key, any_value(user_id % 20) AS site_id, arg_min(event_id, ts) AS trigger_id FROM events GROUP BY 1""",
)
def _(spark, sf):
    triggers = V.table(spark, sf, "events").select((F.col("user_id") % 20).alias("site_id"), "ts", F.col("event_id").alias("trigger_id"))
    return schedule.accept_triggers(triggers)


@query(
    "stream_fetch_health",
    """SELECT host, job_id, count(*) FILTER (timeout OR error IS NULL) AS request_count, count(*) FILTER (timeout) AS timeout_count,
              count(*) FILTER (accepted) AS success_count FROM fetch_log GROUP BY host, job_id""",
)
def _(spark, sf):
    # The static view of the log, over streamed rows.
    health = feeds.fetch_health_feed(V.fetch_rows(V.event_stream(spark, sf)))
    return feeds.newest_per_key(runner.drained(health, shared_path(spark, "health"), "update"), ["host", "job_id"])


# --- the whole job -------------------------------------------------------------------------------

S.CTES["merged_active"] = "SELECT * FROM merged WHERE is_active"
S.CTES["due_sites"] = """
SELECT * FROM refreshed_seen WHERE id IN (SELECT site_id FROM counts WHERE changed > 0 OR removed > 0 OR site_id NOT IN (SELECT site_id FROM stored_files))"""


@query("refresh_index", S.rendered("merged_active", "due_sites"))
def refresh_index(spark, sf):
    """Extract a crawl, compare it with the stored pages, merge, render what changed."""
    known = V.page_sites(spark, sf)
    have = known.filter(F.length("domain") > 20).select(F.col("id").alias("site_id"))
    done = refresh(known, *_snapshots(spark, sf), have, V.ts(V.LATER))
    return done.rebuilt


S.CTES["job_of"] = "SELECT id AS site_id, id + 5 AS job_id FROM page_sites"


def _jobs_of(spark, sf):
    own = V.page_sites(spark, sf)
    return own.select((F.col("id") + 5).alias("id"), F.col("id").alias("site_id"), F.lit(200).alias("max_pages"), V.ts(V.NOW).alias("created_at"))


def _files_of(spark, sf):
    """Rows of the indexes that some sites have."""
    known = V.page_sites(spark, sf).filter(F.length("domain") > 20)
    return known.select(F.length("domain").cast("bigint").alias("id"), F.col("id").alias("site_id"))


def _refreshed(spark, sf):
    return refresh(V.page_sites(spark, sf), *_snapshots(spark, sf), _files_of(spark, sf), V.ts(V.LATER), jobs=_jobs_of(spark, sf))


S.CTES["due_or_empty"] = """
SELECT * FROM refreshed_seen WHERE id NOT IN (SELECT site_id FROM stored_files) OR id IN (SELECT site_id FROM counts WHERE changed > 0 OR removed > 0)"""
S.CTES["rebuilt"] = S.rendered("merged_active", "due_or_empty")


@query(
    "refresh_files",
    f"""SELECT (SELECT coalesce(max(n), 0) FROM page_sites0 WHERE n > 20) + row_number() OVER (ORDER BY r.site_id) AS id, r.site_id, j.job_id AS crawl_job_id,
          r.content, r.content_hash, false AS is_edited, TIMESTAMP '{V.LATER}' AS created_at, TIMESTAMP '{V.LATER}' AS updated_at
        FROM rebuilt r JOIN job_of j ON j.site_id = r.site_id""",
)
def _(spark, sf):
    return _refreshed(spark, sf).files


@query(
    "refresh_jobs",
    f"""SELECT j.job_id AS id, j.site_id, 'completed' AS status, coalesce(added + updated + unchanged, 0)::INT AS pages_crawled, coalesce(added, 0)::INT AS pages_added,
          coalesce(updated, 0)::INT AS pages_updated, coalesce(removed, 0)::INT AS pages_removed, coalesce(unchanged, 0)::INT AS pages_unchanged, 200 AS max_pages,
          j.site_id IN (SELECT id FROM due_or_empty) AS index_regenerated, (added + updated + unchanged)::INT AS active_pages, NULL::VARCHAR AS error_message,
          TIMESTAMP '{V.NOW}' AS created_at, TIMESTAMP '{V.LATER}' AS updated_at
        FROM job_of j LEFT JOIN counts c ON c.site_id = j.site_id""",
)
def _(spark, sf):
    return _refreshed(spark, sf).jobs.select(
        "id", "site_id", "status", "pages_crawled", "pages_added", "pages_updated", "pages_removed", "pages_unchanged", "max_pages",
        "index_regenerated", "change_summary.active_pages", "error_message", "created_at", "updated_at",
    )


@query(
    "refresh_twice",
    """SELECT site_id, 0::BIGINT AS changed, 0::BIGINT AS removed, count(*) AS unchanged, 0::BIGINT AS rebuilt FROM merged_active GROUP BY site_id""",
)
def _(spark, sf):
    """A second refresh with the same crawl finds nothing changed and renders nothing."""
    sites, (stored, crawled), files = V.page_sites(spark, sf), _snapshots(spark, sf), _files_of(spark, sf)
    jobs = _jobs_of(spark, sf)
    first = refresh(sites, stored, crawled, files, V.ts(V.LATER), jobs=jobs)
    have = files.unionByName(first.files.select("id", "site_id"))
    root = shared_path(spark, "state")
    tables.write_state(first.pages, "pages", f"{root}/pages/v=1", check=True)
    again = refresh(first.sites, tables.read_state(spark, "pages", f"{root}/pages/v=1"), crawled, have, V.ts(V.LATER), jobs=jobs)
    rebuilt = again.files.groupBy("site_id").agg(F.count("*").alias("rebuilt"))
    seen = again.counts.filter("unchanged > 0 OR changed > 0 OR removed > 0")
    return seen.join(rebuilt, "site_id", "left").select("site_id", "changed", "removed", "unchanged", F.coalesce("rebuilt", F.lit(0)).alias("rebuilt"))


# The cleaning and planning of the catalog, over the pages of a refresh.
for _name, _source in [("by_url", "catalog"), ("no_junk", "by_url"), ("clean", "no_junk"), ("numbered", "clean"), ("resolved", "numbered"), ("capped0", "resolved"), ("capped", "capped0")]:
    _now = {"catalog": "merged_active"}.get(_source, f"new_{_source}")
    S.CTES[f"new_{_name}"] = re.sub(rf"\b{_source}\b", _now, S.CTES[_name])
S.CTES["due_going"] = "SELECT * FROM due_sites WHERE n % 7 <> 2"
S.CTES["unplanned"] = "SELECT * FROM due_going WHERE id NOT IN (SELECT site_id FROM good_plans)"


def untagged(title: str) -> str:
    """A title up to the first tagline separator there is, by rank."""
    cases = " ".join(f"WHEN contains({title}, '{x}') THEN string_split({title}, '{x}')[1]" for x in (" - ", " | ", " — ", " · ", " : "))
    return f"trim(CASE {cases} ELSE {title} END)"


def assembled(sites: str, capped: str) -> str:
    return f"""
        SELECT site_id, content, sha256(content) AS content_hash FROM (
        SELECT g.site_id, {S.head_of("g.title", "g.about")} || coalesce(b.t, '') AS content FROM (
          SELECT p.site_id, {untagged('coalesce(s.title, s.domain)')} AS title,
                 coalesce(nullif(p.j->>'site_description', ''), s.description) AS about FROM good_plans p JOIN {sites} s ON s.id = p.site_id) g
        LEFT JOIN (SELECT site_id, string_agg(t, '' ORDER BY section_pos) AS t FROM (
          SELECT site_id, section_pos, chr(10) || '## ' || section || chr(10) || chr(10) || string_agg({S.md_link("title", "url", "description")} || chr(10), '' ORDER BY entry_pos) AS t
          FROM {capped} GROUP BY site_id, section_pos, section) GROUP BY site_id) b ON b.site_id = g.site_id)"""


@query("refresh_planned", f"SELECT * FROM ({assembled('due_going', 'new_capped')}) UNION ALL SELECT * FROM ({S.rendered('merged_active', 'unplanned')})")
def _(spark, sf):
    """Some sites have a plan, some crawls were aborted."""
    known = V.page_sites(spark, sf)
    stopped = known.filter(F.length("domain") % 7 == 2).select(F.col("id").alias("site_id"))
    done = refresh(known, *_snapshots(spark, sf), _files_of(spark, sf), V.ts(V.LATER), V.plans(spark, sf), stopped)
    return done.rebuilt
