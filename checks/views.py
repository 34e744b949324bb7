"""Inputs derived from the given tables, on the Spark side.

Every view keeps all rows of its table. What a real deployment would find in
its own tables (stored pages, robots files, plans, tasks) is spelled out here
from the columns at hand; ``checks.sql`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import sha256
from linkloom.functions.urls import normalize_url, site_key, url_host
from linkloom.operators.dedup import dedup_url
from linkloom.operators.extract import extract_pages, score_pages
from linkloom.schemas import table_schema
from linkloom.session import cut_lineage, shared_path
from linkloom.sources.pages import read_page_stream, scan_pages

# Category paths plus one that only looks like one, and none.
PREFIXES = [
    "/docs", "/documentation", "/api", "/guide", "/tutorial", "/getting-started", "/quickstart", "/install",
    "/setup", "/blog", "/news", "/example", "/demo", "/sample", "/faq", "/changelog", "/release", "/about",
    "/team", "/contact", "/pricing", "/api-reference", "",
]
TITLES = ["Page Not Found", "404 oops", "Template talk:x", "2006", "February 19", "", "Home", " home "]
CRONS = ["15 */6 * * *", "30 3 * * *", "0 4 * * 1", "45 5 12 * *"]
BEGIN = "2024-01-01 00:00:00"
NOW = "2024-01-15 00:00:00"
LATER = "2024-06-01 00:00:00"


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def after(start: str, unit: str, amount: Column) -> Column:
    return F.timestamp_add(unit, amount.cast("int"), ts(start))


def pick(values: list[str], index: Column) -> Column:
    """``values[index]`` or NULL."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    return scan_pages(spark, f"{sf}/pages.parquet")


def with_site(pages: DataFrame) -> DataFrame:
    """Canonical URL, host, site id and depth of fetched pages."""
    return (
        pages.withColumn("raw_url", F.col("url"))
        .withColumn("url", normalize_url("url"))
        .withColumn("host", url_host("url"))
        .withColumn("site_id", site_key("host"))
        .withColumn("depth", (F.col("page_id") % 4).cast("int"))
    )


def page_base(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without their text, one per canonical URL."""
    return dedup_url(with_site(raw_pages(spark, sf).drop("html")), [F.asc("page_id")])


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of every page, one per canonical URL. The text is cut before anything is shuffled."""
    raw = scan_pages(spark, f"{sf}/pages.parquet")
    return dedup_url(extract_pages(with_site(raw)), [F.asc("page_id")])


def page_sites(spark: SparkSession, sf: str) -> DataFrame:
    base = with_site(raw_pages(spark, sf).drop("html"))
    root = F.regexp_extract("url", "^(https?://[^/]*)", 1)
    sites = base.groupBy(F.col("host").alias("domain")).agg(
        F.min(root).alias("url"), F.min("page_id").alias("_first")
    )
    size = F.length("domain")
    title = F.when(size % 3 == 1, F.concat("domain", F.lit(" - Docs | More"))).when(
        size % 3 == 2, F.concat("domain", F.lit(" · Site"))
    )
    return sites.select(
        site_key("domain").alias("id"),
        "url",
        "domain",
        title.alias("title"),
        F.when(size % 2 == 0, F.concat(F.lit("About "), "domain")).alias("description"),
        after(BEGIN, "HOUR", F.col("_first")).alias("created_at"),
        after(BEGIN, "HOUR", F.col("_first") + 1).alias("updated_at"),
    )


def crawl_of(found: DataFrame) -> DataFrame:
    """The new crawl: pages asked for with ``page=2`` came back as "not modified"."""
    unchanged = F.contains("raw_url", F.lit("page=2"))
    etag = F.when(F.col("depth") == 1, F.concat(F.lit("c"), F.col("page_id").cast("string"))).when(
        F.col("depth") == 2, ""
    )
    return found.withColumns(
        {
            "not_modified": unchanged,
            "http_status": F.when(unchanged, 304).otherwise(200),
            "etag": etag,
            "last_modified": F.lit(None).cast("string"),
        }
    )


def stored(spark: SparkSession, sf: str) -> DataFrame:
    return stored_of(facts(spark, sf))


def stored_of(found: DataFrame) -> DataFrame:
    """The pages as stored before: ``.html`` pages had another address then, some
    texts were others, some pages were inactive, some rows are incomplete."""
    old = found.withColumn("url", F.regexp_replace("url", r"\.html$", ""))
    old = score_pages(dedup_url(old, [F.asc("page_id")]))
    lang = F.regexp_extract("url", "^https?://[^/]*/([a-z]+)/", 1)
    born = after(BEGIN, "HOUR", F.col("page_id"))
    seen = after(BEGIN, "HOUR", F.col("page_id") + 24)
    state = old.withColumns(
        {
            "id": F.col("page_id"),
            "text_hash": F.when(F.contains("raw_url", F.lit("utm_source")), sha256(F.concat(F.lit("old"), "url"))).otherwise(
                F.col("text_hash")
            ),
            "headings_hash": F.when(lang != "es", F.col("headings_hash")),
            "canonical_url": F.when(lang == "de", ""),
            "links": F.when(lang == "fr", F.array().cast("array<string>")).otherwise(F.col("links")),
            "etag": F.concat(F.lit("s"), F.col("page_id").cast("string")),
            "last_modified": F.lit(None).cast("string"),
            "http_status": F.lit(200),
            "is_active": ~(F.endswith("raw_url", F.lit("#top")) | (F.col("page_id") % 11 == 0)),
            "first_seen_at": born,
            "last_seen_at": seen,
            "last_checked_at": seen,
            "created_at": born,
            "updated_at": seen,
        }
    )
    return state.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema("pages").fields])


def url_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Pages below the paths that name a category."""
    base = page_base(spark, sf)
    head = F.regexp_extract("url", "^(https?://[^/]*)", 1)
    rest = F.regexp_extract("url", "^https?://[^/]*(.*)$", 1)
    return base.withColumn("url", F.concat(head, pick(PREFIXES, F.col("page_id") % 23), rest))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pages with all kinds of sections, titles and descriptions."""
    base = facts(spark, sf)
    head = F.regexp_extract("url", "^(https?://[^/]*)", 1)
    rest = F.regexp_extract("url", "^https?://[^/]*(.*)$", 1)
    title = F.coalesce(pick(TITLES, F.col("page_id") % 25), F.col("title"))
    kind = F.col("page_id") % 7
    told = (
        F.when(kind == 1, F.concat(F.lit("About "), "host")).when(kind == 2, title).when(kind > 2, F.col("description"))
    )
    varied = base.select(
        F.col("page_id").alias("id"),
        "site_id",
        F.concat(head, pick(PREFIXES, F.col("page_id") % 23), rest).alias("url"),
        title.alias("title"),
        told.alias("description"),
        "depth",
        (F.col("page_id") % 9 != 0).alias("is_active"),
    )
    return score_pages(varied)


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """One selection plan per site; some are truncated, incomplete or cut off by the model."""

    def entry(i: Column | str, title: Column, description: Column) -> Column:
        return F.concat(
            F.lit('{"id":'), i, F.lit(',"title":"'), title, F.lit('","description":"'), description, F.lit('"}')
        )

    def lit_entry(i: int, title: str, description: str) -> Column:
        return entry(F.lit(str(i)), F.lit(title), F.lit(description))

    many = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.lit(200)),
            lambda i: entry(i.cast("string"), F.concat(F.lit("T"), i.cast("string")), F.lit("")),
        ),
        ",",
    )
    start = [lit_entry(2, "", ""), lit_entry(1, "One", "First page"), lit_entry(2, "Again", ""), lit_entry(999999, "No", "")]
    optional = F.concat(F.lit(',"optional":['), lit_entry(3, "Opt", "Maybe"), F.lit("]"))
    size = F.length("domain")
    text = F.concat(
        F.lit('{"site_description":"'),
        F.when(size % 4 == 0, "").otherwise(F.concat(F.lit("All about "), "domain")),
        F.lit('","sections":[{"name":"Start","pages":['),
        F.concat_ws(",", *start),
        F.lit(']},{"name":"None","pages":[]},{"name":"Rest","pages":['),
        many,
        F.lit("]}]"),
        F.when(size % 11 == 0, "").otherwise(optional),
        F.lit("}"),
    )
    return page_sites(spark, sf).select(
        F.col("id").alias("site_id"),
        F.when(size % 5 == 0, F.left(text, F.lit(60))).otherwise(text).alias("json"),
        F.when(size % 7 == 0, "length").otherwise("stop").alias("finish_reason"),
    )


def robots(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("domain")
    first = F.concat(
        F.lit("User-agent: *\nDisallow: /x\\E(*[^\nDisallow: /th\nAllow: /the$\nAllow: /tha*n\nSitemap: https://"), "domain", F.lit("/sitemap.xml\n")
    )
    second = F.concat(
        F.lit("# all\nUser-agent: Bot\nDisallow: /\n\nUser-Agent: other\nuser-agent: *\nDisallow: /*n$ # short\nDisallow: /de\nAllow: /de\nSITEMAP:   https://"),
        "domain",
        F.lit("/a.xml  \r\nsitemap:\nSitemap: https://"),
        "domain",
        F.lit("/b.xml"),
    )
    # A file that names every agent there is and lists its pages one by one.
    number = lambda i: F.lower(F.hex(i.cast("long")))
    agents = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("User-agent: bot"), i.cast("string")))
    listed = F.transform(
        F.sequence(F.lit(1), F.lit(10_000)),
        lambda i: F.concat(F.when(i % 3 == 0, "Allow: /").otherwise("Disallow: /"), number(i)),
    )
    long = F.concat(
        F.array_join(agents, "\n"), F.lit("\nUser-agent: *\n"), F.array_join(listed, "\n"),
        F.lit("\nAllow: /d*e*$\nDisallow: /*a*b*\nSitemap: https://"), "domain", F.lit("/c.xml"),
    )
    return page_sites(spark, sf).select(
        F.col("id").alias("site_id"),
        F.col("domain").alias("host"),
        F.when(size == 25, long)
        .when(size % 3 == 0, first).when(size % 3 == 1, second).otherwise("").alias("body"),
    )


def edges_of(found: DataFrame) -> DataFrame:
    """Links of every page, bent so that each filter has something to drop."""
    out = found.select("site_id", "page_id", F.col("url").alias("src"), F.posexplode("links").alias("pos", "link"))
    head = F.regexp_extract("link", "^(https?://[^/]*)", 1)
    rest = F.regexp_extract("link", "^https?://[^/]*(.*)$", 1)
    kind = (F.col("page_id") + F.col("pos")) % 8
    dst = (
        F.when(kind == 1, F.concat("link", F.lit(".PDF")))
        .when(kind == 2, F.concat(head, F.lit("/login"), rest))
        .when(kind == 3, F.concat(F.lit("https://other.example"), rest))
        .when(kind == 4, F.concat("link", F.lit("?page=2")))
        .when(kind == 5, F.concat(head, F.lit("/Administration"), rest))
        .otherwise(F.col("link"))
    )
    return out.select("site_id", "page_id", "src", "pos", dst.alias("dst"))


def tag_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Pages lead to the words in their menu, words to the pages that show them."""
    out = facts(spark, sf).select("site_id", "url", F.explode("links").alias("link"))
    both = F.expr("array(named_struct('src', url, 'dst', link), named_struct('src', link, 'dst', url))")
    return out.select("site_id", F.inline(both))


def roots(spark: SparkSession, sf: str) -> DataFrame:
    """First page of every site."""
    base = page_base(spark, sf)
    return base.groupBy("site_id").agg(F.min("url").alias("url")).withColumn("depth", F.lit(0))


def sitemap_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One document per page: an index of neighbours, or the page's links."""
    page = F.col("page_id")

    def child(step: int) -> Column:
        return F.concat(
            F.lit("<sitemap><loc>https://maps.example/"), (page + step).cast("string"), F.lit(".xml</loc><lastmod>x</lastmod></sitemap>")
        )

    def written(u: Column) -> Column:
        """An address as XML has it; some characters as numbers."""
        plain = F.replace(u, F.lit("&"), F.lit("&amp;"))
        numbers = F.replace(F.replace(plain, F.lit("en"), F.lit("&#101;&#x6E;")), F.lit("/de"), F.lit("&#47;de"))
        return F.when(page % 3 == 0, numbers).otherwise(plain)

    kind = page % 8
    listed = F.array_join(
        F.transform(
            F.col("links"),
            lambda u: F.concat(F.lit("<url><loc> "), written(u), F.lit("/ </loc><image:loc>https://i.example/x</image:loc></url>")),
        ),
        "",
    )
    xml = (
        F.when(kind == 0, F.concat(F.lit("<sitemapindex>"), child(1), child(2), F.lit("</sitemapindex>")))
        .when(kind == 1, F.concat(F.lit("<sitemapindex>"), child(2), child(3), F.lit("</sitemapindex>")))
        .when(kind == 3, F.concat(F.lit("<sitemapindex>"), child(2), F.lit("</sitemapindex>")))
        .otherwise(F.concat(F.lit('<?xml version="1.0"?><urlset>'), listed, F.lit("</urlset>")))
    )
    return facts(spark, sf).select("site_id", "page_id", F.concat(F.lit("https://maps.example/"), page.cast("string"), F.lit(".xml")).alias("url"), xml.alias("xml"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")

    def n(mod: int) -> Column:
        return (key % mod).cast("int")

    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    return table(spark, sf, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("site_id"),
        status.alias("status"),
        (n(200) + n(23)).alias("pages_found"),
        n(200).alias("pages_crawled"),
        (n(11) + n(6)).alias("pages_changed"),
        n(11).alias("pages_added"),
        n(6).alias("pages_updated"),
        n(5).alias("pages_removed"),
        n(50).alias("pages_unchanged"),
        n(23).alias("pages_skipped"),
        F.when(key % 10 == 0, 0).otherwise(200).alias("max_pages"),
        F.when(status == "failed", F.concat(F.lit("error "), "o_orderpriority")).alias("error_message"),
        F.col("o_orderdate").alias("created_at"),
        F.timestamp_add("HOUR", F.lit(1), F.col("o_orderdate")).alias("updated_at"),
    )


def live_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs again, begun within the month of the event log."""
    return jobs(spark, sf).withColumn("created_at", after(BEGIN, "MINUTE", F.col("id") * 37 % 43200))


def live_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page rows of the sites those jobs belong to."""
    e = table(spark, sf, "events")
    rows = e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("site_id"),
        F.concat(F.lit("https://s.example/docs/"), F.col("event_id").cast("string")).alias("url"),
        F.col("event_type").alias("title"),
        F.col("props").alias("description"),
        (F.col("event_id") % 4).cast("int").alias("depth"),
        (F.col("value") > 2).alias("is_active"),
        F.col("ts").alias("last_checked_at"),
    )
    return score_pages(rows)


def sites(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    domain = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit(".example.com"))
    return table(spark, sf, "customer").select(
        key.alias("id"),
        F.concat(F.lit("https://"), domain).alias("url"),
        domain.alias("domain"),
        F.col("c_name").alias("title"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("description"),
        after(BEGIN, "MINUTE", key * 7 % 1000).alias("created_at"),
        after(BEGIN, "MINUTE", key * 11 % 5000).alias("updated_at"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    made = after(BEGIN, "HOUR", key * 37 % 500)
    return table(spark, sf, "documents").select(
        key.alias("id"),
        (key % 100).alias("site_id"),
        key.alias("crawl_job_id"),
        F.concat(F.lit("# "), "source", F.lit("\n\n> "), "lang", F.lit(" site\n"), "text").alias("content"),
        sha256(F.col("text")).alias("content_hash"),
        (key % 3 == 0).alias("is_edited"),
        made.alias("created_at"),
        made.alias("updated_at"),
    )


def job_files(spark: SparkSession, sf: str) -> DataFrame:
    """Indexes with the job that made them, on that job's site."""
    job = table(spark, sf, "orders").select(F.col("o_orderkey").alias("crawl_job_id"), F.col("o_custkey").alias("site_id"))
    made = files(spark, sf).select("id", "crawl_job_id", "created_at", "is_edited")
    return made.join(job, "crawl_job_id")


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("id"),
        key.alias("site_id"),
        pick(CRONS, F.col("s_nationkey") % 4).alias("cron_expression"),
        (key % 3 != 0).alias("is_active"),
        F.when(key % 5 != 0, after("1998-01-01 00:00:00", "DAY", key * 13 % 1500)).alias("last_run_at"),
        F.when(key % 3 != 0, after(NOW, "HOUR", key)).alias("next_run_at"),
        ts(BEGIN).alias("created_at"),
        ts(BEGIN).alias("updated_at"),
    )


def schedule_requests(spark: SparkSession, sf: str) -> DataFrame:
    """New settings, half of them for sites that have no schedule yet; some sites ask twice."""
    key = F.col("s_suppkey")
    twice = table(spark, sf, "supplier").withColumn("again", F.explode(F.sequence(F.lit(0), F.when(key % 3 == 0, 1).otherwise(0))))
    return twice.select(
        (key * 2 + F.col("again")).alias("request_id"),
        (key + F.when(F.col("s_acctbal") > 5000, 0).otherwise(1_000_000)).alias("site_id"),
        pick(CRONS, (F.col("s_nationkey") + 1 + F.col("again")) % 4).alias("cron_expression"),
        (key % 4 != 0).alias("is_active"),
    )


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    return fetch_rows(table(spark, sf, "events"))


def fetch_rows(events: DataFrame) -> DataFrame:
    """Fetch attempts, from event rows."""
    kind, event, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    timeout = (kind == "error") | ((user % 5 == 0) & (kind != "view"))
    status = (
        F.when(kind == "signup", 403)
        .when(kind == "click", F.element_at(F.array(F.lit(304), F.lit(404), F.lit(200), F.lit(500)), (event % 4 + 1).cast("int")))
        .otherwise(200)
    )
    error = F.when(~timeout & (kind == "purchase") & (event % 6 == 0), F.concat(F.lit("ConnectError: "), "props"))
    return events.select(
        "event_id",
        F.concat(F.lit("h"), user.cast("string")).alias("host"),
        # A host is crawled anew every 15 days.
        (user * 100_000 + F.floor(F.unix_date(F.to_date("ts")) / 15)).alias("job_id"),
        F.concat(F.lit("https://h"), user.cast("string"), F.lit("/"), event.cast("string")).alias("url"),
        "ts",
        timeout.alias("timeout"),
        F.when(~timeout & error.isNull(), status).alias("status"),
        F.when(kind == "view", "text/html; charset=utf-8").when(event % 3 == 1, "application/pdf ; q=1").when(event % 3 == 2, "text/html").alias("content_type"),
        F.when(event % 7 == 0, "<title>Just A MOMENT...</title>").otherwise(F.col("props")).alias("body"),
        (user % 2 == 0).alias("has_state"),
        error.alias("error"),
        ((kind == "view") & ~timeout).alias("accepted"),
    )


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event_id")
    status = (
        F.when(F.col("event_type") == "view", "queued")
        .when(F.col("event_type") == "click", "failed")
        .when(F.col("event_type") == "error", "running")
        .when(F.col("event_type") == "purchase", "completed")
        .otherwise("dead_letter")
    )
    leased = F.timestamp_add("SECOND", F.floor(F.col("value") * 60).cast("int"), F.col("ts"))
    return table(spark, sf, "events").select(
        event.alias("id"),
        F.col("user_id").alias("site_id"),
        event.alias("crawl_job_id"),
        status.alias("status"),
        (event % 3 * 100).cast("int").alias("priority"),
        (event % 6).cast("int").alias("attempt_count"),
        F.lit(5).alias("max_attempts"),
        F.col("ts").alias("available_at"),
        F.when((status == "running") | (event % 4 == 0), leased).alias("leased_until"),
        F.when(status == "running", F.concat(F.lit("w"), (event % 10).cast("string"))).alias("lease_owner"),
        F.when(event % 4 == 1, "").when(event % 4 == 2, F.concat(F.lit("boom "), "props")).alias("last_error"),
        F.col("ts").alias("created_at"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl requests: known sites, one much wanted new site per nation, and bad ones."""
    key, nation = F.col("id"), F.col("_nation")
    known = sites(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("_nation")), "id"
    )
    kind = key % 6
    url = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat("url", F.lit("//")))
        .when(kind == 2, F.concat(F.lit("https://new-"), nation.cast("string"), F.lit(".example.org/")))
        .when(kind == 3, F.lit("ftp://files.example.org"))
        .when(kind == 4, F.concat(F.lit("HTTPS://Shop.example/"), nation.cast("string")))
        .otherwise(F.lit("no url"))
    )
    return known.select(
        key.alias("request_id"),
        url.alias("url"),
        F.when(nation % 8 != 7, nation % 8).cast("int").alias("max_depth"),
        F.when(nation != 3, 40 + nation * 20).cast("int").alias("max_pages"),
    )


def edits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("site_id"), F.concat("s_name", F.lit(" edited")).alias("content")
    )


def progress_rows(df: DataFrame) -> DataFrame:
    """Progress polls of the jobs, from event rows."""
    v = F.floor("value").cast("int")
    zero = F.lit(0)
    return df.select(
        F.col("user_id").alias("job_id"),
        "event_id",
        "ts",
        (v % 3).alias("pages_found"),
        (v % 2).alias("pages_crawled"),
        zero.alias("pages_changed"),
        zero.alias("pages_added"),
        zero.alias("pages_updated"),
        zero.alias("pages_removed"),
        zero.alias("pages_unchanged"),
        F.when(F.col("event_type") == "click", F.lit(None).cast("int")).otherwise(zero).alias("pages_skipped"),
        F.when(F.col("event_type") == "signup", "generating").otherwise("running").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def progress_table(spark: SparkSession, sf: str) -> DataFrame:
    """Progress polls with the end of each job."""
    events = table(spark, sf, "events")
    polls = progress_rows(events)
    last = events.groupBy("user_id").agg(F.max("ts").alias("_last"))
    failed = F.col("user_id") % 2 == 1
    ends = {c: F.lit(9) for c in polls.columns if c.startswith("pages_")} | {
        "job_id": F.col("user_id"),
        "event_id": F.col("user_id") + 1_000_000_000,
        "ts": F.timestamp_add("SECOND", F.lit(1), F.col("_last")),
        "status": F.when(failed, "failed").otherwise("completed"),
        "error_message": F.when(failed, F.concat(F.lit("lost "), F.col("user_id").cast("string"))),
    }
    return polls.unionByName(last.select(*[ends[c].cast(polls.schema[c].dataType).alias(c) for c in polls.columns]))


def feed_rows(df: DataFrame) -> DataFrame:
    """Feed events of a few busy jobs, from event rows."""
    return df.select((F.col("user_id") % 5).alias("job_id"), "ts")


#: Files of a piece, which a micro-batch takes together.
FILES = 4


def pieces(rows: DataFrame, name: str, order: str, n: int) -> str:
    """A table in ``n`` pieces of ``FILES`` files that a stream takes one by one, in the order of a column.

    Written one after the other: a file stream goes by the age of the files.
    """
    out = shared_path(rows.sparkSession, f"{name}-pieces")
    rows = cut_lineage(rows, name)
    shares = [F.percentile_approx(F.col(order), k / n) for k in range(1, n)]
    bounds = rows.agg(*shares).first()
    for k in range(n):
        part = rows
        if k > 0:
            part = part.filter(F.col(order) > F.lit(bounds[k - 1]))
        if k < n - 1:
            part = part.filter(F.col(order) <= F.lit(bounds[k]))
        part.repartition(FILES).write.mode("append").parquet(out)
    return out


def progress_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = progress_table(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = pieces(rows, "progress", "ts", 4)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def ticking_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Feed events (job_id, ts) in four batches; every fiftieth is a tick of the clock."""
    events = table(spark, sf, "events")
    job = F.when(F.col("event_id") % 50 != 0, F.col("user_id") % 5)
    rows = events.select(job.alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(pieces(rows, "ticks", "ts", 4))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event log read as a stream of four batches."""
    folder = pieces(table(spark, sf, "events"), "events", "ts", 4)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def page_stream(spark: SparkSession, sf: str) -> DataFrame:
    return read_page_stream(spark, pieces(raw_pages(spark, sf), "pages", "page_id", 3), max_files=FILES)
