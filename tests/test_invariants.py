"""Random inputs against the standard library, and rules that hold for any input."""

import random
import re
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from checks import views as V
from linkloom.functions.urls import normalize_url, resolve_href
from linkloom.operators import dedup, render, snapshot
from linkloom.operators.extract import score_pages

PIECES = [
    "http:", "https:", "HTTP:", "ftp:", "mailto:", "//", "/", "/", "h.example", "H.Example:80", "u@h", "a", "b", "A", "..", ".",
    "a.html", ";p", ";", "?q=1", "?", "#f", "#", " ", "é", "%20", "x:y", "\t", "", "a/b", "/./", "/../", "//a", "1",
]


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(43)
    made = {"".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 7))) for _ in range(4000)}
    made |= {rng.choice(["http://", "https://"]) + "h" + u for u in rng.sample(sorted(made), 1500)}
    return sorted(made)


# Written by hand: what comes in, and the canonical form.
CANONICAL = [
    ("HTTP://H.Example:80/A/", "http://h.example:80/A"),
    ("https://h.example", "https://h.example/"),
    ("https://h.example/", "https://h.example/"),
    ("https://h.example/a//", "https://h.example/a/"),
    ("https://u@H/a?q=1#f", "https://u@h/a"),
    ("https://h/a;p", "https://h/a"),
    ("https://h/a;p/b", "https://h/a;p/b"),
    ("https://h?x", "https://h/"),
    ("ftp://h/a", "ftp://h/a"),
    ("mailto:x@y", "mailto:x@y"),
    ("no url", "no url"),
    ("", ""),
]


def test_canonical_forms(spark):
    df = spark.createDataFrame(CANONICAL, "u string, want string").select("u", "want", normalize_url("u").alias("got"))
    assert [(r.u, r.got) for r in df.collect()] == CANONICAL


def test_canonical_urls_have_no_rest(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", normalize_url("u").alias("n"))
    for r in df.collect():
        if r.n == r.u:
            continue
        scheme, rest = r.n.split("://", 1)
        host, slash, path = rest.partition("/")
        assert scheme in ("http", "https") and host == host.lower() and slash
        assert "?" not in r.n and "#" not in r.n
        raw = r.u.replace("\t", "").split("?")[0].split("#")[0]
        assert path == "" or path in raw


def test_normalizing_twice_changes_nothing_more(spark, urls):
    # One slash and one run of params go per pass; several are another matter.
    single = [(u,) for u in urls if not urlparse(u).path.endswith("//") and ";" not in u]
    df = spark.createDataFrame(single, "u string").select(normalize_url("u").alias("a")).withColumn("b", normalize_url("a"))
    assert df.filter("a <> b").count() == 0


def test_resolved_links_are_canonical_and_keep_their_host(spark, urls):
    rng = random.Random(53)
    web = [u for u in urls if re.match(r"(?i)https?://[a-z@.]", u)]
    pairs = [(rng.choice(web), rng.choice(urls)) for _ in range(4000)]
    df = spark.createDataFrame(pairs, "b string, h string").select("b", "h", resolve_href("b", "h").alias("r"))
    for r in df.withColumn("again", normalize_url("r")).collect():
        if r.r is None:
            continue
        joined = urlparse(urljoin(r.b, r.h))
        found = urlparse(r.r)
        assert (found.scheme, found.netloc) == (joined.scheme, joined.netloc.lower())
        assert "?" not in r.r and "#" not in r.r and found.path.startswith("/")


def test_scores_stay_in_range(spark, urls):
    df = score_pages(spark.createDataFrame([(u, i % 9) for i, u in enumerate(urls)], "url string, depth int"))
    low, high = df.agg(F.min("relevance_score"), F.max("relevance_score")).first()
    assert 0 <= low <= high <= 1


def test_counts_add_up(spark, sf):
    found = V.facts(spark, sf)
    stored, crawled = V.stored_of(found), V.crawl_of(found)
    fetched = crawled.filter("not not_modified")
    counts = snapshot.change_counts(snapshot.snapshot_diff(stored, fetched))
    seen = counts.agg(F.sum(F.col("added") + F.col("updated") + F.col("unchanged"))).first()[0]
    assert seen == fetched.count()


def test_index_lists_only_known_pages_once(spark, sf):
    pages = V.catalog(spark, sf)
    index = render.render_index(V.page_sites(spark, sf), pages)
    listed = index.select("site_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^- \[.*\]\((http[^)]*)\)"), F.lit(1))).alias("url"))
    assert listed.count() == listed.distinct().count() > 0
    assert listed.join(pages, ["site_id", "url"], "left_anti").count() == 0


def test_cleaning_twice_changes_nothing_more(spark, sf):
    once = dedup.clean_pages(V.catalog(spark, sf))
    assert dedup.clean_pages(once).count() == once.count()
