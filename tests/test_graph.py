"""Walks, filters, robots and sitemaps against literal cases and brute force."""

import random
import re

from pyspark.sql import functions as F

from linkloom.functions.urls import normalize_url
from linkloom.operators import graph
from linkloom.operators import robots as robots_txt
from linkloom.operators.robots import robots_filter, robots_sitemaps
from linkloom.session import cut_into_buckets, cut_lineage
from linkloom.sources.sitemaps import default_roots, expand_sitemaps


def brute_walk(edges, seeds, max_depth):
    depth = {}
    for level in range(max_depth + 1):
        front = {s for s, d in seeds if d == level}
        front |= {t for (s, t) in edges if depth.get(s) == level - 1}
        for node in front:
            depth.setdefault(node, level)
    return depth


def test_bfs_with_a_hub(spark):
    rng = random.Random(3)
    edges = {("hub", f"n{i}") for i in range(60)} | {(f"n{rng.randrange(60)}", f"m{rng.randrange(200)}") for _ in range(150)}
    edges |= {(f"m{rng.randrange(200)}", f"k{rng.randrange(50)}") for _ in range(80)} | {("k1", "hub"), ("m1", "hub")}
    seeds = [("hub", 0), ("m3", 1), ("far", 2)]
    e = spark.createDataFrame([(1, s, t) for s, t in edges], "site_id bigint, src string, dst string")
    s = spark.createDataFrame([(1, u, d) for u, d in seeds], "site_id bigint, url string, depth int")
    got = {r.url: r.depth for r in graph.bfs(e, s, 3).collect()}
    assert got == brute_walk(edges, seeds, 3)


def test_bfs_budget(spark):
    e = spark.createDataFrame([(1, "a", f"b{i}") for i in range(9)] + [(1, "b8", "c")], "site_id bigint, src string, dst string")
    s = spark.createDataFrame([(1, "a", 0), (2, "z", 0)], "site_id bigint, url string, depth int")
    got = sorted((r.site_id, r.url) for r in graph.bfs(e, s, 3, max_pages=4).collect())
    assert got == [(1, "a"), (1, "b0"), (1, "b1"), (1, "b2"), (2, "z")]


def test_path_filter(spark):
    cases = {
        "https://h/a.PNG": False, "https://h/a.png/": False, "https://h/a.png/x": True, "https://h/administration": False,
        "https://h/registered": False, "https://h/x/signup": False, "https://h/loginx": False, "https://h/ok": True,
        "https://h/a.js?x": False, "https://h/a.jsx": True,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: r.ok for r in df.withColumn("n", normalize_url("u")).select("u", graph.crawlable_path("n").alias("ok")).collect()}
    assert got == cases


def test_crawlable_links_stay_on_the_host(spark):
    edges = spark.createDataFrame(
        [(1, "s", i, u) for i, u in enumerate(["https://h/a?page=2", "https://H/b", "https://www.h/c", "https://h/secret/x", "https://h/z.pdf"])],
        "site_id bigint, src string, pos int, dst string",
    )
    sites = spark.createDataFrame([(1, "h")], "id bigint, domain string")
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /secret")], "host string, body string")
    got = {r.dst for r in graph.crawlable_links(edges, sites, robots).collect()}
    assert got == {"https://h/a", "https://h/b"}


def test_robots(spark):
    body = (
        "User-agent: nice\nDisallow: /\n\nuser-agent: other\nUSER-AGENT: *   # all\nCrawl-delay: 3\n"
        "Disallow: /p\nAllow: /p\nDisallow: /q/\nAllow: /q/open$\nDisallow: /*.cgi$\nDisallow:\nDisallow: /a*z/b\n"
        "Allow: /long/path\nDisallow: /long\n\nUser-agent: *\nDisallow: /second\nUser-agent: late\nDisallow: /late\n"
    )
    cases = {
        "/p": True, "/q/x": False, "/q/open": True, "/q/open2": False, "/x.cgi": False, "/x.cgi2": True, "/azz/b1": False,
        "/az/c": True, "/long/path/x": True, "/longer": False, "/second": False, "/late": True, "/": True, "/a.b+c": True,
    }
    urls = spark.createDataFrame([(f"https://h{p}",) for p in cases] + [("https://free/q/x",)], "url string")
    robots = spark.createDataFrame([("h", body), ("empty", ""), ("nothing", None)], "host string, body string")
    got = {r.url for r in robots_filter(urls, robots).collect()}
    assert got == {f"https://h{p}" for p, ok in cases.items() if ok} | {"https://free/q/x"}


def plain_robots(body, path):
    """One line and one rule at a time."""
    agents, listed, groups = [], [], []
    for line in re.split(r"\r\n|[\r\n]", body):
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if listed is not None:
                agents, listed = [], None
                groups.append((agents, []))
            agents.append(value)
        elif key in ("allow", "disallow") and groups:
            listed = groups[-1][1]
            if value:
                listed.append((key == "allow", value.split()[0]))
    best = (-1, True)
    for names, found in groups:
        for allow, rule in found if "*" in names else []:
            pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$"))
            if re.match(pattern + (r"\Z" if rule.endswith("$") else ""), path, re.S):
                best = max(best, (len(rule), allow))
    return best[1]


def test_robots_against_one_rule_at_a_time(spark, monkeypatch):
    rng = random.Random(6)
    letters = "ab/*$."

    def rule():
        return "/" + "".join(rng.choice(letters[:3] if rng.random() < 0.6 else letters) for _ in range(rng.randint(0, 5)))

    def robots():
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines += [f"User-Agent: {rng.choice(['*', 'x', ' * '])}" for _ in range(rng.randint(1, 3))]
            lines += [f"{rng.choice(['Allow', 'disallow'])}:{rule()}  # {rule()}" for _ in range(rng.randint(0, 30))]
        return "\n".join(lines)

    bodies = {f"h{i}": robots() for i in range(25)}
    paths = {"/" + "".join(rng.choice("ab/.$*") for _ in range(rng.randint(0, 7))) for _ in range(120)}
    urls = spark.createDataFrame([(f"http://{h}{p}",) for h in bodies for p in paths], "url string")
    frame = spark.createDataFrame(list(bodies.items()), "host string, body string")
    want = {f"http://{h}{p}" for h, body in bodies.items() for p in paths if plain_robots(body, p)}
    assert 0 < len(want) < len(bodies) * len(paths)
    for indexed in (64, 3):
        monkeypatch.setattr(robots_txt, "INDEXED", indexed)
        assert {r.url for r in robots_filter(urls, frame).collect()} == want


def test_robots_of_any_size(spark):
    """Many agents, many rules, many stars: none may stop the job or take long."""
    agents = "".join(f"User-agent: bot{i}\n" for i in range(100_000))
    rules = "".join(f"{'Allow' if i % 3 == 0 else 'Disallow'}: /p/{i}\n" for i in range(10_000))
    stars = "Disallow: /" + "*a" * 5000 + "$\n" + "Disallow: /z" + "*a" * 12 + "*b\n" + "Disallow: /y" + "*" * 5000 + "q\n"
    robots = spark.createDataFrame([("h", agents + "User-agent: *\n" + rules + stars), ("g", agents + "Disallow: /")], "host string, body string")
    paths = [f"/p/{i}" for i in range(0, 20_000, 7)] + ["/z" + "a" * 2000, "/z" + "a" * 2000 + "b", "/yyq", "/" + "a" * 5000, "/a" * 4999]
    urls = spark.createDataFrame([(f"http://h{p}",) for p in paths] + [("http://g/x",)], "url string")
    got = {r.url.removeprefix("http://h") for r in robots_filter(urls, robots).collect()}

    def ok(p):
        if not p.startswith("/p/"):
            return p in ("/z" + "a" * 2000, "/a" * 4999)
        # Of the numbers that p begins with, the longest one listed decides.
        n = next(int(p[3:end]) for end in range(len(p), 3, -1) if int(p[3:end]) < 10_000)
        return n % 3 == 0

    assert got == {p for p in paths if ok(p)} | {"http://g/x"}


def test_robots_sitemaps(spark):
    robots = spark.createDataFrame([("h", "x\r SiteMap: https://h/1.xml \nsitemap:\n\x0bSITEMAP:https://h/2.xml\nNo sitemap: y")], "host string, body string")
    assert [(r.pos, r.url) for r in robots_sitemaps(robots).orderBy("pos").collect()] == [(1, "https://h/1.xml"), (4, "https://h/2.xml")]


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc><image:loc>https://i/x</image:loc></url>" for u in urls) + "</urlset>"


def test_sitemaps(spark):
    docs = {
        "r": index("i1", "l1", "missing"), "i1": index("i2"), "i2": index("l3"), "l3": urlset("https://h/too-deep"),
        "l1": urlset("https://h/a", "https://h/a/", " https://h/b?x=1&amp;y=2 ", "<![CDATA[https://h/c]]>"),
        "d": "<!-- <loc>https://h/no</loc> --><ns:loc>https://h/no</ns:loc><loc>HTTPS://H/d",
        "e": "<urlset><url><loc>https://h/e</loc>",
    }
    d = spark.createDataFrame(list(docs.items()), "url string, xml string")
    roots = spark.createDataFrame([(1, 0, "r"), (1, 1, "d"), (1, 2, "e"), (2, 0, "l3")], "site_id bigint, pos int, url string")
    got = [(r.site_id, r.url) for r in expand_sitemaps(roots, d).orderBy("site_id", "place").collect()]
    assert got == [(1, "https://h/a"), (1, "https://h/a"), (1, "https://h/b"), (1, "https://h/c"), (1, "https://h/e"), (2, "https://h/too-deep")]
    capped = expand_sitemaps(roots, d, max_pages=2)
    assert sorted((r.site_id, r.url) for r in capped.collect()) == [(1, "https://h/a"), (1, "https://h/a"), (2, "https://h/too-deep")]


def test_default_sitemap_only_without_named_ones(spark):
    sites = spark.createDataFrame([(1, "https://h/x", "h"), (2, "http://g", "g")], "id bigint, url string, domain string")
    named = spark.createDataFrame([(1, 4, "https://h/m.xml")], "site_id bigint, pos int, url string")
    got = {(r.site_id, r.url) for r in default_roots(sites, named).collect()}
    assert got == {(1, "https://h/m.xml"), (2, "http://g/sitemap.xml")}


def test_render_promotion(spark):
    probes = spark.createDataFrame([(s, f"u{i}", 1) for s in (1, 2, 3, 4) for i in range(4)], "site_id bigint, url string, depth int")
    copies = [(1, "u0", 1), (1, "u1", 3), (2, "u2", 9), (3, "u3", 9), (3, "u0", 1), (3, "u1", 1), (3, "u2", 2), (4, "u1", 9)]
    rendered = spark.createDataFrame(copies, "site_id bigint, url string, crawlable_links int")
    got = {r.site_id: (r.attempts, r.failures, r.promoted) for r in graph.render_promotion(probes, rendered).collect()}
    # Stops when promoted; stops after two failures; never tries a fourth page; one failure is no end.
    assert got == {1: (2, 0, True), 2: (2, 2, False), 3: (3, 0, False), 4: (2, 1, True)}


def test_title_and_fallback(spark):
    listed = spark.createDataFrame(
        [(1, "https://h/docs/getting-started_now/", 0), (1, "https://h/", 1), (1, "https://h/zz", 2)], "site_id bigint, url string, pos int"
    )
    rows = {r.url: r for r in graph.sitemap_fallback(listed, max_pages=2).collect()}
    assert set(rows) == {"https://h/docs/getting-started_now/", "https://h/"}
    first = rows["https://h/docs/getting-started_now/"]
    assert (first.title, first.http_status, first.content_hash) == ("Getting Started Now", 0, "")
    assert rows["https://h/"].title == "h"


def test_capital_hosts_and_hostile_robots(spark):
    site = spark.createDataFrame([(1, "Shop.Example")], "id bigint, domain string")
    body = "User-agent: *\nDisallow: /x\\E(*\nDisallow: /a[b*\nDisallow: /q.\\+*$"
    robots = spark.createDataFrame([("Shop.Example", body)], "host string, body string")
    edges = spark.createDataFrame([(1, "s", 0, "https://SHOP.example/ok"), (1, "s", 1, "https://shop.example/a[bc"), (1, "s", 2, "https://shop.example/x\\E(1")], "site_id bigint, src string, pos int, dst string")
    assert [r.dst for r in graph.crawlable_links(edges, site, robots).collect()] == ["https://shop.example/ok"]


def test_registered_urls(spark):
    from linkloom.operators.rewrites import registered_url

    df = spark.createDataFrame([("HTTPS://Shop.Example/X//",), (" http://h:80/ ",), ("https://h:443",), ("https://h:8443/",)], "u string")
    assert [r[0] for r in df.select(registered_url(F.col("u"))).collect()] == ["https://shop.example/X", "http://h", "https://h", "https://h:8443"]


def test_edges_stay_where_they_are(spark):
    from linkloom.operators import graph as g

    seen = []

    def spy(df, name, keys):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_into_buckets(df, name, keys)

    edges = spark.range(5000).selectExpr("id % 1 + 1 AS site_id", "cast(id AS string) AS src", "cast(id * 2 AS string) AS dst")
    seeds = spark.createDataFrame([(1, "1", 0)], "site_id bigint, url string, depth int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    g.cut_into_buckets = spy
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.url: r.depth for r in g.bfs(edges, seeds).collect()}
    finally:
        g.cut_into_buckets = cut_into_buckets
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {"1": 0, "2": 1, "4": 2, "8": 3}
    # The first plans are those of the edges and the seeds. After that edges and levels are read where they
    # lie; what moves is the seeds and the reached URLs, together.
    assert len(seen) == 5
    for depth, plan in enumerate(seen[2:], 1):
        assert plan.count("Bucketed: true") == 2 + depth
        assert plan.count("Exchange") == 1


def test_references_in_sitemaps(spark):
    from linkloom.sources.sitemaps import locations

    cases = [
        ("a&#38;b", "a&b"), ("a&#x26;amp;b", "a&amp;b"), ("&amp;#38;", "&#38;"), ("&#233;&#x4e2D;&#128512;", "é中😀"),
        ("&lt;&gt;&quot;&apos;&amp;", "<>\"'&"), ("a&b &nosuch; &#; &#xg;", "a&b &nosuch; &#; &#xg;"), ("&#9999999;x", "x"), ("&#65;", "A"),
    ]
    df = spark.createDataFrame([(f"<loc>{raw}</loc>",) for raw, _ in cases], "x string")
    assert [r[0] for r in df.select(locations(F.col("x"))[0]).collect()] == [want for _, want in cases]
