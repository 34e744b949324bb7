"""Plans, listings and rendering: literal cases."""

import json

from pyspark.sql import functions as F

from linkloom.operators import curation, dedup, listing, render
from linkloom.plans.refresh import index_sites

PAGE = "site_id bigint, url string, title string, description string, depth int, category string, relevance_score double"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGE)


def plan(sections, optional=(), description=""):
    return json.dumps(
        {
            "site_description": description,
            "sections": [{"name": n, "pages": [{"id": i, "title": t, "description": d} for i, t, d in p]} for n, p in sections],
            "optional": [{"id": i, "title": t, "description": d} for i, t, d in optional],
        }
    )


def test_dedup_order(spark):
    rows = [
        (1, "u1", "Page not found", None, 0, "Blog", 0.9),
        (1, "u1", "Fine", None, 1, "Blog", 0.5),  # lost: its URL was taken by the junk row
        (1, "u2", " Home ", None, 0, "Blog", 0.4),
        (1, "u3", "HOME", None, 2, "Blog", 0.6),
        (1, "u4", "home", None, 1, "Blog", 0.6),
        (2, "u5", "Home", None, 1, "Blog", 0.1),
    ]
    kept = {(r.site_id, r.url) for r in dedup.clean_pages(pages(spark, rows)).collect()}
    assert kept == {(1, "u4"), (2, "u5")}


def test_listing_lines(spark):
    long = "y" * 151
    rows = [
        (1, "a", "T", "About us", 0, "Blog", 0.1), (1, "b", "T2", " t2 ", 0, "Blog", 0.1), (1, "c", None, long, 0, "Blog", 0.1),
        (1, "d", "T4", "y" * 150, 1, "Blog", 0.1),
    ]
    sites = spark.createDataFrame([(1, " about US ")], "id bigint, description string")
    numbered = listing.assign_page_ids(pages(spark, rows))
    whole = {r.url: r.line for r in listing.listing_lines(numbered, sites).collect()}
    assert whole["c"] == f"[3] (no title) — {long}"
    lines = {r.url: r.line for r in listing.listing_lines(numbered, sites, 150).collect()}
    assert lines == {"a": "[1] T", "b": "[2] T2", "c": f"[3] (no title) — {long[:150]}...", "d": f"[4] T4 — {'y' * 150}"}


def test_render_rules(spark):
    rows = [
        (1, "https://h/(x)", "", "d", 0, "Guides", 0.8), (1, "https://h/low", "Low", None, 0, "Guides", 0.29),
        (1, "https://h/edge", "Edge", "", 0, "Other", 0.3), (1, "https://h/odd", "Odd", None, 0, "Unknown", 0.9),
        (1, "https://h/fake", "Fake", None, 0, "Optional", 0.9), (1, "https://h/faq", "Q", None, 0, "FAQ", 0.5),
        (9, "https://x/", "No site", None, 0, "FAQ", 0.5),
    ]
    sites = spark.createDataFrame([(1, "", "h.example", "")], "id bigint, title string, domain string, description string")
    got = render.render_index(sites, pages(spark, rows)).collect()
    assert len(got) == 1
    assert got[0].content == (
        "# h.example\n\n## Guides\n\n- [https://h/(x)](https://h/%28x%29): d\n\n## FAQ\n\n- [Q](https://h/faq)\n"
        "\n## Other\n\n- [Edge](https://h/edge)\n\n## Optional\n\n- [Low](https://h/low)\n"
    )


def numbered(spark, n):
    rows = [(1, f"https://h/{i:03d}", f"P{i}", f"D{i}", 1, "Blog", 0.5) for i in range(1, n + 1)]
    return listing.assign_page_ids(pages(spark, rows))


def test_plan_rules(spark):
    text = plan(
        [("A", [(2, "", ""), (1, "One", "x"), (2, "again", ""), (77, "none", "")]), ("Empty", []), ("Gone", [(1, "dup", "")])],
        [(3, "Three", "y"), (1, "dup", "")],
    )
    plans = spark.createDataFrame([(1, text, "stop")], "site_id bigint, json string, finish_reason string")
    sites = spark.createDataFrame([(1, "S | T", "h", "site says")], "id bigint, title string, domain string, description string")
    row = curation.assemble_plan(sites, plans, numbered(spark, 5)).first()
    assert row.content == (
        "# S\n\n> site says\n\n## A\n\n- [P2](https://h/002): D2\n- [One](https://h/001): x\n\n## Optional\n\n- [Three](https://h/003): y\n"
    )


def test_cap_counts_sections_then_optional(spark):
    entries = [(i, "", "") for i in range(1, 71)]
    text = plan([("A", entries), ("B", [(i, "", "") for i in range(60, 74)])], [(i, "", "") for i in range(74, 100)])
    plans = spark.createDataFrame([(1, text, "stop")], "site_id bigint, json string, finish_reason string")
    capped = curation.plan_cap(curation.resolve_plan(curation.parse_plans(plans), numbered(spark, 120)))
    urls = [r.url for r in capped.orderBy("section_pos", "entry_pos").collect()]
    assert urls == [f"https://h/{i:03d}" for i in range(1, 76)]


def test_unusable_plans_fall_back(spark):
    good = plan([("A", [(1, "One", "")])], description="told")
    texts = [
        (1, good, "stop"), (2, good[:40], "stop"), (3, good, "length"), (4, " ", "stop"), (5, None, "stop"),
        (6, '{"site_description": "x", "sections": []}', "stop"), (7, f"  {good}\n", None), (8, "[1]", "stop"), (9, '"x"', "stop"),
    ]
    plans = spark.createDataFrame(texts, "site_id bigint, json string, finish_reason string")
    usable, broken = curation.split_plans(plans)
    assert {r.site_id for r in usable.collect()} == {1, 7}
    assert {r.site_id for r in broken.collect()} == {2, 3, 4, 5, 6, 8, 9}
    sites = spark.createDataFrame([(i, f"S{i}", "h", None) for i in range(1, 10)], "id bigint, title string, domain string, description string")
    rows = [(i, "https://h/a", "One", None, 0, "FAQ", 0.5) for i in range(1, 10)]
    built = {r.site_id: r.content for r in index_sites(sites, pages(spark, rows), plans).collect()}
    assert len(built) == 9
    assert built[1] == "# S1\n\n> told\n\n## A\n\n- [One](https://h/a)\n"
    assert built[2] == "# S2\n\n## FAQ\n\n- [One](https://h/a)\n"


def test_top_pages(spark):
    rows = [(1, f"u{i:02d}", "t", None, 0, "Blog", 0.9 - i * 0.02) for i in range(40)]
    best = listing.top_pages(pages(spark, rows)).orderBy(F.desc("relevance_score")).collect()
    assert [r.url for r in best if not r.optional] == [f"u{i:02d}" for i in range(20)]
    assert [r.rank for r in best if r.optional] == [1, 2, 3, 4, 5]


def test_plans_are_parsed_once(spark, sf):
    from checks import views as V

    numbered = listing.assign_page_ids(V.catalog(spark, sf))
    made = curation.assemble_plan(V.page_sites(spark, sf), V.plans(spark, sf), numbered)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan  # the parsed plans are read from where they were written
