"""Literal cases for URL, text and classification expressions."""


import pytest
from pyspark.sql import functions as F

from linkloom.functions import classify, text, urls


def named(spark, expression, *values):
    """An expression that takes column names, on literal values."""
    return one(spark, lambda *columns: expression(*[f"v{i}" for i in range(len(columns))]), *values)


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    ddl = ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], ddl).select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("HTTP://Ex.COM:8080/A/b?x=1#f", "http://ex.com:8080/A/b"),
        ("https://u:P@h.example", "https://u:p@h.example/"),
        ("https://h/a//", "https://h/a/"),
        ("https://h/a/b;p=1", "https://h/a/b"),
        ("https://h//x/", "https://h//x"),
        ("https://h/a b", "https://h/a b"),
        ("ftp://h/a/", "ftp://h/a/"),
        ("/rel/", "/rel/"),
        ("http:///x", "http:///x"),
    ],
)
def test_normalize(spark, raw, clean):
    assert named(spark, urls.normalize_url, raw) == clean


# Written by hand: page, link as it stands there, and where it leads.
LINKS = [
    ("http://h/a/b", "", "http://h/a/b"),
    ("http://h/a/b", "#t", "http://h/a/b"),
    ("http://h/a/b", "?q", "http://h/a/b"),
    ("http://h/a/b", "c", "http://h/a/c"),
    ("http://h/a/b/", "c", "http://h/a/b/c"),
    ("http://h", "c", "http://h/c"),
    ("http://h/a/b", "./", "http://h/a"),
    ("http://h/a/b", "../c/", "http://h/c"),
    ("http://h/a/b", "../../../q", "http://h/q"),
    ("http://h/a/b", "/r/./s/../t", "http://h/r/t"),
    ("https://H/a//b/c;p?q", "//o.example/x/", "https://o.example/x"),
    ("http://h/a/b", "http:z", "http://h/a/z"),
    ("https://H/a/b", "https:z", "https://h/a/z"),
    ("http://h/a/b", "https:z", None),
    ("http://h/a/b", "HTTP://O/x;y", "http://o/x"),
    ("http://h/a/b", "..", "http://h/"),
    ("http://h/a/b/", ".", "http://h/a/b"),
    ("http://h/a/b", "mailto:x", None),
    ("http://h/a/b", "javascript:f()", None),
    ("http://h/a/b", " /s", "http://h/s"),
    ("http://h/a/b", "/t\n/u", "http://h/t/u"),
    ("http://h/a/b", "http://", "http://h/a/b"),
]


def test_resolve_links(spark):
    df = spark.createDataFrame(LINKS, "b string, h string, want string")
    got = df.select("b", "h", urls.resolve_href("b", "h").alias("r")).collect()
    assert [tuple(r) for r in got] == LINKS


@pytest.mark.parametrize(
    "path, depth, category",
    [
        ("/docs", 3, "Documentation"),
        ("/DOC/x", 3, "Documentation"),
        ("/docsy", 3, "Other"),
        ("/api-reference", 3, "Other"),
        ("/apireference/x", 3, "API Reference"),
        ("/x/api-ref/", 3, "API Reference"),
        ("/blog/setup", 3, "Getting Started"),
        ("/quick_start", 0, "Getting Started"),
        ("/x", 1, "Core Pages"),
        ("/x", 2, "Other"),
    ],
)
def test_category(spark, path, depth, category):
    assert named(spark, classify.page_category, "https://h" + path, depth) == category


def test_relevance(spark):
    def score(url, depth, category, listed=None):
        flag = str(bool(listed)).lower()
        return named(spark, lambda u, d, c: classify.page_relevance(u, d, c, flag), url, depth, category)

    assert score("https://h/a", 0, "Getting Started") == 0.9
    assert score("https://h/a/b/c/d/e", 1, "Documentation") == 0.65
    assert score("https://h/a", 0, "Getting Started", True) == 1.0
    assert score("https://h/a", 5, "Other") == 0.0
    assert score("https://h/a", 0, "Unheard of") == 0.3


@pytest.mark.parametrize(
    "title, junk",
    [
        ("Page Not Found", True), ("404", True), ("404s", False), ("Sign up", True), ("Sign up now", False),
        ("User talk:Bob", True), ("x /Archive 3", True), (":archive9", True), ("2006", True), ("20061", False),
        ("february 19", True), ("February 190", False), ("  ", True), (None, True), ("Errors explained", False),
        ("Error 5", True), (" Log in ", True), ("Welcome", False),
    ],
)
def test_junk(spark, title, junk):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(classify.is_junk_title("t")).first()[0] is junk


def test_challenge_window_and_dot(spark):
    def flag(html, window=None):
        return named(spark, lambda h: classify.is_challenge(h, window), html)

    assert flag("Attention Required!\n\n CLOUDFLARE")
    assert flag("blocked by the bot police")
    assert not flag("blocked\nbot")
    assert flag("x" * 60_000 + "access denied")
    assert flag("x" * 4987 + "access denied", 5000)
    assert not flag("x" * 4990 + "access denied", 5000)


def test_text(spark):
    assert one(spark, text.normalize_text, " A  \tB\r\nc\x1f ") == "a b c"
    assert one(spark, text.title_case, "don't stop-éa a1b") == "Don'T Stop-Éa A1B"
    assert one(spark, text.title_case, "日本abc") == "日本Abc"
    assert one(spark, text.normalize_text, "ab " * 30_000) == ("ab " * 30_000).strip()
    assert one(spark, lambda v: text.normalize_text(v, 5), "ab " * 30_000) == "ab ab"
    assert one(spark, text.strip_tagline, "A | B - C") == "A | B"
    assert one(spark, text.strip_tagline, "A | B — C") == "A"
    assert one(spark, text.strip_tagline, "A : B") == "A"
    line = one(spark, lambda t, u, d: text.md_link(t, u, d), "T", "https://h/a_(b)", "")
    assert line == "- [T](https://h/a_%28b%29)"


def test_site_key_is_stable(spark):
    assert named(spark, urls.site_key, "h.example") == named(spark, urls.site_key, "h.example") > 0
