"""Literal pages for the extraction rules."""

import hashlib
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.operators.extract import extract_pages
from linkloom.sources.html import cut_page, html_pieces

FIFTY = "x" * 50


def test_title_order():
    assert cut_page("<title>T</title><meta property='og:title' content='O'>")["og_title"] == "O"
    cut = cut_page("<head><meta property='og:title' content=''><title> T </title></head><h1>A <b>b</b></h1>")
    assert (cut["og_title"], cut["title"], cut["h1"]) == ("", "T", "Ab")


def test_nested_chunks_count_twice():
    assert cut_page("<body><li><p>one</p></li><pre><code>two</code></pre></body>")["body_text"] == "one one two two"


def test_main_before_article_before_role():
    both = "<article><p>a</p></article><main><p>m</p></main>"
    assert cut_page(both)["body_text"] == "m"
    assert cut_page("<div role='main'><p>r</p></div><article><p>a</p></article>")["body_text"] == "a"
    assert cut_page("<p>out</p><div role='main'><p>r</p></div>")["body_text"] == "r"


def test_no_chunks_takes_all_text_of_the_body():
    page = "<html><head><title>T</title></head><body><div>a <span>b</span></div><div>c</div></body></html>"
    assert cut_page(page)["body_text"] == "a b c"


def test_removed_tags_hide_text_and_links_but_not_headings():
    cut = cut_page(
        "<body><noscript><h2>N</h2><a href='/n'>n</a></noscript><template><a href='/t'>t</a></template>"
        "<script>var t='</p><a href=/s>';</script><svg><text>s</text></svg><p>p</p><a href='/k'>k</a></body>"
    )
    assert cut["headings"] == ["N"]
    assert cut["hrefs"] == ["/k"]
    assert cut["body_text"] == "p"


def test_paragraph_of_fifty_characters():
    assert cut_page(f"<p>{'x' * 49}</p><p> {FIFTY} </p>")["paragraph"] == FIFTY
    assert cut_page(f"<p>{'x' * 49}</p>")["paragraph"] is None


def test_open_paragraphs_end_at_the_next_block():
    cut = cut_page(f"<p><b>one<br><p>two<h2>three</h2><ul><li>four<li>five</ul>")
    assert cut["body_text"] == "one two three four five"


def test_all_headings():
    cut = cut_page("".join(f"<h{i % 3 + 1}>h{i}</h{i % 3 + 1}>" for i in range(25)) + "<h1> </h1>")
    assert cut["headings"] == [f"h{i}" for i in range(25)]


def test_entities_and_bare_ampersands():
    cut = cut_page("<title>a &amp; b &copy; &amp c &am &#233;&#xe9;</title>")
    assert cut["title"] == "a & b © &amp c &am éé"


def test_comment_splits_text_and_unclosed_markup_is_kept():
    assert cut_page("<p>a<!-- x -->b</p>")["body_text"] == "a b"
    assert cut_page("<p>1 < 2 and done")["body_text"] == "1 < 2 and done"


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "<script>", "</p></p>", "<a href=>x"])
def test_odd_input(html):
    assert isinstance(cut_page(html)["headings"], list)


def test_facts(spark):
    page = (
        "<head><meta property='og:title' content='  '><link rel='canonical' href='../C/?x=1'>"
        "<meta name='description' content=' D '></head><body><h1>H</h1><p>Some   TEXT</p>"
        "<a href='/a/'>1</a><a href='/a'>2</a><a href='#x'>3</a><a href='mailto:m'>4</a><a href='//O.example/z?q'>5</a>"
    )
    pages = spark.createDataFrame([("https://H.example/d/p", page)], "url string, html string")
    row = extract_pages(pages).first()
    assert row.title == ""  # present, though blank after trimming
    assert row.description == "D"
    assert row.canonical_url == "https://h.example/C"
    assert row.main_text == "h some text"
    assert row.links == ["https://h.example/a", "https://h.example/d/p", "https://o.example/z"]
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    assert row.metadata_hash == sha("D")
    assert row.content_hash == sha(sha("D") + sha("H") + sha("h some text"))


def test_text_is_whole_unless_limits_are_given(spark):
    pages = spark.createDataFrame([("https://h/x", "<p>" + "ab " * 30000 + "</p>")], "url string, html string")
    assert extract_pages(pages).select(F.length("main_text")).first()[0] == 89_999
    few = extract_pages(pages, text_chars=50, paragraph_chars=10).select("main_text", "description").first()
    assert (len(few.main_text), len(few.description)) == (50, 10)


def test_only_html_travels_to_python(spark, sf):
    from checks import views

    facts = extract_pages(views.with_site(views.raw_pages(spark, sf)))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan
    # Columns that need no text do not start Python at all.
    light = facts.select("url", "site_id")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in light and "html" not in light.split("ReadSchema")[1]


def test_broken_markup_stays_cheap():
    """Each of these would take hours if tags were looked up by scanning back and forth."""
    for html in ("<span>" * 200_000 + "</b>" * 200_000, "<div>" * 50_000 + "<li>x" * 50_000, "<script " * 100_000):
        cut_page(html)


def test_deep_nesting_gives_each_level_its_text():
    assert cut_page("<body>" + "<ul><li>" * 40 + "<p>word")["body_text"] == " ".join(["word"] * 41)
    assert cut_page("<ul><li>a<ul><li>b</ul>c<li>d</ul>")["body_text"] == "a b c b d"
    n = 10_000
    assert cut_page("<ul><li>" * n + "<p>word")["body_text"] == " ".join(["word"] * (n + 1))
    assert cut_page("<h1><div>" * 50 + "x")["headings"] == ["x"] * 50


def test_limits_bound_what_is_put_together():
    """Without them this page has 300 MB of text."""
    n = 10_000
    nested = "<ul>" + "".join(f"<li>t{i}<ul>" for i in range(n)) + "</ul></li>" * n
    tracemalloc.start()
    cut = cut_page(nested, text_chars=50_000, max_headings=20)
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()
    want = " ".join(f"t{i}" for i in range(n))
    assert cut["body_text"].startswith(want[:50_000]) and len(cut["body_text"]) < 2 * len(want)
    heads = cut_page("<div>".join(f"<h1>a{i}<div>" for i in range(n)), max_headings=20)
    assert len(heads["headings"]) == 20 and sum(map(len, heads["headings"])) < 21 * 7 * n


@pytest.mark.parametrize("limit", [0, 1, 7, 20, 21, 22, 60, 1000])
def test_limited_text_is_the_start_of_the_whole(spark, limit):
    page = "<ul><li>One \n\t TWO<ul><li>\u0130x &nbsp; y<p>three   3</ul>four<li>ΑΣ</ul>"
    pages = spark.createDataFrame([("https://h/x", page)], "url string, html string")
    whole = extract_pages(pages).first().main_text
    assert whole == "one two i\u0307x y three 3 four i\u0307x y three 3 three 3 ας"
    assert extract_pages(pages, text_chars=limit).first().main_text == whole[:limit]


def test_facts_of_a_hand_written_page(spark):
    """Every field of one page, worked out by hand."""
    page = """<!doctype html><html><head><title> The  Title </title>
        <meta name="description" content="  What it is. "><link rel="canonical" href="/Guide/?v=2#top"></head>
        <body><nav><a href="/login">Log in</a></nav><main><h1>Guide <em>One</em></h1>
        <p>First   paragraph, which has <b>more</b> than fifty characters in it.</p>
        <ul><li>alpha<ul><li><code>beta()</code></li></ul></li></ul><script>var x = "<p>no</p>";</script>
        <table><tr><td>cell &amp; more<td>next</table><a href="../b/">B</a><a href="https://O.example">O</a></main>
        <footer><h2>End</h2><p>gone</p></footer></body></html>"""
    row = extract_pages(spark.createDataFrame([("http://h.example/a/x.html?q=1", page)], "url string, html string")).first()
    assert (row.title, row.description, row.canonical_url) == ("The  Title", "What it is.", "http://h.example/Guide")
    assert row.headings == ["GuideOne", "End"]
    assert row.main_text == (
        "guide one first paragraph, which has more than fifty characters in it. alpha beta() beta() beta() cell & more next"
    )
    assert row.links == ["http://h.example/login", "http://h.example/b", "https://o.example/"]
    assert row.headings_hash == hashlib.sha256(b"GuideOne||End").hexdigest()
    assert row.metadata_hash == hashlib.sha256(b"The  TitleWhat it is.").hexdigest()


def test_a_batch_is_handed_on_piece_by_piece(monkeypatch):
    """A task holds the pieces of few pages, however many pages its batch has."""
    monkeypatch.setattr(F, "arrow_udf", lambda returns: lambda read: read)
    pages = [f"<title>{i}</title><p>" + f"w{i} " * 1500 + "</p>" for i in range(4000)] + [None, ""]
    batches = [pa.array(pages, type=pa.string()), pa.array(pages[:3]), pa.array([], type=pa.string())]
    titles, sizes = [], []
    tracemalloc.start()
    for got in html_pieces(iter(batches)):
        sizes.append(len(got))
        titles += got.field("title").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert titles == [str(i) for i in range(4000)] + [None, None] + ["0", "1", "2"]
    assert peak < 20_000_000 and max(sizes) < 400
