"""Fetched pages -> page facts: titles, headings, text, links and four digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.classify import page_category, page_relevance
from linkloom.functions.text import cut as cut_text
from linkloom.functions.text import empty_to_null, normalize_text, sha256, strip
from linkloom.functions.urls import resolve_all
from linkloom.sources.html import html_pieces

HASHES = ["metadata_hash", "headings_hash", "text_hash", "content_hash"]


def _stripped(value: Column) -> Column:
    """A present value wins even if nothing is left of it after trimming."""
    return strip(empty_to_null(value))


def fingerprint(df: DataFrame) -> DataFrame:
    """Add the four digests of ``title, description, headings, main_text``.

    NULL counts as the empty string everywhere.
    """
    blank = F.lit("")
    return df.withColumns(
        {
            "metadata_hash": sha256(
                F.concat(F.coalesce("title", blank), F.coalesce("description", blank))
            ),
            "headings_hash": sha256(F.array_join("headings", "||")),
            "text_hash": sha256(F.col("main_text")),
        }
    ).withColumn("content_hash", sha256(F.concat("metadata_hash", "headings_hash", "text_hash")))


def extract_pages(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    paragraph_chars: int | None = None,
    max_headings: int | None = None,
    text_chars: int | None = None,
) -> DataFrame:
    """Replace the ``html`` column by the facts read from it.

    Everything is kept unless a limit is given: characters of a description
    taken from a paragraph, headings, and characters of the text.

    Row-local: no shuffle. Links keep other hosts; they are filtered when a
    crawl looks at them.
    """
    cut = pages.withColumn("_cut", html_pieces(F.col(html), text_chars, max_headings)).drop(html)
    described = F.coalesce(
        _stripped(F.col("_cut.og_description")),
        _stripped(F.col("_cut.meta_description")),
        cut_text(F.col("_cut.paragraph"), paragraph_chars),
    )
    # The canonical link is resolved along with the others, as the last one.
    hrefs = "concat(_cut.hrefs, array(nullif(_cut.canonical_href, '')))"
    cut = cut.withColumn("_urls", resolve_all(url, hrefs))
    links = F.slice("_urls", 1, F.size("_urls") - 1)
    facts = cut.withColumns(
        {
            "title": F.coalesce(
                _stripped(F.col("_cut.og_title")), _stripped(F.col("_cut.title")), F.col("_cut.h1")
            ),
            "description": described,
            "headings": F.col("_cut.headings"),
            "main_text": normalize_text(F.col("_cut.body_text"), text_chars),
            "links": F.array_distinct(F.filter(links, lambda u: u.isNotNull())),
            "canonical_url": F.element_at("_urls", -1),
        }
    ).drop("_cut", "_urls")
    return fingerprint(facts)


def score_pages(df: DataFrame) -> DataFrame:
    """Add ``category`` and ``relevance_score`` from ``url`` and ``depth``."""
    return df.withColumn("category", page_category("url", "depth")).withColumn(
        "relevance_score", page_relevance("url", "depth", "category")
    )
