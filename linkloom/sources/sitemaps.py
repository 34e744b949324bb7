"""Stored sitemap documents -> listed URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import strip
from linkloom.functions.urls import normalize_url
from linkloom.plans.ordering import top_per

# Fixed value: an index may lead to indexes, down to this level.
MAX_LEVEL = 2

LOC = r"(?s)<loc(?:\s[^>]*)?>(.*?)</loc\s*>"
CHILD = r"(?s)<sitemap(?:\s[^>]*)?>(.*?)</sitemap\s*>"


REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|lt|gt|quot|apos|amp);"
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _character(code: Column) -> Column:
    """The character with a code point, from its UTF-8 bytes; none beyond the last one."""

    def byte(lead: int, shift: int, mask: int = 0x3F) -> Column:
        return F.hex(F.lit(lead) + F.shiftright(code, shift).bitwiseAND(F.lit(mask)))

    tail = [byte(0x80, shift) for shift in (12, 6, 0)]
    encoded = (
        F.when(code < 0x80, F.lpad(F.hex(code), 2, "0"))
        .when(code < 0x800, F.concat(byte(0xC0, 6, 0x1F), tail[2]))
        .when(code < 0x10000, F.concat(byte(0xE0, 12, 0x0F), *tail[1:]))
        .when(code < 0x110000, F.concat(byte(0xF0, 18, 0x07), *tail))
        .otherwise("")
    )
    return F.decode(F.unhex(encoded), "UTF-8")


def _decoded(text: Column) -> Column:
    """Each reference of a text replaced once by what it stands for."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s)({REFERENCE}|(?:(?!{REFERENCE}).)+)"), F.lit(1))

    def read(part: Column) -> Column:
        digits = F.regexp_extract(part, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(part.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        out = F.when(part.rlike("^&#[0-9xX][0-9a-fA-F]*;$"), _character(code))
        for entity, char in NAMED.items():
            out = out.when(part == entity, F.lit(char))
        return out.otherwise(part)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, read), "")).otherwise(text)


def _loc_text(raw: Column) -> Column:
    return strip(_decoded(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))


def locations(xml: Column) -> Column:
    """All ``loc`` texts of a document; prefixed ones (images, videos) are other elements."""
    found = F.regexp_extract_all(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), F.lit(LOC), F.lit(1))
    return F.transform(found, _loc_text)


def children(xml: Column) -> Column:
    """First ``loc`` of each entry of a sitemap index."""
    entries = F.regexp_extract_all(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), F.lit(CHILD), F.lit(1))
    firsts = F.transform(entries, lambda e: F.regexp_extract(e, LOC, 1))
    return F.filter(F.transform(firsts, _loc_text), lambda u: u != "")


def is_index(xml: Column) -> Column:
    return xml.rlike(r"<sitemap[\s>]")


def expand_sitemaps(
    roots: DataFrame, docs: DataFrame, max_level: int = MAX_LEVEL, max_pages: int | None = None
) -> DataFrame:
    """Listed URLs of every site, in document order; duplicates stay.

    ``roots`` (site_id, pos, url) the sitemaps a site names, ``docs`` (url, xml).
    Indexes are followed level by level with a join on the document URL.
    ``place`` is the path of positions that led to a URL. ``max_pages`` counts
    duplicates, too.
    """
    index = is_index(F.col("xml"))
    nested = docs.filter(index).select("url", children(F.col("xml")).alias("_children"))
    leaves = docs.filter(~index).select("url", locations(F.col("xml")).alias("_locs"))
    level = roots.select("site_id", F.array(F.col("pos")).alias("place"), "url")
    levels = [level]
    for _ in range(max_level):
        below = level.join(nested, "url").select("site_id", "place", F.posexplode("_children").alias("_pos", "url"))
        level = below.select("site_id", F.concat("place", F.array("_pos")).alias("place"), "url")
        levels.append(level)
    # Only lists of addresses are shuffled, and those of the leaves only once.
    found = reduce(DataFrame.unionByName, levels).join(leaves, "url")
    listed = found.select("site_id", "place", F.posexplode("_locs").alias("_pos", "_loc"))
    urls = listed.select(
        "site_id", F.concat("place", F.array("_pos")).alias("place"), normalize_url("_loc").alias("url")
    )
    if max_pages is None:
        return urls
    return top_per(urls, ["site_id"], [F.asc("place"), F.asc("url")], max_pages)


def default_roots(sites: DataFrame, named: DataFrame) -> DataFrame:
    """Sitemaps named in robots.txt; a site that names none has ``/sitemap.xml``."""
    own = sites.select(F.col("id").alias("site_id"), F.regexp_extract("url", "^([^:]+)://", 1).alias("_scheme"), "domain")
    usual = own.join(named.select("site_id"), "site_id", "left_anti").select(
        "site_id", F.lit(0).alias("pos"), F.concat("_scheme", F.lit("://"), "domain", F.lit("/sitemap.xml")).alias("url")
    )
    return named.select("site_id", "pos", "url").unionByName(usual)
