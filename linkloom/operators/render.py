"""Render one Markdown index per site.

The text of an index is the plain concatenation of pieces (site head, section
heads, links) in a total order. Each index is one row with one hash, so its text
is put together in one place; the pieces are glued section by section first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import empty_to_null, md_link, sha256
from linkloom.operators.dedup import dedup_url, input_order
from linkloom.operators.listing import OPTIONAL_BELOW

# Section names in the order they are written.
SECTION_ORDER = [
    "Getting Started",
    "Documentation",
    "API Reference",
    "Guides",
    "Examples",
    "Core Pages",
    "FAQ",
    "Changelog",
    "About",
    "Blog",
    "Other",
]
OPTIONAL = "Optional"


def site_head(title: Column, description: Column) -> Column:
    about = F.coalesce(F.concat(F.lit("\n\n> "), empty_to_null(description)), F.lit(""))
    return F.concat(F.lit("# "), title, about, F.lit("\n"))


def section_head(name: Column) -> Column:
    return F.concat(F.lit("\n## "), name, F.lit("\n\n"))


def sectioned(pages: DataFrame) -> DataFrame:
    """One row per URL with the section it is shown in; unknown categories are dropped."""
    order = F.array(*[F.lit(s) for s in [*SECTION_ORDER, OPTIONAL]])
    section = F.when(F.col("relevance_score") < OPTIONAL_BELOW, F.lit(OPTIONAL)).otherwise(F.col("category"))
    placed = dedup_url(pages, input_order()).withColumn("section", section)
    placed = placed.withColumn("section_pos", F.array_position(order, F.col("section")))
    # A page whose category happens to be called like the optional section is unknown, too.
    known = (F.col("section_pos") > 0) & (
        (F.col("section") != OPTIONAL) | (F.col("relevance_score") < OPTIONAL_BELOW)
    )
    return placed.filter(known)


def category_counts(pages: DataFrame) -> DataFrame:
    return sectioned(pages).groupBy("site_id", "section").agg(F.count("*").alias("pages"))


def glue(pieces: DataFrame) -> DataFrame:
    """Pieces (site_id, section_pos, kind, relevance_score, depth, url, piece) -> indexes."""
    best_first = F.struct((-F.col("relevance_score")).alias("score"), "depth", "url", "piece")
    rows = pieces.select("site_id", "section_pos", F.struct("kind", best_first.alias("p")).alias("_p"))
    texts = F.transform(F.sort_array(F.collect_list("_p")), lambda x: x["p"]["piece"])
    sections = rows.groupBy("site_id", "section_pos").agg(F.array_join(texts, "").alias("_text"))
    placed = F.sort_array(F.collect_list(F.struct("section_pos", "_text")))
    whole = F.array_join(F.transform(placed, lambda x: x["_text"]), "")
    return sections.groupBy("site_id").agg(whole.alias("content")).withColumn("content_hash", sha256(F.col("content")))


def render_index(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Active ``pages`` of ``sites`` -> (site_id, content, content_hash).

    A site without pages still gets its head.
    """
    placed = sectioned(pages)
    blank = {
        "relevance_score": F.lit(None).cast("double"),
        "depth": F.lit(None).cast("int"),
        "url": F.lit(None).cast("string"),
    }
    columns = ["site_id", "section_pos", "kind", "relevance_score", "depth", "url", "piece"]
    label = F.coalesce(empty_to_null(F.col("title")), F.col("url"))
    links = placed.withColumns(
        {
            "kind": F.lit(1),
            "piece": F.concat(md_link(label, F.col("url"), F.col("description")), F.lit("\n")),
            "section_pos": F.col("section_pos").cast("int"),
            "depth": F.col("depth").cast("int"),
        }
    ).select(columns)
    sections = (
        placed.select("site_id", F.col("section_pos").cast("int").alias("section_pos"), "section")
        .distinct()
        .withColumns({"kind": F.lit(0), "piece": section_head(F.col("section")), **blank})
        .select(columns)
    )
    name = F.coalesce(empty_to_null(F.col("title")), F.col("domain"))
    heads = sites.select(
        F.col("id").alias("site_id"), site_head(name, F.col("description")).alias("piece")
    ).withColumns({"section_pos": F.lit(0), "kind": F.lit(0), **blank})
    pieces = heads.select(columns).unionByName(links).unionByName(sections)
    # Pages of unknown sites have no head to stand under. The few finished indexes
    # are filtered, not the many pieces.
    return glue(pieces).join(heads.select("site_id"), "site_id", "left_semi")


def index_description(files: DataFrame, sites: DataFrame) -> DataFrame:
    """First quoted line of an index, else the site's own description."""
    quoted = files.select(
        "site_id",
        empty_to_null(F.regexp_extract("content", r"(?m)^> ([^\r\n\x{2028}\x{2029}]+)$", 1)).alias("_quoted"),
    )
    joined = sites.select(F.col("id").alias("site_id"), F.col("description")).join(quoted, "site_id", "left")
    return joined.select(
        "site_id", F.coalesce("_quoted", empty_to_null(F.col("description"))).alias("description")
    )
