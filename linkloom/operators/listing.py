"""The numbered page listing of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import text_key
from linkloom.plans.ordering import ranked, top_per

# The selection limits.
MAIN_PICKS = 20
OPTIONAL_PICKS = 5
OPTIONAL_BELOW = 0.3


def assign_page_ids(pages: DataFrame) -> DataFrame:
    """Dense ids 1..n per site by depth, then URL."""
    return ranked(pages, ["site_id"], [F.asc("depth"), F.asc("url")], "list_id")


def listing_lines(numbered: DataFrame, sites: DataFrame, description_chars: int | None = None) -> DataFrame:
    """``[id] title — description``; a description that says nothing new is left out.

    Longer descriptions than ``description_chars``, if given, end in dots.
    """
    about = sites.select(F.col("id").alias("site_id"), text_key(F.col("description")).alias("_about"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("(no title)"))
    description = F.coalesce("description", F.lit(""))
    key = text_key(description)
    told = (F.coalesce(F.col("_about"), F.lit("")) != "") & (key == F.col("_about"))
    shown = (description != "") & ~told & (key != text_key(title))
    cut = description
    if description_chars is not None:
        dotted = F.concat(F.left(description, F.lit(description_chars)), F.lit("..."))
        cut = F.when(F.length(description) > description_chars, dotted).otherwise(description)
    head = F.concat(F.lit("["), F.col("list_id").cast("string"), F.lit("] "), title)
    line = F.when(shown, F.concat(head, F.lit(" — "), cut)).otherwise(head)
    return numbered.join(about, "site_id", "left").select("site_id", "list_id", "url", line.alias("line"))


def top_pages(pages: DataFrame, k: int = MAIN_PICKS, optional_k: int = OPTIONAL_PICKS) -> DataFrame:
    """The best pages of each site, main and optional counted apart.

    Stands in for a chosen plan when a site has none.
    """
    grouped = pages.withColumn("optional", F.col("relevance_score") < OPTIONAL_BELOW)
    order = [F.desc("relevance_score"), F.asc("depth"), F.asc("url")]
    best = top_per(grouped, ["site_id", "optional"], order, max(k, optional_k), "rank")
    return best.filter(F.col("rank") <= F.when(F.col("optional"), optional_k).otherwise(k))
