"""Take out repeated and worthless pages before a site is listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.classify import is_challenge, is_junk_title
from linkloom.functions.text import text_key
from linkloom.plans.ordering import first_per


def input_order() -> list[Column]:
    """Order in which the pages of a site are looked at."""
    return [F.desc("relevance_score"), F.asc("depth"), F.asc("url")]


def dedup_url(df: DataFrame, order: list[Column]) -> DataFrame:
    return first_per(df, ["site_id", "url"], order)


def drop_junk(df: DataFrame) -> DataFrame:
    return df.filter(~is_junk_title("title"))


def dedup_title(df: DataFrame, tie_break: list[Column] | None = None) -> DataFrame:
    """Keep the most relevant page per title; ties keep the earlier page."""
    keyed = df.withColumn("_title_key", text_key(F.col("title")))
    order = [F.desc("relevance_score"), *(tie_break or [F.asc("depth"), F.asc("url")])]
    return first_per(keyed, ["site_id", "_title_key"], order).drop("_title_key")


def clean_pages(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """URL first, then junk, then title: a clean copy of a URL whose first row was junk stays lost."""
    return dedup_title(drop_junk(dedup_url(df, order or input_order())))


def challenge_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(is_challenge("html"))
