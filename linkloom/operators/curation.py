"""Indexes built from a supplied selection plan (JSON, one per site)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import empty_to_null, md_link, sha256, strip, strip_tagline
from linkloom.operators.render import OPTIONAL, section_head, site_head
from linkloom.plans.ordering import first_per, top_per
from linkloom.schemas import PLAN
from linkloom.session import cut_lineage

# Fixed value: most links in an index built from a plan.
MAX_LINKS = 75
BROKEN = "_broken"


def _parsed(plans: DataFrame) -> DataFrame:
    schema = f"{PLAN}, {BROKEN} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    plan = F.from_json(strip(F.coalesce("json", F.lit(""))), schema, options)
    parsed = plans.withColumn("_plan", plan)
    usable = (
        (F.coalesce(F.col("finish_reason"), F.lit("")) != "length")
        & F.col("_plan").isNotNull()
        & F.col(f"_plan.{BROKEN}").isNull()
        & F.col("_plan.site_description").isNotNull()
        & F.col("_plan.sections").isNotNull()
        & F.col("_plan.optional").isNotNull()
    )
    return parsed.withColumn("usable", F.coalesce(usable, F.lit(False)))


def split_plans(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable plans (site_id, site_description, sections) and the sites that have none.

    Optional entries become one last section.
    """
    parsed = _parsed(plans)
    optional = F.struct(F.lit(OPTIONAL).alias("name"), F.col("_plan.optional").alias("pages"))
    usable = parsed.filter("usable").select(
        "site_id",
        F.col("_plan.site_description").alias("site_description"),
        F.concat(F.col("_plan.sections"), F.array(optional)).alias("sections"),
    )
    return usable, parsed.filter(~F.col("usable")).select("site_id")


def usable_plans(plans: DataFrame) -> DataFrame:
    """The usable plans, written once: whatever reads them does not parse again.

    Plans that have been parsed come back as they are.
    """
    return plans if "sections" in plans.columns else cut_lineage(split_plans(plans)[0], "plans")


def adopt_descriptions(sites: DataFrame, plans: DataFrame) -> DataFrame:
    """Sites with the description their usable plan gives, if it gives one."""
    told = usable_plans(plans).select(F.col("site_id").alias("id"), empty_to_null(F.col("site_description")).alias("_told"))
    joined = sites.join(told, "id", "left")
    return joined.withColumn("description", F.coalesce("_told", "description")).select(*sites.columns)


def parse_plans(plans: DataFrame) -> DataFrame:
    """One row per plan entry, with its place."""
    sections = (plans if "sections" in plans.columns else split_plans(plans)[0]).select(
        "site_id", "site_description", F.posexplode("sections").alias("section_pos", "_section")
    )
    entries = sections.select(
        "site_id",
        "site_description",
        "section_pos",
        F.col("_section.name").alias("section"),
        F.posexplode("_section.pages").alias("entry_pos", "_entry"),
    )
    return entries.select(
        "site_id",
        "site_description",
        "section_pos",
        "section",
        "entry_pos",
        F.col("_entry.id").alias("id"),
        F.col("_entry.title").alias("title"),
        F.col("_entry.description").alias("description"),
    )


def resolve_plan(entries: DataFrame, numbered: DataFrame) -> DataFrame:
    """Entries that name a real page, with that page's URL and its texts as fallback."""
    pages = numbered.select(
        "site_id",
        F.col("list_id").alias("id"),
        "url",
        F.col("title").alias("_title"),
        F.col("description").alias("_description"),
    )
    return entries.join(pages, ["site_id", "id"]).select(
        "site_id",
        "section_pos",
        "section",
        "entry_pos",
        "url",
        F.coalesce(empty_to_null(F.col("title")), empty_to_null(F.col("_title")), F.col("url")).alias("title"),
        F.coalesce(empty_to_null(F.col("description")), F.col("_description")).alias("description"),
    )


def plan_cap(resolved: DataFrame, limit: int = MAX_LINKS) -> DataFrame:
    """First place of each URL, then the first ``limit`` of the site."""
    order = [F.asc("section_pos"), F.asc("entry_pos")]
    return top_per(first_per(resolved, ["site_id", "url"], order), ["site_id"], order, limit)


def assemble_plan(sites: DataFrame, plans: DataFrame, numbered: DataFrame, limit: int = MAX_LINKS) -> DataFrame:
    """Index of every site with a usable plan; at most ``limit`` links per site are gathered."""
    usable = usable_plans(plans)
    entries = plan_cap(resolve_plan(parse_plans(usable), numbered), limit)
    link = F.concat(md_link(F.col("title"), F.col("url"), F.col("description")), F.lit("\n"))
    placed = entries.select("site_id", F.struct("section_pos", "entry_pos", "section", link.alias("link")).alias("_e"))
    gathered = placed.groupBy("site_id").agg(F.sort_array(F.collect_list("_e")).alias("_entries"))

    def opens(entry, i):
        earlier = F.get(F.col("_entries"), i - 1)["section_pos"]
        return F.when(~earlier.eqNullSafe(entry["section_pos"]), section_head(entry["section"])).otherwise(F.lit(""))

    body = F.array_join(F.transform("_entries", lambda e, i: F.concat(opens(e, i), e["link"])), "")
    bodies = gathered.select("site_id", body.alias("_body"))
    about = F.coalesce(empty_to_null(F.col("site_description")), F.col("description"))
    name = strip_tagline(F.coalesce(empty_to_null(F.col("title")), F.col("domain")))
    known = sites.select(F.col("id").alias("site_id"), "title", "domain", "description")
    content = F.concat(site_head(name, about), F.coalesce("_body", F.lit("")))
    return (
        usable.select("site_id", "site_description")
        .join(known, "site_id")
        .join(bodies, "site_id", "left")
        .select("site_id", content.alias("content"))
        .withColumn("content_hash", sha256(F.col("content")))
    )
