"""The pages table laid out for its own merge.

Pages lie in parts by site, and in each part in buckets by (site_id, url). A crawl is compared
with the parts of its sites only, bucket by bucket: of the two sides just the crawl is shuffled,
and just those parts are written again. A hot site fills one part, but all its buckets.

The table is a folder of parquet files; any session can open it, and ``parts`` and ``buckets``
must be those it was written with.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.snapshot import KEY, snapshot_diff, snapshot_merge
from linkloom.schemas import TABLES, table_schema
from linkloom.session import cut_lineage

PARTS = 64
BUCKETS = 64
#: Sites named one by one in the scan of a part; more are joined.
NAMED_SITES = 1000


def _table(path: str) -> str:
    return f"pages_{hashlib.md5(path.encode()).hexdigest()}"


def part_of(site: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(parts)).cast("int")


def write_pages(pages: DataFrame, path: str, parts: int = PARTS, buckets: int = BUCKETS) -> DataFrame:
    """Lay ``pages`` out in a new folder and return the table."""
    typed = pages.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema("pages").fields])
    dealt = typed.withColumn("part", part_of(F.col("site_id"), parts)).repartition(buckets, *KEY)
    writer = dealt.write.partitionBy("part").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path)
    writer.saveAsTable(_table(path))
    return open_pages(pages.sparkSession, path, buckets)


def open_pages(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table of a folder, with its column ``part``."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        keys = ", ".join(KEY)
        spark.sql(
            f"CREATE TABLE {name} ({TABLES['pages']}, part int) USING parquet PARTITIONED BY (part)"
            f" CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def forget_pages(spark: SparkSession, path: str) -> None:
    """Take the table out of the session's catalog; the folder stays."""
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")


class _Crawl:
    """What a crawl touches: its sites, and the parts they lie in."""

    def __init__(self, crawled: DataFrame, sites: DataFrame | None, parts: int):
        own = (crawled if sites is None else sites).select("site_id").distinct()
        # One number a part at most, and as many sites as are named.
        self.parts = [r.part for r in own.select(part_of(F.col("site_id"), parts).alias("part")).distinct().collect()]
        named = [r.site_id for r in own.limit(NAMED_SITES + 1).collect()]
        self.named = named if len(named) <= NAMED_SITES else None
        self.sites = own

    def touched(self, pages: DataFrame) -> DataFrame:
        return pages.filter(F.col("part").isin(self.parts))

    def of_sites(self, pages: DataFrame, inside: bool = True) -> DataFrame:
        rows = self.touched(pages)
        if self.named is None:
            return rows.join(self.sites, "site_id", "left_semi" if inside else "left_anti")
        mine = F.col("site_id").isin(self.named)
        return rows.filter(mine if inside else ~mine)


def diff_pages(
    pages: DataFrame, crawled: DataFrame, sites: DataFrame | None = None, aborted_sites: DataFrame | None = None, parts: int = PARTS
) -> DataFrame:
    """``snapshot_diff`` of a crawl with the stored pages of its sites.

    ``sites`` (site_id) were crawled, those without any page included; by default the sites of ``crawled``.
    """
    return snapshot_diff(_Crawl(crawled, sites, parts).of_sites(pages), crawled, aborted_sites)


def merge_pages(
    spark: SparkSession,
    path: str,
    crawled: DataFrame,
    now: Column,
    sites: DataFrame | None = None,
    aborted_sites: DataFrame | None = None,
    parts: int = PARTS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Merge a crawl into the table and return its changes (site_id, url, change).

    Sites that were not crawled keep their rows. The rows of the touched parts are put together
    in the shared folder first and replace their parts after that, so a lost executor leaves the
    table as it was.
    """
    pages = open_pages(spark, path, buckets)
    crawl = _Crawl(crawled, sites, parts)
    merged = snapshot_merge(crawl.of_sites(pages).drop("part"), crawled, now, aborted_sites, taken=pages)
    kept = crawl.of_sites(pages, inside=False).drop("part").withColumn("change", F.lit(None).cast("string"))
    whole = cut_lineage(merged.unionByName(kept), "next-pages")
    dealt = whole.drop("change").withColumn("part", part_of(F.col("site_id"), parts)).repartition(buckets, *KEY)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        dealt.write.insertInto(_table(path), overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    spark.catalog.refreshTable(_table(path))
    return whole.filter("change IS NOT NULL").select(*KEY, "change")
