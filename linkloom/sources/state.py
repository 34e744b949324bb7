"""The six state tables as plain parquet folders.

The caller names the folder of a version, for instance ``<root>/pages/v=7``; a folder
is written once and never changed, so readers of a version keep it. Rows lie in the
order of their site, split by range: a question about one site is pushed to the scan
and touches the few files whose value range holds it, and a hot site has many files.
Keys that the order does not help, of jobs, files and schedules, have Bloom filters: a
question about one of them opens only the row groups that may hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.schemas import UNIQUE_KEYS, duplicate_keys, table_schema


#: Columns a row is looked up by, besides its site.
LOOKUP = {"id", "crawl_job_id", "idempotency_key", "url"}


def site_column(name: str) -> str:
    return "id" if name == "sites" else "site_id"


def write_state(df: DataFrame, name: str, path: str, check: bool = False) -> None:
    """Write a version of a table; with ``check`` only if its keys are unique."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema(name).fields])
    if check:
        wrong = repeated_keys({name: typed}).limit(5).collect()
        if wrong:
            raise ValueError(f"keys of {name} repeat: {wrong}")
    order = dict.fromkeys([site_column(name), "id"])
    writer = typed.repartitionByRange(*order).sortWithinPartitions(*order).write
    # A filter is as large as its row group needs.
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for key in sorted(LOOKUP & set(typed.columns)):
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def read_state(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(table_schema(name)).parquet(path)


def read_site(spark: SparkSession, name: str, path: str, site_id: int) -> DataFrame:
    """Rows of one site; the equality reaches the parquet scan."""
    return read_state(spark, name, path).filter(F.col(site_column(name)) == site_id)


def repeated_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, key, value, copies) of every key value that more than one row of a table holds."""
    found = None
    for name, df in tables.items():
        for key in UNIQUE_KEYS[name]:
            rows = duplicate_keys(df, key).select(
                F.lit(name).alias("tbl"),
                F.lit(", ".join(key)).alias("key"),
                F.concat_ws(", ", *[F.col(c).cast("string") for c in key]).alias("value"),
                "copies",
            )
            found = rows if found is None else found.unionByName(rows)
    return found
