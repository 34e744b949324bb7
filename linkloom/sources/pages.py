"""Fetched pages, as a table and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.schemas import RAW_PAGES


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Table of fetched pages, read as it lies."""
    return spark.read.schema(RAW_PAGES).parquet(path)


def read_page_stream(spark: SparkSession, path: str, max_files: int = 1000, names: str = "*.parquet") -> DataFrame:
    """New files below ``path`` as they arrive."""
    reader = spark.readStream.schema(RAW_PAGES).option("maxFilesPerTrigger", max_files)
    return reader.option("pathGlobFilter", names).parquet(path)
