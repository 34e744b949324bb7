"""The corpus pipeline: language ID, near-copies, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir), works on all rows it is given, and returns the
columns of ``documents``; the last one adds ``shard`` and ``slot``. Between stages the
rows are written as Parquet in the shared folder and read again.

Defined cases, for every stage: an empty table gives an empty table with its columns; columns
of any other names come along, also those that operators use themselves, and where ``docs`` has a
``shard`` or ``slot`` of its own the new one gets a longer name; ids and sources may be null or repeat;
texts of any length are read whole.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linkloom.llm import langid, mixing, sharding, simhash, tiling  # noqa: E402
from linkloom.llm.common import table  # noqa: E402
from linkloom.session import cut_lineage  # noqa: E402


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that language ID accepts (operator 1); it learns from the rows given.

    Rows go that have no letter, a null text included, or that no learned language codes in fewer
    than 8 bits a byte. If no row has both a language and a text, nothing is learned and all rows go.
    """
    return langid.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of least id, of each SimHash group (operator 10).

    The row of a null id stays only if its whole group has null ids; of rows alike in every column
    one stays.
    """
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no item of ``benchmark`` leaks into (operator 6). A null or short text holds none."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix, one for each epoch a row is taken in (operator 4). Null sources are one
    source; rows without words go."""
    return mixing.mixed_documents(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and place (operator 8). A null text has no bytes."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("language_id", in_known_language),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("mix", mixed),
    ("shards", in_shards),
]

#: Trained trees, fingerprint links and tilings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
