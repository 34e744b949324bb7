"""Word rules, row splits and distributed running sums that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PIECE = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Folded words of a text, some ``PIECE`` bytes at a time."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        yield raw[at:end].lower().split()
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names like ``stems`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"{stem}_{uuid.uuid4().hex[:8]}"
        taken.add(name.lower())
        names.append(name)
    return names


def running(
    df: DataFrame,
    order: list[Column],
    pos: str = "pos",
    sums: dict[str, str] | None = None,
    name: str = "running",
) -> DataFrame:
    """Rows in the total order ``order`` with their 0-based position ``pos`` and,
    for each ``new: column`` of ``sums``, the sum of ``column`` over all rows before.

    One range exchange deals the rows out and sorts them; the sorted table is
    written to the shared folder. What the pieces hold is added up in a table of
    one row per piece, so no task sees more than its own piece.
    """
    sums = sums or {}
    mark, piece, first, start = fresh(df, "mark", "piece", "first", "start")
    laid = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(mark, F.monotonically_increasing_id()),
        name,
    ).withColumn(piece, F.shiftright(mark, 33))
    totals = laid.groupBy(piece).agg(
        F.min(mark).alias(first),
        F.count(F.lit(1)).alias(start),
        *(F.sum(c).alias(new) for new, c in sums.items()),
    )
    before = Window.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        piece,
        first,
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in (start, *sums)),
    )
    out = laid
    if sums:
        inside = Window.partitionBy(piece).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
        inner = fresh(laid, *(f"{new}_inner" for new in sums))
        out = laid.select(
            "*",
            *(
                F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(i)
                for i, c in zip(inner, sums.values())
            ),
        )
    else:
        inner = []
    # One row per piece: as many as the exchange has partitions.
    out = out.join(F.broadcast(offsets), piece)
    return out.select(
        *df.columns,
        (F.col(start) + F.col(mark) - F.col(first)).alias(pos),
        *((F.col(new) + F.col(i)).alias(new) for new, i in zip(sums, inner)),
    )
