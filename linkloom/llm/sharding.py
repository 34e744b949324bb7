"""Sharding by histogram sort.

The order of the rows is (hash of the text, hash of the id, place), so equal texts
stand together. Exact byte counts below candidate keys are taken over all rows, and
the candidates around each wanted boundary are refined until a single text is left.
A boundary goes to the nearer edge of that text's group if the edge lies within the
tolerance, else into the group, refined on in the same way by id. Then the rows are
dealt out once, by range, and numbered from the counts of the sorted pieces.

Defined cases: a null text has no bytes and equals the empty text; every row has
one byte on top, so empty rows spread, too; null and repeated ids are ordered by
place; an empty table gives no rows. To the driver come only the counts of a pass,
at most ``shards * 16 ** STEP`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import fresh, running, table
from linkloom.session import cut_lineage

SHARDS = 16
TOLERANCE = 0.01
#: Hex digits by which the candidate keys grow in one pass.
STEP = 2
#: Digits of the key that stand for the text.
TEXT_DIGITS = 32


def sort_key(mark: str) -> Column:
    """Digits of the text's hash, of the id's hash, and the place of the row."""
    return F.concat(
        F.md5(F.coalesce(F.col("text"), F.lit(""))),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        F.lpad(F.hex(mark), 16, "0"),
    )


def row_size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def splitters(keyed: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[str]:
    """Ascending keys: a row is in shard k if k of them are at or below its key.

    ``keyed`` has ``key`` and ``size``. Each pass counts, over all rows, the bytes
    below ``16 ** STEP`` candidates in every range that still holds a boundary.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    # Of a boundary: bytes wanted below it, the common prefix of its range, bytes below that range.
    wanted = {k: (total * k / shards, "", 0) for k in range(1, shards)} if total else {}
    found: dict[int, str] = {}
    while wanted:
        ranges: dict[int, set[str]] = {}
        for _, prefix, _ in wanted.values():
            ranges.setdefault(len(prefix), set()).add(prefix)
        counts: dict[str, list] = {}
        for n, prefixes in ranges.items():
            inside = keyed.where(F.substring("key", 1, n).isin(sorted(prefixes))) if n else keyed
            probes = inside.groupBy(F.substring("key", 1, n + STEP).alias("probe")).agg(
                F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")
            )
            for r in probes.collect():
                counts.setdefault(r.probe[:n], []).append(r)
        for k, (goal, prefix, below) in list(wanted.items()):
            for r in sorted(counts[prefix]):
                if below + r["size"] >= goal:
                    break
                below += r["size"]
            short, over = goal - below, below + r["size"] - goal
            one_text = r.low[:TEXT_DIGITS] == r.high[:TEXT_DIGITS]
            if r.low == r.high or one_text and min(short, over) <= slack:
                found[k] = r.low if short < over else r.high + "0"
                del wanted[k]
            else:
                same = next(i for i, (a, b) in enumerate(zip(r.low, r.high)) if a != b)
                wanted[k] = (goal, r.low[:same], below)
    return [found[k] for k in sorted(found)]


def assign(keyed: DataFrame, bounds: list[str], key: str, shard: str, slot: str) -> DataFrame:
    """Deal ``keyed`` out by range once; add the shard and the place in it.

    Whole rows may be passed: they move in that one exchange only, and what is joined
    to them afterwards, one row per piece and one per shard, is sent to where they lie.
    """
    passed = [F.when(F.col(key) >= b, 1).otherwise(0) for b in bounds]
    number = sum(passed[1:], passed[0]) if passed else F.lit(0)
    pos, first = fresh(keyed, "pos", "first")
    laid = running(keyed.withColumn(shard, number.cast("int")), [F.col(key).asc()], pos=pos, name="shards")
    firsts = laid.groupBy(shard).agg(F.min(pos).alias(first))
    # One row per shard.
    return laid.join(F.broadcast(firsts), shard).select(*keyed.columns, shard, (F.col(pos) - F.col(first)).alias(slot))


def shard_rows(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select("doc_id", "text").withColumn("mark", F.monotonically_increasing_id())
    keyed = cut_lineage(
        rows.select(
            "doc_id",
            row_size().alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            sort_key("mark").alias("key"),
        ),
        "shard-keys",
    )
    placed = assign(keyed, splitters(keyed, shards, tolerance), "key", "shard", "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, stored in the order of the shards."""
    mark, key, size, shard, slot = fresh(docs, "mark", "key", "size", "shard", "slot")
    rows = docs.withColumn(mark, F.monotonically_increasing_id()).withColumn(key, sort_key(mark))
    slim = cut_lineage(rows.select(F.col(key).alias("key"), row_size().alias("size")), "shard-keys")
    placed = assign(rows.drop(mark), splitters(slim, shards, tolerance), key, shard, slot)
    return placed.drop(key)


def op8(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
