"""Benchmark decontamination by greedy string tiling.

A seed is the running Karp-Rabin hash of ``RUN`` words. Seeds of all documents are
joined with those of the benchmark items; a fixed-size bit filter of the items' seeds
keeps most others from the shuffle and changes no result. For each pair that shares a
seed, the longest match of unmarked words is marked on both sides again and again
until none of ``RUN`` words is left. An item leaks into a document when the tiles
cover at least ``COVERAGE`` of its words, in whatever order they stand.

Words are runs of letters and digits, without regard to case. Hashes have 64 bits.

Defined cases: a null or empty text, and an item of fewer than ``RUN`` words, matches
nothing; a null id is an id; repeated rows are reported once each; without items there
are no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import PIECE, fresh, table
from linkloom.session import cut_lineage

RUN = 5
COVERAGE = 0.5
#: Bits of the filter, as a power of two.
FILTER = 26
BASE = 0x9E3779B97F4A7C15
#: Words whose hashes a task keeps.
CACHE = 1 << 18

WORD = re.compile(r"[^\W_]+")


class Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: str, words: Words) -> np.ndarray:
    """Hash of each word, of a long text some ``PIECE`` characters at a time."""
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end].isalnum():
            end += 1
        found = WORD.findall(text[at:end].lower())
        parts.append(np.fromiter(map(words.__getitem__, found), np.uint64, len(found)))
        at = end
    return np.concatenate(parts)


def seeds(text: str | None, words: Words, run: int = RUN) -> np.ndarray:
    """Hash of the ``run`` words from each place on."""
    own = word_hashes(text or "", words)
    n = len(own) - run + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = out * np.uint64(BASE) + own[k : k + n]
    return out ^ (out >> np.uint64(29))


def tiles(at: list[int], doc: list[int], item: list[int], run: int = RUN) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, words).

    ``doc`` has the seeds of a document at its places ``at``, ascending; ``item`` all
    seeds of the item.
    """
    where: dict[int, list[int]] = {}
    for i, seed in enumerate(item):
        where.setdefault(seed, []).append(i)
    runs: list[tuple[int, int, int]] = []
    open_: dict[int, tuple[int, int]] = {}  # by place in the item: where a run began, and in the document
    last = None
    for d, seed in zip(at, doc):
        before = open_ if last == d - 1 else {}
        now = {i: before.pop(i - 1, (i, d)) for i in where.get(seed, ())}
        if last != d - 1:
            before = open_
        runs += [(i + run - b, e, b) for i, (b, e) in before.items()]
        open_, last = now, d
    runs += [(i + run - b, e, b) for i, (b, e) in open_.items()]
    # Free stretches of the runs, longest first; a run that is cut goes back with what is left.
    heap = [(-n, d, i) for n, d, i in runs]
    heapq.heapify(heap)
    doc_marks: set[int] = set()
    item_marks: set[int] = set()
    out = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        taken = [k for k in range(n) if d + k in doc_marks or i + k in item_marks]
        if not taken:
            out.append((d, i, n))
            doc_marks.update(range(d, d + n))
            item_marks.update(range(i, i + n))
            continue
        begin = 0
        for k in [*taken, n]:
            if k - begin >= run:
                heapq.heappush(heap, (begin - k, d + begin, i + begin))
            begin = k + 1
    return out


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) -> item_id, n_words, seeds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            own = [seeds(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(s) + RUN - 1 for s in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))],
                ["item_id", "n_words", "seeds"],
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    read_ = benchmark.select("item_id", "text").mapInArrow(read, f"item_id {kind}, n_words long, seeds array<long>")
    return read_.where(F.size("seeds") > 0)


def seed_filter(items: DataFrame) -> np.ndarray:
    """One bit for each value of the top ``FILTER`` bits that a seed of an item has."""
    bit = F.shiftrightunsigned("seed", 64 - FILTER)
    words = (
        items.select(F.explode("seeds").alias("seed"))
        .select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER}) & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> doc_id, item_id, coverage, n_tiles,
    longest, copies, and the text's hashes x and y, for each leak."""
    items = cut_lineage(item_seeds(benchmark), "item-seeds")
    bits = seed_filter(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows, places, values = [], [], []
            for row, text in enumerate(batch.column(1)):
                own = seeds(text.as_py(), words)
                spot = own >> np.uint64(64 - FILTER)
                hit = np.flatnonzero((bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1))
                if len(hit):
                    rows.append(row)
                    places.append(hit)
                    values.append(own[hit].view(np.int64))
            if rows:
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), batch.column(3).take(pa.array(rows)),
                     pa.array(places, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))],
                    ["doc_id", "x", "y", "places", "seeds"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), F.col("text")).alias("y"))
        .mapInArrow(scan, f"doc_id {kind}, x long, y long, places array<long>, seeds array<long>")
        .groupBy(F.struct("doc_id", "x", "y").alias("key"))
        .agg(F.first("places").alias("places"), F.first("seeds").alias("seeds"), F.count(F.lit(1)).alias("copies"))
    )
    hits = cut_lineage(hits, "seed-hits")
    pairs = (
        hits.select("key", F.explode(F.array_distinct("seeds")).alias("seed"))
        .join(items.select("item_id", F.explode(F.array_distinct("seeds")).alias("seed")), "seed")
        .select("key", "item_id")
        .distinct()
    )
    both = pairs.join(hits, "key").join(items.withColumnRenamed("seeds", "item_seeds"), "item_id")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                tiles(r["places"], r["seeds"], r["item_seeds"])
                for r in batch.select(["places", "seeds", "item_seeds"]).to_pylist()
            ]
            yield pa.record_batch(
                [batch.column("key"), batch.column("item_id"), batch.column("copies"), batch.column("n_words"),
                 pa.array([sum(t[2] for t in f) for f in found], pa.int64()),
                 pa.array([len(f) for f in found], pa.int64()),
                 pa.array([max((t[2] for t in f), default=0) for f in found], pa.int64())],
                ["key", "item_id", "copies", "n_words", "covered", "n_tiles", "longest"],
            )

    columns = ["key", "item_id", "copies", "n_words", "places", "seeds", "item_seeds"]
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    key_kind = hits.schema["key"].dataType.simpleString()
    tiled = both.select(*columns).mapInArrow(
        tile, f"key {key_kind}, item_id {item_kind}, copies long, n_words long, covered long, n_tiles long, longest long"
    )
    share = F.col("covered") / F.col("n_words")
    return tiled.where(share >= coverage).select(
        F.col("key.doc_id").alias("doc_id"), "item_id", share.alias("coverage"), "n_tiles", "longest", "copies",
        F.col("key.x").alias("x"), F.col("key.y").alias("y"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` that no item leaks into."""
    x, y = fresh(docs, "x", "y")
    found = cut_lineage(
        leaks(docs, benchmark, coverage).select(F.col("x").alias(x), F.col("y").alias(y)).distinct(), "leaked-texts"
    )
    keyed = docs.withColumn(x, F.xxhash64("text")).withColumn(y, F.xxhash64(F.lit(1), F.col("text")))
    return keyed.join(found, [x, y], "left_anti").select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "item_id", "coverage", "n_tiles", "longest")
