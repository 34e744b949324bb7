"""Exact search of the greatest inner products over vectors sorted by length.

Components become integers, so scores are exact. Equal vectors are one entry with
their ``k + 1`` least ids. Entries are turned by the right singular vectors of all entries,
which puts most of a product into the first components, and laid out by descending length. A
query reads entries in that order: by Cauchy-Schwarz, the product of two lengths bounds a
score, so a run of shorter entries is passed over whole. In the others, partial sums over
more and more turned components, with the product of the lengths of what is left,
bound each score; only entries that may reach the ``k`` best are multiplied out in integers.
Each query brings a bar to be cleared from the start, its ``k``-th best score among the ``HEAD``
longest entries. Bounds give way for rounding, so nothing is missed.

Queries are a stated share of the rows and meet all entries, in blocks of at most ``BLOCK``
vectors; a task streams its entries and keeps at most ``k + 1`` a query. The singular vectors
come from the sum of products of components, one row a pair of components.

Defined cases: rows whose id is null, or whose vector is null or holds a null or a component that
is not finite, take no part; an empty or zero vector takes part and scores 0; shorter vectors
count as padded with zeros; rows alike in id and integer vector count once; another vector under a query's
id is a candidate; ties go to the smaller id; fewer than ``k`` candidates are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import running, table
from linkloom.llm.vectors import gathered, integer_matrix, integer_vectors
from linkloom.session import cut_lineage, shared_path

SCALE = 64
K = 20
EVERY = 20
#: Longest entries that give each query its first bar.
HEAD = 4096
#: Queries sent to the tasks at a time; queries and entries of one product.
BLOCK = 16384
QUERIES, ROWS = 128, 4096
#: Shares of the turned components after which bounds are taken.
STAGES = (0.25, 0.5, 0.75)
#: Pairs are multiplied out once no more than this share is left.
FEW = 0.01
#: Sums are taken in 32 bits; bounds give way by this share of the product of the lengths.
ROUNDING = 1e-5


def products(entries: DataFrame, width: int) -> np.ndarray:
    """Sums over all entries of the products of every two components."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in gathered(batches, ROWS):
            own = integer_matrix(batch.column("v"), width).astype(np.float64)
            total += own.T @ own
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.record_batch([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["i", "j", "s"])

    rows = entries.select("v").mapInArrow(add, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width))
    for r in rows.collect():
        out[r.i, r.j] = r.s
    return out


def turn_of(gram: np.ndarray) -> np.ndarray:
    """Right singular vectors, by descending singular value."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors[:, np.argsort(-values)]


class Turned:
    """Integer vectors, turned, with the lengths of what is left after each stage."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.vectors = vectors
        turned = vectors @ turn
        width = turn.shape[0]
        #: The last stage is the whole product.
        self.stops = sorted({max(1, round(width * s)) for s in STAGES} | {width}) if width else []
        self.length = np.sqrt((vectors**2).sum(axis=1).astype(np.float64))
        self.left = [np.linalg.norm(turned[:, s:], axis=1).astype(np.float32) for s in self.stops]
        self.turned = turned.astype(np.float32)

    def part(self, some: slice) -> Turned:
        out = Turned.__new__(Turned)
        out.vectors, out.turned, out.length = self.vectors[some], self.turned[some], self.length[some]
        out.stops, out.left = self.stops, [left[some] for left in self.left]
        return out


def survivors(queries: Turned, rows: Turned, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) whose score may reach the query's bar, by rising partial sums.

    Rows that no query of the group can use go after each stage; once few pairs are left, those are returned.
    """
    bars = (bars - ROUNDING * queries.length * rows.length.max(initial=0) - 1e-3).astype(np.float32)
    sums = np.zeros((len(bars), len(rows.length)), np.float32)
    at, begin = np.arange(len(rows.length)), 0
    ok = np.broadcast_to(bars[:, None] <= 0, sums.shape)
    for stop, left_q, left_r in zip(queries.stops, queries.left, rows.left):
        sums += queries.turned[:, begin:stop] @ rows.turned[at, begin:stop].T
        ok = sums >= bars[:, None] - left_q[:, None] * left_r[at]
        if np.count_nonzero(ok) < FEW * ok.size:
            break
        useful = ok.any(axis=0)
        if np.count_nonzero(useful) < len(at) / 2:
            at, sums, ok = at[useful], sums[:, useful], ok[:, useful]
        begin = stop
    q, r = np.nonzero(ok)
    return q, at[r]


class Best:
    """The best entries found so far of each query, and the bars to clear."""

    def __init__(self, bars: np.ndarray, k: int):
        self.k, self.bars = k, bars.astype(np.float64)
        none = np.zeros(0, np.int64)
        #: Of each query the entries, their least ids and scores.
        self.found = [(none, none, none)] * len(bars)

    def add(self, q: int, *more: np.ndarray) -> None:
        entries, least, scores = (np.concatenate(c) for c in zip(self.found[q], more))
        if len(entries) > self.k:
            keep = np.lexsort((entries, least, -scores))[: self.k]
            entries, least, scores = entries[keep], least[keep], scores[keep]
            self.bars[q] = max(self.bars[q], scores[-1])
        self.found[q] = entries, least, scores

    def read(self, queries: Turned, rows: Turned, entries: np.ndarray, ids: np.ndarray) -> None:
        """Take in entries with their least ids, given by descending length."""
        for a in range(0, len(self.found), QUERIES):
            some = slice(a, a + QUERIES)
            # Rows too short for every query of the group are not looked at.
            least = (self.bars[some] / np.maximum(queries.length[some], 1e-9)).min()
            end = int(np.searchsorted(-rows.length, ROUNDING * rows.length.max(initial=0) + 1e-6 - least, side="right"))
            group = queries.part(some)
            for b in range(0, end, ROWS):
                part = rows.part(slice(b, min(b + ROWS, end)))
                q, r = survivors(group, part, self.bars[some])
                scores = np.einsum("nd,nd->n", group.vectors[q], part.vectors[r])
                good = scores >= self.bars[some][q]
                q, r, scores = q[good], r[good], scores[good]
                at = np.flatnonzero(np.diff(q, prepend=-1))
                for first, last in zip(at.tolist(), np.append(at[1:], len(q)).tolist()):
                    own = b + r[first:last]
                    self.add(a + int(q[first]), entries[own], ids[own], scores[first:last])


def laid_out(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, v) -> entry, least, ids, v, size, x, y: each vector once, by descending length."""
    least = Window.partitionBy("v").orderBy("vec_id")
    entries = (
        rows.withColumn("nth", F.row_number().over(least))
        .where(F.col("nth") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("size", F.aggregate("v", F.lit(0).cast("long"), lambda s, e: s + e.cast("long") * e))
    )
    # Lengths may be few, so a digest parts entries of one length.
    laid = entries.repartitionByRange(F.desc("size"), F.xxhash64("v")).sortWithinPartitions(F.desc("size"))
    # Entries are numbered when they are written, so that a number keeps its meaning.
    return cut_lineage(
        laid.select(F.monotonically_increasing_id().alias("entry"), F.element_at("ids", 1).alias("least"), "ids", "v", "size", *digests()), "product-entries"
    )


def digests():
    return F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), F.col("v")).alias("y")


def greatest_products(vectors: DataFrame, scale: int = SCALE, every: int = EVERY, k: int = K) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    # Trailing zeros are padding; without them equal vectors are equal arrays.
    rows = integer_vectors(vectors.where("vec_id IS NOT NULL"), scale, "vec_id")
    last = F.array_max(F.transform("v", lambda e, i: F.when(e != 0, i + 1).otherwise(0)))
    rows = rows.withColumn("v", F.slice("v", 1, F.coalesce(last, F.lit(0)))).distinct()
    entries = laid_out(rows, k)
    asked = cut_lineage(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", *digests()), "product-queries")
    schema = "qx long, qy long, entry long, least long, score long"
    out = shared_path(spark, "product-candidates")
    spark.createDataFrame([], schema).write.parquet(out)
    width = entries.agg(F.max(F.size("v"))).first()[0]
    if width is not None:
        turn = turn_of(products(entries, width))
        longest = entries.orderBy(F.desc("size"), "entry").limit(HEAD).select("v").toArrow()
        longest = integer_matrix(longest.column("v").combine_chunks(), width)

        def first_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bars = np.full(batch.num_rows, np.iinfo(np.int64).min)
                if len(longest) > k:
                    for a in range(0, batch.num_rows, QUERIES):
                        own = integer_matrix(batch.column("v").slice(a, QUERIES), width)
                        scores = own.astype(np.float64) @ longest.T.astype(np.float64)
                        # One of them may be the query itself.
                        bars[a : a + QUERIES] = -np.partition(-scores, k, axis=1)[:, k].astype(np.int64)
                yield pa.record_batch([*batch.columns, pa.array(bars)], [*batch.schema.names, "bar"])

        once = asked.groupBy("x", "y").agg(F.first("v").alias("v")).mapInArrow(first_bars, "x long, y long, v array<int>, bar long")
        placed = cut_lineage(running(once, [F.col("x"), F.col("y")], name="product-order"), "product-blocks")
        for begin in range(0, placed.count(), BLOCK):
            block = placed.where((F.col("pos") >= begin) & (F.col("pos") < begin + BLOCK)).toArrow()
            qx, qy, bars = (block.column(c).to_numpy() for c in ("x", "y", "bar"))
            queries = integer_matrix(block.column("v").combine_chunks(), width)

            def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                turned, best = Turned(queries, turn), Best(bars, k + 1)
                for batch in gathered(batches, ROWS):
                    own = integer_matrix(batch.column("v"), width)
                    order = np.argsort(-(own**2).sum(axis=1), kind="stable")
                    numbers, least = (batch.column(c).to_numpy()[order] for c in ("entry", "least"))
                    best.read(turned, Turned(own[order], turn), numbers, least)
                for q, found in enumerate(best.found):
                    if len(found[0]):
                        sides = [np.full(len(found[0]), c[q]) for c in (qx, qy)]
                        yield pa.record_batch([pa.array(c) for c in (*sides, *found)], ["qx", "qy", "entry", "least", "score"])

            entries.select("entry", "least", "v").mapInArrow(search, schema).write.mode("append").parquet(out)
    # Each entry has a candidate at least, so k + 1 of them are enough beside the query's own row.
    order = Window.partitionBy("qx", "qy").orderBy(F.desc("score"), "least", "entry")
    found = spark.read.schema(schema).parquet(out).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    each = found.join(entries.select("entry", "x", "y", "ids"), "entry").select(
        "qx", "qy", "score", F.explode("ids").alias("vec_id"), ((F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy"))).alias("same")
    )
    order = Window.partitionBy("qx", "qy").orderBy(F.desc("score"), "vec_id", "same")
    listed = (
        each.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= k + 1)
        .groupBy("qx", "qy")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score", "same"))).alias("list"))
    )
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    others = F.slice(F.filter("list", lambda e: ~(e["same"] & (e["vec_id"] == F.col("query_id")))), 1, k)
    return (
        asked.join(listed, ["qx", "qy"])
        .select("query_id", F.posexplode(others).alias("pos", "e"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return greatest_products(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH kept AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % 20 = 0 AND (q.vec_id <> c.vec_id OR q.v <> c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
