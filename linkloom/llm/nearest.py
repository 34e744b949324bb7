"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Around the mean, each vector is turned by one random rotation and only the signs of
its components are kept, with its length and the cosine between it and its code. A
query is turned, too, and cut into ``PLANES`` bit planes; counting common bits gives an
estimate of the inner product with every vector and a bound of its error. Vectors that
may be among the best by that bound, and no others, are reranked in double precision.

Queries are a stated share of the rows and meet all rows, in blocks: a block of at
most ``BLOCK`` query vectors goes to the tasks, which hold a part of the index each and
hand on their best ``k + 1`` a query. Equal vectors are one entry of the index with
their ``k + 1`` least ids, so a vector that a third of the rows have costs no more.

Defined cases: rows whose id is null, or whose vector is null, empty, zero, or holds a
null or a component that is not finite, take no part; shorter vectors count as padded with
zeros; rows alike in id and vector count once; ties go to the smaller id; fewer than
``k`` candidates are all returned. Codes decide with an error bound of ``SIGMAS``
deviations, so a neighbour can be missed, with small probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import running, table
from linkloom.session import cut_lineage, shared_path

K = 20
EVERY = 20
PLANES = 6
SIGMAS = 3.0
SEED = 11
#: Query vectors sent to the tasks at a time; queries and rows of one estimate.
BLOCK = 16384
QUERIES, ROWS = 32, 4096


def rotation(width: int) -> np.ndarray:
    turn, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return turn * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, width = bits.shape
    wide = np.zeros((n, -(-width // 64) * 64), bool)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


class Codes:
    """One-bit codes of some vectors with their correction scalars."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        turned = (vectors - centre) @ turn
        width = turned.shape[1]
        self.length = np.linalg.norm(turned, axis=1)
        size = np.maximum(self.length, 1e-300)
        #: Cosine between a vector and its code.
        self.cosine = np.maximum(np.abs(turned).sum(axis=1) / (np.sqrt(width) * size), 1e-12)
        self.bits = packed(turned > 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        sine = np.sqrt(np.maximum(0.0, 1 - self.cosine**2))
        self.error = SIGMAS * self.length * sine / self.cosine / np.sqrt(max(1, width - 1))


class Queries:
    """Turned queries as bit planes of ``low + step * value``."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        turned = vectors @ turn
        self.vectors = vectors
        self.size = np.linalg.norm(vectors, axis=1)
        self.centre = vectors @ centre
        self.width = turned.shape[1]
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        value = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.total = value.sum(axis=1)
        self.planes = [packed((value >> j) & 1 == 1) for j in range(PLANES)]

    def estimate(self, some: slice, codes: Codes, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries and rows, and the bounds of their errors."""
        n, m = len(self.size[some]), len(codes.length[rows])
        # Sum of the query's values under set bits: fits 16 bits up to 1,000 components.
        dot = np.zeros((n, m), np.uint16 if self.width <= 1000 else np.uint32)
        common, counts, shifted = np.empty((n, m), np.uint64), np.empty((n, m), np.uint8), np.empty_like(dot)
        for j, plane in enumerate(self.planes):
            for w in range(codes.bits.shape[1]):
                np.bitwise_and(plane[some, w][:, None], codes.bits[rows, w][None, :], out=common)
                np.bitwise_count(common, out=counts)
                dot += np.multiply(counts, 1 << j, out=shifted, dtype=dot.dtype)
        f = np.float32
        step, low = self.step[some][:, None].astype(f), self.low[some][:, None].astype(f)
        total = low * f(self.width) + step * self.total[some][:, None].astype(f)
        scale = (codes.length[rows] / codes.cosine[rows] / np.sqrt(self.width)).astype(f)[None, :]
        # What lies under set bits, less what lies under clear ones.
        guess = dot.astype(f)
        guess *= 2 * step
        guess += (2 * low) * codes.ones[rows].astype(f)[None, :]
        guess -= total
        guess *= scale
        guess += self.centre[some][:, None].astype(f)
        error = self.size[some][:, None].astype(f) * codes.error[rows].astype(f)[None, :]
        error += (f(SIGMAS * np.sqrt(self.width / 12)) * step) * scale
        return guess, error


def best(queries: Queries, vectors: np.ndarray, codes: Codes, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query its ``k`` best places among ``vectors``, with exact products."""
    n = len(vectors)
    for a in range(0, len(queries.size), QUERIES):
        some = slice(a, a + QUERIES)
        own = len(queries.size[some])
        found = [(np.zeros(0, np.int64), np.zeros(0))] * own
        bar = np.full(own, -np.inf)
        for b in range(0, n, ROWS):
            guess, error = queries.estimate(some, codes, slice(b, b + ROWS))
            if b == 0 and guess.shape[1] > 4 * k:
                # Exact products of the most promising rows give the bar to clear.
                first = np.argpartition(-guess, 4 * k, axis=1)[:, : 4 * k]
                exact = np.einsum("qrd,qd->qr", vectors[first], queries.vectors[some])
                bar = np.partition(exact, 3 * k, axis=1)[:, 3 * k]
            guess += error
            for i in range(own):
                at = np.flatnonzero(guess[i] >= bar[i])
                if not len(at):
                    continue
                at += b
                exact = np.einsum("rd,d->r", vectors[at], queries.vectors[a + i])
                at, exact = np.concatenate((found[i][0], at)), np.concatenate((found[i][1], exact))
                if len(at) > k:
                    keep = np.lexsort((at, -exact))[:k]
                    at, exact = at[keep], exact[keep]
                    bar[i] = max(bar[i], exact[-1])
                found[i] = (at, exact)
        for i, (at, exact) in enumerate(found):
            yield a + i, at, exact


def matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat):
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(column)), sizes), inner] = flat
    return out


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part, as (vec_id, v)."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    off = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~off & some).select("vec_id", v.alias("v"))


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors).distinct()
    least = Window.partitionBy("v").orderBy("vec_id")
    index = cut_lineage(
        rows.withColumn("nth", F.row_number().over(least))
        .where(F.col("nth") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("entry"), "ids", "v", F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), F.col("v")).alias("y")),
        "vector-index",
    )
    # An id with several vectors heads several entries, so entries go by their vector's hashes.
    asked = cut_lineage(
        rows.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), F.col("v")).alias("y"), "v"),
        "vector-queries",
    )
    width = index.agg(F.max(F.size("v"))).first()[0]
    schema = "qx long, qy long, x long, y long, entry long, score double"
    out = shared_path(spark, "vector-candidates")
    spark.createDataFrame([], schema).write.parquet(out)
    if width:
        means = index.select(F.posexplode("v").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect()
        centre = np.zeros(width)
        n = index.count()
        for r in means:
            centre[r.i] = r.c / n
        turn = rotation(width)
        distinct = asked.groupBy("x", "y").agg(F.first("v").alias("v"))
        placed = cut_lineage(running(distinct, [F.col("x"), F.col("y")], name="query-order"), "query-blocks")
        for begin in range(0, placed.count(), BLOCK):
            block = placed.where((F.col("pos") >= begin) & (F.col("pos") < begin + BLOCK)).select("x", "y", "v").toArrow()
            qx, qy = block.column("x").to_numpy(), block.column("y").to_numpy()
            queries = Queries(matrix(block.column("v").combine_chunks(), width), centre, turn)

            def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3), width)) for b in batches]
                if not parts:
                    return
                x, y, entry, own = (np.concatenate([p[i] for p in parts]) for i in range(4))
                order = np.argsort(entry, kind="stable")
                x, y, entry, own = x[order], y[order], entry[order], own[order]
                for q, at, exact in best(queries, own, Codes(own, centre, turn), k + 1):
                    yield pa.record_batch(
                        [pa.array(np.full(len(at), qx[q])), pa.array(np.full(len(at), qy[q])), pa.array(x[at]), pa.array(y[at]), pa.array(entry[at]), pa.array(exact)],
                        ["qx", "qy", "x", "y", "entry", "score"],
                    )

            index.select("x", "y", "entry", "v").mapInArrow(search, schema).write.mode("append").parquet(out)
    found = spark.read.schema(schema).parquet(out)
    order = Window.partitionBy("qx", "qy").orderBy(F.desc("score"), "entry")
    top = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth", "entry")
    each = top.join(index.select("x", "y", F.explode("ids").alias("vec_id")), ["x", "y"])
    order = Window.partitionBy("qx", "qy").orderBy(F.desc("score"), "vec_id")
    listed = (
        each.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= k + 1)
        .groupBy("qx", "qy")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("list"))
    )
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    others = F.slice(F.filter("list", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(listed, ["qx", "qy"])
        .select("query_id", F.posexplode(others).alias("pos", "e"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
