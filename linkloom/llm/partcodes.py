"""Vectors as codes of their parts, assigned by LAESA pivots.

Components become integers, vectors are cut into ``PARTS`` equal consecutive parts, and
each part position learns a codebook of ``ENTRIES`` entries in ``ROUNDS`` rounds of
assignment and floored means. ``PIVOTS`` of the first entries of a position, far from each
other, stay its pivots for good: the distance of every part to them is worked out once and
stored with the vectors. In a round the distances of pivots to entries are known to
all tasks, so by the triangle inequality the greatest difference of the two is a lower
bound of the distance of a part to an entry. Entries are tried in the order of these bounds, with exact integer
distances, until the bound is beyond the best found; so the results are those of trying all.

Tasks add up their own parts; one row per (position, entry, component) leaves each.
What comes to the driver and goes to the tasks is the codebooks, ``ENTRIES`` vectors.

Defined cases: rows whose vector is null or holds a null or a component that is not finite are
dropped; vectors of unequal length count as padded with zeros to the longest, up to a
multiple of ``PARTS``; an empty vector is all padding. Codebooks start from rows in the
order of (vec_id, vector), null ids last; repeated rows are rows of their own; fewer rows than
``ENTRIES`` make as many entries. Null labels are one label. Without rows kept the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.vectors import gathered, integer_matrix, integer_vectors
from linkloom.session import cut_lineage

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
#: Vectors assigned at a time.
STEP = 8192
#: Distances to pivots are stored in 32 bits; bounds give way by this share.
ROUNDING = 1e-6
#: A label with this share of all rows is joined by broadcast: so many labels at most, inversely.
HOT = 1 / 256


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def chosen_pivots(entries: np.ndarray, pivots: int) -> np.ndarray:
    """Entries of one position, each with the greatest sum of distances to those before."""
    between = np.sqrt(squared(entries, entries))
    taken = [0]
    while len(taken) < min(pivots, len(entries)):
        total = between[taken].sum(axis=0)
        total[taken] = -1
        taken.append(int(total.argmax()))
    return entries[taken]


def assign(values: np.ndarray, far: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, of equal ones the first, and the squared distance.

    ``far`` holds the distances of the parts to the pivots.
    """
    near = np.sqrt(squared(pivots, entries))
    low = np.zeros((len(values), len(entries)))
    for p in range(len(pivots)):
        np.maximum(low, np.abs(far[:, p, None] - near[p]), out=low)
    low -= ROUNDING * (far.max(axis=1, initial=0)[:, None] + near.max(initial=0))
    order = np.argsort(low, axis=1, kind="stable")
    choice = np.zeros(len(values), np.int64)
    best = np.full(len(values), np.iinfo(np.int64).max)
    left = np.arange(len(values))
    for j in range(len(entries)):
        entry = order[left, j]
        bound = np.maximum(low[left, entry], 0.0)
        go = bound * bound * (1 - ROUNDING) <= best[left]
        left, entry = left[go], entry[go]
        if not len(left):
            break
        exact = ((values[left] - entries[entry]) ** 2).sum(axis=1)
        better = (exact < best[left]) | ((exact == best[left]) & (entry < choice[left]))
        best[left[better]], choice[left[better]] = exact[better], entry[better]
    return choice, best


class Books:
    """Codebooks of all positions and their fixed pivots."""

    def __init__(self, first: np.ndarray, parts: int, pivots: int):
        #: (position, entry, component)
        self.entries = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
        self.pivots = np.stack([chosen_pivots(own, pivots) for own in self.entries])

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, position, pivot), in 32 bits."""
        cut = vectors.reshape(len(vectors), len(self.entries), -1)
        out = [np.sqrt(squared(cut[:, p], own)) for p, own in enumerate(self.pivots)]
        return np.stack(out, axis=1).astype(np.float32)

    def assigned(self, vectors: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each position its parts, their entries and squared distances."""
        cut = vectors.reshape(len(vectors), len(self.entries), -1)
        for p, own in enumerate(self.entries):
            yield cut[:, p], *assign(cut[:, p], far[:, p].astype(np.float64), own, self.pivots[p])

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def part_sums(measured: DataFrame, books: Books, width: int) -> DataFrame:
    """(v, far) -> part, entry, at, n, total: parts assigned to each entry, and their sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(books.entries.shape[:2], np.int64)
        totals = np.zeros(books.entries.shape, np.int64)
        for batch in gathered(batches, STEP):
            vectors, far = read(batch, books, width)
            for p, (parts, choice, _) in enumerate(books.assigned(vectors, far)):
                counts[p] += np.bincount(choice, minlength=counts.shape[1])
                np.add.at(totals[p], choice, parts)
        part, entry = np.nonzero(counts)
        size = totals.shape[2]
        if len(part) and size:
            columns = [np.repeat(part, size), np.repeat(entry, size), np.tile(np.arange(size), len(part))]
            columns += [np.repeat(counts[part, entry], size), totals[part, entry].ravel()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "at", "n", "total"])

    rows = measured.select("v", "far").mapInArrow(add, "part long, entry long, at long, n long, total long")
    return rows.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def read(batch: pa.RecordBatch, books: Books, width: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = integer_matrix(batch.column("v"), width)
    far = np.frombuffer(b"".join(batch.column("far").to_pylist()), np.float32)
    return vectors, far.reshape(len(vectors), *books.pivots.shape[:2])


def with_totals(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum ``name`` of ``value`` over rows of equal ``key``, nulls together.

    Keys with a share ``HOT`` of the rows get their sum by broadcast, one row a key; only
    the other rows are shuffled, and none of their keys has more than that share.
    """
    totals = cut_lineage(
        rows.groupBy(F.col(key).alias("own_key")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("own_rows")), "part-totals"
    )
    least = (totals.agg(F.sum("own_rows")).first()[0] or 0) * HOT
    same = F.col(key).eqNullSafe(F.col("own_key"))
    hot = F.broadcast(totals.where(F.col("own_rows") >= least))
    rest = rows.join(hot, same, "left_anti").join(totals.where(F.col("own_rows") < least), same)
    return rows.join(hot, same).unionByName(rest).drop("own_key", "own_rows")


def part_codes(
    rows: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS
) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256."""
    kept = integer_vectors(rows, scale, "vec_id", "label")
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    out = f"vec_id {id_kind}, label {label_kind}, code string, error long"
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        coded, digest = rows.sparkSession.createDataFrame([], out), ""
    else:
        width = -(-longest // parts) * parts
        first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
        books = Books(integer_matrix(first.column("v").combine_chunks(), width), parts, pivots)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, STEP):
                    own = batch.slice(begin, STEP)
                    far = books.distances(integer_matrix(own.column("v"), width))
                    yield pa.record_batch([*own.columns, pa.array([f.tobytes() for f in far], pa.binary())], [*own.schema.names, "far"])

        measured = cut_lineage(
            kept.mapInArrow(measure, f"vec_id {id_kind}, label {label_kind}, v array<int>, far binary"), "part-distances"
        )
        for _ in range(rounds):
            # One row a component of each entry.
            for r in part_sums(measured, books, width).collect():
                books.entries[r.part, r.entry, r["at"]] = r.total // r.n

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in gathered(batches, STEP):
                choices, errors = [], 0
                for _, choice, error in books.assigned(*read(batch, books, width)):
                    choices.append(choice.astype(np.uint8))
                    errors = errors + error
                names = [c.tobytes().hex() for c in np.stack(choices, axis=1)]
                yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(names), pa.array(errors)], ["vec_id", "label", "code", "error"])

        coded = cut_lineage(measured.mapInArrow(code, out), "part-codes")
        digest = books.digest()
    return with_totals(coded, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def op11(spark, sf_dir: str) -> DataFrame:
    return part_codes(table(spark, sf_dir, "embeddings"))


def _assigned(book: str) -> str:
    return f"""
  SELECT p.vec_id, p.label, p.part, p.own, p.nth, min(list_sum(list_transform(list_zip(p.own, b.own), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.entry) AS hit
  FROM parts p JOIN {book} b ON p.part = b.part GROUP BY ALL"""


def _moved(book: str, assigned: str) -> str:
    return f"""
  SELECT b.part, b.entry, coalesce(m.own, b.own) AS own FROM {book} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS own FROM (
      SELECT part, CAST(hit % 64 AS BIGINT) AS entry, i, CAST(sum(own[i]) AS BIGINT) AS s, count(*) AS n
      FROM {assigned}, (SELECT unnest(range(1, (SELECT any_value(len(own)) + 1 FROM parts))) AS i)
      GROUP BY ALL) GROUP BY ALL) m ON b.part = m.part AND b.entry = m.entry"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id) - 1 AS nth
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, nth, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS own
  FROM kept, (SELECT unnest(range(16)) AS part)
), b0 AS (SELECT part, nth AS entry, own FROM parts WHERE nth < 64
), a0 AS MATERIALIZED ({_assigned("b0")}
), b1 AS MATERIALIZED ({_moved("b0", "a0")}
), a1 AS MATERIALIZED ({_assigned("b1")}
), b2 AS MATERIALIZED ({_moved("b1", "a1")}
), a2 AS MATERIALIZED ({_assigned("b2")}
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', hit % 64), '' ORDER BY part) AS code, CAST(sum(hit // 64) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id, label, nth
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(own, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM coded
"""
