"""Near-duplicates by SimHash, found with vantage-point trees.

Words are folded and cut into shingles of ``WIDTH`` words; a bit of the fingerprint
is set if it is set in more than half of the shingles' XXH64 values. Distinct
fingerprints are dealt to the shards of a vantage-point tree: a fingerprint lives in
one shard and visits every other that the triangle inequality leaves open within
``RADIUS``. Inside a shard a deeper tree does the same, and its leaves are compared
in full, so no pair is lost. A shard hands on links to the least fingerprint of each
of its groups, never all pairs; components are joined up from those links.

Defined cases: a null or wordless text has fingerprint zero and is linked like any
other; ids may repeat; a component's id is the least id in it, null if it has none;
an empty table gives no rows. Only the tree comes from a sample: ``SAMPLE``
fingerprints, on the driver, place the vantage points. It decides the load of the
shards, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import table, word_pieces
from linkloom.llm.components import components
from linkloom.session import cut_lineage

WIDTH = 4
RADIUS = 4
SEED = 42
#: Fingerprints a shard is meant to hold, and the sample the tree is fitted on.
SHARD = 65536
SAMPLE = 65536
#: Cells of one comparison block.
CELLS = 1 << 20

#: Of each byte its bits, one per byte of a 64-bit lane.
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every run of ``width`` words; of the whole sequence if it is shorter."""
    parts = [np.zeros(0, np.uint64)]
    carry: list[bytes] = []
    total = 0
    digest = xxhash.xxh64_intdigest
    for words in word_pieces(raw):
        total += len(words)
        words = carry + words
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        ends = ends.tolist()
        parts.append(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64))
        carry = words[-(width - 1) :] if width > 1 else []
    if 0 < total < width:
        parts = [np.array([digest(b" ".join(carry), SEED)], np.uint64)]
    return np.concatenate(parts)


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits of runs of hashes; ``counts`` has the length of each run."""
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    ends = np.cumsum(counts[filled])
    begins = ends - counts[filled]
    # Byte lanes hold sums of up to 255 rows, so runs are summed in steps.
    steps = -(-counts[filled] // 255)
    run = np.repeat(np.arange(len(filled)), steps)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(steps) - steps, steps)
    cut = begins[run] + 255 * inner
    lanes = LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, cut, axis=0)
    bits = np.ascontiguousarray(sums).astype("<u8").view(np.uint8).reshape(len(run), 64).astype(np.int64)
    ones = np.add.reduceat(bits, np.cumsum(steps) - steps, axis=0)
    major = 2 * ones > counts[filled][:, None]
    out[filled] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        fps = np.zeros(len(texts), np.uint64)
        hashes, counts, begin = [], [], 0
        for i, raw in enumerate(texts):
            own = shingle_hashes(raw.as_py() or b"")
            hashes.append(own)
            counts.append(len(own))
            if sum(counts) > 1 << 18 or i == len(texts) - 1:
                fps[begin : i + 1] = fingerprints(np.concatenate(hashes), np.array(counts))
                hashes, counts, begin = [], [], i + 1
        yield pa.record_batch([keys, pa.array(fps.view(np.int64))], ["key", "fp"])


def with_fingerprints(docs: DataFrame, key: str) -> DataFrame:
    """(key, text) -> (key, fp)."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.encode("text", "UTF-8").alias("raw")).mapInArrow(
        fingerprint_batches, f"key {kind}, fp long"
    )


def distance(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point)


def split(fps: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the distance that halves ``fps`` best, or none.

    Of a few candidates the one with the fewest points near its boundary is taken.
    """
    best = None
    for point in rng.choice(fps, 4):
        d = distance(fps, point)
        cut = int(np.median(d))
        near = np.count_nonzero((d >= cut - RADIUS) & (d < cut + RADIUS))
        low = np.count_nonzero(d < cut)
        if low and low < len(d) and (best is None or near < best[0]):
            best = (near, point, cut)
    return best[1:] if best else None


def plant(fps: np.ndarray, depth: int, rng: np.random.Generator) -> list | None:
    """Tree of [vantage point, cut, below, from the cut on]; None is a shard."""
    parts = split(fps, rng) if depth and len(fps) > 1 else None
    if not parts:
        return None
    low = distance(fps, parts[0]) < parts[1]
    return [int(parts[0]), parts[1], plant(fps[low], depth - 1, rng), plant(fps[~low], depth - 1, rng)]


def visits(tree: list | None, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places in ``fps`` that look there, whether they live there)."""
    stack = [(tree, 1, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        node, number, at, home = stack.pop()
        if not len(at):
            continue
        if node is None:
            yield number, at, home
            continue
        d = distance(fps[at], np.uint64(node[0])).astype(np.int64)
        below = d < node[1]
        go = d - RADIUS < node[1]
        stack.append((node[2], 2 * number, at[go], (home & below)[go]))
        go = d + RADIUS >= node[1]
        stack.append((node[3], 2 * number + 1, at[go], (home & ~below)[go]))


class Groups:
    """Least member of each group of linked places."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            low, high = np.minimum(x[open_], y[open_]), np.maximum(x[open_], y[open_])
            parent = np.arange(len(self.root))
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.root = parent[self.root]


def compare(fps: np.ndarray, home: np.ndarray, look: np.ndarray, groups: Groups, rng: np.random.Generator) -> None:
    """Link all places of ``home`` to those of ``look`` within the radius."""
    stack = [(home, look)]
    while stack:
        home, look = stack.pop()
        if not len(home) or not len(look):
            continue
        parts = split(fps[home], rng) if len(home) > 128 and len(look) > 1024 else None
        if parts:
            point, cut = parts
            dh = distance(fps[home], point).astype(np.int64)
            dl = distance(fps[look], point).astype(np.int64)
            low, high = dl - RADIUS < cut, dl + RADIUS >= cut
            if np.count_nonzero(low) + np.count_nonzero(high) < 1.9 * len(look):
                stack += [(home[dh < cut], look[low]), (home[dh >= cut], look[high])]
                continue
        step = max(1, CELLS // len(look))
        other = fps[look]
        for i in range(0, len(home), step):
            some = home[i : i + step]
            a, b = np.nonzero(np.bitwise_count(fps[some][:, None] ^ other[None, :]) <= RADIUS)
            a, b = some[a], look[b]
            own = a != b
            if own.any():
                groups.link(a[own], b[own])


def shard_links(group: pa.Table) -> pa.Table:
    """Of one shard: each fingerprint in a group of two or more, with the group's first."""
    fps = group.column("fp").to_numpy().view(np.uint64)
    home = group.column("home").to_numpy()
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    groups = Groups(len(fps))
    rng = np.random.default_rng(SEED)
    compare(fps, np.flatnonzero(home), np.arange(len(fps)), groups, rng)
    linked = np.flatnonzero(groups.root != np.arange(len(fps)))
    return pa.table({"a": fps[groups.root[linked]].view(np.int64), "b": fps[linked].view(np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """(fp) distinct -> (a, b), links that connect all fingerprints within the radius."""
    n = fps.count()
    share = min(1.0, SAMPLE / max(n, 1))
    picked = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * SAMPLE)
    sample = np.sort(np.array([r.fp for r in picked.collect()], np.int64)).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / SHARD))))
    tree = plant(sample, depth, np.random.default_rng(SEED))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for number, at, home in visits(tree, own):
                yield pa.record_batch(
                    [pa.array(np.full(len(at), number)), pa.array(own[at].view(np.int64)), pa.array(home)],
                    ["shard", "fp", "home"],
                )

    dealt = fps.mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(shard_links, "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) -> (key, fp, component): the least key of all that are linked."""
    rows = cut_lineage(with_fingerprints(docs, key), "fingerprints")
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("key").alias("first")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    known = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = known.groupBy("root").agg(F.min("first").alias("component"))
    named = cut_lineage(known.join(firsts, "root").select("fp", "component"), "components")
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...) without near-copies: of each component the
    row with the least id stays; of rows alike in every column, one.
    """
    row = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.col("doc_id").alias("id"),
        F.xxhash64(*docs.columns).alias("x"),
        F.xxhash64(F.lit(1), *docs.columns).alias("y"),
    )
    cols = docs.columns
    keyed = docs.select(F.struct(*cols).alias("row"), row.alias("key"), F.col("text").alias("text"))
    grouped = near_groups(keyed.select("key", "text"), "key")
    first = grouped.where(F.col("key") == F.col("component")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    first = cut_lineage(first, "kept")
    kept = keyed.select("key", "row").join(first, "key")
    single = kept.where("n = 1").select("key", "row")
    repeated = kept.where("n > 1").groupBy("key").agg(F.first("row").alias("row"))
    return single.union(repeated).select(*(F.col("row").getField(c).alias(c) for c in cols))


def op10(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )
