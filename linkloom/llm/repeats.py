"""Removal of long repeats over suffix arrays.

A byte goes if a string of ``WIDTH`` bytes covers it that also starts anywhere else.

Every window of ``WIDTH`` bytes has an anchor: the least hash of a run of ``GRAM`` bytes
in it. Equal windows have equal anchors, so windows are compared among those with one
anchor only. Neighbouring windows that hold the anchor at one place form a segment; the
place is kept as long as it can be, so periodic text makes few segments, too. Segments are counted by hash, so copies never meet as
text; one of each, where an anchor has several, goes to the comparison:

The segments of a block are sorted into a suffix array, which gives the Burrows-Wheeler
transform. Starting with the empty string, intervals of rows are extended backwards by
one byte at a time, breadth first. The interval of a string of l + 1 bytes ends where
neighbouring rows share exactly l bytes, if no shorter string has ended there before:
common prefixes come out by increasing value. At ``WIDTH`` the expansion stops; rows
that no end separates share ``WIDTH`` bytes, and those are the repeats.

An anchor with more than ``GROUP`` bytes of segments (a passage that very many texts
have in other surroundings) is split: by halves of the places that the anchor has in a
window, and by the bytes that all windows of a half share. Cut to a half, most segments
become equal and are counted; a half of one place holds one text. So every block is
bounded and nothing is left out.

Defined cases: a null text is empty; texts shorter than ``WIDTH`` and empty tables have
no repeats; of texts that occur twice nothing is kept if they have ``WIDTH`` bytes; ids
may be null or repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.session import cut_lineage

WIDTH = 400
GRAM = 50
#: Bytes of segments that one anchor may bring to a block, and that a block should have.
GROUP = 1 << 18
BLOCK = 1 << 19
#: Bytes of text anchored at a time; places in it must fit into ``PLACE`` bits.
STEP = 1 << 20
PLACE = 22

BASE = 0x9E3779B97F4A7C15 | 1
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Anchors:
    """Anchors of all windows of a stretch of bytes."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram, self.run = width, gram, width - gram + 1
        n = STEP + 2 * width
        inverse = pow(BASE, -1, 1 << 64)
        self.power = np.full(n, BASE, np.uint64)
        self.inverse = np.full(n, inverse, np.uint64)
        self.power[0] = self.inverse[0] = 1
        self.power, self.inverse = np.cumprod(self.power), np.cumprod(self.inverse)

    def of(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor of each window, and the last place where the window has it."""
        n = len(raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        grams = (sums[self.gram :] - sums[: n - self.gram + 1]) * self.inverse[: n - self.gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(29)
        mask = np.uint64((1 << PLACE) - 1)
        order = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
        # Least of each run: from the blocks' running minima from both ends.
        rows = -(-len(order) // self.run)
        padded = np.full(rows * self.run, NONE)
        padded[: len(order)] = order
        padded = padded.reshape(rows, self.run)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - self.width + 1
        least = np.minimum(back[:windows], ahead[self.run - 1 : self.run - 1 + windows])
        return (least >> np.uint64(PLACE)).astype(np.int64), (mask - (least & mask)).astype(np.int64)


def stretches(texts: list[bytes], width: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes with, for each text or piece of a long one: which text it is, its
    begin in the joined bytes, and its begin in the text. Pieces overlap by a window."""
    parts, which, begin, inner, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), STEP):
            piece = text[at : at + STEP + width - 1]
            if len(piece) < width:
                continue
            if size + len(piece) > STEP + width and parts:
                yield b"".join(parts), np.array(which), np.array(begin), np.array(inner)
                parts, which, begin, inner, size = [], [], [], [], 0
            parts.append(piece)
            which.append(i)
            begin.append(size)
            inner.append(at)
            size += len(piece)
    if parts:
        yield b"".join(parts), np.array(which), np.array(begin), np.array(inner)


def segment_batches(width: int, gram: int):
    """Rows x, y, a (first window), more (windows after it), p (anchor from a), anchor, seg,
    tied (the segment has the anchor at other places, too, so it may repeat itself)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(width, gram)
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for raw, which, begin, inner in stretches(texts, width):
                anchor, place = anchors.of(np.frombuffer(raw, np.uint8))
                ends = np.append(begin[1:], len(raw))
                piece = np.searchsorted(begin, np.arange(len(place)), side="right") - 1
                valid = np.arange(len(place)) + width <= ends[piece]
                new = np.ones(len(place), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])
                change = np.flatnonzero(new)
                stop = np.append(change[1:], len(place))[valid[change]]
                start = change[valid[change]]
                at, after = [], []
                while len(start):
                    # The place holds until the window has passed it.
                    until = np.minimum(stop, place[start] + 1)
                    at.append(start)
                    after.append(until)
                    more = until < stop
                    start, stop = until[more], stop[more]
                if not at:
                    continue
                at, after = np.concatenate(at), np.concatenate(after)
                digest = xxhash.xxh3_64_intdigest
                segs, tied = [], []
                for a, b, p in zip(at.tolist(), (after + width - 1).tolist(), place[at].tolist()):
                    segs.append(digest(raw[a:b]))
                    mark = raw[p : p + gram]
                    tied.append(raw.find(mark, a, b) < p or raw.find(mark, p + 1, b) >= 0)
                own = piece[at]
                yield pa.record_batch(
                    [pa.array(x[which[own]]), pa.array(y[which[own]]), pa.array((at - begin[own] + inner[own]).astype(np.int64)),
                     pa.array((after - at - 1).astype(np.int32)), pa.array((place[at] - at).astype(np.int32)),
                     pa.array(anchor[at]), pa.array(np.array(segs, np.uint64).view(np.int64)), pa.array(tied)],
                    ["x", "y", "a", "more", "p", "anchor", "seg", "tied"],
                )

    return read


def suffixes(symbols: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Suffix array of texts that each end with a 0; ``room`` counts to the next 0.

    The 0 of an earlier text is the lesser, so equal suffixes go by place.
    """
    n = len(symbols)
    wide = symbols.astype(np.uint64)
    key = wide.copy()
    for m in range(2, 8):
        after = np.append(key[1:], np.uint64(0))
        key = np.where(wide == 0, np.uint64(0), (wide << np.uint64(9 * (m - 1))) | after)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    known, longest = 7, int(room.max())
    while known < longest:
        after = np.zeros(n, np.int64)
        far = np.flatnonzero(room > known)
        after[far] = rank[far + known] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        known *= 2
    return np.argsort(rank, kind="stable")


def repeated(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the places whose ``width`` bytes start elsewhere in the texts, too."""
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = raw.astype(np.int64) + 1
    symbols[ends] = 0
    room = ends[np.searchsorted(ends, np.arange(len(raw)))] - np.arange(len(raw))
    rows = suffixes(symbols, room)
    n = len(rows)
    before = rows - 1  # the first suffix wraps round to the last end
    last = symbols[before]
    row_of = np.empty(n, np.int64)
    row_of[rows] = np.arange(n)
    back = row_of[before]
    # Rows go in runs of one preceding byte, so that long runs cost one step.
    edge = np.flatnonzero(np.diff(last, prepend=-1))
    edge_end = np.append(edge[1:], n)
    run_of = np.zeros(n, np.int64)
    run_of[edge[1:]] = 1
    run_of = np.cumsum(run_of)
    # Row i begins a new string of at most ``width`` bytes where split[i]; ends are strings of their own.
    split = np.zeros(n + 1, bool)
    split[: len(texts) + 1] = True
    split[n] = True
    low = np.array([len(texts)])
    high = np.array([n])
    for length in range(width):
        if length == 0:
            # Strings of one byte, and the ends.
            first = np.flatnonzero(np.diff(symbols[rows], prepend=-1))
            first = first[first >= len(texts)]
            low = np.concatenate((np.arange(len(texts)), first))
            high = np.concatenate((np.arange(1, len(texts) + 1), np.append(first[1:], n) if len(first) else first))
            split[high] = True
            continue
        wide = run_of[high - 1] - run_of[low] + 1
        interval = np.repeat(np.arange(len(low)), wide)
        run = np.arange(wide.sum()) + np.repeat(run_of[low] - np.append(0, np.cumsum(wide)[:-1]), wide)
        inside = last[edge[run]] > 0
        run, interval = run[inside], interval[inside]
        key = interval * 257 + last[edge[run]]
        order = np.argsort(key, kind="stable")
        run, interval, key = run[order], interval[order], key[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        end = np.append(begin[1:], len(key))[: len(begin)] - 1
        low, high = (
            back[np.maximum(edge[run[begin]], low[interval[begin]])],
            back[np.minimum(edge_end[run[end]], high[interval[end]]) - 1] + 1,
        )
        new = ~split[high]
        low, high = low[new], high[new]
        split[high] = True
        if not len(low):
            break
    group = np.cumsum(split[:n]) - 1
    many = np.bincount(group)[group] > 1
    places = np.sort(rows[many])
    begins = ends - sizes
    owner = np.searchsorted(ends, places)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [places[cut[i] : cut[i + 1]] - begins[i] for i in range(len(texts))]


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch of neighbouring places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist()))


def compare_batches(width: int):
    """Of each block: rows g, t, from, to with the repeated windows of its items."""

    def compare(group: pa.Table) -> pa.Table:
        # Whatever order the rows come in, the block is the same text.
        rows = group.select(["g", "t", "n", "body"]).sort_by([("g", "ascending"), ("t", "ascending")]).to_pylist()
        found = repeated([r["body"] for r in rows], width)
        out = {"g": [], "t": [], "first": [], "last": []}
        for r, places in zip(rows, found):
            spans = [(0, len(r["body"]) - width)] if r["n"] > 1 else runs(places)
            for first, last in spans:
                for name, value in zip(out, (r["g"], r["t"], first, last)):
                    out[name].append(value)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return compare


def halves(width: int, gram: int):
    """Items of a group that is too large, cut to each half of the anchor's places.

    A window's place is that of the first run of bytes in it that equals the anchor's,
    counted from the window's begin; the windows of a half have it in ``low .. high``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body, mark = r["body"], r["body"][r["p"] : r["p"] + gram]
                middle = (r["low"] + r["high"] + 1) // 2
                passed, p = -1, body.find(mark)
                while p >= 0:
                    for low, high in ((r["low"], middle - 1), (middle, r["high"])):
                        first = max(passed + 1, p - high)
                        last = min(len(body) - width, p - low)
                        if first > last:
                            continue
                        # Bytes that all windows of this half share, seen from the anchor.
                        core = body[p - low : p - high + width]
                        own = body[first : last + width]
                        digest = xxhash.xxh3_64(core)
                        digest.update(f"{r['g']} {low} {high}".encode())
                        name = xxhash.xxh3_64(own)
                        name.update(f"{p - first}".encode())
                        out.append((r["g"], r["t"], signed(digest.intdigest()), signed(name.intdigest()), first, r["n"], p - first, low, high, own))
                    passed, p = p, body.find(mark, p + 1)
            names = ["old_g", "old_t", "g", "t", "first", "n", "p", "low", "high", "body"]
            columns = list(zip(*out)) if out else [[] for _ in names]
            kinds = [pa.int64()] * 9 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return cut


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def marks(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(x, y, raw), copies included -> x, y, first, last: windows that occur elsewhere, too."""
    found = cut_lineage(
        texts.mapInArrow(
            segment_batches(width, gram), "x long, y long, a long, more int, p int, anchor long, seg long, tied boolean"
        ),
        "segments",
    )
    where = F.min(F.struct("x", "y", "a")).alias("at")
    segments = cut_lineage(
        found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.first("more").alias("more"), F.first("p").alias("p"), F.first("tied").alias("tied"), where),
        "distinct-segments",
    )
    several = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("tied").alias("tied"))
    several = several.where("kinds > 1 or tied").select("anchor")
    asked = segments.join(several, "anchor").select(
        F.col("at.x").alias("x"), F.col("at.y").alias("y"),
        F.struct(F.col("anchor").alias("g"), F.col("seg").alias("t"), "n", F.col("at.a").alias("a"), "more", "p").alias("s"),
    )
    asked = asked.groupBy("x", "y").agg(F.collect_list("s").alias("s"))
    bodies = texts.join(asked, ["x", "y"]).groupBy("x", "y").agg(F.first("raw").alias("raw"), F.first("s").alias("s"))
    items = cut_lineage(
        bodies.select("raw", F.explode("s").alias("s")).select(
            "s.g", "s.t", "s.n", F.col("s.p").cast("long").alias("p"),
            F.lit(0).cast("long").alias("low"), F.lit(width - gram).cast("long").alias("high"),
            F.substring(F.col("raw"), F.col("s.a").cast("int") + 1, F.col("s.more") + F.lit(width)).alias("body"),
        ),
        "segment-items",
    )
    done = None
    levels: list[DataFrame] = []
    while True:
        sizes = items.groupBy("g").agg(F.sum(F.length("body")).alias("bytes"), F.min("low").alias("l"), F.min("high").alias("h"))
        large = cut_lineage(sizes.where((F.col("bytes") > group) & (F.col("h") > F.col("l"))).select("g"), "large-groups")
        rest = items.join(large, "g", "left_anti").select("g", "t", "n", "body")
        done = rest if done is None else done.union(rest)
        if large.isEmpty():
            break
        schema = "old_g long, old_t long, g long, t long, first long, n long, p long, low long, high long, body binary"
        cut = cut_lineage(items.join(large, "g", "left_semi").select(*items.columns).mapInArrow(halves(width, gram), schema), "segment-halves")
        levels.append(cut.select("old_g", "old_t", "g", "t", "first"))
        items = cut_lineage(
            cut.groupBy("g", "t").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("p", "low", "high", "body"))),
            "segment-items",
        ).select("g", "t", "n", "p", "low", "high", "body")
    total = done.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    dealt = done.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(blocks)))
    spans = cut_lineage(
        dealt.groupBy("block").applyInArrow(compare_batches(width), "g long, t long, first long, last long"), "segment-marks"
    )
    # From the halves back up to the segments they were cut from.
    for level in reversed(levels):
        up = level.withColumnRenamed("first", "offset").join(spans, ["g", "t"])
        up = up.select(F.col("old_g").alias("g"), F.col("old_t").alias("t"), (F.col("first") + F.col("offset")).alias("first"), (F.col("last") + F.col("offset")).alias("last"))
        spans = cut_lineage(spans.union(up), "segment-marks")
    spans = spans.select(F.col("g").alias("anchor"), F.col("t").alias("seg"), "first", "last")
    copies = segments.where("n > 1").select("anchor", "seg", F.lit(0).cast("long").alias("first"), F.col("more").cast("long").alias("last"))
    both = spans.union(copies).groupBy("anchor", "seg").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    hit = found.join(both, ["anchor", "seg"]).select("x", "y", "a", F.explode("spans").alias("s"))
    return hit.select("x", "y", (F.col("a") + F.col("s.first")).alias("first"), (F.col("a") + F.col("s.last")).alias("last"))


def merged(spans: list[dict], width: int) -> list[tuple[int, int]]:
    """Bytes from .. to (exclusive) covered by windows ``first`` to ``last``, as maximal runs."""
    out: list[list[int]] = []
    for s in sorted((s["first"], s["last"] + width) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(doc_id, text) -> doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.encode(text, "UTF-8").alias("raw"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))
    spans = marks(keyed.select("x", "y", "raw").where(F.length("raw") >= width), width, gram, group, block)
    spans = cut_lineage(spans.groupBy("x", "y").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "repeat-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kept, removed, n = [], [], []
            for raw, own in zip(raws, spans):
                gone = merged(own or [], width)
                ends = [0, *(e for span in gone for e in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))
                removed.append(len(raw) - len(kept[-1]))
                n.append(len(gone))
            yield pa.record_batch(
                [batch.column(0), pa.array(kept), pa.array([len(r) for r in raws], pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(n, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.join(spans, ["x", "y"], "left").select("doc_id", "raw", "spans").mapInArrow(
        cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
