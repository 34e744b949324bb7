"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes. A byte costs
-log2(n / (T + D)) bits in the longest context that has seen it, and -log2(D / (T + D))
for the escape from every longer context that has not (n: times seen, T: bytes and
D: distinct bytes seen in the context); below the empty context all 256 bytes cost 8
bits. The statistics are frozen after training, so the cost of a byte depends on the
``ORDER + 1`` bytes that end with it only. Costs of all windows seen in training are
worked out once for all languages; other windows are followed down the escapes.
The shortest code names the language.

The trees are learned from a bounded sample of the labelled rows: of each language,
pieces of texts whose hash falls into the share that keeps ``TRAIN_BYTES`` bytes, and
the piece of least hash in any case. Texts are scored whole, in lower case.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go
to the first language by name; without labelled rows every text is ``und``; rows with
a null id count as the empty id in the split; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import remainder, table

ORDER = 4
#: Bytes of text a language is learned from.
TRAIN_BYTES = 1 << 20
#: Bytes of a text that are drawn together.
PIECE = 1 << 14
#: Bytes scored in one step.
STEP = 1 << 19
UNKNOWN = "und"
#: A text is rejected when no language needs fewer bits a byte than plain storage.
PLAIN_BITS = 8.0

EMPTY = np.uint64(1 << 63)
MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte, it and the ``ORDER`` bytes before it in its text, as one number.

    ``raw`` holds texts one after the other; places before a text's start are zero.
    """
    own = raw.astype(np.uint64)
    out = own.copy()
    room = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    for k in range(1, ORDER + 1):
        before = np.zeros_like(own)
        before[k:] = own[:-k]
        before[room < k] = 0
        out |= before << np.uint64(8 * k)
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-empty texts in a row, and where each begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes


class Places:
    """Place of a key in a sorted array of keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY)
        self.place = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] == EMPTY]
            self.keys[slot[free]] = keys[free]
            self.place[slot[free]] = free
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where there is none."""
        slot = self.slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.place[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen != EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.place[slot[left[hit]]]
            left = left[~hit & (seen != EMPTY)]
        return out


class Trees:
    """Costs of windows and escapes of every order, one column per language."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]]):
        """``counted``: per language its distinct windows and how often each was seen."""
        n = len(counted)
        self.levels = []
        lower_keys, lower = np.zeros(1, np.uint64), np.full((1, n), 8.0)
        for k in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            own = []
            for keys, counts in counted:
                short, inverse = np.unique(keys & mask, return_inverse=True)
                own.append((short, np.bincount(inverse, counts, len(short))))
            keys = np.unique(np.concatenate([o[0] for o in own]))
            contexts = np.unique(keys >> np.uint64(8))
            escape = np.zeros((len(contexts), n))
            below = np.searchsorted(lower_keys, keys & (mask >> np.uint64(8)) if k else np.zeros_like(keys))
            cost = lower[below]
            at = np.searchsorted(contexts, keys >> np.uint64(8))
            for i, (short, counts) in enumerate(own):
                place = np.searchsorted(contexts, short >> np.uint64(8))
                total = np.bincount(place, counts, len(contexts))
                kinds = np.bincount(place, minlength=len(contexts))
                seen = kinds > 0
                escape[seen, i] = -np.log2(kinds[seen] / (total + kinds)[seen])
                cost[:, i] += escape[at, i]
                cost[np.searchsorted(keys, short), i] = -np.log2(counts / (total + kinds)[place])
            lower_keys, lower = keys, cost
            self.levels.append((Places(keys), cost.astype(np.float32), Places(contexts), escape.astype(np.float32)))

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window in every language."""
        n = self.levels[0][1].shape[1]
        out = np.zeros((len(keys), n), np.float32)
        left = np.arange(len(keys))
        for k in range(ORDER, -1, -1):
            places, cost, contexts, escape = self.levels[k]
            short = keys[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = places.find(short)
            known = at >= 0
            out[left[known]] += cost[at[known]]
            left, short = left[~known], short[~known]
            if not len(left):
                return out
            at = contexts.find(short >> np.uint64(8))
            known = at >= 0
            out[left[known]] += escape[at[known]]
        out[left] += 8.0
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in every language, in bits."""
        out = np.zeros((len(texts), self.levels[0][1].shape[1]))
        group: list[int] = []
        size = 0

        def score(group: list[int]) -> None:
            raw, starts = joined([texts[i] for i in group])
            out[group] = np.add.reduceat(self.costs(windows(raw, starts)), starts, axis=0, dtype=np.float64)

        for i, text in enumerate(texts):
            if len(text) > STEP:
                for a in range(0, len(text), STEP):
                    b = max(0, a - ORDER)
                    raw, starts = joined([text[b : a + STEP]])
                    keys = windows(raw, starts)[a - b :]
                    out[i] += self.costs(keys).sum(axis=0, dtype=np.float64)
            elif text:
                group.append(i)
                size += len(text)
                if size > STEP:
                    score(group)
                    group, size = [], 0
        if group:
            score(group)
        return out


def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, raw, skip): the first ``skip`` bytes are context only."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        skips = batch.column(2).to_pylist()
        for lang in sorted(set(langs)):
            own = [(t, skip) for t, at, skip in zip(texts, langs, skips) if at == lang and t]
            if own:
                raw, starts = joined([t for t, _ in own])
                inner = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
                kept = inner >= np.repeat([skip for _, skip in own], [len(t) for t, _ in own])
                keys, counts = np.unique(windows(raw, starts)[kept], return_counts=True)
                yield pa.record_batch(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)],
                    ["lang", "key", "n"],
                )


def folded() -> Column:
    return F.encode(F.lower(F.col("text")), "UTF-8")


def drawn(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame | None:
    """The pieces to learn from (doc_id, text, lang), as (lang, raw, skip)."""
    places = 1 << 30
    known = docs.where("lang is not null and text is not null and text != ''").select(
        "lang", F.xxhash64("doc_id", "text").alias("draw"), folded().alias("raw")
    )
    numbers = lambda raw: F.sequence(F.lit(0), F.floor((F.octet_length(raw) - 1) / PIECE).cast("int"))
    place = lambda i: F.pmod(F.xxhash64("draw", i), F.lit(places))
    least = F.array_min(F.flatten(F.transform(F.array("raw"), lambda raw: F.transform(numbers(raw), place))))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("raw")).alias("n"), F.min(least).alias("least")).collect()
    if not sizes:
        return None
    limit = F.lit(0)
    for r in sizes:
        # The piece of least hash is always drawn.
        below = max(int(min(1.0, train_bytes / r.n) * places), r.least + 1)
        limit = F.when(F.col("lang") == r.lang, F.lit(below)).otherwise(limit)

    def cut(raw: Column) -> Column:
        kept = F.filter(numbers(raw), lambda i: place(i) < F.col("limit"))
        skip = lambda i: F.when(i > 0, F.lit(ORDER)).otherwise(0)
        piece = lambda i: F.substring(raw, i * PIECE + 1 - skip(i), skip(i) + PIECE)
        return F.transform(kept, lambda i: F.struct(piece(i).alias("raw"), skip(i).alias("skip")))

    # In a list, so that a text is folded once.
    pieces = F.flatten(F.transform(F.array("raw"), cut))
    return known.withColumn("limit", limit).select("lang", F.explode(pieces).alias("p")).select("lang", "p.raw", "p.skip")


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> tuple[list[str], Trees | None]:
    """Languages and trees from (doc_id, text, lang); rows without either are left out."""
    pieces = drawn(docs, train_bytes)
    if pieces is None:
        return [], None
    counts = (
        pieces.mapInArrow(count_windows, "lang string, key long, n long")
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    if not len(counts):
        return [], None
    langs = sorted(set(counts.column("lang").to_pylist()))
    names = np.array(counts.column("lang").to_pylist())
    keys = counts.column("key").to_numpy().view(np.uint64)
    n = counts.column("n").to_numpy()
    return langs, Trees([(keys[names == lang], n[names == lang]) for lang in langs])


def predicted(docs: DataFrame, langs: list[str], trees: Trees | None, name: str) -> DataFrame:
    """``docs`` with a struct ``name``: lang, score, and bits a byte of the best code."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if trees is None:
        none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
        return docs.withColumn(name, none)
    kind = pa.struct([("best", pa.int32()), ("score", pa.float64()), ("bits", pa.float64())])

    @F.arrow_udf("best int, score double, bits double")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or b"" for t in batch.to_pylist()]
            bits = trees.lengths(texts)
            best = bits.argmin(axis=1) if len(texts) else np.zeros(0, int)
            least = bits.min(axis=1, keepdims=True) if len(texts) else bits
            score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)
            each = np.array([max(1, len(t)) for t in texts])
            yield pa.StructArray.from_arrays(
                [pa.array(best, pa.int32()), pa.array(score), pa.array(least.ravel() / each)], fields=list(kind)
            )

    # Texts without a letter are not sent to be read.
    got = docs.withColumn(name, read(F.when(letters, folded())))
    lang = F.element_at(F.array(*(F.lit(x) for x in langs)), F.col(f"{name}.best") + 1)
    return got.withColumn(
        name,
        F.struct(
            F.when(letters, lang).otherwise(UNKNOWN).alias("lang"),
            F.when(letters, F.col(f"{name}.score")).otherwise(0.0).alias("score"),
            F.when(letters, F.col(f"{name}.bits")).alias("bits"),
        ),
    )


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, held_out, lang_pred, score, bits a byte."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    langs, trees = train(docs.where(~held_out).select("doc_id", "text", "lang"), train_bytes)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return predicted(rows, langs, trees, "p").select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.bits").alias("bits")
    )


def accepted(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Rows of ``docs`` in a learned language: those that are not ``und`` and that the
    best language codes in fewer bits than plain storage needs. Columns stay."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    langs, trees = train(docs.where(~held_out).select("doc_id", "text", "lang"), train_bytes)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    kept = predicted(rows, langs, trees, "p").where((F.col("p.lang") != UNKNOWN) & (F.col("p.bits") < PLAIN_BITS))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op1(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
