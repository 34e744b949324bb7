"""Language-model scores from a weighted backoff automaton.

Words and runs of up to three words are counted over all training rows. Word counts are
never pruned, and a longer run is an arc if it is seen ``LEAST`` times, at any size of the
corpus. With absolute discounting,

    p(w) = (c(w) - d) / N, and d V / N for the unknown word,
    p(w | h) = (c(h w) - D) / c(h) + b(h) p(w | h'),   if h w is an arc, else b(h) p(w | h'),

where h' is h without its first word and b(h) is what the arcs of h leave of 1. The automaton
has a state for the empty run and for each run that arcs go out from. An arc of w leads, with
log p(w | h), to the longest state that ends the run read; a state without the arc fails to h' with
log b(h). A text is read from left to right: its state is carried from word to word.

No task could hold the automaton of a big corpus, and a text needs only what its words
touch. Texts lie in groups of about ``STEP`` bytes with their words as numbers. A group asks for the
counts of its words and of its runs of two, each distinct one once, and brings its own
training counts along; what it asks goes to buckets by hash of the run without its last word. A bucket
adds up, drops what is seen less than ``LEAST`` times, and answers each group in the order
it asked: counts, and of each context the number and the sum of its arcs. Runs of three are asked for
only if both their halves are arcs, which loses none. From the answers a group builds its part of the
automaton and reads all its texts abreast, one word a step; texts of more than ``LANE`` words are read in
pieces that begin in the state which the two words before them lead to.

Words are known by 48 bits of their hash and the bucket's, contexts by 40 and the bucket's, the word
after a context by 32. Defined cases: a null text is empty and has the end as its only token; null ids
count as the empty id in the split; repeated rows are counted and scored one by one; without training
rows all words are unknown, N is 0, and scores are null where they are the log of nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import remainder, table, word_pieces
from linkloom.session import add_to_buckets, bucket_table, cut_into_buckets, release

ORDER = 3
#: Times a run must be seen to be kept, at any size of the corpus.
LEAST = 2
DISCOUNT = 0.5
#: Bytes of text in a group, runs that a bucket should have, bits of its hash that name a bucket, at least.
STEP = 1 << 22
HELD = 1 << 21
BITS = 7
#: Times a context is seen for each part it is cut into, so that a frequent word fills no bucket.
SPLIT = 1 << 20
#: Words of a text read in one piece.
LANE = 256
#: Bytes in which the hash of a word and of a context are sent, besides the bits of the bucket, and of the word after it.
WORD, LEFT, RIGHT = 6, 5, 4

#: Neither holds a character of a word.
START = xxhash.xxh64_intdigest(b" ")
END = xxhash.xxh64_intdigest(b"\n")


class Numbers(dict):
    """Numbers words in the order in which they come first."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text as numbers of its words, and the hash of each number's word."""
    seen = Numbers()
    number = seen.__getitem__
    out = []
    for raw in texts:
        parts = [np.fromiter(map(number, piece), np.int32, len(piece)) for piece in word_pieces(raw)]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
    return out, hashes


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a run of two words from theirs."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# Numbers and hashes as bytes


def packed(values: np.ndarray) -> bytes:
    """Counts as a byte each; those that do not fit follow."""
    big = values >= 255
    return np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype(np.uint64).tobytes()


def unpacked(raw: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """``n`` counts from ``packed``, which begin at ``at``, and where they end."""
    small = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    big = np.flatnonzero(small == 255)
    at += n
    if len(big):
        small[big] = np.frombuffer(raw[at : at + 8 * len(big)], np.uint64).astype(np.int64)
        at += 8 * len(big)
    return small, at


def planes(codes: np.ndarray) -> bytes:
    """Numbers with their low bytes first, then the next ones: most are small, so this packs well."""
    return np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def cut_hashes(x: np.ndarray, size: int) -> bytes:
    """The first ``size`` bytes of each hash."""
    return np.ascontiguousarray((x >> np.uint64(64 - 8 * size)).view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def read_hashes(raw: bytes, n: int, size: int, at: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
    return out.view(np.uint64).ravel(), at + n * size


def part_hash(context: np.ndarray, part: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Hash of a part of a context; a context in one part is itself."""
    return np.where(parts > 1, mixed(context, part.astype(np.uint64)), context)


def spread(counts: np.ndarray) -> np.ndarray:
    """Parts of contexts that are seen so often: none brings more than ``SPLIT`` runs or so to a bucket."""
    return np.maximum(-(-counts // SPLIT), 1)


def all_parts(contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of a context and hash, for all parts of all contexts."""
    parts = spread(counts)
    which = np.repeat(np.arange(len(contexts)), parts)
    part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    return which, part_hash(contexts[which], part, parts[which])


def ascending(x: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


class Asked:
    """Distinct runs of a group in the order in which they are asked for, by context.

    ``context`` and ``word`` are hashes, ``own`` the training counts in the group, ``seen`` the
    counts of the contexts in the whole corpus. ``known`` are all contexts (hash, count) whose arcs are asked
    for, in all their parts, whether the group has words there or not. Words alone are contexts with
    themselves as the only word.
    """

    def __init__(
        self,
        context: np.ndarray,
        word: np.ndarray,
        own: np.ndarray,
        bits: int,
        seen: np.ndarray | None = None,
        known: tuple[np.ndarray, np.ndarray] | None = None,
    ):
        if seen is not None:
            parts = spread(seen)
            if parts.max(initial=1) > 1:
                context = part_hash(context, (word % parts.astype(np.uint64)), parts)
        # Runs of one context stand together, so stretches of them are put in order, not runs.
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        size = np.diff(np.append(first, len(context)))
        stretch = np.argsort(context[first], kind="stable")
        put = np.cumsum(size[stretch]) - size[stretch]
        self.order = np.repeat(first[stretch] - put, size[stretch]) + np.arange(len(context))
        self.word, self.own = word[self.order], own[self.order]
        self.alone = known is None
        # What is known holds the contexts of all runs.
        self.heads = ascending(context[first] if known is None else all_parts(*known)[1])
        self.wide = np.bincount(np.searchsorted(self.heads, context[first]), size, len(self.heads)).astype(np.int64)
        self.bits = bits
        bucket = (self.heads >> np.uint64(64 - bits)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        #: Buckets, and the slices of contexts and of runs that go there.
        self.buckets = bucket[begin]
        self.head_cuts = np.append(begin, len(bucket))
        self.run_cuts = np.append(0, np.cumsum(self.wide))[self.head_cuts]

    def messages(self) -> Iterator[tuple[int, int, int, bytes]]:
        """Bucket, its contexts and runs, and those as bytes."""
        for i, bucket in enumerate(self.buckets.tolist()):
            heads = slice(self.head_cuts[i], self.head_cuts[i + 1])
            runs = slice(self.run_cuts[i], self.run_cuts[i + 1])
            if self.alone:
                body = cut_hashes(self.heads[heads] << np.uint64(self.bits), WORD)
            else:
                body = cut_hashes(self.heads[heads] << np.uint64(self.bits), LEFT) + packed(self.wide[heads])
                body += cut_hashes(self.word[runs], RIGHT)
            body += packed(self.own[runs])
            yield bucket, heads.stop - heads.start, runs.stop - runs.start, body

    def answered(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run, as it was given, its count; of each of its contexts (hash) the arcs and their sum."""
        counts = np.zeros(len(self.word), np.int64)
        arcs, sums = np.zeros(len(self.heads), np.int64), np.zeros(len(self.heads), np.int64)
        for i, bucket in enumerate(self.buckets.tolist()):
            raw = answers[bucket]
            heads, runs = slice(self.head_cuts[i], self.head_cuts[i + 1]), slice(self.run_cuts[i], self.run_cuts[i + 1])
            counts[runs], at = unpacked(raw, runs.stop - runs.start, 0)
            if self.alone:
                continue
            arcs[heads], at = unpacked(raw, heads.stop - heads.start, at)
            sums[heads], at = unpacked(raw, heads.stop - heads.start, at)
        out = np.zeros_like(counts)
        out[self.order] = counts
        return out, self.heads, arcs, sums


def added_up(group: pa.Table) -> pa.Table:
    """What all groups ask of a bucket -> what each is answered, and totals over the bucket's words."""
    level = group.column("level")[0].as_py()
    bucket = group.column("bucket")[0].as_py()
    g, n_heads, n_runs, bodies = (group.column(c).to_pylist() for c in ("g", "heads", "runs", "body"))
    heads, wide, words, own = [], [], [], []
    for n, m, raw in zip(n_heads, n_runs, bodies):
        if level == 1:
            h, at = read_hashes(raw, n, WORD, 0)
            w, x = np.ones(n, np.int64), np.zeros(n, np.uint64)
        else:
            h, at = read_hashes(raw, n, LEFT, 0)
            w, at = unpacked(raw, n, at)
            x, at = read_hashes(raw, m, RIGHT, at)
        c, at = unpacked(raw, m, at)
        heads.append(h), wide.append(w), words.append(x), own.append(c)
    heads, wide, words, own = (np.concatenate(c) for c in (heads, wide, words, own))
    kinds, head = np.unique(heads, return_inverse=True)
    key = (np.repeat(head, wide).astype(np.uint64) << np.uint64(8 * RIGHT)) | words
    keys, run = np.unique(key, return_inverse=True)
    total = np.bincount(run, own, len(keys)).astype(np.int64)
    # Words are never pruned.
    kept = np.where(total >= (LEAST if level > 1 else 1), total, 0)
    context = (keys >> np.uint64(8 * RIGHT)).astype(np.int64)
    arcs = np.bincount(context[kept > 0], minlength=len(kinds))
    sums = np.bincount(context, kept, len(kinds)).astype(np.int64)
    rows, a, b = [], 0, 0
    for n, m in zip(n_heads, n_runs):
        mine = head[a : a + n]
        body = packed(kept[run[b : b + m]])
        rows.append(body if level == 1 else body + packed(arcs[mine]) + packed(sums[mine]))
        a, b = a + n, b + m
    stats = [total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()] if level == 1 else [0] * 4
    columns = [pa.array([*g, None], pa.int64()), pa.array([level] * len(g) + [None], pa.int32()), pa.array([bucket] * (len(g) + 1), pa.int64()), pa.array([*rows, None], pa.binary())]
    columns += [pa.array([0] * len(g) + [int(s)], pa.int64()) for s in stats]
    return pa.table(columns, ["g", "level", "bucket", "body", "n", "v", "one", "two"])


ASKED = "level int, g long, bucket long, heads int, runs int, body binary"
ASKED_ARROW = pa.schema([("level", pa.int32()), ("g", pa.int64()), ("bucket", pa.int64()), ("heads", pa.int32()), ("runs", pa.int32()), ("body", pa.binary())])
ANSWERED = "g long, level int, bucket long, body binary, n long, v long, one long, two long"


def asked_batch(g: int, level: int, asked: Asked) -> pa.RecordBatch:
    rows = [(level, g, *message) for message in asked.messages()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(ASKED_ARROW.types)]
    return pa.record_batch(columns, schema=ASKED_ARROW)


class Group:
    """Texts of a group as one line of word numbers, each between a start and an end."""

    def __init__(self, row: dict, bits: int):
        sizes, codes = np.frombuffer(row["sizes"], np.int32), from_planes(row["codes"])
        self.g, self.bits = row["g"], bits
        self.hashes = np.append(np.frombuffer(row["hashes"], np.uint64), np.array([START, END], np.uint64))
        self.wide = len(self.hashes)
        self.start, self.end = self.wide - 2, self.wide - 1
        n = len(sizes)
        #: Place of the first word of each text, or of its end; words and end of each.
        self.tokens = sizes.astype(np.int64) + 1
        self.begin = np.cumsum(self.tokens + 1) - self.tokens
        self.line = np.full(int((self.tokens + 1).sum()), self.start, np.int64)
        inside = np.ones(len(self.line), bool)
        inside[self.begin - 1] = inside[self.begin + self.tokens - 1] = False
        self.line[inside] = codes
        self.line[self.begin + self.tokens - 1] = self.end
        self.is_word = np.ones(len(self.line), bool)
        self.is_word[self.begin - 1] = False
        held = np.array(row["held"], bool)
        self.learnt = np.repeat(~held, self.tokens + 1)

    def words(self) -> Asked:
        """All words and the end. (The start is no token.)"""
        own = np.bincount(self.line[self.learnt & self.is_word], minlength=self.wide)
        few = np.append(np.arange(self.start), self.end)
        return Asked(self.hashes[few], self.hashes[few], own[few], self.bits)

    def pairs(self, c1: np.ndarray) -> Asked:
        """Runs of two; afterwards ``pair`` is the number of the run that ends at a place, -1 at a start."""
        at = np.flatnonzero(self.is_word)
        keys, inverse = np.unique(self.line[at - 1] * self.wide + self.line[at], return_inverse=True)
        self.pair = np.full(len(self.line), -1, np.int64)
        self.pair[at] = inverse
        self.first, self.second = keys // self.wide, keys % self.wide
        own = np.bincount(inverse, self.learnt[at], len(keys)).astype(np.int64)
        return Asked(self.hashes[self.first], self.hashes[self.second], own, self.bits, c1[self.first], (self.hashes, c1))

    def triples(self, c2: np.ndarray) -> Asked:
        """Runs of three whose halves are arcs: ``left``, ``right`` are the halves' numbers.

        Afterwards ``triple`` is the number of the run that ends at a place, or -1.
        """
        before = np.append(-1, self.pair[:-1])
        at = np.flatnonzero((self.pair >= 0) & (before >= 0))
        at = at[(c2[self.pair[at]] > 0) & (c2[before[at]] > 0)]
        n = len(self.first)
        keys, inverse = np.unique(before[at] * n + self.pair[at], return_inverse=True)
        self.triple = np.full(len(self.line), -1, np.int64)
        self.triple[at] = inverse
        self.left, self.right = keys // n, keys % n
        own = np.bincount(inverse, self.learnt[at], len(keys)).astype(np.int64)
        #: Contexts are the runs of two that are arcs.
        self.kept = np.flatnonzero(c2)
        self.context = np.zeros(n, np.uint64)
        self.context[self.kept] = mixed(self.hashes[self.first[self.kept]], self.hashes[self.second[self.kept]])
        known = self.context[self.kept], c2[self.kept]
        return Asked(self.context[self.left], self.hashes[self.second[self.right]], own, self.bits, c2[self.left], known)

    def counts(self, asked: Asked, answers: dict[int, bytes]) -> np.ndarray:
        """Counts of all words; the start is there as often as the end."""
        out = np.zeros(self.wide, np.int64)
        out[np.append(np.arange(self.start), self.end)] = asked.answered(answers)[0]
        out[self.start] = out[self.end]
        return out


def left_over(contexts: np.ndarray, counts: np.ndarray, heads: np.ndarray, arcs: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """b(h) of contexts (hash) with their counts, and whether arcs go out from them."""
    if not len(heads):
        return np.ones(len(contexts)), np.zeros(len(contexts), bool)
    which, part = all_parts(contexts, counts)
    at = np.minimum(np.searchsorted(heads, part), len(heads) - 1)
    known = heads[at] == part
    n = np.bincount(which, np.where(known, arcs[at], 0), len(contexts))
    taken = np.bincount(which, np.where(known, sums[at], 0), len(contexts)) - DISCOUNT * n
    over = 1 - taken / np.maximum(counts, 1)
    return np.where(n > 0, np.clip(over, 1e-12, 1.0), 1.0), n > 0


class Automaton:
    """The part of the automaton that a group's texts can touch.

    States: 0 is the empty run, 1 + w a word, 1 + words + i a run of two.
    """

    def __init__(self, group: Group, totals: dict, answers: dict[int, dict[int, bytes]]):
        wide = group.wide
        c1 = self.counts = group.counts(group.words(), answers.get(1, {}))
        n, v, d = totals["n"], totals["v"], totals["d"]
        p1 = np.where(c1 > 0, (c1 - d) / n, d * v / n)
        c2, *arcs = group.pairs(c1).answered(answers.get(2, {}))
        over1, state1 = left_over(group.hashes, c1, *arcs)
        first, second = group.first, group.second
        p2 = np.where(c2 > 0, (c2 - DISCOUNT) / np.maximum(c1[first], 1) + over1[first] * p1[second], 0.0)
        c3, *arcs = group.triples(c2).answered(answers.get(3, {}))
        over2, state2 = np.ones(len(first)), np.zeros(len(first), bool)
        over2[group.kept], state2[group.kept] = left_over(group.context[group.kept], c2[group.kept], *arcs)
        left, right = group.left, group.right
        p3 = (c3 - DISCOUNT) / np.maximum(c2[left], 1) + over2[left] * p2[right]

        self.wide, self.group = wide, group
        self.word_state = np.where(state1, 1 + np.arange(wide), 0)
        self.pair_state = np.where(state2, 1 + wide + np.arange(len(first)), self.word_state[second])
        self.fail = np.concatenate(([0], np.zeros(wide, np.int64), self.word_state[second]))
        self.fail_weight = np.log10(np.concatenate(([1.0], over1, over2)))
        # Arcs by the run they end: of words, of runs of two and of three, with the states they lead to.
        of = [np.ones(wide, bool), c2 > 0, c3 > 0]
        self.base = np.cumsum([0, wide, len(first)])
        self.known = np.append(np.concatenate(of), False)
        self.weight = np.log10(np.where(self.known, np.concatenate((p1, p2, p3, [1.0])), 1.0))
        self.next = np.concatenate((self.word_state, self.pair_state, self.pair_state[right], [0]))

    def read(self) -> np.ndarray:
        """Log10 probability of each text."""
        group = self.group
        pieces = -(-group.tokens // LANE)
        text = np.repeat(np.arange(len(pieces)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = group.begin[text] + nth * LANE
        length = np.minimum(group.tokens[text] - nth * LANE, LANE)
        # The longest on top, so that those still being read come first.
        order = np.argsort(-length, kind="stable")
        text, at, length, nth = text[order], at[order], length[order], nth[order]
        # A text begins at the start; a piece in the state that the words before it lead to.
        state = np.where(nth == 0, self.word_state[group.start], self.pair_state[group.pair[at - 1]])
        score = np.zeros(len(at))
        line, pair, triple = group.line, group.pair, group.triple
        none = len(self.known) - 1
        for step in range(int(length.max(initial=0))):
            active = int(np.searchsorted(-length, -step, side="left"))
            place, now = at[:active] + step, state[:active]
            # The arc of the word read from a state of two words, of one, and of none.
            arcs = (self.base[0] + line[place], self.base[1] + pair[place], np.where(triple[place] >= 0, self.base[2] + triple[place], none))
            deep, some = now > self.wide, now > 0
            arc = np.where(deep, arcs[2], np.where(some, arcs[1], arcs[0]))
            gained = np.zeros(active)
            for shorter in (arcs[1], arcs[0]):
                # A state without the arc fails to the state of one word less.
                failed = ~self.known[arc]
                gained += np.where(failed, self.fail_weight[now], 0.0)
                now = np.where(failed, self.fail[now], now)
                arc = np.where(failed, np.where(now > 0, shorter, arcs[0]), arc)
            score[:active] += gained + self.weight[arc]
            state[:active] = self.next[arc]
        return np.bincount(text, score, len(pieces))


def raw_text() -> Column:
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")


def grouped(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, held_out, raw) -> g, ids, held, sizes, codes, hashes, tokens: a row for about ``STEP`` bytes of text."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            codes, hashes = numbered([h[2] for h in held])
            # Words are numbered in the order of their hashes, in which they are asked for.
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            hashes = hashes[order]
            ids = pa.array([h[0] for h in held], ids_kind)
            columns = [
                pa.array([(task << 32) + n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), ids),
                pa.array([[h[1] for h in held]], pa.list_(pa.bool_())), pa.array([np.array([len(c) for c in codes], np.int32).tobytes()], pa.binary()),
                pa.array([planes(rank[np.concatenate(codes)])], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
                pa.array([sum(len(c) + 1 for c in codes)], pa.int64()),
            ]
            return pa.record_batch(columns, ["g", "ids", "held", "sizes", "codes", "hashes", "tokens"])

        for batch in batches:
            ids_kind = batch.schema.field(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(row)
                size += len(row[2])
                if size > STEP:
                    yield out()
                    held, size, n = [], 0, n + 1
        if held:
            yield out()

    return rows.mapInArrow(
        number, f"g long, ids array<{kind}>, held array<boolean>, sizes binary, codes binary, hashes binary, tokens long"
    )


def by_level(answers: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, bucket, body in zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "body"))):
        out.setdefault(level, {})[bucket] = body
    return out


def told(answers: DataFrame):
    """Answers by the group they are for, without the totals."""
    return answers.where("g IS NOT NULL").select("g", "level", "bucket", "body").groupBy("g")


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score; learns from the rows that are not held out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out.alias("held_out"), raw_text())
    groups = cut_into_buckets(grouped(rows, kind), "lm-groups", ["g"], shuffle=False)
    tokens = groups.agg(F.sum("tokens")).first()[0] or 0
    bits = max(BITS, math.ceil(math.log2(max(1, tokens / HELD))))

    answers = bucket_table(docs.sparkSession, "lm-answers")

    def answered(asked: DataFrame) -> DataFrame:
        """All answers so far. What was shuffled for them is let go before the next level is asked."""
        out = add_to_buckets(asked.groupBy("level", "bucket").applyInArrow(added_up, ANSWERED), answers, ["g"])
        release(docs.sparkSession)
        return out

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group = Group(row, bits)
                yield asked_batch(group.g, 1, group.words())

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            group = Group(row, bits)
            c1 = group.counts(group.words(), by_level(right)[1])
            out.append(asked_batch(group.g, 2, group.pairs(c1)))
        return pa.Table.from_batches(out, schema=ASKED_ARROW)

    def ask_triples(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            group, known = Group(row, bits), by_level(right)
            c2 = group.pairs(group.counts(group.words(), known[1])).answered(known[2])[0]
            out.append(asked_batch(group.g, 3, group.triples(c2)))
        return pa.Table.from_batches(out, schema=ASKED_ARROW)

    parts = groups.select("g", "held", "sizes", "codes", "hashes")
    known = answered(parts.mapInArrow(ask_words, ASKED))
    r = known.where("g IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "one", "two"))).first()
    totals = {"n": max(r.n, 1), "v": r.v, "d": r.one / (r.one + 2 * r.two) if r.one and r.two else 0.5}
    for ask in (ask_pairs, ask_triples):
        known = answered(parts.groupBy("g").cogroup(told(known)).applyInArrow(ask, ASKED))
    n, v = r.n, r.v
    base = math.log10(n + 0.1 * (v + 1))

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i, row in enumerate(left.to_pylist()):
            group = Group(row, bits)
            if n:
                automaton = Automaton(group, totals, by_level(right))
                counts, scores = automaton.counts, pa.array(automaton.read())
            else:
                counts, scores = np.zeros(group.wide, np.int64), pa.nulls(len(group.tokens), pa.float64())
            text = np.repeat(np.arange(len(group.tokens)), group.tokens)
            own = counts[group.line[group.is_word]]
            size = len(group.tokens)
            columns = [
                left.column("ids").combine_chunks().slice(i, 1).flatten(), pa.array(row["held"], pa.bool_()), pa.array(group.tokens),
                pa.array(np.bincount(text, own > 0, size).astype(np.int64)), pa.array(np.full(size, n, np.int64)),
                pa.array(np.bincount(text, np.log10(own + 0.1), size) - group.tokens * base), scores,
            ]
            out.append(pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return groups.groupBy("g").cogroup(told(known)).applyInArrow(read, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, remainder(F.col("doc_id"), 10) == 0)
