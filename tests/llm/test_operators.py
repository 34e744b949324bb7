"""Each operator against a plain version of it, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import langid, licences, lm, mixing, nearest, registry, repeats, rules, sharding, simhash, tiling

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


VOCABULARY = {
    "aa": ["anna", "bar", "cabal", "dada", "Ära", "fall", "gala", "halma", "jazz", "kanal"],
    "ii": ["iris", "bit", "pilz", "ring", "silo", "tipi", "wille", "zick", "édit", "kiwi"],
}


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows among plain ones, and columns with names that operators use."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lang = "aa" if i % 3 else "ii"
        text = prose(rng, rng.randint(3, 60), VOCABULARY[lang])
        rows.append((i, text + ("\n" + text if i % 7 == 0 else ""), lang, f"s{i % 4}" if i % 5 else None, len(text)))
    rows += [(200 + i, rows[0][1], "ii", "hot", 1) for i in range(60)]
    rows += [
        (300, None, "aa", "s1", None), (301, "", None, "s1", 0), (302, " \t\n ", "ii", "", 4), (303, "123 !!", "aa", "one", 6),
        (None, "anna bar cabal dada fall", None, None, 1), (None, None, None, None, None),
        (304, "Ända", "aa", "s2", 1), (304, "Ända", "aa", "s2", 1), (304, "other words of one id", "ii", "s2", 1),
        (305, prose(rng, 60_000, VOCABULARY["aa"]), "aa", "s3", 1), (306, "a" * 5000, "aa", "s3", 1),
    ]
    out = spark.createDataFrame(rows, DOC)
    for c in ("size", "KEY", "shard", "row", "x", "y", "mark", "taken", "p", "raw", "epoch"):
        out = out.withColumn(c, F.lit(c))
    return out.cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def as_key(doc_id):
    return b"" if doc_id is None else str(doc_id).encode()


# Language ID


def plain_trees(samples):
    trees = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    for lang, raw in samples:
        for i, b in enumerate(raw):
            for k in range(langid.ORDER + 1):
                context = (b"\0" * langid.ORDER + raw)[i + langid.ORDER - k : i + langid.ORDER]
                trees[lang][context][b] += 1
    return trees


def plain_length(tree, raw):
    bits = 0.0
    for i, b in enumerate(raw):
        for k in range(langid.ORDER, -1, -1):
            seen = tree.get((b"\0" * langid.ORDER + raw)[i + langid.ORDER - k : i + langid.ORDER])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if b in seen:
                bits -= math.log2(seen[b] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_language_id(docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    samples = [
        (r.lang, r.text.lower().encode()) for r in rows if r.lang and r.text and zlib.crc32(as_key(r.doc_id)) % 3 != 1
    ]
    trees = plain_trees(samples)
    texts = {(r.doc_id, r.text) for r in rows}
    assert {(g.doc_id, g.held_out) for g in got} == {(d, zlib.crc32(as_key(d)) % 3 == 1) for d, _ in texts}
    want = collections.Counter()
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            want[r.doc_id, "und", None] += 1
            continue
        raw = r.text.lower().encode()
        if len(raw) > 10_000:
            continue
        lengths = {lang: plain_length(trees[lang], raw) for lang in sorted(trees)}
        best = min(lengths, key=lengths.get)
        want[r.doc_id, best, round(lengths[best] / len(raw), 3)] += 1
    have = collections.Counter((g.doc_id, g.lang_pred, None if g.bits is None else round(g.bits, 3)) for g in got if g.doc_id != 305)
    assert have == want
    assert all(0 <= g.score <= 1 for g in got)


def test_long_text_is_scored_in_steps(monkeypatch):
    monkeypatch.setattr(langid, "STEP", 64)
    keys, counts = np.unique(langid.windows(*langid.joined([b"some plain text to learn from"])), return_counts=True)
    trees = langid.Trees([(keys, counts)])
    texts = [b"text to learn some from " * 20, b"", b"x", b"plain" * 30]
    got = trees.lengths(texts)[:, 0]
    tree = plain_trees([("l", b"some plain text to learn from")])["l"]
    assert np.allclose(got, [plain_length(tree, t) for t in texts], rtol=1e-5)


def test_language_id_of_nothing(docs, none):
    assert langid.identify(none).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    assert {300, 301, 302, 303}.isdisjoint({r.doc_id for r in kept.collect()})


@pytest.mark.parametrize("share", [0.02, 0.0])
def test_language_of_few_long_texts_is_learned(spark, share):
    rng = random.Random(9)
    long = [(i, prose(rng, 40_000, VOCABULARY["ii"]), "ii") for i in range(3)]
    short = [(10 + i, prose(rng, 50, VOCABULARY["aa"]), "aa") for i in range(200)]
    frame = spark.createDataFrame(long + short, "doc_id long, text string, lang string")
    size = sum(len(t.encode()) for _, t, _ in long)
    langs, trees = langid.train(frame, int(share * size))
    assert langs == ["aa", "ii"]
    assert [trees.lengths([prose(rng, 30, VOCABULARY[x]).lower().encode()]).argmin() for x in langs] == [0, 1]


def test_drawn_pieces_are_bounded(spark):
    rng = random.Random(9)
    long = [(i, prose(rng, 400_000, VOCABULARY["ii"]), "ii") for i in range(2)]
    frame = spark.createDataFrame(long, "doc_id long, text string, lang string")
    size = sum(len(r.raw) - r.skip for r in langid.drawn(frame, 1 << 19).collect())
    assert 1 << 18 < size < 1 << 20
    every = sum(len(r.raw) - r.skip for r in langid.drawn(frame, 1 << 30).collect())
    assert every == sum(len(t.encode()) for _, t, _ in long)


# Language-model scores


def test_lm_base_and_counts(docs, rows):
    got = lm.scored(docs.select("doc_id", "text", "row"), langid.remainder(F.col("doc_id"), 10) == 0).collect()
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(as_key(r.doc_id)) % 10:
            counts.update([*words(r.text), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in rows:
        own = [*words(r.text), b"\n"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want[r.doc_id, zlib.crc32(as_key(r.doc_id)) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n, round(base, 4)] += 1
    assert want == collections.Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 4)) for g in got)
    assert all(g.score <= 0 for g in got)


def plain_lm(texts, order=lm.ORDER, least=2):
    """p(word | history) by the same discounts, from runs of words as tuples."""
    runs = [collections.Counter() for _ in range(order)]
    for t in texts:
        line = [None, *t, "\n"]
        for n in range(order):
            runs[n].update(tuple(line[i : i + n + 1]) for i in range(len(line) - n))
    starts = len(texts)
    one = {w[0]: c for w, c in runs[0].items() if w[0] is not None}
    total, kinds = sum(one.values()), len(one)
    n1, n2 = sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    kept = [None] + [{r: c for r, c in runs[n].items() if c >= least} for n in range(1, order)]

    def p(history, w):
        if not history:
            return (one[w] - d) / total if w in one else d * kinds / total
        n = len(history)
        context = starts if history == (None,) else runs[n - 1][history]
        arcs = {r: c for r, c in kept[n].items() if r[:-1] == history}
        left = 1 - sum(c - lm.DISCOUNT for c in arcs.values()) / context if context else 1.0
        left = min(1.0, max(left, 1e-12)) if arcs else 1.0
        gain = (arcs[(*history, w)] - lm.DISCOUNT) / context if (*history, w) in arcs else 0.0
        return gain + left * p(history[1:], w)

    def score(t):
        line = [None, *t, "\n"]
        total = 0.0
        for i in range(1, len(line)):
            history = tuple(line[max(0, i - order + 1) : i])
            total += math.log10(p(history, line[i]))
        return total

    return p, score, one


def test_lm_automaton_is_the_model(spark):
    rng = random.Random(2)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randint(0, 12))] for _ in range(40)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    more = [["a", "b", "zz", "a"], ["zz"], []]
    frame = frame.union(spark.createDataFrame([(1000 + i, " ".join(t)) for i, t in enumerate(more)], "doc_id long, text string"))
    got = {r.doc_id: r for r in lm.scored(frame, F.col("doc_id") >= 1000).collect()}
    p, score, one = plain_lm(texts)
    for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(more))]:
        assert got[i].score == pytest.approx(score(t), abs=1e-6)
    for history in ((), ("a",), ("a", "b"), (None,), (None, "c"), ("zz",)):
        assert sum(p(history, w) for w in [*one, "zz"]) == pytest.approx(1)


@pytest.mark.parametrize("step, held, split, lane", [(200, 50, 3, 5), (1 << 22, 1 << 21, 20, 1)])
def test_lm_keeps_rare_runs_of_big_corpora(spark, monkeypatch, step, held, split, lane):
    # As when the corpus is so big that it has many groups and buckets, and words fill several parts.
    for name, value in (("STEP", step), ("HELD", held), ("SPLIT", split), ("LANE", lane)):
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(3)
    texts = [[rng.choice("abcdefghij") for _ in range(rng.randint(0, 30))] for _ in range(60)]
    more = [["a", "b", "zz", "a"], ["zz"], [], [rng.choice("abcdefghij") for _ in range(400)]]
    every = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(more))]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in every], "doc_id long, text string").repartition(3)
    # Tasks read several files.
    packed = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for key, value in packed.items():
        spark.conf.set(key, value)
    try:
        got = {r.doc_id: r for r in lm.scored(frame, F.col("doc_id") >= 1000).collect()}
    finally:
        for key in packed:
            spark.conf.unset(key)
    _, score, _ = plain_lm(texts)
    assert {i: r.score for i, r in got.items()} == {i: pytest.approx(score(t), abs=1e-6) for i, t in every}


def test_lm_of_nothing(docs, none):
    assert lm.scored(none, F.lit(False)).collect() == []
    all_out = lm.scored(docs, F.lit(True)).collect()
    assert {r.score for r in all_out} == {None} and {r.n_known for r in all_out} == {0}


# Nearest vectors


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.standard_normal(24).tolist() for _ in range(700)]
    vectors += [vectors[3]] * 200
    rows = list(enumerate(vectors))
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0, None]), (2080, []), (None, [1.0] * 24)]
    rows += [(2100, [1.0, 2.0]), (2100, [1.0, 2.0]), (2120, [float("inf")] * 24)]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, score int, x int")
    got = collections.defaultdict(list)
    for r in sorted(nearest.nearest(frame).collect()):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(list(v) + [0.0] * (24 - len(v))) for i, v in rows if i is not None and (i < 2000 or i == 2100)}
    ids = np.array(sorted(good))
    matrix = np.array([good[i] for i in ids])
    hits = 0
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(got) == queries
    for q in queries:
        score = (matrix * good[q]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        assert [g[0] for g in got[q]] == list(range(1, 21))
        for _, v, s in got[q]:
            assert s == pytest.approx(float((good[v] * good[q]).sum()), rel=1e-12)
        hits += len({g[1] for g in got[q]} & {int(ids[k]) for k in order})
    assert hits >= 0.98 * 20 * len(queries)
    tie = [g for g in got[0] if np.array_equal(good[g[1]], good[3])]
    assert [g[1] for g in tie] == sorted(g[1] for g in tie)


def test_nearest_in_small_blocks(spark, monkeypatch):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(41)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nearest, "BLOCK", 1)
    got = nearest.nearest(frame).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got if r["rank"] < 3) == [
        (0, 1, 1), (0, 2, 2), (20, 1, 40), (20, 2, 39), (40, 1, 39), (40, 2, 38)
    ] or {r.query_id for r in got} == {0, 20, 40}
    few = nearest.nearest(frame.where("vec_id < 5")).collect()
    assert sorted((r["rank"], r.vec_id) for r in few if r.query_id == 0) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert nearest.nearest(frame.limit(0)).collect() == []


# Mixing


def plain_targets(sizes, ratio=1.5, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    share, full = ratio * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left = share - sum(full.values())
        goal = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if goal[s] >= 2 * sizes[s]]
        if not over:
            return {**full, **goal}
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    goal = plain_targets(dict(sizes))
    taken = collections.Counter()
    for g in got:
        assert (g.source_size, g.target) == (sizes[g.source], pytest.approx(goal[g.source]))
        assert 0 <= g.taken <= 2 * g.size
        taken[g.source] += g.taken
    for source in sizes:
        assert abs(taken[source] - goal[source]) <= 3
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    assert collections.Counter((g.doc_id, g.size) for g in got) == collections.Counter((r.doc_id, len(words(r.text))) for r in rows)


def test_mixed_documents_give_the_mix(docs, none):
    want = collections.Counter()
    for g in mixing.mix(docs).collect():
        want[g.doc_id, g.source] += g.taken
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.schema["n_chars"] == docs.schema["n_chars"]
    have = collections.Counter()
    for r in out.collect():
        have[r.doc_id, r.source] += len(words(r.text))
        assert r.text is not None
    assert have == +want
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []


# Sharding


def check_shards(got, total, shards, tolerance, largest):
    load = collections.Counter()
    slots = collections.defaultdict(list)
    for shard, slot, size in got:
        load[shard] += size
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for s in range(shards):
        assert abs(load[s] - total / shards) <= 2 * (tolerance * total / shards + largest)


def test_shards(docs, rows, none):
    got = sharding.shard_rows(docs).collect()
    assert collections.Counter((g.doc_id, g["size"], g.text_crc32) for g in got) == collections.Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows
    )
    sizes = [len((r.text or "").encode()) + 1 for r in rows]
    check_shards([(g.shard, g.slot, g["size"]) for g in got], sum(sizes), 16, 0.01, max(sizes))
    assert sharding.shard_rows(none).collect() == []
    full = sharding.sharded_documents(docs.drop("shard"))
    assert full.columns == [*docs.drop("shard").columns, "shard", "slot"]
    assert full.count() == len(rows)


def test_shards_split_one_hot_text_and_keep_others_whole(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    cold = spark.range(3000, 9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text no "), F.floor(F.col("id") / 3)).alias("text"))
    twins = spark.range(900).select(F.lit(7).cast("long").alias("doc_id"), F.lit("row that repeats").alias("text"))
    got = sharding.shard_rows(hot.union(cold).union(twins), shards=4).collect()
    check_shards([(g.shard, g.slot, g["size"]) for g in got], sum(g["size"] for g in got), 4, 0.01, 20)
    where = collections.defaultdict(set)
    for g in got:
        where[g.text_crc32].add(g.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 3


# Repeats


def plain_repeats(texts, width):
    seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = len([r for r in bytes(gone).split(b"\0") if r])
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings():
    rng = random.Random(3)
    for _ in range(200):
        width = rng.choice([2, 3, 5, 8, 20])
        letters = b"abcd"[: rng.choice([1, 2, 4])]
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(width, 60))) for _ in range(rng.randint(1, 6))]
        texts += [t for t in (rng.choice(texts)[rng.randint(0, 3) :] + b"ab" for _ in range(3)) if len(t) >= width]
        seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
        want = [[i for i in range(len(t) - width + 1) if seen[t[i : i + width]] > 1] for t in texts]
        assert [g.tolist() for g in repeats.repeated(texts, width)] == want


@pytest.mark.parametrize("group, block, step", [(1 << 18, 1 << 19, 1 << 20), (200, 2000, 1 << 20), (1000, 4000, 300)])
def test_without_repeats(spark, docs, monkeypatch, group, block, step):
    monkeypatch.setattr(repeats, "STEP", step)
    rng = random.Random(4)
    passage = prose(rng, 20, VOCABULARY["aa"])
    texts = [(400 + i, prose(rng, 20, VOCABULARY["ii"]) + passage + prose(rng, 20, VOCABULARY["aa"])) for i in range(60)]
    texts += [(500, "be " * 80), (501, "x" + "be " * 70), (502, passage[5:] + "é" * 90)]
    frame = docs.select("doc_id", "text", "x", "raw").where("doc_id is null or doc_id <> 305")
    frame = frame.unionByName(spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True)
    rows = frame.collect()
    want = plain_repeats([(r.text or "").encode() for r in rows], 60)
    got = repeats.without_repeats(frame, width=60, gram=12, group=group, block=block).collect()
    assert collections.Counter((r.doc_id, *w) for r, w in zip(rows, want)) == collections.Counter(
        (g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got
    )


def test_without_repeats_of_nothing(none):
    assert repeats.without_repeats(none).collect() == []


def test_repeats_of_the_contract(spark, tmp_path):
    """400 bytes go, 399 stay, 51 words or not; n_bytes is the input's either way."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    rest = iter(" ".join(words[i : i + 90]) for i in range(0, 3600, 90))
    short, long = " ".join(words[3600:3651]), " ".join(words[3700:3800])
    passages = {"51 words": short, "399": long[:399], "400": long[100:500]}
    rows, want = [], {}
    for i, (name, passage) in enumerate(passages.items()):
        for j in range(2):
            # Marks that differ between the two, so that the passage is all they share.
            text = f"{next(rest)}é{j}{passage}{2 + j}{next(rest)}"
            raw, gone = text.encode(), passage.encode() if name == "400" else b""
            rows.append((10 * i + j, text))
            kept = raw.replace(gone, b"") if gone else raw
            want[10 * i + j] = (len(raw), len(gone), int(name == "400"), hashlib.sha256(kept).hexdigest())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.op5(spark, str(tmp_path)).collect()
    assert {g.doc_id: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got} == want


# Tiling


def plain_tiles(doc, item, run):
    doc_marks, item_marks, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while (
                    d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n]
                    and d + n not in doc_marks and i + n not in item_marks
                ):
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < run:
            return out
        out.append((d, i, n))
        doc_marks |= set(range(d, d + n))
        item_marks |= set(range(i, i + n))


def test_tiles():
    rng = random.Random(6)
    cache = tiling.Words()
    for _ in range(150):
        doc = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        item = [rng.choice("abc") for _ in range(rng.randint(5, 20))]
        own = tiling.seeds(" ".join(doc), cache)
        ask = tiling.seeds(" ".join(item), cache)
        at = [k for k, s in enumerate(own.tolist()) if s in set(ask.tolist())]
        got = tiling.tiles(at, own[at].tolist(), ask.tolist())
        assert sorted(got) == sorted(plain_tiles(doc, item, tiling.RUN))


def test_leaks(spark, docs, none):
    rng = random.Random(8)
    items = [prose(rng, 24, [f"{a}{b}" for a in "bcdf" for b in ("ox", "um", "ip", "ek", "ar")]) for _ in range(6)]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(6, None, 1), (7, "too short", 1), (8, items[0], 1)], "item_id long, text string, x int")
    half = items[1].split()
    planted = [
        (900, f"anna bar, {items[0].upper()}. dada"),
        (901, " ".join([*half[12:], "between", *half[:12]])),
        (902, " ".join([*half[:8], "and no more of it"])),
        (903, f"{items[2]} {items[3]}"),
        (904, items[4]), (904, items[4]),
    ]
    frame = docs.select("doc_id", "text", "x").unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    got = collections.Counter((r.doc_id, r.item_id, r.n_tiles, r.copies) for r in tiling.leaks(frame, benchmark).collect())
    assert got == collections.Counter([(900, 0, 1, 1), (900, 8, 1, 1), (901, 1, 2, 1), (903, 2, 1, 1), (903, 3, 1, 1), (904, 4, 1, 2)])
    left = tiling.clean(frame, benchmark)
    assert left.columns == frame.columns
    assert sorted({r.doc_id for r in left.where("doc_id >= 900").collect()}) == [902]
    assert left.count() == docs.count() + 1
    assert tiling.leaks(none, benchmark).collect() == [] and tiling.leaks(frame, benchmark.limit(0)).collect() == []


# Quality rules


def test_rules_learn_and_compile(spark):
    rng = random.Random(9)
    good = [(i, prose(rng, 40, VOCABULARY["aa"]) + ".", 1) for i in range(0, 300)]
    bad = [(i, rng.choice(VOCABULARY["ii"]) .upper()* 3 + " !!" * 20, 0) for i in range(300, 500)]
    frame = spark.createDataFrame([*good, *bad, (600, None, None), (601, "", None), (None, "text", 1)], "doc_id long, text string, quality int")
    labels = frame.select("doc_id", "quality")
    got = rules.scored(frame.select("doc_id", "text", F.lit(1).alias("score")), labels).collect()
    assert len(got) == frame.count()
    truth = {r.doc_id: r.quality for r in frame.collect()}
    held = [g for g in got if g.held_out and truth[g.doc_id] is not None]
    assert sum(g.predicted == truth[g.doc_id] for g in held) >= 0.95 * len(held)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    one = rules.scored(frame, labels.where("quality = 1")).collect()
    assert {g.score for g in one} == {1.0}
    assert {g.score for g in rules.scored(frame, labels.limit(0)).collect()} == {0.5}
    assert rules.scored(frame.limit(0), labels).collect() == []


def test_leaks_in_a_very_long_text(spark):
    """An item is found wherever it stands, in parts and in other order, too."""
    rng = random.Random(13)
    filler = [f"w{rng.randrange(10**7)}" for _ in range(300_000)]
    item = [f"item{i}" for i in range(30)]
    whole, turned = filler[:200_000] + item + filler[200_000:], filler[:9] + item[15:] + filler[:250_000] + item[:15]
    rows = [(1, " ".join(whole)), (2, "\n".join(turned)), (3, " ".join(filler)), (4, None), (5, "item0 item1 item2"), (6, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles, r.longest) for r in tiling.leaks(docs, benchmark).collect())
    assert got == [(1, 7, 1.0, 1, 30), (2, 7, 1.0, 2, 15)]
    assert sorted(r.doc_id for r in tiling.clean(docs, benchmark).collect()) == [3, 4, 5, 6]


def plain_statistics(text):
    """The statistics of one text, in the order of ``STATISTICS``."""
    text = text or ""
    own, lines = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ").split(" "), text.split("\n")
    part = lambda a, b: a / b if b else 0.0
    of = lambda chars: part(sum(text.count(c) for c in chars), len(text))
    return [
        math.log1p(len(own)), part(len(text), len(own)), part(len(set(own)), len(own)), part(len(set(lines)), len(lines)), part(len(own), len(lines)),
        of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("0123456789"), of(".,;:?!'\"()-"), of("#$%&*+/<=>@[\\]^_`{|}~"), of("!"),
    ]


def test_compiled_rules_score_each_row(spark, monkeypatch):
    """The expression against its rules and weights, taken one by one."""
    kept = {}

    class Spy(rules.LogisticRegression):
        def fit(self, rows):
            kept["model"] = super().fit(rows)
            return kept["model"]

    def holds(rule, plain=rules.holds):
        kept.setdefault("rules", {})[rule] = None
        return plain(rule)

    monkeypatch.setattr(rules, "LogisticRegression", Spy)
    monkeypatch.setattr(rules, "holds", holds)
    rng = random.Random(10)
    texts = [(i, " ".join(rng.choice(["Word", "x1", "!?", "low\nline", "A,B", "é#"]) for _ in range(rng.randint(0, 50)))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "long text. " * 100_000), (1002, "id that repeats"), (None, "no id")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t.count("!") > t.count("x")), 0) for i, t in texts[:400]], "doc_id long, quality int, score int")
    got = collections.Counter((g.doc_id, round(g.score, 9)) for g in rules.scored(frame, labels).collect())
    # Rules are asked for in their order when they are fitted, before the weighty ones are compiled.
    weights = dict(zip(sorted(kept["rules"]), kept["model"].coefficients.toArray()))
    assert 0 < sum(w != 0 for w in weights.values()) < len(weights)
    want = collections.Counter()
    for i, text in texts:
        own = dict(zip(rules.STATISTICS, plain_statistics(text)))
        odds = kept["model"].intercept
        for rule, weight in weights.items():
            odds += weight * all(own[n] > bound if above else own[n] <= bound for n, above, bound in rule)
        want[i, round(1 / (1 + math.exp(-odds)), 9)] += 1
    assert got == want


def test_paths_keep_the_tightest_bounds():
    assert rules.simplest((("a", False, 3.0), ("a", False, 2.0), ("a", True, 1.0), ("b", True, 0.0), ("b", True, 5.0))) == (
        ("a", False, 2.0), ("a", True, 1.0), ("b", True, 5.0)
    )


# Licences


def test_licences(spark, docs, none):
    lines = [
        (1, "anna\nReleased under the MIT License.\nbar"),
        (2, "This work is licensed under the GNU General Public License, version 3"),
        (3, "This work is licensed\nunder the GNU General\nPublic License version 2."),
        (4, "a licence is not a license"), (5, None), (6, ""), (1, "anna\nReleased under the MIT License.\nbar"),
    ]
    frame = spark.createDataFrame(lines, "doc_id long, text string").withColumn("unit", F.lit(9)).withColumn("words", F.lit("w"))
    got = sorted((r.doc_id, r.unit, r.licence, round(r.dice, 3)) for r in licences.scan(frame).collect())
    # Both copies of text 1 match as a whole, too: at the bound of size and of Dice.
    assert got == [(1, -1, "MIT", 0.8)] * 2 + [(1, 1, "MIT", 1.0)] * 2 + [(2, 0, "GPL-3.0", 1.0), (3, -1, "GPL-2.0", 1.0)]
    assert licences.scan(docs).count() == 0 and licences.scan(none).collect() == []


def test_licences_inside_other_text(spark):
    notice = licences.TEMPLATES["Apache-2.0 notice"].split()
    wrapped = "\n".join(" ".join(notice[i : i + 6]) for i in range(0, len(notice), 6))
    other = "\n".join("some other line of plain words %d" % i for i in range(40))
    rows = [
        (1, "Copyright 2024 Acme. All rights reserved."),
        (2, f"{other}\n/* This work is licensed\n\n * under the GNU General\n * Public License version 2. */\n{other}"),
        (3, f"{other}\n{wrapped}\n{other}"),
        (4, "Acme 2024, all rights reserved. Released under the MIT License. And so on, for many more words than the notice has."),
        (5, "all rights\nreserved seats"), (6, "anna\nAll rights reserved.\nAll rights reserved.\nrights"),
        (7, "all rights are reserved under the law of the land"),
    ]
    got = sorted((r.doc_id, r.unit, r.licence, round(r.dice, 3)) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [
        (1, 0, "Reserved", 1.0), (2, 40, "GPL-2.0", 1.0), (3, 40, "Apache-2.0", 0.833), (3, 40, "Apache-2.0 notice", 1.0), (4, 0, "MIT", 1.0), (4, 0, "Reserved", 1.0),
        (5, -1, "Reserved", 0.8), (5, 0, "Reserved", 1.0), (6, 1, "Reserved", 1.0), (6, 2, "Reserved", 1.0),
    ]


def plain_scan(text, templates, least=0.8):
    """Units and spans of one text, each compared with each template."""
    lines = [re.findall(r"[a-z0-9]+", line) for line in text.lower().split("\n")]
    flat = [(w, n) for n, line in enumerate(lines) for w in line]
    pairs = lambda w: collections.Counter(zip(w, w[1:]))

    def dice(own, other):
        common = sum((pairs(own) & pairs(other)).values())
        return 2 * common / (max(len(own) - 1, 0) + len(other) - 1), common

    units, found = [], []
    for unit, own in [*enumerate(lines), *([(-1, [w for w, _ in flat])] if len(lines) > 1 else [])]:
        scored = [(-round(dice(own, t)[0], 12), name, dice(own, t)[1]) for name, t in templates.items() if own]
        if scored and -min(scored)[0] >= least:
            minus, name, common = min(scored)
            units.append((unit, name, -minus))
            s = 0 if unit == -1 else sum(len(line) for line in lines[:unit])
            found.append(((round(minus * common, 9), 0, name, s, s + len(own) - 1, unit), -minus))
    for name, t in templates.items():
        known, b = pairs(t), len(t) - 1
        for s in range(len(flat) - 1):
            if (flat[s][0], flat[s + 1][0]) not in known:
                continue
            runs = []
            for e in range(s, len(flat) - 1):
                a = e - s + 1
                if a > b * (2 - least) / least + 1e-9:
                    break
                if (flat[e][0], flat[e + 1][0]) in known:
                    d, common = dice([w for w, _ in flat[s : e + 2]], t)
                    runs.append((d, -a, common))
            d, a, common = max(runs)
            if d >= least - 1e-9:
                found.append(((-round(common * d, 9), 1, name, s, s - a, flat[s][1]), d))
    kept = []
    for x, d in sorted(found):
        if all(k[3] > x[4] or x[3] > k[4] for k, _ in kept):
            kept.append((x, d))
    return sorted([(u, n, round(d, 9)) for u, n, d in units] + [(x[5], x[2], round(d, 9)) for x, d in kept if x[1] == 1])


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_licences_against_every_run(spark, monkeypatch, rounds):
    monkeypatch.setattr(licences, "ROUNDS", rounds)
    templates = {"A": "all rights reserved", "B": "free as in free as in beer or free", "C": "rights reserved all rights", "D": "as in free beer in all"}
    rng = random.Random(8)
    some = sorted({w for t in templates.values() for w in t.split()}) + ["x"]
    rows = [(i, "".join(rng.choice(some) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    rows += [(200 + i, " ".join([rng.choice(list(templates.values())) for _ in range(6)])) for i in range(20)]
    table = spark.createDataFrame([*templates.items(), (None, "x y"), ("N", None)], "licence string, text string")
    got = collections.defaultdict(list)
    for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), table).collect():
        got[r.doc_id].append((r.unit, r.licence, round(r.dice, 9)))
    own = {k: v.split() for k, v in templates.items()}
    for i, text in rows:
        assert sorted(got[i]) == plain_scan(text, own), text


def test_licences_of_a_very_long_text(spark):
    """Notices without end: work grows with the text."""
    notice = licences.TEMPLATES["Apache-2.0 notice"] + " "
    rows = [(1, "all rights reserved " * 20_000), (2, notice * 1000), (3, "all rights " * 20_000)]
    begin = time.time()
    got = collections.Counter((r.doc_id, r.licence) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[1, "Reserved"] == 20_000 and got[2, "Apache-2.0 notice"] == 1000
    assert time.time() - begin < 60


# SimHash


def plain_components(rows):
    """Of each row its fingerprint and the number of its component."""
    prints = []
    for r in rows:
        own = words(r.text)
        shingles = [b" ".join(own[i : i + 4]) for i in range(len(own) - 3)] if len(own) >= 4 else [b" ".join(own)] if own else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= 4) + i + 1:
            root[find(j)] = find(i)
    return [(f"{prints[i]:016x}", find(i)) for i in range(len(rows))]


def plain_groups(rows):
    least = {}
    found = plain_components(rows)
    for r, (_, root) in zip(rows, found):
        if r.doc_id is not None:
            least[root] = min(r.doc_id, least.get(root, r.doc_id))
    return [(r.doc_id, fp, least.get(root)) for r, (fp, root) in zip(rows, found)]


@pytest.mark.parametrize("shard", [simhash.SHARD, 8])
def test_simhash_groups(docs, rows, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    got = simhash.near_groups(docs.select("doc_id", "text")).collect()
    have = collections.Counter((g.doc_id, f"{g.fp & (2**64 - 1):016x}", g.component) for g in got)
    assert have == collections.Counter(plain_groups(rows))


def test_vantage_point_trees_lose_no_pair(monkeypatch):
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = fps[:800].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, near, fps[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    tree = simhash.plant(fps, 4, rng)
    groups = simhash.Groups(len(fps))
    homes = np.zeros(len(fps), int)
    for _, at, home in simhash.visits(tree, fps):
        homes[at[home]] += 1
        simhash.compare(fps, at[home], at, groups, rng)
    assert (homes == 1).all()
    plain = simhash.Groups(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)
        plain.link(np.full(len(j), i), j)
    assert (groups.root == plain.root).all()


def test_one_of_each(docs, rows, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    first = {}
    for r, (_, root) in zip(rows, plain_components(rows)):
        ids = [i for i in (r.doc_id, first.get(root)) if i is not None]
        first[root] = min(ids, default=None)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(first.values())
    assert simhash.one_of_each(none).collect() == [] and simhash.near_groups(none.select("doc_id", "text")).collect() == []


def test_components(spark):
    from linkloom.llm.components import components

    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked if find(x) != x} | {x: x for x in got if got[x] == x}


# Queries and their SQL


@pytest.mark.parametrize("name", registry.ORACLES)
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, sf)
    columns = want.columns
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
