"""Part codes and greatest products against plain versions, and on awkward rows."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import partcodes, topk

KIND = "vec_id long, embedding array<double>, label int"


def frame(spark, rows):
    out = spark.createDataFrame(rows, KIND)
    for c in ("v", "error", "code", "own_key", "x", "y", "nth", "entry", "score", "RANK"):
        out = out.withColumn(c, F.lit(c))
    return out


def floors(v, scale, width):
    return [math.floor(scale * x) for x in v] + [0] * (width - len(v))


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 32).tolist(), int(i % 3)) for i in range(300)]
    rows += [(400 + i, rows[5][1], None) for i in range(150)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 1), (None, rows[9][1], 2), (None, rows[9][1], 2), (None, None, None)]
    rows += [(700, [], 1), (701, [0.0] * 32, None), (702, [1.0, -2.0], 5), (703, [float("nan")] * 32, 1), (704, [None] * 32, 1)]
    rows += [(720, [0.0] * 32, 1), (740, [float("inf")], 1), (760, [-0.0] * 40, 9), (780, [x * 30 for x in rows[3][1]], 1)]
    return rows


# Part codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if usable(v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    size = width // parts
    kept = sorted(
        ((i, floors(v, 256, width), label, len(v)) for i, v, label in kept),
        key=lambda r: (r[0] is None, r[0] or 0, r[1][: r[3]]),
    )
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            for i, own in groups.items():
                books[p][i] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, totals = [], collections.Counter()
    for (i, _, label, _), c in zip(kept, cut):
        hits = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(h[0] for h in hits)
        totals[label] += error
        out.append((i, "".join(f"{h[1]:02x}" for h in hits), error, label))
    return collections.Counter((i, code, error, totals[label], digest) for i, code, error, label in out)


def got_codes(df):
    return collections.Counter(tuple(r) for r in partcodes.part_codes(df).collect())


def test_part_codes(spark, awkward):
    assert got_codes(frame(spark, awkward).repartition(5)) == plain_codes(awkward)


def test_few_rows_make_few_entries(spark):
    rows = [(3, [0.5, 0.25] * 8, None), (1, [0.5, 0.25] * 8, None), (2, [-0.1] * 16, 4)]
    assert got_codes(frame(spark, rows)) == plain_codes(rows)


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_label_errors_of_hot_and_other_labels(spark, awkward, monkeypatch, share):
    monkeypatch.setattr(partcodes, "HOT", share)
    assert got_codes(frame(spark, awkward)) == plain_codes(awkward)


def test_part_codes_of_nothing(spark, awkward):
    df = frame(spark, awkward)
    want = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for none in (df.limit(0), df.where("vec_id IN (703, 704)")):
        out = partcodes.part_codes(none)
        assert out.columns == want and out.collect() == []
    assert [tuple(r)[:4] for r in partcodes.part_codes(df.where("vec_id = 700")).collect()] == [(700, "00" * 16, 0, 0)]


def test_huge_components_end_the_job(spark):
    with pytest.raises(Exception, match="beyond"):
        partcodes.part_codes(frame(spark, [(1, [1e30], 0)])).collect()


def test_bounds_prune_but_lose_nothing():
    rng = np.random.default_rng(3)
    values, entries = rng.integers(-90, 90, (2000, 4)), rng.integers(-90, 90, (64, 4))
    entries[40] = entries[7]
    values[:64] = entries
    pivots = partcodes.chosen_pivots(entries, 4)
    far = np.sqrt(partcodes.squared(values, pivots)).astype(np.float32).astype(np.float64)
    choice, best = partcodes.assign(values, far, entries, pivots)
    every = partcodes.squared(values, entries)
    assert (choice == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


# Greatest products


def plain_products(rows, every=20, k=20):
    kept = {(i, tuple(floors(v, 64, 40))) for i, v, _ in rows if i is not None and usable(v)}
    out = set()
    for i, v in kept:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if (j, w) != (i, v))[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)}
    return out


def got_products(df, **more):
    rows = topk.greatest_products(df, **more).collect()
    out = {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def test_greatest_products(spark, awkward):
    assert got_products(frame(spark, awkward).repartition(7)) == plain_products(awkward)


def test_greatest_products_in_small_blocks(spark, awkward, monkeypatch):
    for name, value in (("BLOCK", 5), ("QUERIES", 2), ("ROWS", 16), ("HEAD", 3)):
        monkeypatch.setattr(topk, name, value)
    assert got_products(frame(spark, awkward), k=3) == plain_products(awkward, k=3)


def test_ties_and_few_rows(spark):
    rows = [(i, [0.5, 0.5], 0) for i in range(60, -3, -1)] + [(40, [0.5, 0.5], 0)] * 30
    assert got_products(frame(spark, rows)) == plain_products(rows)
    few = rows[-4:-2] + [(1, [1.0], 0), (2, [-1.0], 0)]
    assert got_products(frame(spark, few)) == plain_products(few) and len(plain_products(few)) == 2


def test_greatest_products_of_nothing(spark, awkward):
    df = frame(spark, awkward)
    out = topk.greatest_products(df.limit(0))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.collect() == []
    assert got_products(df.where("vec_id = 700")) == set()


def test_short_vectors_are_passed_over():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-50, 50, (4000, 32)) // (1 + np.arange(4000)[:, None] // 40)
    vectors = vectors[np.argsort(-(vectors**2).sum(axis=1), kind="stable")]
    turn = topk.turn_of((vectors.T @ vectors).astype(float))
    queries, rows = topk.Turned(vectors[::200], turn), topk.Turned(vectors, turn)
    best = topk.Best(np.full(20, np.iinfo(np.int64).min), 5)
    ids = np.arange(4000)
    best.read(queries, rows.part(slice(0, 1000)), ids[:1000], ids[:1000])
    bars = best.bars
    multiplied = sum(
        len(topk.survivors(queries, rows.part(slice(b, b + 500)), bars)[0]) for b in range(1000, 4000, 500)
    )
    assert multiplied < 0.05 * 20 * 3000
    for b in range(1000, 4000, 500):
        best.read(queries, rows.part(slice(b, b + 500)), ids[b : b + 500], ids[b : b + 500])
    exact = queries.vectors @ vectors.T
    for q, (_, found, scores) in enumerate(best.found):
        assert found.tolist() == np.lexsort((ids, -exact[q]))[:5].tolist() and (scores == exact[q][found]).all()
