"""The pipeline, stage by stage, against plain versions on the small tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import langid, mixing, tiling
from linkloom.session import cut_lineage

from .test_operators import VOCABULARY, plain_groups, prose, words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    given = docs.collect()
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["in_known_language", "without_near_copies", "without_benchmark", "mixed", "in_shards"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out[name] = docs.collect()
        assert docs.columns == (columns if name != "shards" else [*columns, "shard", "slot"])

    known = out["language_id"]
    assert {r.doc_id for r in given} - {r.doc_id for r in known} == {
        r.doc_id for r in langid.identify(spark.createDataFrame(given)).collect() if r.lang_pred == "und" or r.bits >= 8
    }
    kept = out["near_copies"]
    assert sorted(r.doc_id for r in kept) == sorted({g[2] for g in plain_groups(known)})
    leaked = {r.doc_id for r in tiling.leaks(spark.createDataFrame(kept), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    clean = out["benchmark"]
    assert sorted(r.doc_id for r in clean) == sorted({r.doc_id for r in kept} - leaked)
    want = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(clean, docs.schema.names and spark.read.parquet(f"{sf}/documents.parquet").schema)).collect()}
    have = collections.Counter()
    for r in out["mix"]:
        have[r.doc_id] += len(words(r.text))
    assert have == collections.Counter({d: n for d, n in want.items() if n})
    assert collections.Counter((r.doc_id, r.text) for r in out["shards"]) == collections.Counter((r.doc_id, r.text) for r in out["mix"])
    slots = collections.defaultdict(list)
    for r in out["shards"]:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        lang = "aa" if i % 2 else "ii"
        rows.append((i, prose(rng, rng.randint(5, 80), VOCABULARY[lang]), lang, f"s{i % 3}" if i % 7 else None, 1))
    rows += [(200 + i, rows[3][1], "aa", "s1", 1) for i in range(40)]
    rows += [(300, None, "aa", "s1", None), (301, "", None, None, 0), (302, "12 34", "ii", "s1", 5), (None, prose(rng, 30, VOCABULARY["aa"]), None, None, 1)]
    rows += [(303, prose(rng, 40_000, VOCABULARY["ii"]), "ii", "s2", 1), (5, rows[5][1], "aa", "s2", 1), (5, rows[5][1], "aa", "s2", 1)]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("shard", "SLOT", "key", "row", "x", "fp", "size", "epoch", "taken", "mark"):
        out = out.withColumn(c, F.lit(c))
    return out.cache()


def test_stages_on_awkward_rows(spark, sf, awkward):
    docs, columns = awkward, awkward.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf), name)
        assert docs.columns[: len(columns)] == columns
        assert {tuple(r) for r in docs.select("shard", "SLOT", "key").distinct().collect()} == {("shard", "SLOT", "key")}
        counts.append(docs.count())
        if name == "language_id":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in awkward.collect()} - {300, 301, 302}
        if name == "near_copies":
            texts = collections.Counter(r.text for r in docs.collect())
            assert max(texts.values()) == 1 and len([t for t in texts if len(t) > 100_000]) == 1
    new = docs.columns[len(columns) :]
    assert [c.split("_")[0] for c in new] == ["shard", "slot"] and len({c.lower() for c in docs.columns}) == len(docs.columns)
    assert counts[-1] == counts[-2] > 0
    slots = collections.defaultdict(list)
    for r in docs.select(*new).collect():
        slots[r[0]].append(r[1])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_on_no_rows(spark, sf, awkward):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward.limit(0), sf)
        assert out.columns[: len(awkward.columns)] == awkward.columns and out.collect() == [], name
