"""Slice-wise work must equal plain work, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import feed, fetchlog, listing, render
from linkloom.plans.ordering import ranked


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one key."""
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(50)}", rng.randrange(1000), i) for i in range(6000)]
    return spark.createDataFrame(rows, "k string, v int, id int")


def test_ranked_in_slices(skewed):
    order = [F.desc("v"), F.asc("id")]
    plain = skewed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    sliced = ranked(skewed, ["k"], order, "r")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sliced.select(plain.columns).collect()))


def brute_fetch(rows):
    """Streak and breaker openings of one host, attempt by attempt."""
    requests = timeouts = streak = 0
    success = None
    start = rows[0][1] if rows else None
    for event_id, ts, timeout, ok in rows:
        requests += 1
        streak = streak + 1 if timeout else 0
        timeouts += timeout
        if ok:
            success = ts
        stalled = ts - (start if success is None else success)
        by_streak = requests >= 12 and streak >= 8
        by_rate = requests >= 12 and timeouts / requests >= 0.7 and stalled >= 30
        yield event_id, streak, ("streak" if by_streak else "rate+stall") if timeout and (by_streak or by_rate) else None


def test_fetch_log_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fetchlog, "SLICE_SECONDS", 60)
    rng = random.Random(2)
    log, event_id = {}, 0
    for host, n, share in [("hot", 900, 0.6), ("bad", 200, 0.95), ("good", 200, 0.05), ("one", 1, 1.0)]:
        t = 0
        for _ in range(n):
            t += rng.choice([0, 1, 1, 5, 90])
            timeout = rng.random() < share
            log.setdefault(host, []).append((event_id, t, timeout, not timeout and rng.random() < 0.8))
            event_id += 1
    rows = [(h, e, t, to, ok) for h, es in log.items() for e, t, to, ok in es]
    df = spark.createDataFrame(rows, "host string, event_id int, t int, timeout boolean, accepted boolean")
    df = df.withColumn("ts", F.timestamp_seconds("t")).withColumn("error", F.lit(None).cast("string"))
    df = df.withColumn("job_id", F.lit(1))
    want = {e: (s, o) for h in log for e, s, o in brute_fetch(log[h])}
    streaks = {r.event_id: r.streak for r in fetchlog.timeout_streak(df).collect()}
    assert streaks == {e: s for e, (s, _) in want.items()}
    events = fetchlog.circuit_events(df).collect()
    assert {r.event_id: r.trigger for r in events} == {e: o for e, (_, o) in want.items() if o}
    for host in log:
        opened = [e for e, *_ in log[host] if want[e][1]]
        assert [r.event_id for r in events if r.host == host and r.aborts] == opened[:1]


def test_progress_changes_across_slices(spark):
    rows = [(1, i, i * 7, i // 10) for i in range(200)] + [(2, 1000 + i, i * 400, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "job_id int, event_id int, t int, pages_found int")
    blank = {c: F.lit(None).cast("int") for c in feed.PROGRESS if c != "pages_found"}
    df = df.withColumns({**blank, "status": F.lit("running"), "ts": F.timestamp_seconds("t")})
    got = feed.progress_changes(df, slice_seconds=30).collect()
    assert sorted(r.event_id for r in got) == [*range(0, 200, 10), 1000]


def pages_of(spark, n):
    rows = [(1, f"https://h/p{i:05d}", f"T{i}", "d" if i % 2 else None, i % 4, "Blog" if i % 3 else "FAQ") for i in range(n)]
    df = spark.createDataFrame(rows, "site_id bigint, url string, title string, description string, depth int, category string")
    return df.withColumn("relevance_score", F.lit(0.9) - F.col("depth") * 0.25)


def test_index_is_one_row(spark):
    sites = spark.createDataFrame(
        [(1, "S", "h", "about"), (2, None, "e.example", None)], "id bigint, title string, domain string, description string"
    )
    pages = pages_of(spark, 300)
    rows = render.render_index(sites, pages).collect()
    whole = {r.site_id: r.content for r in rows}
    assert len(rows) == 2 and whole[2] == "# e.example\n"
    links = [line for line in whole[1].splitlines() if line.startswith("- ")]
    assert len(links) == 300
    faq = [line for line in whole[1].split("## FAQ")[1].split("##")[0].splitlines() if line]
    ranks = [int(line[3:].split("]")[0][1:]) % 4 for line in faq]
    assert ranks == sorted(ranks)


def test_page_ids_in_slices(spark):
    pages = pages_of(spark, 300)
    ids = {r.url: r.list_id for r in listing.assign_page_ids(pages).collect()}
    order = sorted((r.depth, r.url) for r in pages.collect())
    assert ids == {url: i for i, (_, url) in enumerate(order, 1)}
