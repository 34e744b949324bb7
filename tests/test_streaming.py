"""Streams over several micro-batches give what the batch jobs give."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import views as V
from linkloom.operators import feed, fetchlog, snapshot
from linkloom.operators.extract import extract_pages
from linkloom.schemas import table_schema
from linkloom.sources.state import read_state, write_state
from linkloom.streaming import feeds, runner


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """The event log in four files, in order of time, read one per micro-batch."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    bounds = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0)
    for i, (low, high) in enumerate(zip([-1, *bounds], [*bounds, 1e18])):
        part = events.filter((F.col("event_id") > low) & (F.col("event_id") <= high))
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def folded(spark, stream, out, step):
    return runner.finished(spark, runner.folded(stream, out, step), out)


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_progress(spark, sf, files, tmp_path):
    got = folded(spark, V.progress_rows(files), f"{tmp_path}/out", feeds.progress_step)
    assert got.select("batch").distinct().count() == 4
    batch = feed.progress_changes(V.progress_rows(V.table(spark, sf, "events")))
    assert rows_of(got.drop("batch")) == rows_of(batch)


def test_ends_of_the_feed(spark, sf, tmp_path):
    got = folded(spark, V.progress_stream(spark, sf), f"{tmp_path}/out", feeds.progress_step).drop("batch")
    kinds = {(r.type, r.error): r.n for r in feeds.feed_events(got).groupBy("type", "error").agg(F.count("*").alias("n")).collect()}
    jobs = {r.user_id for r in V.table(spark, sf, "events").select("user_id").distinct().collect()}
    assert kinds.pop(("progress", None)) == got.count()
    assert kinds.pop(("completed", None)) == sum(j % 2 == 0 for j in jobs)
    assert kinds == {("failed", f"lost {j}"): 1 for j in jobs if j % 2}


def test_repeated_batch_writes_once(spark, files, tmp_path):
    rows, out = V.progress_rows(files), f"{tmp_path}/out"
    before = folded(spark, rows, out, feeds.progress_step).count()
    assert folded(spark, rows, out, feeds.progress_step).count() == before  # nothing new


def stream_of(spark, folder, batches, schema):
    """Each list of rows is a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


POLL = "job_id long, event_id long, ts timestamp, status string, error_message string, " + ", ".join(f"{c} int" for c in feed.PROGRESS)


def poll(job, n, status="running", found=0):
    return (job, n, datetime(2024, 1, 1) + timedelta(seconds=n), status, None, found, *[0] * (len(feed.PROGRESS) - 1))


def test_progress_of_a_job_with_a_third_of_all_rows(spark, tmp_path):
    """Its rows are compared in time slices; what is known is one row a running job, gone with the job's end."""
    hot = [poll(0, n * 60, found=n // 7) for n in range(4000)]
    rest = [poll(1 + n % 50, n * 60, found=n // 400) for n in range(8000)]
    done = [poll(0, 4000 * 60, "completed", 9), *[poll(j, 8001 * 60 + j, "failed") for j in range(1, 26)]]
    out = f"{tmp_path}/out"
    stream = stream_of(spark, f"{tmp_path}/in", [hot[:2000] + rest[:4000], hot[2000:] + rest[4000:], done, [poll(0, 9000 * 60)]], POLL)
    got = folded(spark, stream, out, feeds.progress_step).drop("batch")
    batch = feed.progress_changes(spark.createDataFrame(hot + rest + done, POLL))
    assert rows_of(got.filter("event_id < 540000")) == rows_of(batch)
    # A job that was forgotten starts anew.
    assert [r.event_id for r in got.filter("event_id = 540000").collect()] == [540000]
    assert spark.read.parquet(runner.known_path(out, 3)).count() == 26
    plan = feeds.progress_step(spark.createDataFrame(hot, POLL), spark.read.parquet(runner.known_path(out, 3)))[0]
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_fetch_health(spark, sf, files, tmp_path):
    stream = feeds.fetch_health_feed(V.fetch_rows(files))
    got = feeds.newest_per_key(runner.drained(stream, f"{tmp_path}/out", "update"), ["host", "job_id"])
    assert rows_of(got) == rows_of(fetchlog.fetch_counts(V.fetch_log(spark, sf)))


def test_page_feed_once(spark, sf, files, tmp_path):
    arrivals = files.select((F.col("user_id") % 7).alias("job_id"), F.col("props").alias("url"), "ts")
    got = runner.drained(feeds.page_feed(arrivals), f"{tmp_path}/out").select("job_id", "url")
    want = V.table(spark, sf, "events").select((F.col("user_id") % 7).alias("job_id"), F.col("props").alias("url")).distinct()
    assert rows_of(got) == rows_of(want)


def test_pages_are_forgotten_in_time_and_never_lost(spark, tmp_path):
    """State ends some time after a page came, however old its own time is."""
    schema = "job_id long, url string, ts timestamp"
    old = [(1, f"u{i}", datetime(2000, 1, 1)) for i in range(50)]
    new = [(2, f"u{i}", datetime(2030, 1, 1)) for i in range(5)]
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    stream = stream_of(spark, folder, [new, old + old, old[:3]], schema)
    kept = feeds.page_feed(stream, remembered="4 seconds")
    query = runner.start(kept, out)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 55
    assert spark.read.parquet(out).count() == 55
    for rows in ([(3, "a", datetime(2024, 1, 1))], [(3, "b", datetime(2024, 1, 1))]):
        time.sleep(5)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        query = runner.start(kept, out)
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    assert spark.read.parquet(out).count() == 57


def test_heartbeats_are_silences(spark, sf, files, tmp_path):
    got = folded(spark, V.feed_rows(files), f"{tmp_path}/out", feeds.heartbeat_step()).drop("batch")
    gaps = feed.heartbeat_gaps(V.feed_rows(V.table(spark, sf, "events")))
    assert rows_of(got) == rows_of(gaps)


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_live_heartbeats_by_a_clock(spark, tmp_path):
    """Rows without a job tick; beats come while a feed is silent and none comes twice."""
    batches = [
        [(1, at(0), False), (1, at(3), False), (2, at(0), False)],
        [(None, at(20), None)],
        [(None, at(28), None), (None, at(34), None)],
        [(1, at(50), False), (2, at(31), True)],
        [(1, at(49), False), (None, at(64), None)],  # late: nothing changes
        [(1, at(64), False), (1, at(80), False), (None, at(200), None), (3, at(190), False)],
        [(None, at(204), None)],
    ]
    schema = "job_id long, ts timestamp, done boolean"
    out = f"{tmp_path}/out"
    step = feeds.heartbeat_step(gap=15, ended=F.col("done"))
    got = folded(spark, stream_of(spark, f"{tmp_path}/in", batches, schema), out, step)
    second = lambda t: None if t is None else (t - at(0)).total_seconds()
    assert sorted(((r.batch, r.job_id, second(r.silent_from), second(r.silent_to), r.heartbeats) for r in got.collect()), key=repr) == [
        (1, 1, 3.0, None, 1), (1, 2, 0.0, None, 1),
        (2, 1, 3.0, None, 1), (2, 2, 0.0, None, 1),
        (3, 1, 3.0, 50.0, 1),
        (5, 1, 64.0, 80.0, 1), (5, 1, 80.0, None, 8),
    ]
    # Job 2 ended, and was forgotten.
    assert {(r.job_id, second(r["last"])) for r in spark.read.parquet(runner.known_path(out, 6)).collect()} == {(1, 80.0), (3, 190.0)}


def test_running_change_counts(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = f"{tmp_path}/pages"
    middle = pages.approxQuantile("page_id", [0.5], 0)[0]
    pages.filter(F.col("page_id") <= middle).coalesce(1).write.mode("append").parquet(folder)
    pages.filter(F.col("page_id") > middle).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stored = V.stored(spark, sf)
    out = f"{tmp_path}/out"
    query = runner.logged(V.crawl_of(extract_pages(V.with_site(stream))), out, feeds.change_step(stored))
    got = snapshot.change_counts(runner.finished(spark, query, out))
    whole = snapshot.change_counts(snapshot.snapshot_diff(stored, V.crawl_of(V.facts(spark, sf))))
    want = {r.site_id: (r.added, r.updated, 0) for r in whole.collect() if r.added + r.updated + r.unchanged}
    assert {r.site_id: (r.added, r.updated, r.removed) for r in got.collect()} == want


def test_only_files_of_the_sites_of_a_batch_are_read(spark, tmp_path):
    """Counters stay right, and stored files of other sites are not opened."""
    kind = table_schema("pages")
    rows = spark.range(4000).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind if f.name not in ("id", "site_id", "url")], "id",
                                    (F.col("id") % 40).alias("site_id"), F.concat(F.lit("https://h/"), F.col("id").cast("string")).alias("url"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_state(rows, "pages", f"{tmp_path}/pages")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = read_state(spark, "pages", f"{tmp_path}/pages")
    batch = rows.filter("site_id IN (3, 4)").withColumn("not_modified", F.lit(False))
    found = feeds.change_step(stored)(batch, None)
    assert found.count() == 200
    used = feeds.of_sites(stored, batch).select(F.input_file_name()).distinct().count()
    assert used <= 3 < len(stored.inputFiles())
    plan = feeds.of_sites(stored, batch)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(site_id, [3,4])]" in plan
