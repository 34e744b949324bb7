"""Schedules, backlog, history and rewrites: literal cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.functions.text import sha256
from linkloom.operators import backlog, history, rewrites, schedule
from linkloom.schemas import duplicate_keys
from linkloom.sources import sinks
from linkloom.sources import state


def at(text):
    return F.lit(text).cast("timestamp")


def matches(cron, t):
    """A plain reading of a cron expression, for comparison."""

    def field(text, value, low, high):
        for item in text.split(","):
            span, _, step = item.partition("/")
            first, last = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]))
            if "-" not in span and span != "*" and step:
                last = high
            if first <= value <= last and (value - first) % int(step or 1) == 0:
                return True
        return False

    m, h, d, mo, w = cron.split()
    weekday = (t.weekday() + 1) % 7
    return (
        field(m, t.minute, 0, 59) and field(h, t.hour, 0, 23) and field(d, t.day, 1, 31) and field(mo, t.month, 1, 12)
        and (field(w, weekday, 0, 7) or (weekday == 0 and field(w, 7, 0, 7)))
    )


CRONS = ["15 */6 * * *", "30 3 * * *", "0 4 * * 1", "45 5 12 * *", "*/20 1-3 * * 0", "5,50 22 28-31 2,12 *", "0 0 * * 7", "10/25 5 * * 3-5"]


def test_fire_times_against_brute_force(spark):
    start, end = datetime(2024, 1, 30, 5, 10), datetime(2024, 3, 2, 4)
    rows = [(i, c, True) for i, c in enumerate(CRONS)] + [(99, "* * * * *", False)]
    df = spark.createDataFrame(rows, "site_id int, cron_expression string, is_active boolean")
    got = {(r.site_id, r.fire_at) for r in schedule.fire_times(df, at(str(start)), at(str(end))).collect()}
    minutes = [start + timedelta(minutes=i) for i in range(int((end - start).total_seconds() // 60))]
    assert got == {(i, t) for i, c in enumerate(CRONS) for t in minutes if matches(c, t)}


def test_next_run(spark):
    now = datetime(2024, 3, 1, 22, 50)
    rows = [(i, c, True) for i, c in enumerate(CRONS)] + [(50, "0 0 29 2 *", True), (51, "0 0 30 2 *", True), (52, "50 22 * * *", True), (53, "0 0 * * *", False)]
    df = spark.createDataFrame(rows, "site_id int, cron_expression string, is_active boolean")
    got = {r.site_id: r.next_run_at for r in schedule.next_run(df, at(str(now))).collect()}
    for i, cron in enumerate(CRONS):
        t = now
        while not matches(cron, t):
            t += timedelta(minutes=1)
        assert got[i] == t, cron
    assert got[50] == datetime(2028, 2, 29) and got[51] is None and got[52] == now and got[53] is None


def test_idempotency_key(spark):
    df = spark.createDataFrame([(7, "2024-01-02 03:04:59.9")], "s int, t string")
    key = df.select(schedule.idempotency_key(F.col("s"), F.col("t").cast("timestamp"))).first()[0]
    assert key == "site:7:cron:2024-01-02T03:04:00+00:00"


def test_upsert(spark):
    have = spark.createDataFrame(
        [(11, 1, "0 0 * * *", True, datetime(2024, 1, 1), datetime(2024, 1, 1)), (12, 2, "0 1 * * *", True, datetime(2024, 1, 2), datetime(2024, 1, 1))],
        "id bigint, site_id int, cron_expression string, is_active boolean, next_run_at timestamp_ntz, created_at timestamp_ntz",
    ).withColumn("updated_at", F.col("created_at"))
    asked = spark.createDataFrame(
        [(1, 2, "0 2 * * *", False), (2, 3, "0 5 * * *", True), (3, 3, "0 3 * * *", True)],
        "request_id int, site_id int, cron_expression string, is_active boolean",
    )
    rows = rewrites.schedule_upsert(have, asked, at("2024-05-05 12:00:00")).collect()
    assert len(rows) == 3 and [r.id for r in sorted(rows, key=lambda r: r.site_id)][:2] == [11, 12]
    assert all(r.id is not None and r.created_at is not None and r.updated_at is not None for r in rows)
    got = {r.site_id: (r.cron_expression, r.is_active, r.next_run_at) for r in rows}
    assert got[1] == ("0 0 * * *", True, datetime(2024, 1, 1))
    assert got[2] == ("0 2 * * *", False, None)
    assert got[3] == ("0 3 * * *", True, datetime(2024, 5, 6, 3))


def test_retry(spark):
    rows = [(1, 10, 0, 5, "e"), (2, 20, 1, 5, ""), (3, 30, 4, 5, "x" * 3000), (4, 40, 5, 5, "dead")]
    df = spark.createDataFrame(rows, "id int, crawl_job_id int, attempt_count int, max_attempts int, error string")
    now = at("2024-01-01 00:00:00")
    got = {r.id: r for r in backlog.retry_plan(df, now, F.lit(0.0)).collect()}
    assert [got[i].retry_in_seconds for i in (1, 2, 3, 4)] == [15, 15, 120, None]
    assert got[2].last_error == "Unknown worker failure" and len(got[3].last_error) == 3000
    assert got[3].job_error == "Retrying (attempt 4/5): " + "x" * 3000
    assert (got[4].status, got[4].job_status) == ("dead_letter", None)
    spread = [r.retry_in_seconds for r in backlog.retry_plan(df, now).collect() if r.id == 3]
    assert 120 <= spread[0] < 144


def test_ready_and_expired(spark):
    t = [datetime(2024, 1, 1, h) for h in range(24)]
    rows = [
        (1, "queued", 100, t[1], None, None, None, t[1]), (2, "failed", 0, t[2], t[3], None, None, t[1]), (3, "queued", 0, t[9], None, None, None, t[1]),
        (4, "queued", 0, t[2], t[9], None, None, t[1]), (5, "running", 0, t[2], t[3], "w", "", t[1]), (6, "running", 0, t[2], None, "w", None, t[1]),
        (7, "running", 0, t[2], t[3], "w", "boom", t[1]), (8, "queued", 100, t[1], None, None, None, t[0]),
    ]
    df = spark.createDataFrame(
        rows, "id int, status string, priority int, available_at timestamp, leased_until timestamp, lease_owner string, last_error string, created_at timestamp"
    )
    now = at("2024-01-01 05:00:00")
    assert [r.id for r in backlog.ready_tasks(df, now).collect()] == [2, 8, 1]
    assert [r.id for r in backlog.ready_tasks(df, now, 2).collect()] == [2, 8]
    got = {r.id: r for r in backlog.expired_leases(df, now).collect()}
    assert (got[5].status, got[5].last_error, got[5].lease_owner) == ("failed", "Lease expired before worker heartbeat", None)
    assert got[7].last_error == "boom" and got[6].status == "running" and got[4].leased_until == t[9]


def test_requests(spark):
    rows = [(1, "https://a.example/x//", None, None), (2, "https://a.example/x", 5, 500), (3, "https://a.example/x", 6, 100), (4, "http://b", 1, 49), (5, "https://", 1, 50), (6, None, 1, 50)]
    df = spark.createDataFrame(rows, "request_id int, url string, max_depth int, max_pages int")
    ok, bad = rewrites.validate_requests(df)
    assert {(r.request_id, r.max_depth, r.max_pages) for r in ok.collect()} == {(1, 3, 200), (2, 5, 500)}
    assert {(r.request_id, r.rejection) for r in bad.collect()} == {(3, "max_depth"), (4, "max_pages"), (5, "url"), (6, "url")}
    sites = spark.createDataFrame([(77, "https://known")], "id bigint, url string")
    asked = ok.unionByName(spark.createDataFrame([(9, "https://known/", 1, 50)], df.schema))
    new_sites, jobs = rewrites.register_sites(asked, sites, at("2024-01-01 00:00:00"))
    found = new_sites.collect()
    assert [(r.url, r.domain) for r in found] == [("https://a.example/x", "a.example")]
    assert sorted(r.site_id for r in jobs.collect()) == sorted([77, found[0].id, found[0].id])
    assert duplicate_keys(jobs, ["id"]).count() == 0 and duplicate_keys(jobs, ["site_id"]).count() == 1


def test_tasks_are_compared_by_key_not_pair_by_pair(spark):
    """A table whose keys are all one constant stands against requests as one row."""
    asked = spark.createDataFrame([(i, 3, 200) for i in range(8)] + [(None, 3, 200)], "request_id long, max_depth int, max_pages int")
    now = at("2024-01-01 00:00:00")
    sites = spark.createDataFrame([(1, "https://a.example"), (2, "https://a.example")], "id long, url string")
    jobs = rewrites.register_sites(asked.withColumn("url", F.lit("https://a.example/")), sites, now)[1]
    no_key = jobs.select(F.lit("").alias("idempotency_key"))
    first = rewrites.enqueue_tasks(asked.filter("request_id < 3"), jobs, no_key, now)
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("LeftAnti") :]
    # Two sites share the address, so a request has two jobs, with one key.
    assert first.count() == 6 and first.select("id", "idempotency_key").distinct().count() == 3
    new = rewrites.enqueue_tasks(asked, jobs, first, now)
    assert {(r.site_id, r.payload.max_pages) for r in new.collect()} == {(1, 200), (2, 200)}
    assert new.count() == 10 and new.join(first, "idempotency_key", "left_semi").count() == 0


def test_edits_touch_the_newest_file_only(spark):
    files = spark.createDataFrame(
        [(1, 1, "a", "h", False, datetime(2024, 1, 1)), (2, 1, "b", "h", False, datetime(2024, 1, 1)), (3, 2, "c", "h", False, datetime(2024, 1, 1))],
        "id int, site_id int, content string, content_hash string, is_edited boolean, created_at timestamp",
    )
    edits = spark.createDataFrame([(1, "new"), (9, "none")], "site_id int, content string")
    got = {r.id: (r.content, r.is_edited) for r in rewrites.edit_overlay(files, edits).collect()}
    assert got == {1: ("a", False), 2: ("new", True), 3: ("c", False)}
    hashes = rewrites.edit_overlay(files, edits).filter(F.col("content_hash") == sha256(F.col("content")))
    assert [r.id for r in hashes.collect()] == [2]


def test_cascade(spark):
    tables = {
        "sites": spark.createDataFrame([(1,), (2,)], "id int"),
        "crawl_jobs": spark.createDataFrame([(10, 1), (20, 2), (21, 2)], "id int, site_id int"),
        "crawl_tasks": spark.createDataFrame([(5, 2, 20), (6, 2, 21), (7, 1, 10)], "id int, site_id int, crawl_job_id int"),
        "generated_files": spark.createDataFrame([(8, 2, 20), (9, 2, None), (11, 1, 10)], "id int, site_id int, crawl_job_id int"),
        "pages": spark.createDataFrame([(1, 1), (2, 2)], "id int, site_id int"),
    }
    gone = spark.createDataFrame([(1,)], "id int")
    left = rewrites.cascade_delete(tables, gone, spark.createDataFrame([(20,)], "id int"))
    ids = {n: sorted(r.id for r in df.collect()) for n, df in left.items()}
    assert ids == {"sites": [2], "crawl_jobs": [21], "crawl_tasks": [6], "generated_files": [8, 9], "pages": [2]}
    assert {r.id: r.crawl_job_id for r in left["generated_files"].collect()} == {8: None, 9: None}


def test_percent(spark):
    rows = [(1, 200), (0, 0), (5, 8), (201, 200), (1, 8)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert [r[0] for r in df.select(history.percent(F.col("a"), F.col("b"))).collect()] == [1, 0, 63, 100, 13]


def test_lookup_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = history.lookup(df, o_orderkey=3, o_custkey=5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,3)" in plan and "EqualTo(o_custkey,5)" in plan


def test_newest_per_group_is_cut_before_the_shuffle(spark, sf):
    from checks import views

    plan = history.recent_jobs(views.jobs(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_overview_leaves_texts_alone(spark, sf):
    from checks import views

    plan = history.site_overview(
        views.sites(spark, sf), views.jobs(spark, sf), views.files(spark, sf), views.schedules(spark, sf)
    )._jdf.queryExecution().executedPlan().toString()
    assert "text:" not in plan


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_state_versions(spark, sf, folder):
    from checks import views

    first = views.sites(spark, sf)
    state.write_state(first, "sites", f"{folder}/v=1", check=True)
    old = state.read_state(spark, "sites", f"{folder}/v=1")
    state.write_state(old.withColumn("title", F.lit("new")), "sites", f"{folder}/v=2")
    assert state.read_state(spark, "sites", f"{folder}/v=2").select("title").distinct().collect()[0].title == "new"
    assert old.filter("title = 'new'").count() == 0  # readers of a version keep it
    one = state.read_site(spark, "sites", f"{folder}/v=1", 5)
    assert [r.id for r in one.collect()] == [5]
    assert "EqualTo(id,5)" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="already exists"):
        state.write_state(first, "sites", f"{folder}/v=1")
    with pytest.raises(ValueError, match="keys of sites repeat"):
        state.write_state(first.union(first), "sites", f"{folder}/v=3", check=True)


def test_export(spark, folder):
    rows = [(1, 1, datetime(2024, 1, 1), "old"), (2, 1, datetime(2024, 1, 2), "# a\n\n> b\n"), (3, 2, datetime(2024, 1, 1), "x")]
    sinks.export_index(spark.createDataFrame(rows, "id int, site_id int, created_at timestamp, content string"), folder + "/out")
    read = spark.read.text(folder + "/out", wholetext=True).collect()
    assert {r.site_id: r.value for r in read} == {1: "# a\n\n> b\n", 2: "x\n"}


def test_next_run_has_no_horizon(spark):
    rows = [(1, "0 0 29 2 1"), (2, "0 0 29 2 *"), (3, "0 0 30 2 *"), (4, "0 0 31 12 *")]
    df = spark.createDataFrame(rows, "site_id int, cron_expression string").withColumn("is_active", F.lit(True))
    got = {r.site_id: r.next_run_at for r in schedule.next_run(df, at("2024-03-01 00:00:00")).collect()}
    assert got == {1: datetime(2044, 2, 29), 2: datetime(2028, 2, 29), 3: None, 4: datetime(2024, 12, 31)}
    late = {r.site_id: r.next_run_at for r in schedule.next_run(df, at("2096-03-01 00:00:00")).collect()}
    assert late[2] == datetime(2104, 2, 29)


def test_next_run_of_many_schedules(spark):
    """Every day of some months as the present, against the plain reading."""
    crons = ["0 12 31 * *", "30 23 29-31 1-3 *", "0 0 * 2 0", "59 23 28 2 *", "0 6 1 1 1", "5 5 5,15 */5 2-4", "0 0 31 2 *", "x * * * *"]
    moments = [datetime(2023, 12, 29) + timedelta(hours=31 * i, seconds=i % 2) for i in range(50)]
    rows = [(100 * i + j, c, m) for i, c in enumerate(crons) for j, m in enumerate(moments)]
    df = spark.createDataFrame(rows, "site_id int, c string, n timestamp_ntz")
    got = {r.site_id: r.t for r in df.select("site_id", schedule.next_fire("c", "n").alias("t")).collect()}
    for n, cron, moment in rows:
        t = moment if moment.second == 0 else moment.replace(second=0) + timedelta(minutes=1)
        if cron in crons[-2:]:
            assert got[n] is None
            continue
        h, m = (int(x) for x in cron.split()[1::-1])
        day = t.replace(hour=h, minute=m)
        day = day if day >= t else day + timedelta(days=1)
        while not matches(cron, day):
            day += timedelta(days=1)
        assert got[n] == day, (cron, moment)


def scanned_rows(df):
    """Rows that the scan of a plan gave, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_lookups_open_only_row_groups_that_may_hold_the_key(spark, folder):
    jobs = spark.range(20_000).select(
        (F.col("id") * 7919 % 1_000_003).alias("id"), (F.col("id") % 5).alias("site_id"), (F.col("id") * 104_729 % 1_000_003).alias("crawl_job_id"),
        F.lit("text").alias("content"), F.lit("h").alias("content_hash"), F.lit(False).alias("is_edited"), at("2024-01-01").alias("created_at"), at("2024-01-01").alias("updated_at"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        state.write_state(jobs, "generated_files", f"{folder}/files")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = state.read_state(spark, "generated_files", f"{folder}/files")
    some = jobs.limit(1).first()
    assert history.lookup(files, crawl_job_id=some.crawl_job_id).count() == 1
    absent = next(k for k in range(500_000, 600_000) if files.filter(F.col("crawl_job_id") == k).count() == 0)
    # The value lies between least and greatest of every row group; only the filters exclude it.
    assert scanned_rows(history.lookup(files, crawl_job_id=absent)) == 0
    assert 0 < scanned_rows(history.lookup(files, crawl_job_id=some.crawl_job_id)) < 20_000


def test_intermediate_tables_are_removed(spark, folder):
    import os

    from linkloom import session

    old, session._handed_out[:] = list(session._handed_out), []
    try:
        held = session.cut_lineage(spark.range(3), "held")
        path = session._handed_out[0]
        assert held.count() == 3 and os.path.isdir(path)
        session.clean_up(spark)
        assert not os.path.isdir(path) and not session._handed_out
    finally:
        session._handed_out[:] = old
