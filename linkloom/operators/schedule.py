"""Cron expressions as arrays of matching values, expanded to fire times.

Fields are numbers, lists, ranges and steps. Weekday 0 (and 7) is Sunday, times
are UTC, and all five fields must match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import let

# In 41 years every date that exists falls on every weekday it can: also 29 February,
# across a century without one.
MONTHS = 41 * 12

# Bounds of the five fields.
BOUNDS = [("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7)]


def _values(field: str, low: int, high: int) -> str:
    """``5``, ``1-4``, ``*/6``, ``10-20/5`` and comma lists of them -> array of ints."""
    read = (
        "named_struct('span', substring_index(i, '/', 1), 'stepped', contains(i, '/'),"
        " 'step', coalesce(try_cast(nullif(regexp_extract(i, r'/([0-9]+)$', 1), '') AS int), 1))"
    )
    bounds = (
        f"named_struct('low', if(x.span = '*', {low}, try_cast(substring_index(x.span, '-', 1) AS int)),"
        f" 'high', CASE WHEN x.span = '*' THEN {high} WHEN contains(x.span, '-') THEN try_cast(substring_index(x.span, '-', -1) AS int)"
        f" WHEN x.stepped THEN {high} ELSE try_cast(x.span AS int) END, 'step', x.step)"
    )
    items = f"transform(transform(split({field}, ','), i -> {read}), x -> {bounds})"
    valid = f"filter({items}, y -> y.low <= y.high AND y.step > 0)"
    return f"array_distinct(flatten(transform({valid}, z -> sequence(z.low, z.high, z.step))))"


def with_cron(cron: str, name: str, body: str) -> str:
    """``body`` with the matching values of each field at hand as ``name.minute``, ``name.hour``, ..."""
    fields = ", ".join(f"'{f}', {_values(f'get(f, {i})', low, high)}" for i, (f, low, high) in enumerate(BOUNDS))
    return let("f", rf"split(trim({cron}), r'\s+')", let(name, f"named_struct({fields})", body))


def _minutes(c: str) -> str:
    """Minutes of the day at which a schedule fires."""
    return f"flatten(transform({c}.hour, h -> transform({c}.minute, m -> h * 60 + m)))"


def _days(c: str, start: str, days: str) -> str:
    """Dates from ``start`` on, ``days`` of them looked at, on which a schedule fires."""
    window = f"transform(sequence(0, {days} - 1), n -> date_add({start}, n))"
    return (
        f"filter({window}, d -> array_contains({c}.day, day(d)) AND array_contains({c}.month, month(d))"
        f" AND (array_contains({c}.weekday, dayofweek(d) - 1) OR (dayofweek(d) = 1 AND array_contains({c}.weekday, 7))))"
    )


def _at(day: str, minute: str) -> str:
    return f"make_timestamp_ntz(year({day}), month({day}), day({day}), cast({minute} DIV 60 AS int), {minute} % 60, 0)"


def _masks(c: str, body: str) -> str:
    """``body`` with ``k``: days and months of a schedule as set bits, and its weekdays over six weeks."""

    def bits(values: str) -> str:
        return f"aggregate({values}, 0L, (a, v) -> a | shiftleft(1L, v))"

    week = let("w", f"transform({c}.weekday, v -> v % 7)", bits("w"))
    weeks = let("w", week, "aggregate(sequence(0, 5), 0L, (a, i) -> a | shiftleft(w, 7 * i))")
    return let("k", f"named_struct('days', {bits(c + '.day')}, 'months', {bits(c + '.month')}, 'weeks', {weeks})", body)


def _first_date(start: str, months: int) -> str:
    """First date from ``start`` on at which the schedule ``k`` fires, or NULL within so many months.

    The days of a month that fire are bits of one number: those of the schedule, those of its
    weekdays from the month's first one on, and those the month has. The lowest set bit is the date.
    """
    days = "k.days & shiftleft(shiftright(k.weeks, dayofweek(b) - 1), 1) & (shiftleft(1L, day(last_day(b)) + 1) - 2)"
    left = f"({days} & if(i = 0, -shiftleft(1L, day({start})), -1L))"
    date = let("m", left, "if(m = 0, NULL, date_add(b, bit_count((m & -m) - 1) - 1))")
    month = let("b", f"cast(add_months(trunc({start}, 'MM'), i) AS date)", f"if(k.months & shiftleft(1L, month(b)) = 0, NULL, {date})")
    return f"aggregate(sequence(0, {months}), cast(NULL AS date), (found, i) -> if(found IS NOT NULL, found, {month}))"


def next_fire(cron: str, now: str) -> Column:
    """First fire time at or after ``now``, row by row, without a join. Arguments are SQL text.

    A year is looked at month by month; only schedules that skip years, as those of
    29 February, are followed further.
    """
    moment = f"cast({now} AS timestamp_ntz)"
    today = f"to_date({moment})"
    later = f"filter(o, v -> {_at(today, 'v')} >= {moment})"
    # Today counts only if one of its times is still to come.
    start = f"if(size({later}) > 0, {today}, date_add({today}, 1))"
    date = f"coalesce({_first_date('s', 12)}, {_first_date('s', MONTHS)})"
    minute = f"if(d = {today}, array_min({later}), array_min(o))"
    found = let("d", date, let("v", minute, f"if(d IS NULL OR v IS NULL, NULL, {_at('d', 'v')})"))
    return F.expr(with_cron(cron, "c", let("o", _minutes("c"), let("s", start, _masks("c", found)))))


def next_run(schedules: DataFrame, now: Column) -> DataFrame:
    """(site_id, next_run_at); inactive schedules have none."""
    upcoming = F.when(F.col("is_active"), next_fire("cron_expression", "_now"))
    return schedules.withColumn("_now", now).select("site_id", upcoming.alias("next_run_at"))


def fire_times(schedules: DataFrame, start: Column, end: Column) -> DataFrame:
    """(site_id, fire_at) of the active schedules in [start, end)."""
    span = "datediff(to_date(_end), to_date(_start)) + 1"
    fired = f"named_struct('minutes', {_minutes('c')}, 'days', {_days('c', 'to_date(_start)', f'({span})')})"
    matched = (
        schedules.filter("is_active")
        .withColumns({"_start": start.cast("timestamp_ntz"), "_end": end.cast("timestamp_ntz")})
        .select("site_id", "_start", "_end", F.expr(with_cron("cron_expression", "c", fired)).alias("_f"))
    )
    days = matched.select("site_id", "_start", "_end", "_f.minutes", F.explode("_f.days").alias("_day"))
    times = days.select("site_id", "_start", "_end", "_day", F.explode("minutes").alias("_minute"))
    at = times.select("site_id", "_start", "_end", F.expr(_at("_day", "_minute")).alias("fire_at"))
    return at.filter("fire_at >= _start AND fire_at < _end").select("site_id", "fire_at")


def idempotency_key(site_id: Column, ts: Column) -> Column:
    """``site:<id>:cron:<minute>``: one scheduled crawl per site and minute."""
    minute = F.date_format(F.date_trunc("minute", ts), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.lit("site:"), site_id.cast("string"), F.lit(":cron:"), minute, F.lit("+00:00"))


def accept_triggers(triggers: DataFrame) -> DataFrame:
    """First trigger (site_id, ts, trigger_id) of each site and minute."""
    keyed = triggers.withColumn("idempotency_key", idempotency_key(F.col("site_id"), F.col("ts")))
    return keyed.groupBy("idempotency_key").agg(
        F.min("site_id").alias("site_id"),
        F.min_by("trigger_id", F.struct("ts", "trigger_id")).alias("trigger_id"),
    )
