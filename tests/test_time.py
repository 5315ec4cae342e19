"""Times, zones and schedules against plain versions, under two time zones of the session."""

import calendar
import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quarry.functions import time
from quarry.operators import relational as rel
from quarry.operators import schedules, zones

UTC = dt.timezone.utc


@pytest.fixture(params=["UTC", "America/New_York"], scope="module")
def session(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def far(spark):
    """A session whose zone isn't UTC."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def micros(text):
    t = dt.datetime.fromisoformat(text).replace(tzinfo=UTC)
    return int(t.timestamp()) * 1_000_000 + t.microsecond


def at(text):
    return F.timestamp_micros(F.lit(micros(text)))


def said(spark, column):
    return spark.range(1).select(time.stamp(column).alias("v")).first()["v"]


FORMS = [
    ("1700000000", "2023-11-14 22:13:20"), ("+1700000000000", "2023-11-14 22:13:20"), ("1700000000.9", "2023-11-14 22:13:20"), ("-0.5", "1969-12-31 23:59:59"), ("000000000000000001", "1970-01-01 00:00:01"), ("Tue, 12 Mar 2024 10:20:30 +0800", "2024-03-12 02:20:30"),
    ("12 Mar 24 10:20 PDT", "2024-03-12 17:20:00"), ("2024-03-12t10:20:30.5-05:30", "2024-03-12 15:50:30"), ("2024-03-12 10:20 -0800", "2024-03-12 18:20:00"), ("2024/03/12 10:20:30 +00:00", "2024-03-12 10:20:30"), ("03/12/2024 10:20:30 -0300", "2024-03-12 13:20:30"),
    ("12 mar 2024 01:02:03", "2024-03-12 01:02:03"), ("March 5, 2024", "2024-03-05 00:00:00"), ("Mar  5, 2024 11:12:13", "2024-03-05 11:12:13"), ("31.12.2024", "2024-12-31 00:00:00"), ("31-12-2024", "2024-12-31 00:00:00"), ("2024-3-9T1:2", "2024-03-09 01:02:00"), ("2024-03-10 02:30:00", "2024-03-10 02:30:00"),
    ("02/03/2024", "2024-02-03 00:00:00"), ("13/03/2024", "2024-03-13 00:00:00"), ("2023-02-29", None), ("2024-13-01", None), ("24:00", None), ("", None), ("12 Foo 2024", None), ("99999999999999999999999999999", None), ("2024-01-01 25:00", None),
]


def test_forms_of_a_time(session):
    df = session.createDataFrame([(k, t) for k, (t, _) in enumerate(FORMS)] + [(99, None)], "k int, t string")
    got = {r.k: r.v for r in df.select("k", time.parse_instant(F.col("t")).alias("i")).select("k", time.stamp(F.col("i")).alias("v")).collect()}
    assert got == {k: v for k, (_, v) in enumerate(FORMS)} | {99: None}


def test_wall_times_of_a_zone(far):
    for text, zone, expected in [("2024-03-10 02:30:00", "America/New_York", "2024-03-10 07:00:00"), ("2024-11-03 01:30:00", "America/New_York", "2024-11-03 05:30:00"), ("2024-07-01", "Asia/Shanghai", "2024-06-30 16:00:00"), ("2024-04-07 01:45:00", "Australia/Lord_Howe", "2024-04-06 14:45:00"), ("2024-10-06 02:10:00", "Australia/Lord_Howe", "2024-10-05 15:30:00")]:
        assert said(far, time.parse_instant(F.lit(text), zone=zone)) == expected


PHRASES = [("yesterday 08:30", "2024-05-14 08:30:00"), ("today +2h 09:00", "2024-05-15 11:00:00"), ("2024-01-31 +1M", "2024-02-29 00:00:00"), ("2024-01-31 10:00 +1M -1d", "2024-02-28 10:00:00"), ("quarter-start", "2024-04-01 00:00:00"), ("NOW", "2024-05-15 10:20:30"), ("tomorrow 25:00", None), ("month-start +1w+3d", "2024-05-11 00:00:00"), ("+1M", "2024-06-15 10:20:30"), ("tomorrow or so", None), ("后天", "2024-05-17 00:00:00"), ("week-start", "2024-05-13 00:00:00")]


def test_phrases(session):
    df = session.createDataFrame([(k, t) for k, (t, _) in enumerate(PHRASES)], "k int, t string")
    got = {r.k: r.v for r in df.select("k", time.relative_instant(F.col("t"), at("2024-05-15 10:20:30")).alias("i")).select("k", time.stamp(F.col("i")).alias("v")).collect()}
    assert got == {k: v for k, (_, v) in enumerate(PHRASES)}


def stepwise(low, high):
    """Years, then months, one by one."""

    def add(t, months):
        k = t.year * 12 + t.month - 1 + months
        return t.replace(year=k // 12, month=k % 12 + 1, day=min(t.day, calendar.monthrange(k // 12, k % 12 + 1)[1]))

    out = []
    for step in (12, 1):
        n = 0
        while (after := add(low, step)) <= high:
            low, n = after, n + 1
        out.append(n)
    rest = high - low
    return (*out, rest.days // 7, rest.days % 7, rest.seconds // 3600, rest.seconds // 60 % 60, rest.seconds % 60, rest.microseconds // 1000)


def test_spans_step_by_step(session):
    draw = random.Random(5)
    first = dt.datetime(1995, 12, 20)
    pairs = [(first + dt.timedelta(days=draw.randint(0, 3000), milliseconds=draw.choice([0, 0, draw.randint(0, 86_399_999)])), dt.timedelta(days=draw.choice([draw.randint(0, 70), draw.randint(0, 2500)]), milliseconds=draw.choice([0, draw.randint(0, 86_399_999)]))) for _ in range(4000)]
    pairs += [(dt.datetime(y, 2, 29), dt.timedelta(days=d)) for y in (1996, 2000, 2004) for d in range(360, 1500, 5)] + [(dt.datetime(1999, m, 31), dt.timedelta(days=d)) for m in (1, 3, 5, 7, 8, 10, 12) for d in range(25, 400, 7)]
    rows = [(k, *sorted([a, a + d])) for k, (a, d) in enumerate(pairs)]
    us = lambda t: int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    df = session.createDataFrame([(k, us(a), us(b)) for k, a, b in rows], "k int, a long, b long").select("k", F.timestamp_micros("a").alias("a"), F.timestamp_micros("b").alias("b"))
    got = {r.k: r for r in df.select("k", time.calendar_span(F.col("a"), F.col("b")).alias("s"), time.calendar_span(F.col("b"), F.col("a")).alias("t"), time.date_difference(F.col("a"), F.col("b")).alias("d")).collect()}
    for k, a, b in rows:
        want, r = stepwise(a, b), got[k]
        assert tuple(r.s)[1:] == want and tuple(r.t)[1:] == want, (a, b)
        assert (r.s.sign, r.t.sign) == ((1, -1) if b > a else (0, 0))
        assert (r.d.days, r.d.months_part, r.d.days_part) == ((b.date() - a.date()).days, want[0] * 12 + want[1], want[2] * 7 + want[3])


def test_nothing_moves(session):
    row = session.range(1).select(time.add_calendar(at("2024-03-10 06:30:00"), months=0).alias("a"), time.calendar_span(at("2024-03-10 06:30:00"), at("2024-03-10 06:30:00")).alias("s"), time.wall(at("2024-03-10 02:30:00.25")).alias("w"), time.from_wall(F.lit("2024-03-10 02:30:00.25").cast("timestamp_ntz")).alias("i"), time.calendar_span(F.lit(None).cast("timestamp"), at("2024-03-10")).alias("n")).select(F.unix_micros("a").alias("a"), "s", F.col("w").cast("string").alias("w"), F.unix_micros("i").alias("i"), "n").first()
    assert row.a == micros("2024-03-10 06:30:00") and set(row.s) == {0} and row.w == "2024-03-10 02:30:00.25" and row.i == micros("2024-03-10 02:30:00.25") and row.n is None


def test_stretches_against_the_zone_files(far):
    names = ["America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "Africa/Casablanca", "UTC"]
    df = far.createDataFrame([(z,) for z in names], "zone string")
    for r in zones.stretches(df, "2015-01-01", "2026-01-01").collect():
        off = lambda s, z=r.zone: ZoneInfo(z).utcoffset(dt.datetime.fromtimestamp(s, UTC)).total_seconds()
        for s in (r.starts, (max(r.starts, 1_420_070_400) + min(r.ends, 1_767_225_600)) // 2, r.ends - 1):
            if 1_420_070_400 <= s < 1_767_225_600:
                assert ZoneInfo(r.zone).utcoffset(dt.datetime.fromtimestamp(s, UTC).astimezone(ZoneInfo(r.zone))).total_seconds() == r.offset
        if r.starts > 0:
            assert ZoneInfo(r.zone).utcoffset(dt.datetime.fromtimestamp(r.starts - 1, UTC).astimezone(ZoneInfo(r.zone))).total_seconds() != r.offset


def test_resolved_walls(far):
    rows = [("America/New_York", "2024-03-10 02:30:15", "2024-03-10 07:00:15", "skipped"), ("America/New_York", "2024-03-10 03:00:00", "2024-03-10 07:00:00", "once"), ("America/New_York", "2024-11-03 01:59:59", "2024-11-03 05:59:59", "twice"), ("America/New_York", "2024-11-03 02:00:00", "2024-11-03 07:00:00", "once"), ("Mars/Base", "2024-01-01 00:00:00", None, None), (None, "2024-01-01 00:00:00", None, None)]
    df = far.createDataFrame([(k, z, micros(w) // 1_000_000, "x") for k, (z, w, _, _) in enumerate(rows)], "k int, zone string, wall long, state_ string")
    got = {r.k: r for r in zones.resolved(df, "zone", "wall").collect()}
    for k, (_, _, instant, state) in enumerate(rows):
        assert got[k].state == state and got[k].instant == (instant and micros(instant) // 1_000_000)


def test_board(far):
    df = far.createDataFrame([(1, ["Mars/Base", " Asia/Shanghai ", "", "America/New_York", "Asia/Kathmandu"]), (2, ["x"]), (3, []), (4, None)], "k int, z array<string>").withColumn("t", at("2024-07-01 20:00:00"))
    got = [tuple(r) for r in zones.board(df, ["k"], "t", "z").orderBy("k", "line").collect()]
    assert got == [
        (1, 1, "Mars/Base", None, None, None, None, None, None, None, None),
        (1, 2, "Asia/Shanghai", 1, "2024-07-02 04:00:00", 2, "UTC+08:00", "GMT+8", False, "base", "same day"),
        (1, 3, "America/New_York", 2, "2024-07-01 16:00:00", 1, "UTC-04:00", "EDT", True, "−12 h", "−1 day"),
        (1, 4, "Asia/Kathmandu", 3, "2024-07-02 01:45:00", 2, "UTC+05:45", "GMT+5:45", False, "−2.25 h", "same day"),
        (2, 1, "x", None, None, None, None, None, None, None, None),
    ]


SCHEDULES = [
    ("0 9 * * 1-5", "America/New_York", "2024-03-08 12:00:00", 2, ["2024-03-08 14:00:00", "2024-03-11 13:00:00"]),
    ("30 2 * * *", "America/New_York", "2024-03-09 12:00:00", 1, ["2024-03-11 06:30:00"]),
    ("0-59 2,5 * * *", "America/New_York", "2024-03-10 05:30:00", 2, ["2024-03-10 09:00:00", "2024-03-10 09:01:00"]),
    ("30 1 * * *", "America/New_York", "2024-11-03 05:29:59", 2, ["2024-11-03 05:30:00", "2024-11-04 06:30:00"]),
    ("30 1 * * *", "America/New_York", "2024-11-03 05:40:00", 1, ["2024-11-04 06:30:00"]),
    ("0 0 29 2 *", "UTC", "2023-01-01 00:00:00", 9, ["2024-02-29 00:00:00", "2028-02-29 00:00:00"]),
    ("@WEEKLY", None, "2024-01-01 00:00:00", 1, ["2024-01-06 16:00:00"]),
    ("0 0 30 2 *", "UTC", "2024-01-01 00:00:00", 1, []),
    ("* * * * * */30", "UTC", "2024-01-01 00:00:10", 3, ["2024-01-01 00:00:30", "2024-01-01 00:01:00", "2024-01-01 00:01:30"]),
    ("5 4 1W,3 * *", "UTC", "2024-01-01 00:00:00", 1, []),
    ("0 0 1 1 0", "UTC", "2024-01-01 00:00:00", 2, ["2024-01-07 00:00:00", "2024-01-14 00:00:00"]),
]


@pytest.mark.parametrize("most", [0, 5000])
def test_schedules_as_data(far, monkeypatch, most):
    monkeypatch.setattr(schedules, "MOST_PLANS", most)  # plans in a table, and in the rows
    df = far.createDataFrame([(k, e, z, micros(t), c) for k, (e, z, t, c, _) in enumerate(SCHEDULES)] + [(99, "* * * * *", "UTC", None, 1), (98, None, "UTC", 0, 1)], "k int, e string, z string, t long, c int").withColumn("t", F.timestamp_micros("t"))
    got = schedules.schedule_runs(df, ["k"], "e", "t", "z", "c").select("k", "n", time.stamp(F.col("run")).alias("run")).orderBy("k", "n").collect()
    assert [(r.k, r.n, r.run) for r in got] == [(k, n + 1, t) for k, (*_, runs) in enumerate(SCHEDULES) for n, t in enumerate(runs)]


def test_equal_schedules_share_their_runs(far, monkeypatch):
    """Runs are found once for rows that ask the same, and rows that don't are dealt to tasks by number."""
    asked, found = [], schedules.found_runs
    monkeypatch.setattr(schedules, "found_runs", lambda d, rows: asked.append((d.count(), (out := found(d, rows)).select("_t").rdd.getNumPartitions())) or out)
    monkeypatch.setattr(schedules, "TASK_ROWS", 20)
    rows = [(100 * j + k, e, z, micros(t), c) for j in range(40) for k, (e, z, t, c, _) in enumerate(SCHEDULES)]
    rows += [(9000 + j, e, z, None if e else 0, 1) for j in range(40) for e, z in (("* * * * *", "UTC"), (None, "UTC"))]
    want = sorted((100 * j + k, n + 1, t) for j in range(40) for k, (*_, runs) in enumerate(SCHEDULES) for n, t in enumerate(runs))
    for most in (1_000_000, 0):
        monkeypatch.setattr(schedules, "MOST_SHARED", most)
        df = far.createDataFrame(rows, "k int, e string, z string, t long, c int").withColumn("t", F.timestamp_micros("t"))
        got = schedules.schedule_runs(df, ["k"], "e", "t", "z", "c").select("k", "n", time.stamp(F.col("run")).alias("run")).collect()
        assert sorted(map(tuple, got)) == want
    assert asked[0][0] <= len(SCHEDULES) + 1 and asked[1][0] == 40 * (len(SCHEDULES) + 1) and asked[1][1] >= asked[1][0] / 20


def test_schedules_without_rows(far):
    df = far.createDataFrame([], "k int, e string, t timestamp")
    assert schedules.schedule_runs(df, ["k"], "e", "t").collect() == []
    assert rel.cron_next(df, ["k"], "t", "0 0 * jan mon").collect() == []


def test_spans_name_their_instants_once(spark):
    a, b = F.timestamp_seconds(F.col("first_mark")), F.timestamp_seconds(F.col("last_mark"))
    for c in (time.calendar_span(a, b), time.date_difference(a, b)):
        assert str(c).count("first_mark") == 1 and str(c).count("last_mark") == 1
    # days that shorter months cut off, and those that none does
    for low, high, want in (("2024-01-31", "2024-05-30", (4, 1)), ("2023-12-29", "2024-03-28", (2, 28)), ("2024-01-28", "2024-03-27", (1, 28)), ("2024-01-30", "2024-02-29", (1, 0)), ("2023-05-05", "2023-05-04", (0, 1))):
        r = spark.range(1).select(time.date_difference(F.lit(f"{low}T00:00:00Z").cast("timestamp"), F.lit(f"{high}T00:00:00Z").cast("timestamp")).alias("d")).first().d
        assert (r.months_part, r.days_part) == want, (low, high, r)
