"""Schedules as data: a column of expressions, each with its zone, its start and a number of runs.

An expression has five fields (minute, hour, day, month, weekday), or six with seconds at the end, or is one of MACROS. Its fields become
bit masks by Column expressions, and a month's days that fit are a mask too; if there are at most MOST_PLANS expressions, this is done once for each, in a
table that is sent to all tasks, else in each row. The runs are looked for within the row: by months up to HORIZON after the start that have a day
that fits, then by days, hours, minutes and seconds, and no further than the number of runs asks for. That takes long for a row's size, so rows with the
same expression, zone, start and count share their runs if there are few such, in a table of MOST_SHARED runs at most that is sent to all tasks; else
rows are dealt to tasks by number. No row is shuffled by its expression, which may be as frequent as it likes. Wall times become instants by the stretches of their zone (see zones.py): one that the
clocks skip is no run, and of one that they show twice the first is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.net import bound
from quarry.functions.time import whole
from quarry.operators.zones import known_zones, sent, span_of, stretches, walls, years_around

HORIZON, MOST_RUNS, SPARE, MOST_PLANS, MOST_SHARED, TASK_ROWS = 96, 50, 24, 5000, 1_000_000, 100_000
#: Schedules with a name, the zone of a schedule without one, and the number of runs of one without.
MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@hourly": "0 * * * *"}
ZONE, RUNS = "Asia/Shanghai", 5
FIELDS = ["minute", "hour", "day", "month", "weekday", "second"]


def bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def has(mask: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", mask, n.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def ones(mask: Column, low: int, high: int) -> Column:
    """The bits of a mask from low to high, in order."""
    return F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: has(mask, n))


def field_mask(text: Column, low: int, high: int) -> Column:
    """The values of a field as bits: * a a-b with /n, joined by commas; null if it is none, or out of range."""

    def values(piece: Column) -> Column:
        part = lambda k: F.regexp_extract(piece, r"^(?:(\*)|(\d+)(?:-(\d+))?)(?:/(\d+))?$", k)
        number = lambda k: part(k).try_cast("int")
        a = F.when(part(1) == "*", low).otherwise(number(2))
        b = F.when(part(1) == "*", high).when(part(3) != "", number(3)).when(part(4) != "", high).otherwise(a)
        step = F.when(part(4) == "", 1).otherwise(number(4))

        def mask(x: Column) -> Column:
            good = piece.rlike(r"^(?:\*|\d+(?:-\d+)?)(?:/\d+)?$") & (x["a"] >= low) & (x["a"] <= x["b"]) & (x["b"] <= high) & (x["s"] >= 1)
            steps = F.when(good, F.sequence(x["a"], x["b"], x["s"]))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda m, n: m.bitwiseOR(bit(n)))

        return bound(F.struct(a.alias("a"), b.alias("b"), step.alias("s")), mask)

    return F.aggregate(F.transform(F.split(text, ",", -1), lambda p: values(F.trim(p))), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x))


def day_rule(text: Column, of_month: bool) -> Column:
    """kind, n, k, mask of a day field: all, values, last, last_weekday, nearest (to n), last_day (the last weekday n), nth (the k-th weekday n), bad."""
    up = F.upper(text)
    number = lambda pattern, k: F.regexp_extract(up, pattern, k).try_cast("int")
    none, null_mask = F.lit(None).cast("int"), F.lit(None).cast("long")
    rule = lambda kind, n=none, k=none, mask=null_mask: F.struct(F.lit(kind).alias("kind"), n.alias("n"), k.alias("k"), mask.alias("mask"))
    if of_month:
        near = number(r"^(\d+)W$", 1)
        signs = F.when(up == "L", rule("last")).when(up == "LW", rule("last_weekday")).when(near.between(1, 31), rule("nearest", near)).otherwise(rule("bad"))
        mask = field_mask(text, 1, 31)
    else:
        last, nth = number(r"^(\d+)L$", 1), number(r"^(\d+)#(\d+)$", 1)
        which = number(r"^(\d+)#(\d+)$", 2)
        signs = F.when(up == "L", rule("last_day", F.lit(6))).when(last.between(0, 7), rule("last_day", last % 7)).when(nth.between(0, 7) & which.between(1, 5), rule("nth", nth % 7, which)).otherwise(rule("bad"))
        plain = field_mask(text, 0, 7)
        mask = plain.bitwiseAND(F.lit(127).cast("long")).bitwiseOR(F.when(has(plain, F.lit(7)), 1).otherwise(0).cast("long"))
    values = bound(mask, lambda m: F.when(m.isNull(), rule("bad")).otherwise(rule("values", mask=m)))
    return F.when(text.isin("*", "?"), rule("all")).when(up.rlike("[LW#]"), signs).otherwise(values)


def parsed(expression: Column) -> Column:
    """error, second, minute, hour, month (masks), day and weekday (day_rule()) of an expression. error: expression, fields, the first field that is wrong, reboot, or null."""
    named = F.create_map(*[F.lit(x) for kv in MACROS.items() for x in kv])
    text = F.coalesce(F.trim(expression), F.lit(""))
    fields = F.split(F.trim(F.coalesce(F.try_element_at(named, F.lower(text)), text)), r"\s+")

    def plan(f: Column) -> Column:
        part = lambda k: F.get(f, F.lit(k))
        masks = {"second": F.when(F.size(f) == 6, field_mask(part(5), 0, 59)).otherwise(F.lit(1).cast("long")), "minute": field_mask(part(0), 0, 59), "hour": field_mask(part(1), 0, 23), "month": field_mask(part(3), 1, 12)}
        return F.struct(F.size(f).alias("size"), *[v.alias(k) for k, v in masks.items()], day_rule(part(2), True).alias("day"), day_rule(part(4), False).alias("weekday"))

    def judged(p: Column) -> Column:
        bad = F.when(text == "", "expression").when(F.lower(text) == "@reboot", "reboot").when(~p["size"].isin(5, 6), "fields")
        for k in ("second", "minute", "hour", "day", "month", "weekday"):
            bad = bad.when(p[k]["kind"] == "bad" if k in ("day", "weekday") else p[k].isNull(), k)
        return F.struct(bad.alias("error"), *[p[k].alias(k) for k in ("second", "minute", "hour", "month", "day", "weekday")])

    return bound(bound(fields, plan), judged)


def month_days(plan: Column, start: Column) -> Column:
    """The days of the month from `start` (its first) that fit a plan, as bits 1 to 31."""

    def days(m: Column) -> Column:
        size, first = m["size"], m["first"]
        on = lambda day: (first + day - 1) % 7  # noqa: E731  the weekday of a day
        every = bit(size + 1) - 2
        day, week = plan["day"], plan["weekday"]
        near = F.least(day["n"], size)
        nearest = F.when(on(near) == 6, F.when(near > 1, near - 1).otherwise(near + 2)).when(on(near) == 0, F.when(near < size, near + 1).otherwise(near - 2)).otherwise(near)
        by_day = F.when(day["kind"] == "values", day["mask"]).when(day["kind"] == "last", bit(size)).when(day["kind"] == "last_weekday", bit(size - F.when(on(size) == 6, 1).when(on(size) == 0, 2).otherwise(0))).otherwise(bit(nearest))
        each = F.lit(sum(1 << k for k in (1, 8, 15, 22, 29)))  # days of the weekday that the month begins with
        weekdays = [F.when(has(week["mask"], F.lit(w)), F.call_function("shiftleft", each.cast("long"), ((w - first + 7) % 7).cast("int"))).otherwise(F.lit(0).cast("long")) for w in range(7)]
        nth = 1 + (week["n"] - first + 7) % 7 + 7 * (week["k"] - 1)
        by_week = F.when(week["kind"] == "values", reduce(lambda a, b: a.bitwiseOR(b), weekdays)).when(week["kind"] == "last_day", bit(size - (on(size) - week["n"] + 7) % 7)).otherwise(bit(nth))
        fits = F.when((day["kind"] == "all") & (week["kind"] == "all"), every).when(day["kind"] == "all", by_week).when(week["kind"] == "all", by_day).otherwise(by_day.bitwiseOR(by_week))
        return fits.bitwiseAND(every)

    return bound(F.struct(F.dayofmonth(F.last_day(start)).alias("size"), (F.dayofweek(start) - 1).alias("first")), days)


def planned(plan: Column, start: Column, months: int) -> Column:
    """error, seconds, minutes, hours (in order), months (first day, and days that fit as bits, of those from the month of `start` on that have any)."""

    def listed(p: Column) -> Column:
        first = lambda k: F.add_months(F.trunc(start, "month"), k)
        days = F.transform(F.sequence(F.lit(0), F.lit(months)), lambda k: F.struct(F.unix_date(first(k)).alias("first"), F.when(has(p["month"], F.month(first(k))), month_days(p, first(k))).otherwise(F.lit(0).cast("long")).alias("mask")))
        there = F.when(p["error"].isNull(), F.filter(days, lambda m: m["mask"] != 0))
        return F.struct(p["error"].alias("error"), ones(p["second"], 0, 59).alias("seconds"), ones(p["minute"], 0, 59).alias("minutes"), ones(p["hour"], 0, 23).alias("hours"), there.alias("months"))

    return bound(plan, listed)


def runs(plan: Column, after: Column, zone: Column, count: Column) -> Column:
    """The first `count` runs (seconds since 1970) after an instant (microseconds) of planned(); zone: the stretches of walls() in order, without those that are over before."""
    empty = F.array().cast("array<bigint>")
    full = lambda got: F.size(got) >= count

    def seconds_of(shown: Column) -> Column:
        s = F.get(F.filter(zone, lambda z: shown < z["high"]), F.lit(0))
        return bound(s, lambda z: F.when(shown >= z["shows"], shown - z["offset"]))

    def from_first(x: Column) -> Column:
        def minute(got: Column, at: Column) -> Column:
            shown = F.transform(plan["seconds"], lambda s: at + s)
            found = F.filter(F.transform(shown, seconds_of), lambda s: s.isNotNull() & (s * 1_000_000 > after))
            return F.when(full(got), got).otherwise(F.concat(got, found))

        def hour(got: Column, at: Column) -> Column:
            passed = at + 3600 + 10_800 < x["shown"]  # clocks go back by less than three hours
            return F.when(full(got) | passed, got).otherwise(F.aggregate(F.transform(plan["minutes"], lambda m: at + m * 60), got, minute))

        def one_day(got: Column, day: Column) -> Column:
            return F.when(full(got), got).otherwise(F.aggregate(F.transform(plan["hours"], lambda h: day.cast("long") * 86_400 + h * 3600), got, hour))

        def month(got: Column, m: Column) -> Column:
            days = F.filter(F.transform(ones(m["mask"], 1, 31), lambda d: m["first"] + d - 1), lambda d: (d >= x["day"]) & (d <= x["last"]))
            return F.when(full(got), got).otherwise(F.aggregate(days, got, one_day))

        # a month here has a day that fits; a zone has fewer months than SPARE in which the clocks may skip it
        near = F.slice(F.filter(plan["months"], lambda m: (m["first"] + 31 > x["day"]) & (m["first"] <= x["last"])), 1, count + SPARE)
        return F.slice(F.aggregate(near, empty, month), 1, count)

    # the local time of the start: the stretch that it is in is the first that isn't over
    shown = whole(after + 1000, 1_000_000) + F.get(zone, F.lit(0))["offset"]
    date = lambda s: F.date_from_unix_date(whole(s, 86_400).cast("int"))
    begun = bound(shown, lambda s: F.struct(s.alias("shown"), F.unix_date(date(s)).alias("day"), F.unix_date(F.add_months(date(s), HORIZON)).alias("last")))
    return bound(begun, from_first)


def zone_arrays(df: DataFrame, zone: str, at: str) -> DataFrame:
    """zone, stretches (an array in order) of the known zones in df, for starts `at` (seconds) and HORIZON months on."""
    low, high = span_of(df, at)
    names = known_zones(df.sparkSession).join(df.select(F.col(zone).alias("zone")).distinct(), "zone", "left_semi")
    table = walls(stretches(names, *years_around((low, high + (HORIZON + 2) * 2_678_400))))
    return table.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("starts", "ends", "offset", "shows", "high"))).alias("stretches"))  # a few a year


def schedule_status(df: DataFrame, keys: list[str], expression: str, zone: str | None = None) -> DataFrame:
    """keys, status of each schedule: ok, zone (unknown), or parsed()'s error."""
    named = F.coalesce(F.nullif(F.trim(zone), F.lit("")), F.lit(ZONE)) if zone else F.lit(ZONE)
    known = known_zones(df.sparkSession).withColumn("_known", F.lit(True))
    d = df.select(*keys, parsed(F.col(expression))["error"].alias("_e"), named.alias("zone"))
    status = F.when(F.col("_e") == "expression", F.col("_e")).when(F.col("_known").isNull(), "zone").otherwise(F.coalesce("_e", F.lit("ok")))
    return d.join(F.broadcast(known), "zone", "left").select(*keys, status.alias("status"))


def schedule_runs(df: DataFrame, keys: list[str], expression: str, after: str, zone: str | None = None, count: str | None = None) -> DataFrame:
    """keys, n, run (an instant), local (yyyy-MM-dd HH:mm:ss in its zone) of the first runs of each schedule after an instant.

    zone: a name, null or empty for ZONE; count: of runs, rounded, 1 to MOST_RUNS, null for RUNS. Schedules that schedule_status() doesn't call
    ok, that have no start, or that don't run within HORIZON months give no row; keys needn't be unique.
    """
    many = F.least(F.greatest(F.round(F.coalesce(F.col(count), F.lit(RUNS))), F.lit(1)), F.lit(MOST_RUNS)).cast("int") if count else F.lit(RUNS)
    named = F.coalesce(F.nullif(F.trim(zone), F.lit("")), F.lit(ZONE)) if zone else F.lit(ZONE)
    d = df.select(*keys, F.col(expression).alias("_x"), F.unix_micros(after).alias("_t"), many.alias("_c"), named.alias("zone")).where("_t is not null").withColumn("_s", whole(F.col("_t"), 1_000_000))
    asked = ["_x", "zone", "_t", "_c"]
    rows, kinds, most = d.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*asked)), F.coalesce(F.max("_c"), F.lit(0))).first()
    if 2 * kinds <= rows and kinds * most <= MOST_SHARED:
        shared = found_runs(d.select(*asked, "_s").distinct(), kinds).select(*asked, "_r")
        d = d.join(F.broadcast(shared), asked)
    else:
        d = found_runs(d, rows)
    d = d.select(*keys, F.posexplode_outer("_r").alias("_n", "_run")).select(*keys, "_n", "_run.*").where("_at is not null")  # outer: else Spark asks for the size of the runs first, and finds them twice
    shown = F.col("_at") + F.col("_offset")
    day, clock = F.date_from_unix_date(whole(shown, 86_400).cast("int")), F.pmod(shown, F.lit(86_400))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    local = F.concat(day.cast("string"), F.lit(" "), two(whole(clock, 3600)), F.lit(":"), two(whole(clock, 60) % 60), F.lit(":"), two(clock % 60))
    return d.select(*keys, (F.col("_n") + 1).alias("n"), F.timestamp_seconds("_at").alias("run"), local.alias("local"))


def found_runs(d: DataFrame, rows: int) -> DataFrame:
    """d (_x, zone, _t, _c, _s; about so many rows) with _r: the runs (_at) with the offsets that they are shown by (_offset), null for none; rows of unknown zones are left out."""
    tasks = max(d.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    if d.rdd.getNumPartitions() < tasks:  # a row takes long for its size
        d = d.repartition(tasks)
    kinds, (low, high) = d.select("_x").distinct(), span_of(d, "_s")
    if kinds.count() <= MOST_PLANS:
        # what a row needs of its expression doesn't depend on the row: a table of the expressions' months
        first = F.date_sub(F.date_from_unix_date(F.lit(low // 86_400)), 1)
        plans = kinds.select("_x", planned(parsed(F.col("_x")), first, HORIZON + (high - low) // 2_419_200 + 3).alias("_plan"))
        d = d.join(F.broadcast(plans), "_x")
    else:
        d = d.withColumn("_plan", planned(parsed(F.col("_x")), F.date_from_unix_date(whole(F.col("_s") - 86_400, 86_400).cast("int")), HORIZON + 2))
    d = d.join(sent(zone_arrays(d, "zone", "_s")), "zone")
    ahead = F.filter("stretches", lambda z: z["ends"] * 1_000_000 > F.col("_t"))

    def with_offset(at: Column, zone: Column) -> Column:
        return F.struct(at.alias("_at"), F.get(F.filter(zone, lambda z: at < z["ends"]), F.lit(0))["offset"].alias("_offset"))

    def found(x: Column) -> Column:
        return F.when(x["plan"]["error"].isNull(), F.transform(runs(x["plan"], F.col("_t"), x["ahead"], F.col("_c")), lambda at: with_offset(at, x["ahead"])))

    # no filter: Spark would ask it of each row's expression, before the join
    return d.withColumn("_r", bound(F.struct(F.col("_plan").alias("plan"), ahead.alias("ahead")), found))
