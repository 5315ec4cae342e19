"""Relational operators on files and days: keep-first, natural order, ranges, islands, calendars, schedules, modes, sizes."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.schedules import schedule_runs


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. An aggregate of the least row, combined before the shuffle, so a hot key is no single sort."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in df.columns])).alias("_r")
    return df.groupBy(*named).agg(first).select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def natural_key(name: Column) -> Column:
    """A sort key by which digit runs compare as numbers: each run without leading zeros gets its length before it."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 4, "0"), bare(x))).otherwise(x)), "\x01")


def natural_rank(df: DataFrame, name: str, tie: str, parts: int = 200, seed: int = 7) -> DataFrame:
    """df with `rank` (from 1) in natural order of a name: by natural_key, then bytes of the name, then `tie`.

    Rows are dealt to about `parts` ranges of the key, whose bounds are from a seeded sample of a few thousand
    names, are counted for each range, and numbered within it; no task sees all rows. The bounds don't change the result.
    """
    keyed = df.withColumn("_k", natural_key(F.col(name))).withColumn("_n", F.octet_length(name))
    bounds = sorted({r["_k"] for r in keyed.where("_k is not null").select("_k").orderBy(F.xxhash64("_k", F.lit(seed))).limit(20 * parts).collect()})[:: 20]
    array = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")
    keyed = keyed.withColumn("_b", F.coalesce(F.size(F.filter(array, lambda b: b <= F.col("_k"))), F.lit(0)))
    before = keyed.groupBy("_b").count().withColumn("_before", F.sum("count").over(Window.orderBy("_b")) - F.col("count")).select("_b", "_before")  # `parts` rows
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(F.col("_k").asc_nulls_first(), "_n", tie))
    return keyed.withColumn("_i", inside).join(F.broadcast(before), "_b").withColumn("rank", (F.col("_before") + F.col("_i")).cast("int")).drop("_k", "_n", "_b", "_i", "_before")


def selected_pages(selector: Column, total: Column) -> Column:
    """Page numbers that a selector names, in its order, repeats kept: all, odd, even, a, a-b, a-, -b joined by , ; ，、.

    Sides of a range are held within the document; null if a single page is outside, a range runs backwards or a part isn't one.
    """
    s = F.lower(F.trim(selector))
    every = F.sequence(F.lit(1), total)
    parts = F.filter(F.transform(F.split(s, "[,;，、]"), lambda p: F.trim(p)), lambda p: p != "")

    def pages(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^(\d*)\s*-\s*(\d*)$", 1).try_cast("int"), F.regexp_extract(p, r"^(\d*)\s*-\s*(\d*)$", 2).try_cast("int")
        one = F.when(p.rlike(r"^\d+$"), p.try_cast("int"))
        low, high = F.least(F.greatest(F.coalesce(a, F.lit(1)), F.lit(1)), total), F.least(F.coalesce(b, total), total)
        backwards = F.coalesce(a > b, F.lit(False)) | (F.coalesce(a, F.lit(1)) < 1) | (high < 1)
        return F.when(p.isin("all", "*", "全部", "所有"), every).when(p.isin("odd", "奇数"), F.filter(every, lambda x: x % 2 == 1)).when(p.isin("even", "偶数"), F.filter(every, lambda x: x % 2 == 0)).when(
            one.between(1, total), F.array(one)
        ).when(p.rlike(r"^(\d+\s*-\s*\d*|-\s*\d+)$") & ~backwards, F.sequence(low, high))

    each = F.transform(parts, pages)
    return F.when(F.size(parts) == 0, every).when(F.exists(each, lambda x: x.isNull()), F.lit(None)).otherwise(F.flatten(each))


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, first, last, length of each run of consecutive distinct values (whole numbers or dates)."""
    days = dict(df.dtypes)[value] == "date"
    v = F.unix_date(value) if days else F.col(value)
    d = df.select(*keys, v.cast("long").alias("_v")).where("_v is not null").distinct()
    d = d.withColumn("_g", F.col("_v") - F.row_number().over(Window.partitionBy(*keys).orderBy("_v")))
    back = (lambda c: F.date_from_unix_date(c.cast("int"))) if days else (lambda c: c)
    return d.groupBy(*keys, "_g").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b")).select(*keys, back(F.col("_a")).alias("first"), back(F.col("_b")).alias("last"), (F.col("_b") - F.col("_a") + 1).alias("length"))


def range_text(pages: Column) -> Column:
    """Sorted distinct numbers as `1-3,5`, within a row."""
    p = F.array_sort(F.array_distinct(pages))
    runs = F.aggregate(p, F.array().cast("array<struct<a:int,b:int>>"), lambda acc, x: _grown(acc, x))
    return F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string")))), ",")


def _grown(acc: Column, x: Column) -> Column:
    last = F.try_element_at(acc, F.lit(-1))
    one = F.array(F.struct(x.cast("int").alias("a"), x.cast("int").alias("b")))
    wider = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), x.cast("int").alias("b"))))
    return F.when(last["b"] == x.cast("int") - 1, wider).otherwise(F.concat(acc, one))


#: Sunday is 0; 1970-01-01 was a Thursday.
def weekday(day: Column) -> Column:
    return F.dayofweek(day) - 1


def rest_days(holidays: list[str], weekend: tuple[int, ...] = (0, 6)) -> Column:
    """Holidays that aren't at a weekend, sorted: a literal, as a calendar has few a year."""
    days = sorted({date.fromisoformat(str(h)) for h in holidays})
    kept = [d for d in days if (d.weekday() + 1) % 7 not in weekend]
    return F.array(*[F.lit(d) for d in kept]) if kept else F.array().cast("array<date>")


def day_tally(start: Column, end: Column, holidays: list[str], weekend: tuple[int, ...] = (0, 6)) -> Column:
    """days, weekend_days, holiday_days (not at a weekend) and work_days of a closed interval; all 0 if it is empty, null if an end is.

    Weekend days are counted from the two ends by arithmetic, so no day is listed and nothing is joined.
    """
    a, b = F.unix_date(start), F.unix_date(end)
    days = F.greatest(b - a + 1, F.lit(0))
    at_weekend = sum((F.floor((b + 4 - w) / 7) - F.floor((a + 3 - w) / 7) for w in weekend), F.lit(0))
    at_weekend = F.when(days > 0, at_weekend).otherwise(0)
    off = F.size(F.filter(rest_days(holidays, weekend), lambda h: h.between(start, end)))
    counts = {"days": days, "weekend_days": at_weekend, "holiday_days": off, "work_days": days - at_weekend - off}
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))


def nth_workday(start: Column, n: int, holidays: list[str], weekend: tuple[int, ...] = (0, 6), reach: int | None = None) -> Column:
    """The n-th working day after (or before, n < 0) a date, which isn't counted; null if it lies beyond `reach` days."""
    span = reach or abs(n) * 7 // max(1, 7 - len(weekend)) + 10 + 2 * len(holidays)
    sign, off = 1 if n >= 0 else -1, rest_days(holidays, weekend)
    days = F.transform(F.sequence(F.lit(1), F.lit(span)), lambda k: F.date_add(start, k * sign))
    work = F.filter(days, lambda d: ~weekday(d).isin(*weekend) & ~F.array_contains(off, d))
    return start if n == 0 else F.get(work, F.lit(abs(n) - 1))


def rolled(day: Column, holidays: list[str], weekend: tuple[int, ...] = (0, 6)) -> Column:
    """The first working day from a date on, up to 28 days later; the date itself if there is none."""
    off = rest_days(holidays, weekend)
    work = F.filter(F.transform(F.sequence(F.lit(0), F.lit(28)), lambda k: F.date_add(day, k)), lambda d: ~weekday(d).isin(*weekend) & ~F.array_contains(off, d))
    return F.coalesce(F.get(work, F.lit(0)), day)


def work_ranges(df: DataFrame, keys: list[str], start: str, end: str, holidays: list[str], weekend: tuple[int, ...] = (0, 6)) -> DataFrame:
    """keys, first, last, length of each run of working days in each row's closed interval, found within the row.

    A run starts at a working day after a rest day (or at the start) and ends before the next rest day.
    """
    off = rest_days(holidays, weekend)
    rest = lambda d: weekday(d).isin(*weekend) | F.array_contains(off, d)
    days = F.when(F.col(start) <= F.col(end), F.sequence(F.col(start), F.col(end))).otherwise(F.array().cast("array<date>"))
    firsts = F.filter(days, lambda d: ~rest(d) & ((d == F.col(start)) | rest(F.date_sub(d, 1))))
    lasts = F.filter(days, lambda d: ~rest(d) & ((d == F.col(end)) | rest(F.date_add(d, 1))))
    runs = df.select(*keys, F.explode(F.arrays_zip(firsts.alias("first"), lasts.alias("last"))).alias("r")).select(*keys, "r.first", "r.last")
    return runs.withColumn("length", (F.datediff("last", "first") + 1).cast("long"))


#: Names of months and weekdays in a schedule.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]


def cron_next(df: DataFrame, keys: list[str], after: str, expression: str, count: int = 5) -> DataFrame:
    """keys, run, n of the first `count` runs in UTC after each row's time of one schedule, in which names of months and weekdays may stand; see schedules.py for a column of schedules."""
    fields = expression.split()
    for place, names, low in ((3, MONTHS, 1), (4, WEEKDAYS, 0)):
        for k, name in enumerate(names):
            if place < len(fields):
                fields[place] = re.sub(rf"(?i)\b{name}\b", str(low + k), fields[place])
    rows = df.select(*keys, F.col(after).alias("_after")).withColumns({"_expression": F.lit(" ".join(fields)), "_zone": F.lit("UTC"), "_count": F.lit(count)})
    return schedule_runs(rows, keys, "_expression", "_after", "_zone", "_count").select(*keys, "run", "n")


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, order: Column | None = None) -> DataFrame:
    """keys, mode, weight: the value of greatest weight sum; on ties the one first seen in `order`, else the least."""
    s = df.groupBy(*keys, value.alias("_v")).agg(F.sum(weight).alias("_w"), F.min(F.lit(0) if order is None else order).alias("_o"))
    best = F.min(F.struct((-F.col("_w")).alias("w"), F.col("_o").alias("o"), F.col("_v").alias("v"))).alias("_b")
    return s.groupBy(*keys).agg(best).select(*keys, F.col("_b.v").alias("mode"), (-F.col("_b.w")).alias("weight"))


def size_metrics(df: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """keys, input_bytes, output_bytes, delta_percent (rounded half up)."""
    s = df.groupBy(*keys).agg(F.sum(before).alias("input_bytes"), F.sum(after).alias("output_bytes"))
    return s.withColumn("delta_percent", F.when(F.col("input_bytes") > 0, F.round((F.col("output_bytes") - F.col("input_bytes")) * 100 / F.col("input_bytes"))).cast("double") + 0.0)  # no negative zero
