"""Instants, zones, periods, durations and relative phrases as Column expressions.

Timestamps are instants. Days, months and clocks are those of UTC unless a zone is named, and all arithmetic is on days and
microseconds since 1970, so no result depends on the session's time zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.net import bound

DAY = 86_400_000_000
MILLIS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000, "year": 31_536_000_000}


def whole(n: Column, by: int) -> Column:
    """n over `by`, rounded down, as a long; exact for all longs."""
    return ((n - F.pmod(n, F.lit(by))) / by).cast("long")


def day_of(ts: Column) -> Column:
    """The UTC date of an instant."""
    return F.date_from_unix_date(whole(F.unix_micros(ts), DAY).cast("int"))


def clock_of(ts: Column) -> Column:
    """Microseconds since UTC midnight."""
    return F.pmod(F.unix_micros(ts), F.lit(DAY))


def instant(day: Column, clock: Column | int = 0) -> Column:
    """The instant of a UTC date and microseconds since its midnight."""
    return F.timestamp_micros(F.unix_date(day).cast("long") * DAY + clock)


def from_wall(wall: Column) -> Column:
    """The instant at which UTC clocks show a timestamp without zone."""
    seconds = (F.hour(wall) * 60 + F.minute(wall)).cast("long") * 60
    return instant(wall.cast("date"), seconds * 1_000_000 + (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("long"))


def wall(ts: Column) -> Column:
    """The timestamp without zone that UTC clocks show at an instant."""
    us = clock_of(ts)
    return day_of(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), us.cast("decimal(20,6)") / 1_000_000)


def cut_to_second(ts: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(1_000_000)))


#: Names of months, and offsets in minutes of the zone names that mail dates may have.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MAIL_ZONES = {"GMT": 0, "UT": 0, "UTC": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}

_YMD, _CLOCK, _FULL, _OFFSET = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?", r"(\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d+)?)", r"([+-]\d{2}:?\d{2})"
_SHORT, _LONG = "|".join(m[:3] for m in MONTHS), "|".join(f"{m}|{m[:3]}" for m in MONTHS)
#: Forms of a time, tried in this order: a pattern, and its groups in the order year, month, day, hour, minute, second, offset; `either`: a month over 12 is the day.
FORMS = [
    (rf"^{_YMD}[Tt ](\d{{2}}):(\d{{2}}):(\d{{2}}(?:\.\d+)?)([Zz]|[+-]\d{{2}}:\d{{2}})$", "$1|$2|$3|$4|$5|$6|$7"),
    (rf"^(?i:(?:mon|tue|wed|thu|fri|sat|sun)\s*,\s*)?(\d{{1,2}})\s+((?i:{_SHORT}))\s+(\d{{2}}|\d{{4}})\s+{_CLOCK}\s+((?i:{'|'.join(MAIL_ZONES)})|[+-]\d{{4}})$", "$3|$2|$1|$4|$5|$6|$7"),
    (rf"^{_YMD} +{_CLOCK} +{_OFFSET}$", "$1|$2|$3|$4|$5|$6|$7"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}) +{_FULL} +{_OFFSET}$", "$1|$2|$3|$4|$5|$6|$7"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) +{_FULL} +{_OFFSET}$", "$3|$1|$2|$4|$5|$6|$7"),
    (rf"^{_YMD}(?:[T ]+{_CLOCK})?$", "$1|$2|$3|$4|$5|$6|"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?: +{_CLOCK})?$", "$1|$2|$3|$4|$5|$6|"),
    (rf"^(\d{{1,2}}) +((?i:{_SHORT})) +(\d{{4}})(?: +{_FULL})?$", "$3|$2|$1|$4|$5|$6|"),
    (rf"^((?i:{_LONG})) +(\d{{1,2}}), *(\d{{4}})(?: +{_FULL})?$", "$3|$1|$2|$4|$5|$6|"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: +{_FULL})?$", "$3|$1|$2|$4|$5|$6||either"),
    (r"^(\d{1,2})[.-](\d{1,2})[.-](\d{4})$", "$3|$2|$1||||"),
]


def parse_instant(text: Column, unit: str = "auto", zone: str | None = None) -> Column:
    """The instant that a text names, null if it is none.

    Numbers, with a fraction or not, count from 1970 in `unit` (s, ms, us, ns; auto: by digits before the point
    without leading zeros: up to 10 are seconds, 13 milliseconds, 16 microseconds, else nanoseconds). Others fit
    one of FORMS: ISO and RFC 3339, mail dates, years first or last, names of months. Of two numbers before a year and
    slashes the first is the month if it can be. A text without an offset is a wall time of `zone` (else UTC).
    """
    t = F.trim(text)
    number = r"^([+-]?)0*(\d+)(?:\.(\d+))?$"
    digits = F.length(F.regexp_extract(t, number, 2))
    power = {"s": 0, "ms": 3, "us": 6, "ns": 9}
    scale = F.when(digits <= 10, 0).when(digits <= 13, 3).when(digits <= 16, 6).otherwise(9) if unit == "auto" else F.lit(power[unit])
    n = t.try_cast("decimal(38,9)")
    micros = F.when(scale == 0, n * 1_000_000).when(scale == 3, n * 1000).when(scale == 6, n).otherwise(n / 1000)
    counted = F.when(t.rlike(number), F.timestamp_micros(F.floor(F.when(F.abs(micros) < 9.2e18, micros)).try_cast("long")))
    parts = F.lit(None).cast("string")
    for pattern, order in reversed(FORMS):
        parts = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, order)).otherwise(parts)
    return F.coalesce(counted, bound(F.split(parts, r"\|", -1), lambda p: dated(p, zone)))


def dated(p: Column, zone: str | None) -> Column:
    """The instant of the parts year, month, day, hour, minute, second, offset, as texts; empty ones are 0. An eighth, `either`, lets a month over 12 be the day."""
    part = lambda k: F.get(p, F.lit(k))
    number = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    named = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(part(1), 1, 3)))
    year = F.when(F.length(part(0)) < 3, F.when(number(0) < 50, number(0) + 2000).otherwise(number(0) + 1900)).otherwise(number(0))
    month = F.when(named > 0, named.cast("int")).otherwise(number(1))
    clock = [number(3), number(4), F.coalesce(F.substring(part(5), 1, 9).try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))]
    made = lambda m, d: F.try_make_timestamp_ntz(year, m, d, *clock)
    shown = F.when((F.get(p, F.lit(7)) == "either") & (number(1) > 12), made(number(2), number(1))).otherwise(made(month, number(2)))
    minutes = F.create_map(*[x for k, v in MAIL_ZONES.items() for x in (F.lit(k), F.lit(v))])
    away = F.when(part(6).rlike("^[+-]"), F.concat(F.substring(part(6), 1, 1), F.lit("1")).cast("int") * (F.substring(part(6), 2, 2).try_cast("int") * 60 + F.substring(part(6), -2, 2).try_cast("int"))).otherwise(F.try_element_at(minutes, F.upper(part(6))))

    def moved(plain: Column) -> Column:
        local = local_to_instant(plain, zone) if zone else plain
        return F.when(F.coalesce(part(6), F.lit("")) == "", local).otherwise(F.timestamp_micros(F.unix_micros(plain) - away.cast("long") * 60_000_000))

    return bound(bound(shown, from_wall), moved)


def epochs(ts: Column) -> Column:
    """Seconds, milliseconds and microseconds."""
    return F.struct(F.unix_seconds(ts).alias("seconds"), F.unix_millis(ts).alias("millis"), F.unix_micros(ts).alias("micros"))


def offset_seconds(ts: Column, zone: Column | str) -> Column:
    """Seconds by which a zone's clocks are ahead of UTC at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(ts, zone)) - F.unix_seconds(ts)


def local_to_instant(shown: Column, zone: str) -> Column:
    """The instant of a wall time (as the instant at which UTC clocks show it): the earlier one of two, the first later wall minute where there is none.

    Offsets are asked a day before and after, so that there is at most one change between them. For a table of zones see
    operators/zones.py.
    """

    def resolved(x: Column) -> Column:
        us, before, after = x["us"], x["before"], x["after"]
        fits = lambda off: offset_seconds(F.timestamp_micros(us - off), zone) * 1_000_000 == off
        # a gap is passed by whole minutes: as many as the clocks skip from the wall time on
        steps = F.transform(F.sequence(F.lit(1), F.lit(180)), lambda k: us + k.cast("long") * 60_000_000 - after)
        later = F.get(F.filter(steps, lambda t: offset_seconds(F.timestamp_micros(t), zone) * 1_000_000 == after), F.lit(0))
        return F.when(fits(before), us - before).when(fits(after), us - after).otherwise(later)

    near = lambda us, by: (offset_seconds(F.timestamp_micros(us + by), zone) * 1_000_000)
    offsets = lambda us: F.struct(us.alias("us"), near(us, -DAY).alias("before"), near(us, DAY).alias("after"))
    return F.timestamp_micros(bound(bound(F.unix_micros(shown), offsets), resolved))


def period_bounds(ts: Column, unit: str) -> Column:
    """First and last second of the day, week (from Monday), month, quarter or year."""
    day = day_of(ts)
    start = day if unit == "day" else F.trunc(day, unit)
    after = {"day": F.date_add(start, 1), "week": F.date_add(start, 7), "month": F.add_months(start, 1), "quarter": F.add_months(start, 3), "year": F.add_months(start, 12)}[unit]
    second = lambda d: F.unix_date(d).cast("long") * 86_400
    return F.struct(second(start).alias("first"), (second(after) - 1).alias("last"))


def add_calendar(ts: Column, years: int = 0, months: int = 0, days: int = 0, seconds: int = 0) -> Column:
    """Months and years clamp to the month's end; the time of day stays."""
    return instant(F.date_add(F.add_months(day_of(ts), 12 * years + months), days), clock_of(ts) + seconds * 1_000_000)


def add_months_at(ts: Column, months: Column) -> Column:
    return instant(F.add_months(day_of(ts), months), clock_of(ts))


def calendar_span(a: Column, b: Column) -> Column:
    """sign (1 if b is later), years, months, weeks, days, hours, minutes, seconds and millis from the earlier to the later instant.

    Years are counted one by one, then months, each step from where the last one ended: a day that a shorter month
    has cut off stays cut off, so after some steps it is the least of the lengths of the months passed.
    """
    number = lambda d: F.year(d) * 12 + F.month(d)
    length = lambda d: F.dayofmonth(F.last_day(d))

    def ends(x: Column) -> Column:  # the instants may be long expressions: each is named once
        low, high = F.unix_micros(F.least(x["a"], x["b"])), F.unix_micros(F.greatest(x["a"], x["b"]))
        return F.struct(low.alias("low"), high.alias("high"), F.when(x["b"] > x["a"], 1).when(x["b"] < x["a"], -1).when(x["a"] == x["b"], 0).alias("sign"))

    def from_low(e: Column) -> Column:
        # `to`: the last day that, at the low end's time of day, isn't past the high end
        clock = F.pmod(e["low"], F.lit(DAY))
        date = lambda us: F.date_from_unix_date((us / DAY).cast("int"))
        low, to = e["low"] - clock, e["high"] - clock
        return F.struct(date(low).alias("low"), date(to - F.pmod(to, F.lit(DAY))).alias("to"), to.alias("high"), e["sign"].alias("sign"))

    def by_years(s: Column) -> Column:
        # after a year the 29th of February is the 28th, in leap years too
        from_ = F.when((F.month(s["low"]) == 2) & (F.dayofmonth(s["low"]) == 29), F.date_sub(s["low"], 1)).otherwise(s["low"])
        n = F.year(s["to"]) - F.year(s["low"])
        n = F.when((n > 0) & (F.add_months(from_, 12 * n) > s["to"]), n - 1).otherwise(n)

        def moved(y: Column) -> Column:
            low = F.when(y > 0, F.add_months(from_, 12 * y)).otherwise(s["low"])
            return F.struct(low.alias("low"), y.alias("years"), *[s[k].alias(k) for k in ("to", "high", "sign")])

        return bound(bound(n, moved), lambda x: F.struct(F.dayofmonth(x["low"]).alias("day"), F.date_sub(x["low"], F.dayofmonth(x["low"]) - 1).alias("first"), *[x[k].alias(k) for k in ("years", "to", "high", "sign")]))

    def by_months(s: Column) -> Column:
        # no month cuts off a day up to the 28th
        passed = lambda n: F.when((n < 1) | (s["day"] <= 28), s["day"]).otherwise(F.least(s["day"], F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: length(F.add_months(s["first"], k))))))
        stepped = lambda n: F.date_add(F.add_months(s["first"], n), passed(n) - 1)
        most = number(s["to"]) - number(s["first"])
        n = bound(most, lambda m: F.when((m > 0) & (stepped(m) > s["to"]), m - 1).otherwise(m))
        return bound(n, lambda m: F.struct(m.alias("months"), whole(s["high"] - F.unix_date(stepped(m)).cast("long") * DAY, 1000).alias("rest"), s["years"].alias("years"), s["sign"].alias("sign")))

    def parts(s: Column) -> Column:
        r = s["rest"]
        days = whole(r, 86_400_000)
        named = {"years": s["years"], "months": s["months"], "weeks": F.floor(days / 7), "days": days % 7, "hours": whole(r, 3_600_000) % 24, "minutes": whole(r, 60_000) % 60, "seconds": whole(r, 1000) % 60, "millis": r % 1000}
        return F.when(s["sign"].isNotNull(), F.struct(s["sign"].cast("int").alias("sign"), *[v.cast("int").alias(k) for k, v in named.items()]))

    return bound(bound(bound(bound(bound(F.struct(a.alias("a"), b.alias("b")), ends), from_low), by_years), by_months), parts)


def date_difference(a: Column, b: Column) -> Column:
    """Signed milliseconds, whole days between dates, and the calendar breakdown in months and days of the later minus the earlier, stepwise as in calendar_span()."""

    def parts(x: Column) -> Column:
        s, a, b = x["span"], x["ends"]["a"], x["ends"]["b"]
        months, days = s["years"] * 12 + s["months"], s["weeks"] * 7 + s["days"]
        return F.struct((F.unix_millis(b) - F.unix_millis(a)).alias("millis"), F.datediff(day_of(b), day_of(a)).alias("days"), months.alias("months_part"), days.alias("days_part"))

    ends = F.struct(a.alias("a"), b.alias("b"))
    return bound(bound(ends, lambda x: F.struct(x.alias("ends"), calendar_span(x["a"], x["b"]).alias("span"))), parts)


#: Short names of the units of a span, largest first.
SPAN_UNITS = {"en": ["y", "mo", "w", "d", "h", "m", "s", "ms"], "zh": ["年", "个月", "周", "天", "小时", "分钟", "秒", "毫秒"]}


def span_text(span: Column, locale: str = "en") -> Column:
    """A calendar_span() as its parts that aren't 0, `-` before one that goes back."""
    names = SPAN_UNITS[locale]

    def said(x: Column) -> Column:
        pieces = [F.when(x[k] != 0, F.concat(F.abs(x[k]).cast("string"), F.lit(u))) for k, u in zip(("years", "months", "weeks", "days", "hours", "minutes", "seconds", "millis"), names, strict=True)]
        text = F.concat_ws(" ", *pieces)
        return F.when(x.isNotNull(), F.concat(F.when(x["sign"] < 0, "-").otherwise(""), F.when(text == "", f"0{names[6]}").otherwise(text)))

    return bound(span, said)


def duration_hms(millis: Column) -> Column:
    """HH:MM:SS of a duration; hours may exceed 24, parts of a second are cut off, a minus sign stands before a negative one."""
    s = F.floor(F.abs(millis) / 1000)
    h = F.floor(s / 3600)
    return F.concat(F.when(millis < 0, "\u2212").otherwise(""), F.when(h < 10, F.concat(F.lit("0"), h.cast("string"))).otherwise(h.cast("string")), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def duration_iso(millis: Column) -> Column:
    """ISO 8601 duration in days, hours, minutes and seconds; without days the seconds are always named, parts of them only if there are any."""
    a = F.abs(millis)
    s, part = F.floor(a / 1000), a % 1000
    said = lambda n, u: F.when(n > 0, F.concat(n.cast("string"), F.lit(u))).otherwise("")
    fraction = F.when(part > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), 3, "0"), "0+$", ""))).otherwise("")
    days = F.floor(s / 86400)
    second = F.when((s % 60 > 0) | (part > 0) | (days == 0), F.concat((s % 60).cast("string"), fraction, F.lit("S"))).otherwise("")
    clock = F.concat(said(F.floor(s / 3600) % 24, "H"), said(F.floor(s / 60) % 60, "M"), second)
    return F.when(a == 0, "PT0S").otherwise(F.concat(F.when(millis < 0, "-").otherwise(""), F.lit("P"), said(days, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise("")))


#: Units of a duration in words, and of a rounded one.
WORD_UNITS = {"en": ["day", "hour", "minute", "seconds", "millisecond"], "zh": ["天", "小时", "分", "秒", "毫秒"]}
SPOKEN_UNITS = {"second": "秒", "minute": "分钟", "hour": "小时", "day": "天", "week": "周", "month": "个月", "year": "年"}


def duration_words(millis: Column, locale: str = "en", gap: str | None = None) -> Column:
    """A duration as its parts that aren't 0, joined by `gap`; by default a comma in English and nothing in Chinese."""
    zh = locale == "zh"
    plural = lambda n, u: F.lit(u) if zh or u.endswith("s") else F.when(n == 1, u).otherwise(u + "s")

    def say(m: Column) -> Column:
        parts = [whole(m["a"], 86_400_000), whole(m["a"], 3_600_000) % 24, whole(m["a"], 60_000) % 60, whole(m["a"], 1000) % 60, m["a"] % 1000]
        part = lambda u: lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("" if zh else " "), plural(n, u)))
        said = [bound(n, part(u)) for n, u in zip(parts, WORD_UNITS[locale], strict=True)]
        sign = F.when(m["m"] < 0, "负 " if zh else "-").otherwise("")
        return F.when(m["m"].isNotNull(), F.concat(sign, F.when(m["a"] == 0, "0秒" if zh else "0 seconds").otherwise(F.concat_ws(gap or ("" if zh else ", "), *said))))

    # as one expression of the row it makes a method that is too long for the compiler
    return bound(F.struct(millis.alias("m"), F.abs(millis).alias("a")), say)


def duration_spoken(millis: Column, locale: str = "en") -> Column:
    """A duration without its sign in the largest unit up to weeks that it fills, rounded half up."""
    rounded = lambda unit: lambda n: F.concat(n.cast("string"), F.lit(SPOKEN_UNITS[unit])) if locale == "zh" else F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))

    def say(a: Column) -> Column:
        out = None
        for unit in ("second", "minute", "hour", "day", "week"):
            said = bound(F.round(a / MILLIS[unit]).cast("long"), rounded(unit))
            out = said if out is None else F.when(a >= MILLIS[unit], said).otherwise(out)
        return out

    return bound(F.abs(millis), say)


def number_text(value: Column) -> Column:
    """A number with at most two decimals, rounded half up, and commas between groups of three digits; what is under 0.005 is 0."""
    fixed = F.format_number(F.round(F.abs(value).cast("decimal(38,12)"), 2), 2)
    return F.when(F.isnan(value.cast("double")) | (F.abs(value) < 0.005) | (F.abs(value) == float("inf")), "0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")))


#: Phrases that stand for an amount of a unit.
NAMED = {
    "en": {("day", -1): "yesterday", ("day", 0): "today", ("day", 1): "tomorrow", ("week", -1): "last week", ("week", 1): "next week", ("month", -1): "last month", ("month", 1): "next month", ("year", -1): "last year", ("year", 1): "next year", ("second", 0): "now"},
    "zh": {("day", -1): "昨天", ("day", 0): "今天", ("day", 1): "明天", ("week", -1): "上周", ("week", 1): "下周", ("month", -1): "上个月", ("month", 1): "下个月", ("year", -1): "去年", ("year", 1): "明年", ("second", 0): "现在"},
}


def relative_phrase(millis: Column, locale: str = "en", named: bool = True) -> Column:
    """A difference to now in words: in the largest unit that it fills, rounded half away from 0 below a day and cut off from a day up, but not to 0.

    named: amounts that have a phrase of their own (yesterday, last week, now) are said by it.
    """
    units = list(MILLIS)
    a = F.abs(millis)
    unit, n = F.lit("year"), whole(a, MILLIS["year"])
    for k, name in reversed(list(enumerate(units[:-1]))):
        here = a < MILLIS[units[k + 1]]
        count = F.round(a / MILLIS[name]).cast("long") if MILLIS[name] < MILLIS["day"] else whole(a, MILLIS[name])
        unit, n = F.when(here, name).otherwise(unit), F.when(here, count).otherwise(n)

    def said(x: Column) -> Column:
        unit, n = x["unit"], x["n"]
        back = n < 0
        if locale == "zh":
            called = F.element_at(F.create_map(*[F.lit(v) for kv in SPOKEN_UNITS.items() for v in kv]), unit)
            out = F.concat(F.abs(n).cast("string"), called, F.when(back, "前").otherwise("后"))
        else:
            amount = F.concat(F.abs(n).cast("string"), F.lit(" "), unit, F.when(F.abs(n) == 1, "").otherwise("s"))
            out = F.when(back, F.concat(amount, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), amount))
        for (u, k), phrase in NAMED[locale].items() if named else ():
            out = F.when((unit == u) & (n == k), phrase).otherwise(out)
        return out

    n = F.when(millis < 0, -F.greatest(n, F.lit(1))).when(millis > 0, F.greatest(n, F.lit(1))).otherwise(0)
    return F.when(millis.isNotNull(), bound(F.struct(unit.alias("unit"), n.alias("n")), said))


#: Words that a relative time may begin with, the longest first, and what they mean.
PHRASES = [("quarter-start", "quarter"), ("month-start", "month"), ("week-start", "week"), ("year-start", "year"), ("yesterday", "-1"), ("tomorrow", "1"), ("today", "0"), ("now", "now"), ("前天", "-2"), ("后天", "2"), ("昨天", "-1"), ("明天", "1"), ("今天", "0"), ("现在", "now")]


def relative_instant(text: Column, now: Column) -> Column:
    """The instant of a phrase against now: a word of PHRASES, or a time that parse_instant() reads, then offsets `+1d -2h` (y M w d h m s, in any number) and a time of day; null if it is none.

    Without either the offsets count from now. The time of day is set first; then years, months and days are added, clamped to the month's
    end, and hours, minutes and seconds last.
    """
    offset, clock = r"[+-]\d+[yMwdhms]", r"T?(\d{1,2}:\d{1,2}(?::\d{1,2})?)"

    def begun(x: Column) -> Column:
        low, at = x["text"], x["now"]
        start, word = at, F.lit("")
        for key, kind in reversed(PHRASES):
            of = at if kind == "now" else instant(F.trunc(day_of(at), kind)) if kind.isalpha() else instant(F.date_add(day_of(at), int(kind)))
            hit = F.lower(low).startswith(key)
            start, word = F.when(hit, of).otherwise(start), F.when(hit, key).otherwise(word)
        return F.struct(low.alias("text"), word.alias("word"), start.alias("start"), F.regexp_extract(low, rf"^([^+-].*?)\s+(?:{offset}\s*)+(?:{clock})?$", 1).alias("dated"))

    def split(x: Column) -> Column:
        dated = (x["word"] == "") & (x["dated"] != "")
        word, start = F.when(dated, x["dated"]).otherwise(x["word"]), F.when(dated, parse_instant(x["dated"])).otherwise(x["start"])
        rest = F.trim(F.substring(x["text"], F.length(word) + 1, F.lit(1 << 30)))
        return F.struct(word.alias("word"), start.alias("start"), rest.alias("rest"), F.split(F.regexp_extract(rest, rf"(?:^|\s|[yMwdhms]){clock}$", 1), ":").alias("at"))

    def moved(x: Column) -> Column:
        rest = x["rest"]
        good = rest.rlike(rf"^({offset}\s*)*({clock})?$") & ((x["word"] != "") | rest.rlike(rf"^{offset}"))
        total = lambda u: F.aggregate(F.regexp_extract_all(rest, F.lit(rf"([+-]\d+){u}"), F.lit(1)), F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v.try_cast("long"), F.lit(0).cast("long")))
        part = lambda k: F.coalesce(F.get(x["at"], F.lit(k)).try_cast("long"), F.lit(0))
        right = (part(0) < 24) & (part(1) < 60) & (part(2) < 60)
        timed = F.when(F.get(x["at"], F.lit(0)) != "", (part(0) * 3600 + part(1) * 60 + part(2)) * 1_000_000).otherwise(clock_of(x["start"]))
        day = F.date_add(F.add_months(F.add_months(day_of(x["start"]), (12 * total("y")).cast("int")), total("M").cast("int")), (total("w") * 7 + total("d")).cast("int"))
        return F.when(good & right, instant(day, timed + (total("h") * 3600 + total("m") * 60 + total("s")) * 1_000_000))

    return bound(bound(bound(F.struct(F.trim(text).alias("text"), now.alias("now")), begun), split), moved)


#: Tokens of a format, and Spark's for those of a date.
TOKENS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "ddd": "EEE", "dddd": "EEEE"}


def clock_tokens(ts: Column) -> dict[str, Column]:
    """Tokens of a format that stand for the time of day."""
    seconds = whole(clock_of(ts), 1_000_000)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return {"HH": two(whole(seconds, 3600)), "mm": two(whole(seconds, 60) % 60), "ss": two(seconds % 60), "SSS": F.lpad((whole(clock_of(ts), 1000) % 1000).cast("string"), 3, "0"), "ZZ": F.lit("+0000"), "A": F.when(seconds < 43_200, "AM").otherwise("PM")}


def format_tokens(ts: Column, form: str) -> Column:
    """ts by a format of runs of one letter: those of TOKENS and clock_tokens() stand for parts of the time, all else for itself."""
    runs, clock = [m[0] for m in re.finditer(r"(.)\1*", form, re.S)], clock_tokens(ts)
    return F.concat(*[F.date_format(day_of(ts), TOKENS[r]) if r in TOKENS else clock.get(r, F.lit(r)) for r in runs]) if runs else F.lit("")


def stamp(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss."""
    return F.concat(day_of(ts).cast("string"), F.lit(" "), format_tokens(ts, "HH:mm:ss"))


def zone_board(ts: Column, zone: str) -> Column:
    """local (yyyy-MM-dd HH:mm:ss), weekday (0 is Sunday), offset_minutes and dst of an instant in a zone; dst: the offset is over the least of that local year's first of January and of July. For a table of zones see operators/zones.py."""
    local = F.from_utc_timestamp(ts, zone)
    off = lambda t: whole(offset_seconds(t, zone), 60).cast("int")

    def board(x: Column) -> Column:
        year = F.trunc(day_of(x["local"]), "year")
        least = F.least(off(instant(year)), off(instant(F.add_months(year, 6))))
        return F.struct(stamp(x["local"]).alias("local"), (F.dayofweek(day_of(x["local"])) - 1).alias("weekday"), x["minutes"].alias("offset_minutes"), (x["minutes"] > least).alias("dst"))

    return bound(F.struct(local.alias("local"), off(ts).alias("minutes")), board)
