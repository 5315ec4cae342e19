"""Time zones as a table of stretches of one offset, and joins of instants or wall times with it.

A stretch is zone, starts, ends (seconds since 1970), offset (seconds ahead of UTC). In a zone the clocks of a stretch show
wall times from starts + offset to ends + offset; those of two stretches overlap where clocks went back, and leave a gap where they
went forward. The table has a few rows a zone and year, whatever the data; it is sent to all tasks if it has at most MOST_SENT rows,
by count. Joins are on the zone and a bin of time, so that a row meets few stretches.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.time import day_of, offset_seconds, stamp, whole

#: A time beyond all others, seconds of a bin, and rows up to which a table is sent.
FOREVER, BIN, MOST_SENT = 1 << 42, 1 << 24, 200_000
#: Zones with abbreviations of their own, in winter and in summer.
ABBREVIATIONS = {
    "America/New_York": ("EST", "EDT"), "US/Eastern": ("EST", "EDT"), "America/Chicago": ("CST", "CDT"), "US/Central": ("CST", "CDT"), "America/Denver": ("MST", "MDT"), "US/Mountain": ("MST", "MDT"),
    "America/Los_Angeles": ("PST", "PDT"), "US/Pacific": ("PST", "PDT"), "America/Anchorage": ("AKST", "AKDT"), "Pacific/Honolulu": ("HST", "HST"), "America/Halifax": ("AST", "ADT"), "UTC": ("UTC", "UTC"), "Etc/UTC": ("UTC", "UTC"), "Etc/Universal": ("UTC", "UTC"),
}


def sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def known_zones(spark: SparkSession) -> DataFrame:
    """zone: the names of all zones, some hundred."""
    return spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "zone string")


def stretches(zones: DataFrame, first: str, last: str) -> DataFrame:
    """zone, starts, ends, offset of the zones (zone, known names) between two dates; the outer stretches go on without end.

    Offsets are asked at each midnight; where one differs from the next, the change is looked for by hours, minutes and seconds.
    """
    seconds = lambda d: F.unix_date(d).cast("long") * 86_400
    at = lambda t, z: offset_seconds(F.timestamp_seconds(t), z)
    day = zones.select("zone", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("_d"))
    day = day.select("zone", seconds(F.col("_d")).alias("_t")).withColumn("_o", at(F.col("_t"), F.col("zone"))).withColumn("_n", at(F.col("_t") + 86_400, F.col("zone")))
    change = day.where("_o <> _n")
    low = F.col("_t")
    for step, many in ((3600, 24), (60, 60), (1, 60)):  # the last multiple of the step that still has the old offset
        change = change.withColumn("_t", low + F.array_max(F.filter(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: at(low + k * step, F.col("zone")) == F.col("_o"))) * step)  # noqa: B023
    begun = zones.select("zone", F.lit(-FOREVER).cast("long").alias("starts"), at(seconds(F.lit(first).cast("date")), F.col("zone")).alias("offset"))
    every = begun.unionByName(change.select("zone", (F.col("_t") + 1).alias("starts"), F.col("_n").alias("offset")))
    return every.withColumn("ends", F.lead("starts", 1, FOREVER).over(Window.partitionBy("zone").orderBy("starts"))).select("zone", "starts", "ends", "offset")


def walls(table: DataFrame) -> DataFrame:
    """zone, starts, ends, offset of stretches with shows (the first wall second they show) and the wall seconds that they answer for: from `low` to before `high`, without gap or overlap.

    Of two stretches that show one wall time the earlier answers; for a wall time in a gap the later one does.
    """
    high = F.when(F.col("ends") >= FOREVER, F.col("ends")).otherwise(F.col("ends") + F.col("offset"))
    t = table.withColumn("shows", F.when(F.col("starts") <= -FOREVER, F.col("starts")).otherwise(F.col("starts") + F.col("offset"))).withColumn("high", high)
    return t.withColumn("low", F.lag("high", 1, -FOREVER).over(Window.partitionBy("zone").orderBy("starts")))


def in_stretch(df: DataFrame, table: DataFrame, zone: str, at: str, low: str, high: str, span: tuple[int, int]) -> DataFrame:
    """df with the row of `table` (zone, low, high, ..) that has its zone and `at` (seconds, in span); null where there is none. Columns of the table get `_z_` before their names."""
    first, last = (x // BIN for x in span)
    of = lambda c: F.least(F.greatest(F.floor(c / BIN), F.lit(first)), F.lit(last)).cast("long")
    binned = table.select(*[F.col(c).alias(f"_z_{c}") for c in table.columns])
    binned = binned.withColumn("_z_bin", F.explode(F.sequence(of(F.col(f"_z_{low}")), of(F.col(f"_z_{high}")))))
    meets = (F.col(zone) == F.col("_z_zone")) & (of(F.col(at)) == F.col("_z_bin")) & (F.col(at) >= F.col(f"_z_{low}")) & (F.col(at) < F.col(f"_z_{high}"))
    return df.join(sent(binned), meets, "left").drop("_z_bin", "_z_zone")


def span_of(df: DataFrame, at: str) -> tuple[int, int]:
    """Least and greatest second of a column."""
    r = df.agg(F.min(at), F.max(at)).first()
    return (r[0] or 0, r[1] or 0)


def years_around(span: tuple[int, int]) -> tuple[str, str]:
    """The first of January of the year before, and of the second year after."""
    year = lambda s: 1970 + s // 31_556_952
    return f"{max(year(span[0]) - 2, 1):04d}-01-01", f"{min(year(span[1]) + 3, 9998):04d}-01-01"


def resolved(df: DataFrame, zone: str, wall: str) -> DataFrame:
    """df with instant (seconds) and state of a wall time (seconds that a clock in UTC would show): once, twice (the earlier instant is taken) or skipped (the clocks
    go on by whole minutes to the first wall time there is); null in an unknown zone.
    """
    names = known_zones(df.sparkSession).join(df.select(F.col(zone).alias("zone")).distinct(), "zone", "left_semi")
    span = span_of(df, wall)
    table = walls(stretches(names, *years_around(span)))
    table = table.withColumn("next_shows", F.lead("shows", 1, FOREVER).over(Window.partitionBy("zone").orderBy("starts")))
    d = in_stretch(df, table, zone, wall, "low", "high", span)
    late = F.greatest(F.col("_z_shows") - F.col(wall), F.lit(0))
    minutes = whole(late + 59, 60)
    state = F.when(F.col("_z_offset").isNull(), None).when(late > 0, "skipped").when(F.col(wall) >= F.col("_z_next_shows"), "twice").otherwise("once")
    d = d.withColumn("instant", F.col(wall) + minutes * 60 - F.col("_z_offset")).withColumn("state", state)
    return d.select(*df.columns, "instant", "state")


def offset_text(minutes: Column) -> Column:
    """+08:00."""
    a = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(whole(a, 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((a % 60).cast("string"), 2, "0"))


def abbreviation(zone: Column, minutes: Column, dst: Column) -> Column:
    own = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    a = F.abs(minutes)
    plain = F.concat(F.when(minutes < 0, "GMT-").otherwise("GMT+"), whole(a, 60).cast("string"), F.when(a % 60 > 0, F.concat(F.lit(":"), F.lpad((a % 60).cast("string"), 2, "0"))).otherwise(""))
    return F.coalesce(F.get(F.try_element_at(own, zone), F.when(dst, 1).otherwise(0)), plain)


def board(requests: DataFrame, keys: list[str], at: str, zones: str) -> DataFrame:
    """A row for each line of a list of zones (an array of names) against an instant: keys, line (from 1, without empty ones), zone, number (among the
    known ones; null for an unknown zone, as is all that follows), local, weekday (0 is Sunday), offset, abbreviation, dst, delta and day_shift against the first known zone.

    dst: the offset is over the lesser of those of the local year's first of January and of July (UTC). delta: hours, or `base`.
    A list has few lines; rows meet their list's first zone by a window over the keys.
    """
    spark = requests.sparkSession
    line = F.posexplode(F.filter(F.transform(zones, lambda z: F.trim(z)), lambda z: z != ""))
    d = requests.select(*keys, F.unix_seconds(at).alias("_t"), line.alias("_p", "zone")).withColumn("line", F.col("_p") + 1).drop("_p")
    known = known_zones(spark).join(d.select("zone").distinct(), "zone", "left_semi")
    span = span_of(d, "_t")
    first, last = years_around(span)
    table = stretches(known, first, last)
    d = in_stretch(d, table, "zone", "_t", "starts", "ends", span).withColumnRenamed("_z_offset", "_o").drop("_z_starts", "_z_ends")
    # the lesser offset of January and July, by zone and year
    halves = known.select("zone", F.explode(F.sequence(F.lit(int(first[:4])), F.lit(int(last[:4])))).alias("_year"))
    halves = halves.withColumn("_h", F.explode(F.array(*[F.unix_date(F.make_date("_year", F.lit(m), F.lit(1))).cast("long") * 86_400 for m in (1, 7)])))
    least = in_stretch(halves, table, "zone", "_h", "starts", "ends", (span[0] - 3 * 31_622_400, span[1] + 4 * 31_622_400)).groupBy(F.col("zone").alias("_z"), "_year").agg(F.min("_z_offset").alias("_least"))
    local = F.timestamp_seconds(F.col("_t") + F.col("_o"))
    d = d.withColumn("_y", F.year(day_of(local))).join(sent(least), (F.col("zone") == F.col("_z")) & (F.col("_y") == F.col("_year")), "left")
    listed = Window.partitionBy(*keys).orderBy("line")
    valid = F.col("_o").isNotNull()
    d = d.withColumn("number", F.when(valid, F.count(F.when(valid, 1)).over(listed.rowsBetween(Window.unboundedPreceding, 0)).cast("int")))
    whole_list = listed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("_base", F.first("_o", ignorenulls=True).over(whole_list))
    minutes, away = whole(F.col("_o"), 60), whole(F.col("_o"), 60) - whole(F.col("_base"), 60)
    dst = minutes > whole(F.col("_least"), 60)
    hours = F.regexp_replace(F.regexp_replace(F.format_number(F.abs(away) / 60, 2), "0+$", ""), r"\.$", "")
    shift = whole(F.col("_t") + F.col("_o"), 86_400) - whole(F.col("_t") + F.col("_base"), 86_400)
    said = {
        "local": stamp(local),
        "weekday": F.dayofweek(day_of(local)) - 1,
        "offset": F.concat(F.lit("UTC"), offset_text(minutes)),
        "abbreviation": abbreviation(F.col("zone"), minutes, dst),
        "dst": dst,
        "delta": F.when(away == 0, "base").otherwise(F.concat(F.when(away > 0, "+").otherwise("−"), hours, F.lit(" h"))),
        "day_shift": F.when(shift == 0, "same day").otherwise(F.concat(F.when(shift > 0, "+").otherwise("−"), F.abs(shift).cast("string"), F.when(F.abs(shift) == 1, " day").otherwise(" days"))),
    }
    return d.select(*keys, "line", "zone", "number", *[F.when(valid, v).alias(k) for k, v in said.items()])


