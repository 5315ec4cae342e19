"""Queries of the calendar, schedule, text, network and encoding functions that have no query of their own elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import encoding as enc
from quarry.functions import fields, net, text, time
from quarry.operators import relational as rel
from quarry.operators import schedules, zones
from quarry.plans.registry import query, utc

HOLIDAYS = ["1996-01-01", "1996-05-01", "1996-12-25", "1997-01-01", "1997-12-25", "1998-01-01", "1998-05-01"]
REST_SQL = f"h AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in HOLIDAYS)}]) AS h), cal AS (SELECT g::DATE AS day, dayofweek(g) IN (0, 6) OR g::DATE IN (SELECT h FROM h) AS rest FROM generate_series(DATE '1990-01-01', DATE '2005-12-31', interval 1 day) r(g)), w AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM cal WHERE NOT rest)"


@query("orders", f"WITH {REST_SQL}, o AS (SELECT o_orderkey, o_orderdate::DATE AS d, (SELECT count(*) FROM w WHERE day <= o_orderdate::DATE) AS k, (SELECT count(*) FROM w WHERE day < o_orderdate::DATE) AS b FROM (SELECT DISTINCT ON (o_orderdate::DATE) o_orderdate FROM orders) x, (SELECT 0 AS o_orderkey)) SELECT orders.o_orderkey, a.day AS after_10, z.day AS before_3 FROM orders JOIN o ON o.d = orders.o_orderdate::DATE JOIN w a ON a.n = o.k + 10 JOIN w z ON z.n = o.b - 2")
def nth_workday(d, read):
    day = F.to_date("o_orderdate")
    return d.select("o_orderkey", rel.nth_workday(day, 10, HOLIDAYS).alias("after_10"), rel.nth_workday(day, -3, HOLIDAYS).alias("before_3"))


@query("orders", f"WITH {REST_SQL}, r AS (SELECT c.day, min(w.day) AS work FROM cal c JOIN w ON w.day BETWEEN c.day AND c.day + 28 GROUP BY 1) SELECT o_orderkey, work AS rolled FROM orders JOIN r ON r.day = o_orderdate::DATE")
def roll_to_workday(d, read):
    return d.select("o_orderkey", rel.rolled(F.to_date("o_orderdate"), HOLIDAYS).alias("rolled"))


@query("orders", f"""WITH {REST_SQL}, o AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 25)::INTEGER AS b FROM orders),
d AS (SELECT o_orderkey, day, w.day - (row_number() OVER (PARTITION BY o_orderkey ORDER BY day))::INTEGER AS g FROM o JOIN w ON day BETWEEN a AND b)
SELECT o_orderkey, min(day) AS first, max(day) AS last, count(*) AS length FROM d GROUP BY o_orderkey, g""")
def workday_ranges(d, read):
    o = d.select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 25 as int))").alias("b"))
    return rel.work_ranges(o, ["o_orderkey"], "a", "b", HOLIDAYS)


CRON_SQL = """
WITH u AS (SELECT c_custkey, TIMESTAMP '2023-01-15 10:20:30' + to_days((c_custkey % 900)::INTEGER) AS t FROM customer), c AS (SELECT g::DATE AS day FROM generate_series(DATE '2023-01-01', DATE '2034-12-31', interval 1 day) r(g) WHERE {days}),
r AS (SELECT c_custkey, t, day + to_seconds(s) AS run FROM u JOIN c ON day BETWEEN t::DATE AND t::DATE + interval 96 month, (VALUES {times}) x(s))
SELECT c_custkey, run, n FROM (SELECT c_custkey, run::TIMESTAMP AS run, (row_number() OVER (PARTITION BY c_custkey ORDER BY run))::INTEGER AS n FROM r WHERE run > t) WHERE n <= {count}"""


def cron_query(name: str, expression: str, days: str, times: str, count: int):
    def run(d, read):
        at = F.timestamp_seconds(F.lit(1_673_778_030) + F.col("c_custkey") % 900 * 86_400)  # from 2023-01-15 10:20:30 on
        return rel.cron_next(d.select("c_custkey", at.alias("t")), ["c_custkey"], "t", expression, count).withColumn("run", time.wall(F.col("run")))

    run.__name__ = name
    query("customer", CRON_SQL.format(days=days, times=times, count=count))(run)


cron_query("cron_leap_day", "0 0 29 2 *", "month(g) = 2 AND dayofmonth(g) = 29", "(0)", 2)
cron_query("cron_yearly", "@yearly", "month(g) = 1 AND dayofmonth(g) = 1", "(0)", 3)
cron_query("cron_last_weekday", "15 8 LW * *", "g = (SELECT max(x) FROM generate_series(last_day(g) - 6, last_day(g), interval 1 day) y(x) WHERE dayofweek(x) BETWEEN 1 AND 5)", "(29700)", 4)
cron_query("cron_second_monday", "0 12 * jan-jun 1#2 30", "month(g) <= 6 AND dayofweek(g) = 1 AND dayofmonth(g) BETWEEN 8 AND 14", "(43230)", 3)
cron_query("cron_day_or_week", "0,30 6 L * 5L", "g = last_day(g) OR dayofweek(g) = 5 AND month(g + interval 7 day) <> month(g)", "(21600), (23400)", 5)


#: Schedules: an expression, the days of its runs as a condition on a day g, and the seconds of the day.
SCHEDULES = [
    ("0 9 * * 1-5", "dayofweek(g) BETWEEN 1 AND 5", [32400]),
    ("30 2 * * *", "true", [9000]),
    ("15,45 1-2 * 3,10,11 0", "month(g) IN (3, 10, 11) AND dayofweek(g) = 0", [4500, 6300, 8100, 9900]),
    ("0 0 29 2 *", "month(g) = 2 AND day(g) = 29", [0]),
    ("15 8 LW * *", "g = (SELECT max(x) FROM generate_series(last_day(g) - 6, last_day(g), interval 1 day) y(x) WHERE dayofweek(x) BETWEEN 1 AND 5)", [29700]),
    ("0 12 * 1-6 1#2 30", "month(g) <= 6 AND dayofweek(g) = 1 AND day(g) BETWEEN 8 AND 14", [43230]),
    ("0,30 6 L * 5L", "g = last_day(g) OR dayofweek(g) = 5 AND month(g + interval 7 day) <> month(g)", [21600, 23400]),
    ("@Weekly", "dayofweek(g) = 0", [0]),
    ("*/20 23 13-31/9 */5 7", "month(g) IN (1, 6, 11) AND (day(g) IN (13, 22, 31) OR dayofweek(g) = 0)", [82800, 84000, 85200]),
    ("0 0 30 2 *", "false", [0]),
    ("60 * * * *", "false", [0]),
    ("0 4 1W * ?", "g = (SELECT CASE dayofweek(f) WHEN 6 THEN f + interval 2 day WHEN 0 THEN f + interval 1 day ELSE f END FROM (SELECT date_trunc('month', g) AS f))", [14400]),
]
SCHEDULE_ZONES = ["America/New_York", "Europe/Berlin", "UTC", "Asia/Kolkata", "Australia/Lord_Howe"]
#: A clock's change to summer time leaves wall times out, which aren't runs; of a wall time that is shown twice the first is.
SCHEDULE_SQL = f"""
WITH d AS (SELECT g::DATE AS g FROM generate_series(DATE '2022-12-31', DATE '2033-12-31', interval 1 day) r(g)),
s AS ({" UNION ALL ".join(f"SELECT {k} AS s, g, unnest({seconds}) AS sec FROM d WHERE {days}" for k, (_, days, seconds) in enumerate(SCHEDULES))}),
w AS (SELECT s, zone, g + to_seconds(sec) AS wall FROM s, (SELECT unnest({SCHEDULE_ZONES}) AS zone)),
i AS (SELECT s, zone, wall, timezone('UTC', least(timezone(zone, wall), CASE WHEN timezone(zone, timezone(zone, wall) - interval 1 hour) = wall THEN timezone(zone, wall) - interval 1 hour ELSE timezone(zone, wall) END, CASE WHEN timezone(zone, timezone(zone, wall) - interval 30 minute) = wall THEN timezone(zone, wall) - interval 30 minute ELSE timezone(zone, wall) END)) AS run FROM w WHERE timezone(zone, timezone(zone, wall)) = wall),
c AS (SELECT o_orderkey, o_orderkey % {len(SCHEDULES)} AS s, {SCHEDULE_ZONES}[o_orderkey // 7 % {len(SCHEDULE_ZONES)} + 1] AS zone, TIMESTAMP '2023-01-15 10:20:30' + to_days((o_orderkey % 900)::INTEGER) AS t, o_orderkey % 4 + 1 AS many FROM orders),
n AS (SELECT s, zone, wall, run, row_number() OVER (PARTITION BY s, zone ORDER BY run) AS k FROM i),
f AS (SELECT c.*, (SELECT min(k) FROM n WHERE n.s = c.s AND n.zone = c.zone AND n.run > c.t) AS k FROM c)
SELECT o_orderkey, (n.k - f.k + 1)::INTEGER AS n, n.run::TIMESTAMP AS run, strftime(n.wall, '%Y-%m-%d %H:%M:%S') AS local FROM f JOIN n ON n.s = f.s AND n.zone = f.zone AND n.k >= f.k AND n.k < f.k + many WHERE n.wall::DATE <= timezone(f.zone, timezone('UTC', f.t))::DATE + interval 96 month"""


@query("orders", SCHEDULE_SQL)
def schedule_runs(d, read):
    """An expression, a zone, a start and a number of runs for each order."""
    k = F.col("o_orderkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    rows = d.select("o_orderkey", pick([x[0] for x in SCHEDULES], k % len(SCHEDULES)).alias("expression"), pick(SCHEDULE_ZONES, F.floor(k / 7) % len(SCHEDULE_ZONES)).alias("zone"), F.timestamp_seconds(F.lit(1_673_778_030) + k % 900 * 86_400).alias("start"), (k % 4 + 1).alias("runs"))
    return schedules.schedule_runs(rows, ["o_orderkey"], "expression", "start", "zone", "runs").withColumn("run", time.wall(F.col("run")))


STATUSES = [("0 9 * * 1-5", "UTC", "ok"), (" @DAILY ", None, "ok"), ("* * * * * 59", "", "ok"), ("@reboot", "UTC", "reboot"), ("", "UTC", "expression"), (None, "UTC", "expression"), ("1 2 3", "UTC", "fields"), ("60 * * * *", "UTC", "minute"), ("* 5-3 * * *", "UTC", "hour"), ("* * 32W * *", "UTC", "day"), ("* * 1,L * *", "UTC", "day"), ("* * * 0 *", "UTC", "month"), ("* * * ? *", "UTC", "month"), ("* * * * 8", "UTC", "weekday"), ("* * * * 1#6", "UTC", "weekday"), ("* * * * 7L", "UTC", "ok"), ("* * * * * */0", "UTC", "second"), ("0 9 * * *", "Mars/Base", "zone"), ("x 9 * * *", "Mars/Base", "zone")]


@query("lineitem", f"SELECT l_orderkey, l_linenumber, {[x[2] for x in STATUSES]}[(l_orderkey * 7 + l_linenumber) % {len(STATUSES)} + 1] AS status FROM lineitem")
def schedule_statuses(d, read):
    pick = lambda at: F.get(F.array(*[F.lit(x[at]) for x in STATUSES]), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(STATUSES)).cast("int"))
    return schedules.schedule_status(d.select("l_orderkey", "l_linenumber", pick(0).alias("x"), pick(1).alias("z")), ["l_orderkey", "l_linenumber"], "x", "z")


BOARDS = [["Asia/Shanghai", "America/New_York", " ", "Europe/London", "Nowhere"], ["Nowhere", "Australia/Lord_Howe", "UTC", "Asia/Kolkata", "US/Pacific"], ["Pacific/Auckland", "America/Sao_Paulo"]]


@query("orders", f"""
WITH c AS (SELECT o_orderkey, o_orderdate + to_minutes((o_orderkey * 37 % 1440)::INTEGER) AS t, {BOARDS}[o_orderkey % {len(BOARDS)} + 1] AS z FROM orders),
l AS (SELECT o_orderkey, t, unnest(list_filter(z, lambda x: trim(x) <> '')) AS zone, unnest(range(1, len(list_filter(z, lambda x: trim(x) <> '')) + 1)) AS line FROM c),
k AS (SELECT *, zone <> 'Nowhere' AS valid, CASE WHEN zone <> 'Nowhere' THEN zone ELSE 'UTC' END AS zz FROM l),
m AS (SELECT *, timezone(zz, timezone('UTC', t)) AS local FROM k),
o AS (SELECT *, date_diff('minute', t, local) AS minutes, date_diff('minute', date_trunc('year', local), timezone(zz, timezone('UTC', date_trunc('year', local)))) AS jan, date_diff('minute', date_trunc('year', local) + interval 6 month, timezone(zz, timezone('UTC', date_trunc('year', local) + interval 6 month))) AS jul FROM m),
b AS (SELECT *, minutes > least(jan, jul) AS dst, count(*) FILTER (valid) OVER (PARTITION BY o_orderkey ORDER BY line) AS number, first(CASE WHEN valid THEN minutes END IGNORE NULLS) OVER w AS base, first(CASE WHEN valid THEN local END IGNORE NULLS) OVER w AS base_local FROM o WINDOW w AS (PARTITION BY o_orderkey ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, minutes - base AS away, date_diff('day', base_local::DATE, local::DATE) AS shift FROM b)
SELECT o_orderkey, line::INTEGER AS line, zone, CASE WHEN valid THEN number::INTEGER END AS number, CASE WHEN valid THEN strftime(local, '%Y-%m-%d %H:%M:%S') END AS local, CASE WHEN valid THEN dayofweek(local)::INTEGER END AS weekday,
  CASE WHEN valid THEN 'UTC' || CASE WHEN minutes < 0 THEN '-' ELSE '+' END || lpad((abs(minutes) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(minutes) % 60)::VARCHAR, 2, '0') END AS "offset",
  CASE WHEN valid THEN CASE zone WHEN 'America/New_York' THEN CASE WHEN dst THEN 'EDT' ELSE 'EST' END WHEN 'US/Pacific' THEN CASE WHEN dst THEN 'PDT' ELSE 'PST' END WHEN 'UTC' THEN 'UTC' ELSE 'GMT' || CASE WHEN minutes < 0 THEN '-' ELSE '+' END || (abs(minutes) // 60) || CASE WHEN minutes % 60 <> 0 THEN ':' || lpad((abs(minutes) % 60)::VARCHAR, 2, '0') ELSE '' END END END AS abbreviation,
  CASE WHEN valid THEN dst END AS dst, CASE WHEN valid THEN CASE WHEN away = 0 THEN 'base' ELSE CASE WHEN away > 0 THEN '+' ELSE '−' END || (abs(away) // 60) || CASE WHEN abs(away) % 60 = 30 THEN '.5' WHEN abs(away) % 60 = 45 THEN '.75' ELSE '' END || ' h' END END AS delta,
  CASE WHEN valid THEN CASE WHEN shift = 0 THEN 'same day' ELSE CASE WHEN shift > 0 THEN '+' ELSE '−' END || abs(shift) || CASE WHEN abs(shift) = 1 THEN ' day' ELSE ' days' END END END AS day_shift
FROM e""")
def zone_boards(d, read):
    """An instant and a list of zones for each order; some lines are empty, or no zone."""
    k = F.col("o_orderkey")
    at = F.timestamp_micros(F.unix_micros(utc("o_orderdate")) + k * 37 % 1440 * 60_000_000)
    rows = d.select("o_orderkey", at.alias("at"), F.get(F.array(*[F.array(*map(F.lit, b)) for b in BOARDS]), (k % len(BOARDS)).cast("int")).alias("zones"))
    return zones.board(rows, ["o_orderkey"], "at", "zones")


@query("orders", """
WITH w AS (SELECT o_orderkey, ['Europe/Berlin', 'America/New_York', 'Australia/Lord_Howe'][o_orderkey % 3 + 1] AS zone, o_orderdate + to_minutes((o_orderkey % 32 * 10)::INTEGER) AS wall FROM orders),
t AS (SELECT *, timezone(zone, wall) AS a FROM w),
c AS (SELECT *, list_filter([a - interval 1 hour, a - interval 30 minute, a, a + interval 30 minute, a + interval 1 hour], lambda x: timezone(zone, x) = wall) AS fits FROM t),
g AS (SELECT *, (SELECT min(k) FROM range(1, 181) r(k) WHERE len(fits) = 0 AND timezone(zone, timezone(zone, wall + to_minutes(k::INTEGER))) = wall + to_minutes(k::INTEGER)) AS later FROM c)
SELECT o_orderkey, zone, timezone('UTC', CASE WHEN len(fits) > 0 THEN list_min(fits) ELSE timezone(zone, wall + to_minutes(later::INTEGER)) END) AS instant, CASE len(fits) WHEN 0 THEN 'skipped' WHEN 1 THEN 'once' ELSE 'twice' END AS state FROM g""")
def wall_times(d, read):
    """Wall times of the first hours of each order's day, which clocks may skip or show twice."""
    k = F.col("o_orderkey")
    zone = F.get(F.array(F.lit("Europe/Berlin"), F.lit("America/New_York"), F.lit("Australia/Lord_Howe")), (k % 3).cast("int"))
    rows = d.select("o_orderkey", zone.alias("zone"), (F.unix_seconds(utc("o_orderdate")) + k % 32 * 600).alias("wall"))
    return zones.resolved(rows, "zone", "wall").select("o_orderkey", "zone", time.wall(F.timestamp_seconds("instant")).alias("instant"), "state")


@query("documents", """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, md5(coalesce(text, '')) AS m FROM documents),
bits AS (SELECT doc_id, list_aggregate(list_transform(string_split(h, ''), lambda x: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][(strpos('0123456789ABCDEF', x))::BIGINT]), 'string_agg', '') AS b FROM t WHERE h <> ''),
signs AS (SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(b, '.{1,5}'), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_position(five, rpad(g, 5, '0')), 1)), 'string_agg', '') AS s
  FROM bits, (SELECT list(lpad(bin(i), 5, '0') ORDER BY i) AS five FROM range(32) r(i))),
n AS (SELECT doc_id, m, ('0x' || m)::UHUGEINT AS v, '' AS s FROM t UNION ALL SELECT doc_id, m, v // 58, substr('123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz', (v % 58 + 1)::BIGINT, 1) || s FROM n WHERE v > 0)
SELECT t.doc_id, coalesce(signs.s, '') AS b32, repeat('1', (length(t.m) - length(ltrim(t.m, '0'))) // 2) || n.s AS b58, CASE WHEN t.t <> '' THEN t.t END AS b32_back, CASE WHEN t.t <> '' THEN t.t END AS b36_back
FROM t JOIN n USING (doc_id) LEFT JOIN signs USING (doc_id) WHERE n.v = 0""")
def radix_round_trip(d, read):
    """Whole texts in base 32 and back, small letters read too, and in base 36 and back; their digests in base 58."""
    t = d.select("doc_id", enc.as_bytes(F.coalesce("text", F.lit(""))).alias("b")).withColumn("b32", enc.radix(F.col("b"), enc.BASE32))
    return t.select("doc_id", "b32", enc.radix(F.unhex(F.md5("b")), enc.BASE58).alias("b58"), enc.from_radix(F.lower("b32"), enc.BASE32).cast("string").alias("b32_back"), enc.from_radix(enc.radix(F.col("b"), enc.BASE36), enc.BASE36).cast("string").alias("b36_back"))


@query("customer", """
WITH RECURSIVE n AS (SELECT c_custkey, c_custkey + 1000 AS v, '' AS s FROM customer UNION ALL SELECT c_custkey, v // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (v % 36 + 1)::INTEGER, 1) || s FROM n WHERE v > 0),
m AS (SELECT c_custkey, c_custkey + 1000 AS v, '' AS s FROM customer UNION ALL SELECT c_custkey, v // 58, substr('123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz', (v % 58 + 1)::INTEGER, 1) || s FROM m WHERE v > 0)
SELECT n.c_custkey, n.s AS base36, m.s AS base58 FROM n JOIN m USING (c_custkey) WHERE n.v = 0 AND m.v = 0""")
def radix_numbers(d, read):
    """A number's bytes without zeros before them, in other bases."""
    h = F.hex(F.col("c_custkey") + 1000)
    b = F.unhex(F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h))
    return d.select("c_custkey", enc.radix(b, enc.BASE36).alias("base36"), enc.radix(b, enc.BASE58).alias("base58"))


#: Each character that has a name, with the name, as text of the SQL.
NAMED_SQL = ", ".join(f"({ord(c)}, '{name}')" for c, name in enc.ENTITIES.items())


@query("documents", rf"""
WITH names AS (SELECT map_from_entries(list((c, n))) AS named FROM (VALUES {NAMED_SQL}) v(c, n)),
t AS (SELECT doc_id, '€' || chr((160 + doc_id % 700)::INTEGER) || coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, t, string_split(t, '') AS c FROM t)
SELECT doc_id, list_aggregate(list_transform(c, lambda x: CASE WHEN unicode(x) < 128 THEN x WHEN unicode(x) < 65536 THEN '\u' || lower(printf('%04X', unicode(x))) ELSE '\u' || lower(printf('%04X', 55296 + (unicode(x) - 65536) // 1024)) || '\u' || lower(printf('%04X', 56320 + (unicode(x) - 65536) % 1024)) END), 'string_agg', '') AS escaped, t AS back,
  list_aggregate(list_transform(c, lambda x: CASE WHEN named[unicode(x)] IS NOT NULL THEN '&' || named[unicode(x)] || ';' WHEN unicode(x) BETWEEN 32 AND 126 THEN x ELSE '&#' || unicode(x) || ';' END), 'string_agg', '') AS html, t AS html_back FROM c, names""")
def unicode_escape(d, read):
    """Whole texts, behind two characters that aren't ASCII, escaped in two ways and read again."""
    code = F.lpad(F.hex(160 + F.col("doc_id") % 700), 8, "0")
    t = d.select("doc_id", F.concat(F.lit("€"), F.decode(F.unhex(code), "UTF-32"), F.coalesce("text", F.lit(""))).alias("t"))
    t = t.withColumn("escaped", enc.escape_unicode(F.col("t"))).withColumn("html", enc.escape_html(F.col("t")))
    return t.select("doc_id", "escaped", enc.unescape_unicode(F.col("escaped")).alias("back"), "html", enc.unescape_html(F.col("html")).alias("html_back"))


@query("nation", "SELECT n_nationkey, n_name AS back, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'é' END AS other FROM nation")
def binary_decode(d, read):
    return d.select("n_nationkey", enc.from_binary_text(enc.binary_text(F.col("n_name"))).alias("back"), enc.from_binary_text(F.when(F.col("n_nationkey") % 2 == 0, "0101012").otherwise("11000011, 10101001")).alias("other"))


@query("customer", """
SELECT c_custkey, '0000:0000:0000:' || lpad(printf('%x', c_custkey % 65536), 4, '0') || ':0000:0000:' || lpad(printf('%x', c_custkey * 7 % 65536), 4, '0') || ':0001' AS full_form,
  CASE WHEN c_custkey % 65536 = 0 THEN '::1' ELSE '::' || printf('%x', c_custkey % 65536) || ':0:0:' || printf('%x', c_custkey * 7 % 65536) || ':1' END AS short FROM customer""")
def ipv6_convert(d, read):
    h = lambda c: F.lower(F.hex(c))
    written = F.concat(F.lit("0:0::"), h(F.col("c_custkey") % 65536), F.lit(":00:0:"), h(F.col("c_custkey") * 7 % 65536), F.lit(":1"))
    return d.select("c_custkey", net.ipv6_expand(written).alias("full_form"), net.ipv6_compress(written).alias("short"))


@query("customer", "SELECT c_custkey, 'v=spf1 mx' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ip4:10.0.0.' || c_custkey % 256 END || ' include:' || lower(c_mktsegment) || '.example ~all' AS spf, 'v=DMARC1; p=' || CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'reject' ELSE 'quarantine' END || '; pct=' || least(100, c_custkey % 130) || CASE WHEN c_custkey % 2 = 0 THEN '; rua=mailto:a' || c_custkey || '@x.example' ELSE '' END AS dmarc FROM customer")
def mail_records(d, read):
    k = F.col("c_custkey")
    ip = F.when(k % 3 != 0, F.array(F.concat(F.lit(" 10.0.0."), (k % 256).cast("string"))))
    spf = net.spf_record(True, False, ip, F.array(F.concat(F.lower("c_mktsegment"), F.lit(".example"))))
    policy = F.when(k % 4 == 0, "none").when(k % 4 == 1, "reject").otherwise("odd")
    mail = F.when(k % 2 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit("@x.example"))).otherwise("no mail")
    return d.select("c_custkey", spf.alias("spf"), net.dmarc_record(policy, (k % 130).cast("int"), mail).alias("dmarc"))


@query("nation", "SELECT n_nationkey, 'User-agent: *' || chr(10) || 'Allow: /' || lower(n_name) || chr(10) || 'Disallow: /x' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'Sitemap: https://h/' || n_nationkey ELSE '' END AS robots FROM nation")
def robots_file(d, read):
    site = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "https://h/").otherwise("ftp://h/"), F.col("n_nationkey").cast("string"))
    return d.select("n_nationkey", net.robots_txt(F.lit("*"), F.array(F.lower("n_name")), F.array(F.lit("/x")), site).alias("robots"))


AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0.1 Safari/537.36 EDG/119.2", "Microsoft Edge 119.2", "Windows 10/11", "Desktop"),
    ("Mozilla/5.0 (Linux; Android 13; Pixel) AppleWebKit/537.36 Chrome/118.0 Mobile Safari/537.36", "Chrome 118.0", "Android 13", "Mobile"),
    ("Mozilla/5.0 (iPad; CPU OS 16_1 like Mac OS X) CriOS/117.0 Mobile Safari/604.1", "Chrome 117.0", "iOS / iPadOS", "Tablet"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Version/16.1 Safari/605.1.15", "Safari 16.1", "macOS 10.15.7", "Desktop"),
    ("Opera/9.80 (X11; Linux x86_64) Presto/2.12", "Opera 9.80", "Linux", "Desktop"),
    ("Mozilla/5.0 (Windows NT 6.1) Gecko Firefox/115.0", "Firefox 115.0", "Windows 7", "Desktop"),
    ("curl/8.1", "Unknown", "Unknown", "Unknown"),
]


@query("events", f"SELECT event_id, b AS browser, s AS system, v AS device FROM events JOIN (VALUES {', '.join(str((k, *a[1:])) for k, a in enumerate(AGENTS))}) x(k, b, s, v) ON k = event_id % {len(AGENTS)}")
def user_agents(d, read):
    agent = F.element_at(F.array(*[F.lit(a[0]) for a in AGENTS]), (F.col("event_id") % len(AGENTS) + 1).cast("int"))
    return d.select("event_id", net.user_agent(agent).alias("u")).select("event_id", "u.*")


PHRASE_SQL = ", ".join(f"CASE WHEN ms = 0 THEN '{now}' {named} WHEN ms < 0 THEN {before} ELSE {after} END AS {name}" for name, now, named, before, after in [
    ("phrase", "now", "WHEN k = 1 AND unit = 'day' THEN CASE WHEN ms < 0 THEN 'yesterday' ELSE 'tomorrow' END WHEN k = 1 AND unit IN ('week', 'month', 'year') THEN CASE WHEN ms < 0 THEN 'last ' ELSE 'next ' END || unit", "k || ' ' || unit || s || ' ago'", "'in ' || k || ' ' || unit || s"),
    ("counted", "in 0 seconds", "", "k || ' ' || unit || s || ' ago'", "'in ' || k || ' ' || unit || s"),
    ("chinese", "现在", "WHEN k = 1 AND unit = 'day' THEN CASE WHEN ms < 0 THEN '昨天' ELSE '明天' END WHEN k = 1 AND unit = 'week' THEN CASE WHEN ms < 0 THEN '上周' ELSE '下周' END WHEN k = 1 AND unit = 'month' THEN CASE WHEN ms < 0 THEN '上个月' ELSE '下个月' END WHEN k = 1 AND unit = 'year' THEN CASE WHEN ms < 0 THEN '去年' ELSE '明年' END", "k || zh || '前'", "k || zh || '后'"),
])


@query("orders", f"""
WITH m AS (SELECT o_orderkey, (o_orderkey * 37 % 101 - 50) * (o_orderkey % 13) * (CASE o_orderkey % 5 WHEN 0 THEN 300 WHEN 1 THEN 41000 WHEN 2 THEN 1000000 WHEN 3 THEN 17000000 ELSE 900000000 END)::BIGINT AS ms FROM orders),
p AS (SELECT *, abs(ms) AS a FROM m), u AS (SELECT *, CASE WHEN a < 60000 THEN 'second' WHEN a < 3600000 THEN 'minute' WHEN a < 86400000 THEN 'hour' WHEN a < 604800000 THEN 'day' WHEN a < 2592000000 THEN 'week' WHEN a < 31536000000 THEN 'month' ELSE 'year' END AS unit FROM p),
n AS (SELECT *, greatest(1, CASE unit WHEN 'second' THEN (a + 500) // 1000 WHEN 'minute' THEN (a + 30000) // 60000 WHEN 'hour' THEN (a + 1800000) // 3600000 WHEN 'day' THEN a // 86400000 WHEN 'week' THEN a // 604800000 WHEN 'month' THEN a // 2592000000 ELSE a // 31536000000 END) AS k,
  CASE unit WHEN 'second' THEN '秒' WHEN 'minute' THEN '分钟' WHEN 'hour' THEN '小时' WHEN 'day' THEN '天' WHEN 'week' THEN '周' WHEN 'month' THEN '个月' ELSE '年' END AS zh FROM u),
t AS (SELECT *, CASE WHEN k = 1 THEN '' ELSE 's' END AS s FROM n)
SELECT o_orderkey, {PHRASE_SQL} FROM t""")
def relative_time(d, read):
    k = F.col("o_orderkey")
    ms = (k * 37 % 101 - 50) * (k % 13) * F.when(k % 5 == 0, 300).when(k % 5 == 1, 41_000).when(k % 5 == 2, 1_000_000).when(k % 5 == 3, 17_000_000).otherwise(900_000_000)
    return d.select("o_orderkey", ms.alias("ms")).select("o_orderkey", time.relative_phrase(F.col("ms")).alias("phrase"), time.relative_phrase(F.col("ms"), named=False).alias("counted"), time.relative_phrase(F.col("ms"), "zh").alias("chinese"))


@query("lineitem", """
WITH t AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 977 + l_partkey * 31) * (CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 60 ELSE 2000 END) * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) AS ms FROM lineitem),
p AS (SELECT *, abs(ms) AS a, abs(ms) // 86400000 AS d, abs(ms) // 3600000 % 24 AS h, abs(ms) // 60000 % 60 AS m, abs(ms) // 1000 % 60 AS s, abs(ms) % 1000 AS f FROM t)
SELECT l_orderkey, l_linenumber,
  CASE WHEN ms < 0 THEN '-' ELSE '' END || CASE WHEN a = 0 THEN '0 seconds' ELSE concat_ws(', ', CASE WHEN d > 0 THEN d || CASE WHEN d = 1 THEN ' day' ELSE ' days' END END, CASE WHEN h > 0 THEN h || CASE WHEN h = 1 THEN ' hour' ELSE ' hours' END END, CASE WHEN m > 0 THEN m || CASE WHEN m = 1 THEN ' minute' ELSE ' minutes' END END, CASE WHEN s > 0 THEN s || ' seconds' END, CASE WHEN f > 0 THEN f || CASE WHEN f = 1 THEN ' millisecond' ELSE ' milliseconds' END END) END AS words,
  CASE WHEN ms < 0 THEN '负 ' ELSE '' END || CASE WHEN a = 0 THEN '0秒' ELSE concat_ws(' ', CASE WHEN d > 0 THEN d || '天' END, CASE WHEN h > 0 THEN h || '小时' END, CASE WHEN m > 0 THEN m || '分' END, CASE WHEN s > 0 THEN s || '秒' END, CASE WHEN f > 0 THEN f || '毫秒' END) END AS chinese,
  CASE WHEN a >= 604800000 THEN (a + 302400000) // 604800000 || ' week' || CASE WHEN (a + 302400000) // 604800000 = 1 THEN '' ELSE 's' END WHEN a >= 86400000 THEN (a + 43200000) // 86400000 || ' day' || CASE WHEN (a + 43200000) // 86400000 = 1 THEN '' ELSE 's' END
    WHEN a >= 3600000 THEN (a + 1800000) // 3600000 || ' hour' || CASE WHEN (a + 1800000) // 3600000 = 1 THEN '' ELSE 's' END WHEN a >= 60000 THEN (a + 30000) // 60000 || ' minute' || CASE WHEN (a + 30000) // 60000 = 1 THEN '' ELSE 's' END ELSE (a + 500) // 1000 || ' second' || CASE WHEN (a + 500) // 1000 = 1 THEN '' ELSE 's' END END AS spoken
FROM p""")
def duration_words(d, read):
    n = F.col("l_linenumber")
    ms = (F.col("l_orderkey") * 977 + F.col("l_partkey") * 31) * F.when(n % 3 == 0, 1).when(n % 3 == 1, 60).otherwise(2000) * F.when(n % 2 == 0, -1).otherwise(1)
    t = d.select("l_orderkey", "l_linenumber", ms.alias("ms"))
    return t.select("l_orderkey", "l_linenumber", time.duration_words(F.col("ms")).alias("words"), time.duration_words(F.col("ms"), "zh", " ").alias("chinese"), time.duration_spoken(F.col("ms")).alias("spoken"))


@query("customer", "SELECT c_custkey, c_acctbal::DECIMAL(20,2) AS amount FROM customer")
def amount_round_trip(d, read):
    """Balances as words in capital numerals, read back as numbers."""
    return d.select("c_custkey", text.amount_of_words(text.amount_in_words(F.col("c_acctbal").cast("decimal(18,2)"))).alias("amount"))


@query("customer", """
WITH n AS (SELECT c_custkey, c_custkey % 90 + 10 AS v FROM customer), s AS (SELECT *, '零壹贰叁肆伍陆柒捌玖' AS z FROM n)
SELECT c_custkey, substr(z, (v // 10 + 1)::INTEGER, 1) || '拾' || CASE WHEN v % 10 > 0 THEN substr(z, (v % 10 + 1)::INTEGER, 1) ELSE '' END || '万元整' AS words FROM s""")
def amount_words(d, read):
    return d.select("c_custkey", text.amount_in_words(((F.col("c_custkey") % 90 + 10) * 10_000).cast("decimal(18,2)")).alias("words"))


@query("part", "SELECT p_partkey, CASE WHEN n = 1 THEN f ELSE regexp_extract(f, '^(.*)\\.pdf$', 1) || ' (' || n || ').pdf' END AS name FROM (SELECT p_partkey, f, row_number() OVER (PARTITION BY p_size, f ORDER BY p_partkey) AS n FROM (SELECT p_partkey, p_size, p_brand || '.v1.pdf' AS f FROM part))")
def unique_file_names(d, read):
    files = d.select("p_partkey", "p_size", F.concat("p_brand", F.lit(".v1.pdf")).alias("f"))
    return text.unique_names(files, ["p_size"], "f", [F.col("p_partkey")]).select("p_partkey", F.col("unique_name").alias("name"))


@query("part", "SELECT p_partkey, p_brand || '-split-' || lpad(p_size::VARCHAR, greatest(2, length(p_size::VARCHAR))::INTEGER, '0') || '_' || p_partkey || ' 20240102.pdf' AS name, p_brand || '-t.txt' AS plain FROM part")
def output_names(d, read):
    at = F.lit("2024-01-02").cast("timestamp")
    name = text.output_name("-{name}._{tool}--{i}_{total}  {date}_", F.col("p_brand"), "split", "pdf", F.col("p_size"), F.col("p_partkey"), at=at)
    return d.select("p_partkey", name.alias("name"), text.output_name(None, F.col("p_brand"), "t", "txt").alias("plain"))


@query("customer", "SELECT c_custkey, k AS kind, w AS width_mm, p AS width_px, i AS dpi FROM customer LEFT JOIN (VALUES (0, 'one-inch', 25, 295, 300), (1, 'us-visa', 51, 600, 300), (2, 'china-id-card', 26, 358, 350), (3, 'canada-passport', 50, 591, 300)) v(m, k, w, p, i) ON m = c_custkey % 5")
def photo_sizes(d, read):
    kinds = F.array(*map(F.lit, ["one-inch", "us-visa", "china-id-card", "canada-passport", "no-such"]))
    sized = text.with_photo_size(d.withColumn("kind", F.element_at(kinds, (F.col("c_custkey") % 5 + 1).cast("int"))), "kind")
    return sized.select("c_custkey", F.when(F.col("dpi").isNotNull(), F.col("kind")).alias("kind"), "width_mm", "width_px", "dpi")


@query("events", "SELECT event_id, replace(props, ': ', ':') AS small, '{' || chr(10) || '   ' || props[2:-2] || chr(10) || '}' AS wide FROM events")
def json_format(d, read):
    return d.select("event_id", text.json_text(F.col("props")).alias("small"), text.json_text(F.col("props"), 3).alias("wide"))


@query("events", "SELECT event_id, true AS v4, lpad(printf('%x', 1700000000000 + event_id), 12, '0')[1:8] || '-' || lpad(printf('%x', 1700000000000 + event_id), 12, '0')[9:12] || '-7' AS v7, '00000000000000000000000000000000' AS nil FROM events")
def identifiers(d, read):
    v7 = text.uuid_text("v7", at_millis=F.lit(1_700_000_000_000) + F.col("event_id"))
    return d.select("event_id", text.uuid_text("v4", "upper").rlike("^[0-9A-F]{8}-[0-9A-F]{4}-4[0-9A-F]{3}-[89AB][0-9A-F]{3}-[0-9A-F]{12}$").alias("v4"), F.substring(v7, 1, 15).alias("v7"), text.uuid_text("nil", "bare").alias("nil"))


@query("pages", r"""
WITH q AS (SELECT page_id, url, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages WHERE url LIKE '%?%')
SELECT page_id, regexp_extract(p, '^([^=]*)', 1) AS name, regexp_extract(p, '=(.*)$', 1) AS value, url || '&k%20=' || page_id AS longer FROM q WHERE p <> ''""")
def url_pairs(d, read):
    longer = net.with_query(F.col("url"), F.array(F.struct(F.lit("k ").alias("name"), F.col("page_id").cast("string").alias("value"))))
    pairs = d.select("page_id", longer.alias("longer"), F.explode(net.query_pairs(net.url_parts(F.col("url"))["query"])).alias("p"))
    return pairs.select("page_id", "p.name", "p.value", "longer")


@query("benchmark", f"SELECT item_id, sha256(unhex('{bytes(b ^ 0x5C for b in b'key'.ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in b'key'.ljust(64, bytes(1))).hex()}') || encode(text)))) AS mac, md5(unhex('{bytes(b ^ 0x5C for b in b'key'.ljust(64, bytes(1))).hex()}') || unhex(md5(unhex('{bytes(b ^ 0x36 for b in b'key'.ljust(64, bytes(1))).hex()}') || encode(text)))) AS mac_md5 FROM benchmark")
def hmac_with_key(d, read):
    t = enc.as_bytes(F.col("text"))
    return d.select("item_id", enc.hmac(t, "key").alias("mac"), enc.hmac(t, "key", "md5").alias("mac_md5"))


@query("orders", """
WITH RECURSIVE o AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey * 37 % 900)::INTEGER AS b FROM orders),
y AS (SELECT o_orderkey, a::TIMESTAMP AS a, b, 0 AS n FROM o UNION ALL SELECT o_orderkey, a + interval 1 year, b, n + 1 FROM y WHERE a + interval 1 year <= b),
z AS (SELECT o_orderkey, a, b, n AS years FROM y QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC) = 1),
m AS (SELECT *, 0 AS n FROM z UNION ALL SELECT o_orderkey, a + interval 1 month, b, years, n + 1 FROM m WHERE a + interval 1 month <= b),
r AS (SELECT *, date_diff('day', a, b::TIMESTAMP) AS rest FROM m QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC) = 1)
SELECT o_orderkey, years::INTEGER AS years, n::INTEGER AS months, (rest // 7)::INTEGER AS weeks, (rest % 7)::INTEGER AS days,
  CASE WHEN years + n + rest = 0 THEN '0s' ELSE CASE WHEN o_orderkey * 37 % 900 > 0 THEN '-' ELSE '' END || concat_ws(' ', CASE WHEN years > 0 THEN years || 'y' END, CASE WHEN n > 0 THEN n || 'mo' END, CASE WHEN rest >= 7 THEN (rest // 7) || 'w' END, CASE WHEN rest % 7 > 0 THEN (rest % 7) || 'd' END) END AS said FROM r""")
def date_breakdown(d, read):
    t = utc("o_orderdate")
    later = time.instant(F.date_add(time.day_of(t), (F.col("o_orderkey") * 37 % 900).cast("int")))
    spans = d.select("o_orderkey", time.calendar_span(later, time.instant(time.day_of(t))).alias("s"))
    return spans.select("o_orderkey", "s.years", "s.months", "s.weeks", "s.days", time.span_text(F.col("s")).alias("said"))


@query("customer", "SELECT c_custkey, CASE WHEN abs(c_acctbal) < 0.005 THEN '0' ELSE regexp_replace(regexp_replace(CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:,.2f}', abs(c_acctbal)), '0+$', ''), '\\.$', '') END AS said FROM customer")
def number_texts(d, read):
    return d.select("c_custkey", time.number_text(F.col("c_acctbal")).alias("said"))


@query("orders", "SELECT o_orderkey, timezone('UTC', timezone('Europe/Berlin', o_orderdate + interval 12 hour)) AS berlin, timezone('UTC', timezone('America/New_York', o_orderdate + interval 12 hour)) AS new_york FROM orders")
def local_instants(d, read):
    noon = F.timestamp_seconds(F.unix_seconds(utc("o_orderdate")) + 43_200)
    return d.select("o_orderkey", *[time.wall(time.local_to_instant(noon, z)).alias(k) for k, z in (("berlin", "Europe/Berlin"), ("new_york", "America/New_York"))])


@query("events", """
SELECT event_id, to_base64(encode('{"alg":"HS256","typ":"JWT"}')) IS NOT NULL AS decoded, 's' || user_id AS sub, (2000 + event_id)::BIGINT AS exp, CASE WHEN 2500 - 10 > 2000 + event_id THEN 'expired' WHEN event_id % 3 = 0 THEN 'invalid-signature' ELSE 'valid' END AS status FROM events""")
def jwt_tokens(d, read):
    """Tokens signed here by two secrets, read with one of them."""
    part = lambda t: F.regexp_replace(enc.base64(enc.as_bytes(t), urlsafe=True), "=+$", "")
    head = part(F.lit('{"alg":"HS256","typ":"JWT"}'))
    body = part(F.concat(F.lit('{"sub":"s'), F.col("user_id").cast("string"), F.lit('","exp":'), (F.col("event_id") + 2000).cast("string"), F.lit("}")))
    signed = F.concat(head, F.lit("."), body)
    mac = F.when(F.col("event_id") % 3 == 0, enc.hmac(enc.as_bytes(signed), "other")).otherwise(enc.hmac(enc.as_bytes(signed), "secret"))
    token = F.concat(signed, F.lit("."), F.regexp_replace(enc.base64(F.unhex(mac), urlsafe=True), "=+$", ""))
    t = d.select("event_id", token.alias("token"))
    p = enc.jwt_parts(F.col("token"))
    return t.select("event_id", p.isNotNull().alias("decoded"), p["sub"].alias("sub"), p["exp"].alias("exp"), enc.jwt_status(F.col("token"), "secret", F.lit(2500), 10).alias("status"))


@query("customer", """
SELECT c_custkey, '2024年' || (c_custkey % 12 + 1) || '月3日' AS date, c_name || ' 公司' AS seller, lpad(c_custkey::VARCHAR, 10, '0') AS invoice_no, CASE WHEN c_custkey % 2 = 0 THEN '1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '.50' ELSE '' END AS amount, CASE WHEN c_custkey % 3 = 0 THEN '增值税专用发票' ELSE '电子发票' END AS type FROM customer""")
def bill_fields(d, read):
    k = F.col("c_custkey")
    said = F.concat_ws("\n", F.when(k % 3 == 0, "增值税专用发票").otherwise("数电发票 增值税专用发票"), F.concat(F.lit("开票日期 ：\t2024年"), (k % 12 + 1).cast("string"), F.lit("月3日")), F.concat(F.lit("销售方名称:  "), F.col("c_name"), F.lit("  公司 |\r")), F.concat(F.lit("发票 号码 发票号码："), F.lpad(k.cast("string"), 10, "0")), F.when(k % 2 == 0, F.concat(F.lit("价税合计(小写) ¥1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".50"))))
    return d.select("c_custkey", fields.invoice_fields(said).alias("f")).select("c_custkey", "f.date", "f.seller", "f.invoice_no", "f.amount", "f.type")


@query("events", "SELECT event_id, strftime(ts, '%Y年%m-%d %a %A [%H%M%S]') AS said FROM events")
def format_tokens(d, read):
    return d.select("event_id", time.format_tokens(utc("ts"), "YYYY年MM-DD ddd dddd [HHmmss]").alias("said"))


@query("events", """
WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)
SELECT event_id, CASE event_id % 9 WHEN 0 THEN date_trunc('day', t) - interval 1 day + interval 8 hour + interval 30 minute WHEN 1 THEN date_trunc('month', t) + interval 10 day WHEN 2 THEN t + interval 2 hour - interval 5 minute WHEN 3 THEN date_trunc('day', t) + interval 2 day WHEN 4 THEN date_trunc('quarter', t) - interval 1 year
  WHEN 6 THEN date_trunc('day', t) + interval 11 hour WHEN 7 THEN date_trunc('day', t) + interval 1 month - interval 1 day WHEN 8 THEN t + interval 1 year + interval 3 month END AS at FROM e""")
def relative_instants(d, read):
    t = time.cut_to_second(utc("ts"))
    said = F.element_at(F.array(*map(F.lit, ["yesterday 08:30", "month-start +1w +3d", "+2h -5m", "后天", "Quarter-Start -1y", "sometime", "today +2h 09:00"]), F.concat(time.day_of(t).cast("string"), F.lit(" +1M -1d")), F.concat(time.stamp(t), F.lit(" +3M +1y"))), (F.col("event_id") % 9 + 1).cast("int"))
    return d.select("event_id", time.wall(time.relative_instant(said, t)).alias("at"))


@query("events", """
WITH e AS (SELECT event_id, event_id % 23 AS k, ts, date_trunc('second', ts) AS t FROM events)
SELECT event_id, CASE WHEN k IN (0, 2, 3, 8, 9, 11) THEN t WHEN k IN (1, 12) THEN date_trunc('millisecond', ts) WHEN k IN (4, 5, 6, 7, 10) THEN date_trunc('day', t) WHEN k = 13 THEN t - interval 8 hour WHEN k = 14 THEN t + interval 5 hour WHEN k = 15 THEN t - interval 330 minute
  WHEN k = 16 THEN date_trunc('minute', t) + interval 8 hour WHEN k IN (17, 18) THEN t + interval 3 hour WHEN k = 19 THEN date_trunc('minute', t) WHEN k = 20 THEN ts END AS at FROM e""")
def parsed_instants(d, read):
    """Each form of a time: numbers, ISO, mail dates, offsets, years first and last, names of months; the last two are none."""
    t = time.cut_to_second(utc("ts"))
    day, clock = time.day_of(t), time.format_tokens(t, "HH:mm:ss")
    said = lambda form: F.date_format(day, form)
    seconds = F.unix_seconds(t).cast("string")
    part = F.format_string("%03d", F.unix_millis(utc("ts")) % 1000)
    month = F.element_at(F.array(*[F.lit(m.title()) for m in time.MONTHS]), F.month(day))
    written = [
        seconds, F.concat(seconds, F.lit("."), part), F.concat(day.cast("string"), F.lit(" "), clock), F.concat(day.cast("string"), F.lit("T"), clock, F.lit("Z")), said("yyyy/MM/dd"), said("dd.MM.yyyy"), said("dd-MM-yyyy"), F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.substring(month, 1, 3), F.year(day).cast("string")),
        F.concat(said("yyyy/MM/dd"), F.lit(" "), clock), F.concat(month, F.lit(" "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"), F.lit(" "), clock), said("MM/dd/yyyy"), F.concat(day.cast("string"), F.lit("T"), clock), F.concat(day.cast("string"), F.lit(" "), clock, F.lit("."), part),
        F.concat(said("EEE, d "), F.substring(month, 1, 3), said(" yyyy "), clock, F.lit(" +0800")), F.concat(said("d "), F.substring(month, 1, 3), said(" yyyy "), clock, F.lit(" EST")), F.concat(day.cast("string"), F.lit(" "), clock, F.lit(" +0530")),
        F.concat(day.cast("string"), F.lit(" "), F.substring(clock, 1, 5), F.lit(" -0800")), F.concat(said("yyyy/MM/dd "), clock, F.lit(" -03:00")), F.concat(said("MM/dd/yyyy "), clock, F.lit(" -0300")), F.concat(day.cast("string"), F.lit("T"), F.substring(clock, 1, 5)), F.unix_micros(utc("ts")).cast("string"), F.lit("2024-02-30"), F.lit("no time"),
    ]
    texts = d.select("event_id", F.element_at(F.array(*written), (F.col("event_id") % len(written) + 1).cast("int")).alias("said"))
    return texts.select("event_id", time.parse_instant(F.col("said")).alias("at")).select("event_id", time.wall(F.col("at")).alias("at"))


@query("events", "SELECT event_id, (CASE WHEN s < 0 THEN '-' ELSE '' END) || 'P' || CASE WHEN a // 86400 > 0 THEN (a // 86400) || 'D' ELSE '' END || CASE WHEN a % 86400 > 0 THEN 'T' || CASE WHEN a // 3600 % 24 > 0 THEN (a // 3600 % 24) || 'H' ELSE '' END || CASE WHEN a // 60 % 60 > 0 THEN (a // 60 % 60) || 'M' ELSE '' END || CASE WHEN a % 60 > 0 OR a < 86400 THEN (a % 60) || 'S' ELSE '' END ELSE '' END AS iso, (CASE WHEN s < 0 THEN chr(8722) ELSE '' END) || (CASE WHEN a < 36000 THEN '0' ELSE '' END) || (a // 3600) || ':' || lpad((a // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((a % 60)::VARCHAR, 2, '0') AS hms FROM (SELECT event_id, s, abs(s) AS a FROM (SELECT event_id, event_id * 977 - 300000 + CASE WHEN event_id * 977 = 300000 THEN 1 ELSE 0 END AS s FROM events))")
def duration_iso(d, read):
    ms = (F.col("event_id") * 977 - 300_000) * 1000
    return d.select("event_id", time.duration_iso(ms).alias("iso"), time.duration_hms(ms).alias("hms"))


@query("events", "SELECT user_id, regexp_replace(string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a), '$', '') AS pages FROM (SELECT user_id, min(p) AS a, max(p) AS b FROM (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM (SELECT DISTINCT user_id, event_id % 37 AS p FROM events)) GROUP BY user_id, g) GROUP BY user_id")
def range_texts(d, read):
    return d.groupBy("user_id").agg(rel.range_text(F.collect_set((F.col("event_id") % 37).cast("int"))).alias("pages"))


@query("part", "SELECT p_partkey, h::INTEGER AS h, s::INTEGER AS s, l::INTEGER AS l FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 120 WHEN 2 THEN 240 ELSE 0 END AS h, CASE p_partkey % 4 WHEN 3 THEN 0 ELSE 100 END AS s, 50 AS l FROM part)")
def color_hsl(d, read):
    m = F.col("p_partkey") % 4
    c = text.rgb(F.when(m == 0, "#F00").when(m == 1, "00ff00").when(m == 2, "rgb(0, 0, 255)").otherwise("#808080"))
    return d.select("p_partkey", net.bound(c, lambda c: text.hsl(c["r"], c["g"], c["b"])).alias("x")).select("p_partkey", "x.*")
