"""Queries of the library's operators by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import encoding as enc
from quarry.functions import net, text, time
from quarry.operators import relational as rel
from quarry.plans.registry import QUERIES, SQL, query, utc

@query("documents", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hash_digests(d, read):
    b = enc.as_bytes(F.col("text"))
    return d.select("doc_id", *[enc.digest(b, a).alias(a) for a in ("md5", "sha1", "sha256")])


@query("documents", "SELECT doc_id, base64(encode(text)) AS b64, replace(replace(base64(encode(text)), '+', '-'), '/', '_') AS b64url, true AS same FROM documents")
def base64_codec(d, read):
    b = enc.as_bytes(F.col("text"))
    return d.select("doc_id", enc.base64(b).alias("b64"), enc.base64(b, urlsafe=True).alias("b64url"), (enc.from_base64(enc.base64(b, True, 76)) == b).alias("same"))


@query("benchmark", "SELECT item_id, lower(hex(encode(text))) AS hex, true AS same FROM benchmark")
def hex_codec(d, read):
    b = enc.as_bytes(F.col("text"))
    return d.select("item_id", enc.to_hex(b).alias("hex"), (enc.from_hex(enc.to_hex(b, " ", "0x")) == b).alias("same"))


@query("benchmark", "SELECT item_id, sha256(unhex(repeat('5c', 64)) || unhex(sha256(unhex(repeat('36', 64)) || encode(text)))) AS mac FROM benchmark")
def hmac_sha256(d, read):
    return d.select("item_id", enc.hmac(enc.as_bytes(F.col("text")), "").alias("mac"))


@query("pages", "SELECT page_id, replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%28', '('), '%29', ')'), '%2A', '*'), '%27', '''') AS encoded, true AS same FROM pages")
def url_component(d, read):
    e = enc.encode_component(F.col("url"))
    return d.select("page_id", e.alias("encoded"), (enc.decode_component(e) == F.col("url")).alias("same"))


@query("pages", r"""
SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
  nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, CASE WHEN url LIKE '%?%' THEN len(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) ELSE 0 END::INTEGER AS pairs FROM pages""")
def url_inspect(d, read):
    p = net.url_parts(F.col("url"))
    return d.select("page_id", *[p[k].alias(k) for k in ("scheme", "host", "path", "query", "pairs")])


@query("events", "SELECT event_id, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) // 1000 AS millis, epoch_us(ts) AS micros FROM events")
def epoch_units(d, read):
    return d.select("event_id", time.epochs(utc("ts"))["seconds"].alias("seconds"), time.epochs(utc("ts"))["millis"].alias("millis"), time.epochs(utc("ts"))["micros"].alias("micros"))


@query("events", "SELECT event_id, " + ", ".join(f"epoch(date_trunc('{u}', ts))::BIGINT AS {u}_first, (epoch(date_trunc('{u}', ts) + interval {i}) - 1)::BIGINT AS {u}_last" for u, i in (("day", "1 day"), ("week", "7 day"), ("month", "1 month"), ("year", "1 year"))) + " FROM events")
def period_bounds(d, read):
    return d.select("event_id", *[time.period_bounds(utc("ts"), u)[e].alias(f"{u}_{e}") for u in ("day", "week", "month", "year") for e in ("first", "last")])


@query("events", """
WITH z AS (SELECT event_id, zone, ts, timezone(zone, timezone('UTC', ts)) AS l, date_trunc('year', ts) AS y FROM events, (VALUES ('Asia/Shanghai'), ('America/New_York'), ('Europe/Berlin')) v(zone)),
o AS (SELECT *, date_diff('minute', ts, l) AS m, date_diff('minute', y, timezone(zone, timezone('UTC', y))) AS jan, date_diff('minute', y + interval 6 month, timezone(zone, timezone('UTC', y + interval 6 month))) AS jul FROM z)
SELECT event_id, zone, strftime(l, '%Y-%m-%d %H:%M:%S') AS local, dayofweek(l)::INTEGER AS weekday, m::INTEGER AS offset_minutes, m > least(jan, jul) AS dst FROM o""")
def timezone_board(d, read):
    boards = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), time.zone_board(utc("ts"), z).alias("b")) for z in ("Asia/Shanghai", "America/New_York", "Europe/Berlin")])).alias("z")
    return d.select("event_id", boards).select("event_id", "z.zone", "z.b.*")


@query("orders", "SELECT o_orderkey, isoyear(o_orderdate)::INTEGER AS iso_year, weekofyear(o_orderdate)::INTEGER AS iso_week, strftime(o_orderdate, '%Y/%m/%d %a') AS said, o_orderdate + interval 1 month AS next_month FROM orders")
def calendar_fields(d, read):
    day = time.day_of(utc("o_orderdate"))
    return d.select("o_orderkey", F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("iso_year"), F.weekofyear(day).alias("iso_week"), F.date_format(day, "yyyy/MM/dd EEE").alias("said"), time.wall(time.add_calendar(utc("o_orderdate"), months=1)).alias("next_month"))


@query("events", "SELECT event_id, (CASE WHEN s < 36000 THEN '0' ELSE '' END) || (s // 3600)::VARCHAR || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS hms FROM (SELECT event_id, event_id * 7 AS s FROM events)")
def duration_text(d, read):
    return d.select("event_id", time.duration_hms(F.col("event_id") * 7000).alias("hms"))


@query("customer", "SELECT c_custkey, array_to_string(list_transform(w, lambda x: lower(x)), '_') AS snake, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), '') AS pascal FROM (SELECT c_custkey, list_filter(string_split_regex(regexp_replace(c_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '') AS w FROM customer)")
def case_words(d, read):
    return d.select("c_custkey", text.change_case(F.col("c_name"), "snake").alias("snake"), text.change_case(F.col("c_name"), "pascal").alias("pascal"))


@query("customer", "SELECT c_custkey, (n >> 24)::VARCHAR || '.' || ((n >> 16) & 255)::VARCHAR || '.' || ((n >> 8) & 255)::VARCHAR || '.' || (n & 255)::VARCHAR AS dotted, printf('0x%08X', n) AS hexadecimal, n AS number FROM (SELECT c_custkey, c_custkey * 28633115 % 4294967296 AS n FROM customer)")
def ipv4_convert(d, read):
    n = F.col("c_custkey") * 28633115 % 4294967296
    return d.select("c_custkey", net.ipv4_forms(n)["dotted"].alias("dotted"), net.ipv4_forms(n)["hexadecimal"].alias("hexadecimal"), net.ipv4_number(net.ipv4_text(n)).alias("number"))


@query("customer", """
SELECT c_custkey, 4294967296 - size AS mask, n - n % size AS network, n - n % size + size - 1 AS broadcast, CASE WHEN p < 31 THEN size - 2 ELSE size END AS hosts
FROM (SELECT c_custkey, c_custkey * 28633115 % 4294967296 AS n, c_custkey % 25 + 8 AS p, (1::BIGINT << (32 - c_custkey % 25 - 8)::INTEGER) AS size FROM customer)""")
def ipv4_subnet(d, read):
    s = net.ipv4_subnet(F.col("c_custkey") * 28633115 % 4294967296, F.col("c_custkey") % 25 + 8)
    return d.select("c_custkey", *[s[k].alias(k) for k in ("mask", "network", "broadcast", "hosts")])


@query("events", """
WITH p AS (SELECT * FROM (VALUES (20, 'FTP data', 'TCP', 'File transfer data channel'), (21, 'FTP control', 'TCP', 'File transfer control channel'), (67, 'DHCP server', 'UDP', 'Dynamic host configuration'), (68, 'DHCP client', 'UDP', 'Dynamic host configuration'),
  (389, 'LDAP', 'TCP', 'Directory service'), (1433, 'Microsoft SQL Server', 'TCP', 'Database service'), (8443, 'HTTPS alternate', 'TCP', 'Common alternate secure web port'), (27017, 'MongoDB', 'TCP', 'Database service')) v(n, service, transport, description))
SELECT event_id, port, coalesce(service, 'unknown') AS service, transport, description
FROM (SELECT event_id, (CASE event_id % 10 WHEN 0 THEN 21 WHEN 1 THEN 67 WHEN 2 THEN 68 WHEN 3 THEN 389 WHEN 4 THEN 1433 WHEN 5 THEN 8443 WHEN 6 THEN 27017 WHEN 7 THEN 20 WHEN 8 THEN 8081 ELSE 60000 + event_id % 5000 END)::INTEGER AS port FROM events) LEFT JOIN p ON port = n""")
def port_reference(d, read):
    ports = [21, 67, 68, 389, 1433, 8443, 27017, 20, 8081]
    port = F.coalesce(F.get(F.array(*map(F.lit, ports)), (F.col("event_id") % 10).cast("int")), 60000 + F.col("event_id") % 5000).cast("int")
    return net.with_service(d.withColumn("port", port), "port").select("event_id", "port", "service", "transport", "description")


@query("part", "SELECT p_partkey, printf('#%02X%02X%02X', p_partkey * 7 % 256, p_partkey * 13 % 256, p_partkey * 29 % 256) AS hex FROM part")
def color_hex(d, read):
    r, g, b = (F.col("p_partkey") * k % 256 for k in (7, 13, 29))
    back = text.rgb(text.hex_color(r, g, b))
    return d.select("p_partkey", text.hex_color(back["r"], back["g"], back["b"]).alias("hex"))


@query("nation", "SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ''), lambda c: lpad(bin(ascii(c)), 8, '0')), ' ') AS bits FROM nation")
def binary_codec(d, read):
    return d.select("n_nationkey", enc.binary_text(F.col("n_name")).alias("bits"))


@query("documents", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+ing'))::INTEGER AS n, md5(regexp_replace(text, '([0-9]+)', '<\\1>', 'g')) AS replaced FROM documents")
def regex_test(d, read):
    return d.select("doc_id", text.regex_found(F.col("text"), "[A-Za-z]+ing")["n"].alias("n"), F.md5(text.regex_replaced(F.col("text"), "([0-9]+)", "<$1>").cast("binary")).alias("replaced"))


@query("events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(d, read):
    return d.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("documents", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_keep_first(d, read):
    slim = d.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    return rel.keep_first(slim, [F.col("digest")], [F.col("doc_id")]).select("doc_id", "source")


@query("orders", "WITH t AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders), g AS (SELECT o_custkey, d, d - (row_number() OVER (PARTITION BY o_custkey ORDER BY d))::INTEGER AS k FROM t) SELECT o_custkey, min(d) AS first, max(d) AS last, count(*) AS length FROM g GROUP BY o_custkey, k")
def day_islands(d, read):
    return rel.islands(d.select("o_custkey", F.to_date("o_orderdate").alias("d")), ["o_custkey"], "d")


@query("conversations", "SELECT conv_id, turn // 3 AS part, string_agg(text, chr(10) ORDER BY turn) AS merged FROM conversations GROUP BY 1, 2")
def merge_in_chunks(d, read):
    g = d.groupBy("conv_id", F.floor(F.col("turn") / 3).alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("conv_id", "part", F.array_join(F.col("t.text"), "\n").alias("merged"))


@query("customer", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_delete(d, read):
    return d.select("c_custkey").join(read("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("customer", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_extract(d, read):
    return d.select("c_custkey").join(read("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("documents", "SELECT lang, sum(strlen(text))::BIGINT AS input_bytes, sum(length(text))::BIGINT AS output_bytes, round((sum(length(text)) - sum(strlen(text))) * 100.0 / sum(strlen(text)))::DOUBLE + 0.0 AS delta_percent FROM documents GROUP BY lang")
def size_delta(d, read):
    return rel.size_metrics(d, ["lang"], F.octet_length("text"), F.length("text"))


@query("documents", "SELECT lang, b AS mode, w AS weight FROM (SELECT lang, b, w, row_number() OVER (PARTITION BY lang ORDER BY w DESC, b) AS r FROM (SELECT lang, n_chars // 500 AS b, sum(n_chars)::BIGINT AS w FROM documents GROUP BY 1, 2)) WHERE r = 1")
def weighted_mode(d, read):
    return rel.weighted_mode(d, ["lang"], F.floor(F.col("n_chars") / 500), F.col("n_chars"))


@query("lineitem", """
WITH s AS (SELECT l_orderkey, min(o_orderdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING max(l_shipdate)::DATE >= min(o_orderdate)::DATE),
d AS (SELECT l_orderkey, unnest(generate_series(a, b, interval 1 day))::DATE AS day FROM s),
f AS (SELECT l_orderkey, dayofweek(day) IN (0, 6) AS we, month(day) = 1 AND dayofmonth(day) = 1 OR month(day) = 12 AND dayofmonth(day) = 25 AS ho FROM d)
SELECT l_orderkey, count(*) AS days, count(*) FILTER (we) AS weekend_days, count(*) FILTER (ho AND NOT we) AS holiday_days, count(*) FILTER (NOT we AND NOT ho) AS work_days FROM f GROUP BY 1""")
def day_tally(d, read):
    o = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("a"))
    last = d.groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("b"))
    tally = rel.day_tally(F.col("a"), F.col("b"), [f"{y}-{m}" for y in range(1990, 2031) for m in ("01-01", "12-25")])
    return last.join(o, "l_orderkey").where("b >= a").select("l_orderkey", tally.alias("t")).select("l_orderkey", "t.*")


@query("events", """
WITH u AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1), d AS (SELECT user_id, t, unnest(generate_series(t::DATE, t::DATE + 62, interval 1 day)) AS day FROM u),
r AS (SELECT user_id, t, day + to_minutes(m) AS run FROM d, (VALUES (540), (570), (1020), (1050)) x(m) WHERE dayofweek(day) BETWEEN 1 AND 5)
SELECT user_id, run, n FROM (SELECT user_id, run::TIMESTAMP AS run, row_number() OVER (PARTITION BY user_id ORDER BY run)::INTEGER AS n FROM r WHERE run > t) WHERE n <= 5""")
def cron_next(d, read):
    first = d.groupBy("user_id").agg(F.min("ts").alias("t")).withColumn("t", utc("t"))
    return rel.cron_next(first, ["user_id"], "t", "*/30 9,17 * * 1-5").withColumn("run", time.wall(F.col("run")))


@query("supplier", "SELECT s_suppkey, row_number() OVER (ORDER BY regexp_extract(s_name, '([0-9]+)$', 1)::BIGINT)::INTEGER AS rank FROM supplier")
def natural_rank(d, read):
    return rel.natural_rank(d, "s_name", "s_suppkey").select("s_suppkey", "rank")


@query("lineitem", """
WITH RECURSIVE j AS (SELECT l_orderkey, l_linenumber, l_shipdate AS a, o_orderdate AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT DISTINCT a, b, least(a, b) AS low, greatest(a, b) AS high FROM j),
y AS (SELECT a, b, low, high, 0 AS n FROM p UNION ALL SELECT a, b, low + interval 1 year, high, n + 12 FROM y WHERE low + interval 1 year <= high),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC) = 1),
m AS (SELECT a, b, low, high, n FROM z UNION ALL SELECT a, b, low + interval 1 month, high, n + 1 FROM m WHERE low + interval 1 month <= high),
r AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC) = 1)
SELECT l_orderkey, l_linenumber, j.a, j.b, epoch_ms(j.a) - epoch_ms(j.b) AS millis, date_diff('day', j.b, j.a)::INTEGER AS days, n::INTEGER AS months_part, date_diff('day', low, high)::INTEGER AS days_part FROM j JOIN r ON r.a = j.a AND r.b = j.b""")
def date_difference(d, read):
    o = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("b"))
    j = d.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("a")).join(o, "l_orderkey")
    s = time.date_difference(utc("b"), utc("a"))
    return j.select("l_orderkey", "l_linenumber", "a", "b", s.alias("s")).select("l_orderkey", "l_linenumber", "a", "b", "s.*")


@query("customer", """
WITH p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_mktsegment || c_custkey WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'My-passw0rd-' || c_custkey WHEN 3 THEN repeat('a', (c_custkey % 23)::INTEGER) WHEN 4 THEN 'Xk9!' || c_nationkey || 'Zuq?' || c_custkey || 'é' ELSE c_nationkey || 'trewq-Zz' || c_custkey || '!' END AS t FROM customer),
f AS (SELECT *, length(t) AS n, lower(t) AS l,
  regexp_matches(t, '[a-zé]')::INTEGER + regexp_matches(t, '[A-Z]')::INTEGER + regexp_matches(t, '[0-9]')::INTEGER + regexp_matches(t, '[^A-Za-z0-9é]')::INTEGER + regexp_matches(t, '[^\\x00-\\x7F]')::INTEGER AS kinds,
  list_aggregate([contains(lower(t), w) for w in ['password', 'passw0rd', 'admin', 'welcome', 'letmein', 'qwerty', 'iloveyou', 'monkey', 'dragon', '123456', '123456789', 'abc123', '111111', '000000']], 'bool_or') AS common,
  coalesce(list_aggregate([t[i:i+3] = repeat(t[i], 4) for i in range(1, length(t) - 2)], 'bool_or'), false) OR (t <> '' AND t = repeat(t[1], length(t)::INTEGER)) AS same,
  coalesce(list_aggregate([list_aggregate([contains(q, lower(t[i:i+3])) OR contains(reverse(q), lower(t[i:i+3])) for q in ['0123456789', 'abcdefghijklmnopqrstuvwxyz', 'qwertyuiop', 'asdfghjkl', 'zxcvbnm']], 'bool_or') for i in range(1, length(t) - 2)], 'bool_or'), false) AS follows FROM p),
s AS (SELECT *, (n >= 8)::INTEGER + (n >= 10)::INTEGER + (n >= 14)::INTEGER + (n >= 20)::INTEGER + (kinds >= 4 AND n >= 10)::INTEGER AS b FROM f)
SELECT c_custkey, CASE WHEN n = 0 OR common THEN 0 ELSE least(CASE WHEN same OR follows THEN 1 ELSE 4 END, greatest(0, b - (kinds = 1)::INTEGER)) END::INTEGER AS score,
  array_to_string(list_filter([CASE WHEN n < 14 THEN 'length' END, CASE WHEN kinds < 3 THEN 'variety' END, CASE WHEN common AND n > 0 THEN 'common' END, CASE WHEN (same OR follows) AND n > 0 THEN 'repeated' END], lambda x: x IS NOT NULL), ' ') AS tips FROM s""")
def password_strength(d, read):
    k, seg, nation = F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    m = F.col("c_custkey") % 6
    t = F.when(m == 0, F.concat(seg, k)).when(m == 1, F.lower(seg)).when(m == 2, F.concat(F.lit("My-passw0rd-"), k)).when(m == 3, F.repeat(F.lit("a"), (F.col("c_custkey") % 23).cast("int"))).when(m == 4, F.concat(F.lit("Xk9!"), nation, F.lit("Zuq?"), k, F.lit("é"))).otherwise(F.concat(nation, F.lit("trewq-Zz"), k, F.lit("!")))
    s = text.password_strength(t)
    return d.select("c_custkey", s["score"].alias("score"), F.array_join(s["tips"], " ").alias("tips"))


@query("documents", "SELECT a.doc_id, CASE WHEN a.text = b.text THEN 'matched' ELSE 'mismatched' END AS verdict FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 5")
def expected_checksum(d, read):
    """Each document against the digest, tagged in one of several ways, of the document at the next lower multiple of five."""
    b, k = enc.as_bytes(F.col("text")), F.col("doc_id") % 4
    want = F.when(k == 0, F.concat(F.lit("sha256="), F.upper(F.sha2(b, 256)))).when(k == 1, F.concat(F.lit("SHA-1:"), F.sha1(b))).when(k == 2, F.concat(F.lit("0123456789abcdef "), enc.base64(F.unhex(F.md5(b))))).otherwise(F.concat_ws("; ", F.repeat(F.lit("f"), 64), F.sha2(b, 512)))
    base = d.where("doc_id % 5 = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("doc_id", F.col("doc_id") + F.col("k"))
    base = base.select("doc_id", want.alias("want"))
    return d.join(base, "doc_id").select("doc_id", F.when(enc.matches_expected(b, F.col("want")), "matched").otherwise("mismatched").alias("verdict"))
