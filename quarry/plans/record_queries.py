"""Queries of keyed codes, match tables and archive plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import codes, encoding, matches, passwords
from quarry.operators import archive
from quarry.plans.registry import query


def pad_sql(key: str, byte: int, size: int = 64) -> str:
    """Each byte of a key in hex of `size` bytes, changed by one byte."""
    return f"unhex(array_to_string(list_transform(range(0, {size}), lambda i: printf('%02x', xor(('0x' || {key}[2 * i + 1:2 * i + 2])::INTEGER, {byte}))), ''))"


def keyed_sql(function: str) -> str:
    key = f"rpad(CASE WHEN octet_length(k) > 64 THEN {function}(k) ELSE lower(hex(k)) END, 128, '0')"
    return f"SELECT doc_id, {function}(outer_pad || unhex({function}(inner_pad || m))) AS mac FROM (SELECT doc_id, m, {pad_sql('h', 0x5C)} AS outer_pad, {pad_sql('h', 0x36)} AS inner_pad FROM (SELECT doc_id, m, {key} AS h FROM r))"


@query("documents", f"""
WITH r AS (SELECT doc_id, encode(text) AS m, encode(concat_ws('-', lang, repeat(source, (doc_id % 12)::INTEGER))) AS k FROM documents), a AS ({keyed_sql('sha256')}), b AS ({keyed_sql('sha1')}), c AS ({keyed_sql('md5')})
SELECT doc_id, a.mac AS mac, b.mac AS mac_sha1, c.mac AS mac_md5 FROM a JOIN b USING (doc_id) JOIN c USING (doc_id)""")
def hmac_by_row(d, read):
    key = F.encode(F.concat_ws("-", "lang", F.repeat("source", (F.col("doc_id") % 12).cast("int"))), "UTF-8")
    mac = lambda a: codes.hmac_by_key(F.encode("text", "UTF-8"), key, a)
    return d.select("doc_id", mac("sha256").alias("mac"), mac("sha1").alias("mac_sha1"), mac("md5").alias("mac_md5"))


@query("events", f"""
WITH k AS (SELECT user_id, {pad_sql('h', 0x5C)} AS outer_pad, {pad_sql('h', 0x36)} AS inner_pad FROM (SELECT DISTINCT user_id, rpad(lower(hex(encode('user' || lpad(user_id::VARCHAR, 6, '0')))), 128, '0') AS h FROM events)),
s AS (SELECT event_id, user_id, epoch_us(ts) // 30000000 AS step, unnest(range(-2, 3)) AS o FROM events),
m AS (SELECT event_id, step, o, sha1(outer_pad || unhex(sha1(inner_pad || unhex(lpad(printf('%x', step + o), 16, '0'))))) AS mac FROM s JOIN k USING (user_id)),
c AS (SELECT event_id, step, o, lpad(((('0x' || substr(mac, 2 * ('0x' || mac[40])::INTEGER + 1, 8))::BIGINT & 2147483647) % 1000000)::VARCHAR, 6, '0') AS code FROM m),
g AS (SELECT event_id, code AS said FROM c WHERE o = event_id % 5 - 2)
SELECT event_id, any_value(said) AS code, count(*) FILTER (WHERE o BETWEEN -1 AND 1 AND code = said) > 0 AS valid, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (WHERE o BETWEEN -1 AND 1 AND code = said), '') AS hits, any_value(step) AS step
FROM c JOIN g USING (event_id) GROUP BY event_id""")
def one_time_codes(d, read):
    key = F.encode(F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 6, "0")), "UTF-8")
    at = F.unix_micros(F.col("ts").cast("timestamp_ltz")) / 1_000_000
    typed = d.withColumn("secret", F.lower(encoding.radix(key, encoding.BASE32))).withColumn("at", at)
    typed = typed.withColumn("code", codes.totp(F.col("secret"), F.col("at") + (F.col("event_id") % 5 - 2) * 30))
    checked = typed.withColumn("x", codes.totp_check(F.concat(F.substring("code", 1, 3), F.lit(" "), F.substring("code", 4, 3)), F.col("secret"), F.col("at")))
    return checked.select("event_id", "code", "x.valid", F.array_join("x.hits", ",").alias("hits"), F.col("x.counter").alias("step"))


@query("documents", """
WITH f AS (SELECT doc_id, text, regexp_extract_all(text, '([A-Z])([a-z]+)|([0-9]+)') AS f FROM documents),
m AS (SELECT doc_id, unnest(f) AS value, unnest(string_split_regex(text, '(?:[A-Z])(?:[a-z]+)|(?:[0-9]+)')[1:len(f)]) AS gap, unnest(regexp_extract_all(text, '([A-Z])([a-z]+)|([0-9]+)', 1)) AS head,
  unnest(regexp_extract_all(text, '([A-Z])([a-z]+)|([0-9]+)', 2)) AS rest, unnest(regexp_extract_all(text, '([A-Z])([a-z]+)|([0-9]+)', 3)) AS digits, unnest(range(1, len(f) + 1)) AS n FROM f WHERE len(f) > 0),
s AS (SELECT *, sum(length(gap) + length(value)) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM m)
SELECT doc_id, n::INTEGER AS n, (stop - length(value))::BIGINT AS start, stop::BIGINT AS stop, value, coalesce(head, '') AS head, coalesce(rest, '') AS rest, coalesce(digits, '') AS digits FROM s""")
def regex_match_table(d, read):
    found = matches.match_table(d, ["doc_id"], "text", "(?<head>[A-Z])([a-z]+)|([0-9]+)")
    return found.select("doc_id", "n", "start", "stop", "value", F.col("named")["head"].alias("head"), F.col("groups")[1].alias("rest"), F.col("groups")[2].alias("digits"))


@query("part", """
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: '<' || array_to_string(w[1:i - 1], ' ') || CASE WHEN i > 1 THEN ' ' ELSE '' END || '|' || w[i] || '|' || CASE WHEN i < len(w) THEN ' ' ELSE '' END || array_to_string(w[i + 1:], ' ') || '>'), ' ') AS around,
  '[' || w[1] || ']' || CASE WHEN len(w) > 1 THEN ' ' ELSE '' END || array_to_string(w[2:], ' ') AS first_only FROM p""")
def regex_around(d, read):
    name = F.col("p_name")
    return d.select("p_partkey", matches.regex_rewritten(name, "(?<w>[a-z]+)", "<$`|$<w>|$'>").alias("around"), matches.regex_rewritten(name, "[a-z]+", "[$&]", "").alias("first_only"))


ARCHIVE_SQL = r"""
m AS (SELECT o_orderkey AS position, CASE o_custkey % 11 WHEN 0 THEN 'scan/' WHEN 1 THEN '/other/' ELSE '/scan/' END || o_custkey || '.pdf' AS path,
  CASE WHEN o_orderkey % 101 = 0 THEN '../x.pdf' ELSE o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '\' END || o_orderpriority || CASE o_orderkey % 7 WHEN 0 THEN ' (3)' WHEN 1 THEN '?' ELSE '' END || '.pdf' END AS relative,
  CASE o_orderkey % 17 WHEN 0 THEN sha256('old') WHEN 1 THEN 'none' ELSE upper(sha256(o_custkey::VARCHAR)) END AS sha, o_orderkey % 23 <> 0 AS enabled FROM orders),
l AS (SELECT CASE c_custkey % 31 WHEN 0 THEN '/gone/' ELSE CASE c_custkey % 11 WHEN 0 THEN 'scan/' WHEN 1 THEN '/other/' ELSE '/scan/' END END || c_custkey || '.pdf' AS path, sha256(c_custkey::VARCHAR) AS now, c_custkey * 123457 % 110000000 AS length, c_custkey % 29 AS kind FROM customer),
ex AS (SELECT DISTINCT ['F', 'O', 'P'][p_partkey % 3 + 1] || '/1-URGENT' || CASE WHEN p_size = 1 THEN '' ELSE ' (' || p_size || ')' END || '.pdf' AS name FROM part),
v AS (SELECT position, m.path, replace(replace(relative, '\', '/'), '?', '_') AS asked, CASE WHEN NOT starts_with(m.path, '/') THEN 'not absolute' WHEN l.path IS NULL THEN 'not there' WHEN NOT starts_with(m.path, '/scan/') THEN 'outside the source'
  WHEN kind = 0 THEN 'not a file' WHEN length > 104857600 THEN 'too large' WHEN length(sha) <> 64 THEN 'no digest' WHEN lower(sha) <> now THEN 'changed' WHEN starts_with(relative, '..') THEN 'unsafe target' END AS reason
  FROM m LEFT JOIN l USING (path) WHERE enabled)"""


def archive_inputs(d, read):
    key, customer, size = F.col("o_orderkey"), F.col("o_custkey"), F.col("p_size")
    at = lambda c: F.when(c % 11 == 0, "scan/").when(c % 11 == 1, "/other/").otherwise("/scan/")
    file = lambda c: F.concat(c.cast("string"), F.lit(".pdf"))
    sha = lambda c: F.sha2(c.cast("string"), 256)
    tail = F.when(key % 7 == 0, " (3)").when(key % 7 == 1, "?").otherwise("")
    relative = F.when(key % 101 == 0, "../x.pdf").otherwise(F.concat("o_orderstatus", F.when(key % 2 == 0, "/").otherwise("\\"), "o_orderpriority", tail, F.lit(".pdf")))
    digest = F.when(key % 17 == 0, F.sha2(F.lit("old"), 256)).when(key % 17 == 1, "none").otherwise(F.upper(sha(customer)))
    manifest = d.select(key.alias("position"), F.concat(at(customer), file(customer)).alias("path"), relative.alias("relative_path"), digest.alias("sha256"), (key % 23 != 0).alias("enabled"))
    c = F.col("c_custkey")
    listing = read("customer").select(F.concat(F.when(c % 31 == 0, "/gone/").otherwise(at(c)), file(c)).alias("path"), sha(c).alias("sha256"), (c.cast("long") * 123457 % 110000000).alias("length"), F.when(c % 29 == 0, "directory").otherwise("file").alias("kind"))
    number = F.when(size == 1, "").otherwise(F.concat(F.lit(" ("), size.cast("string"), F.lit(")")))
    existing = read("part").select(F.concat(F.get(F.array(*map(F.lit, "FOP")), (F.col("p_partkey") % 3).cast("int")), F.lit("/1-URGENT"), number, F.lit(".pdf")).alias("name"))
    return manifest, listing, existing


@query("orders", f"""
WITH {ARCHIVE_SQL}, r AS (SELECT position, asked, row_number() OVER (PARTITION BY asked ORDER BY position) - CASE WHEN asked IN (SELECT name FROM ex) THEN 0 ELSE 1 END AS j FROM v WHERE reason IS NULL),
e AS (SELECT name FROM ex UNION SELECT asked FROM r), t AS (SELECT asked, unnest(range(2, max(j) + 2 + (SELECT count(*) FROM e))) AS k FROM r GROUP BY asked),
c AS (SELECT asked, left(asked, -4) || ' (' || k || ').pdf' AS name, row_number() OVER (PARTITION BY asked ORDER BY k) AS j FROM t WHERE left(asked, -4) || ' (' || k || ').pdf' NOT IN (SELECT name FROM e))
SELECT position, v.path, CASE WHEN reason IS NULL THEN 'copied' ELSE 'failed' END AS outcome, CASE WHEN r.j = 0 THEN v.asked ELSE c.name END AS target, reason FROM v LEFT JOIN r USING (position) LEFT JOIN c ON c.asked = r.asked AND c.j = r.j""")
def archive_plan(d, read):
    return archive.archive_plan(*archive_inputs(d, read), "/scan")


@query("orders", f"""
WITH {ARCHIVE_SQL}, r AS (SELECT position, row_number() OVER (PARTITION BY asked ORDER BY position) > 1 OR asked IN (SELECT name FROM ex) AS late FROM v WHERE reason IS NULL)
SELECT position, path, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN late THEN 'skipped' ELSE 'copied' END AS outcome, CASE WHEN reason IS NULL AND NOT late THEN asked END AS target, CASE WHEN late THEN 'target exists' ELSE reason END AS reason FROM v LEFT JOIN r USING (position)""")
def archive_skips(d, read):
    return archive.archive_plan(*archive_inputs(d, read), "/scan", conflict="skip")


def password_sql(length: int, groups: list[str]) -> str:
    draw = "('0x' || sha256(c_name || ':draw:' || i)[1:12])::BIGINT"
    one = lambda signs: f"'{signs}'[{draw} % {len(signs)} + 1]"
    cases = " ".join(f"WHEN {k} THEN {one(g)}" for k, g in enumerate(groups))
    return f"SELECT c_custkey, array_to_string(list_transform(list_sort(list_transform(range(0, {length}), lambda i: {{'at': sha256(c_name || ':place:' || i), 'c': CASE i {cases} ELSE {one(''.join(groups))} END}})), lambda x: x.c), '') AS password FROM customer"


@query("customer", password_sql(16, ["ABCDEFGHJKLMNPQRSTUVWXYZ", "abcdefghijkmnopqrstuvwxyz", "23456789", "!@#$%^&*()-_=+[]{};:,.<>?/~"]))
def seeded_passwords(d, read):
    return d.select("c_custkey", passwords.password(F.col("c_name"), 16, exclude="O0l1I").alias("password"))
