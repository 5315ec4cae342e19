import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import encoding as enc
from quarry.functions import codes, net, text, time
from quarry.operators import relational as rel
from quarry.operators import schedules


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: enc.digest(F.lit(b"abc"), "md5"), "900150983cd24fb0d6963f7d28e17f72"),
        (lambda: enc.digest(F.lit(b"abc"), "blake2b512"), hashlib.blake2b(b"abc").hexdigest()),
        (lambda: enc.hmac(F.lit(b"hello"), "key"), "9307b3b915efb5171ff14d8cb55fbcc798c6c0ef1456d66ded1a6aa723a58b7b"),
        (lambda: enc.radix(F.lit(b"foobar"), enc.BASE32), "MZXW6YTBOI"),
        (lambda: enc.radix(F.lit(b"\0\0hi"), enc.BASE58), "118wr"),
        (lambda: enc.from_base64(F.lit("aGVsbG8")).cast("string"), "hello"),
        (lambda: enc.from_base64(F.lit("a*b")), None),
        (lambda: enc.from_hex(F.lit(r"\x68 0x69")).cast("string"), "hi"),
        (lambda: enc.to_hex(F.lit(b"hi"), " ", "0x"), "0x68 0x69"),
        (lambda: enc.escape_unicode(F.lit("aé😀")), "a\\u00e9\\ud83d\\ude00"),
        (lambda: enc.unescape_unicode(F.lit("\\\\u0041\\ud83d\\ude00\\ud800x")), "\\A😀\ufffdx"),
        (lambda: enc.escape_html(F.lit("a&\x00é€'😀")), "a&amp;&#0;&#233;&euro;&apos;&#128512;"),
        (lambda: enc.escape_html(F.lit("<é>"), True), "<&#233;>"),
        (lambda: enc.unescape_html(F.lit("&lt;&x&#0000000233;& &#xE9;;&")), "<&x&#0000000233;& &#xE9;;&"),
        (lambda: enc.unescape_html(F.lit("&#0000000233;&#55296;")), None),
        (lambda: F.hex(enc.from_radix(enc.radix(F.lit(b"\0ab" * 100), enc.BASE58), enc.BASE58)), (b"\0ab" * 100).hex().upper()),
        (lambda: codes.totp(F.lit("GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ"), F.lit(59)), "287082"),
        (lambda: enc.encode_component(F.lit("a b~!'()*é")), "a%20b~!'()*%C3%A9"),
        (lambda: time.duration_hms(F.lit(3735000)), "01:02:15"),
        (lambda: time.duration_hms(F.lit(-90061999)), "\u221225:01:01"),
        (lambda: time.duration_iso(F.lit(93784000)), "P1DT2H3M4S"),
        (lambda: time.duration_iso(F.lit(3600000)), "PT1H0S"),
        (lambda: time.duration_iso(F.lit(-172800500)), "-P2DT0.5S"),
        (lambda: time.duration_iso(F.lit(86400000)), "P1D"),
        (lambda: time.duration_iso(F.lit(0)), "PT0S"),
        (lambda: time.number_text(F.lit(5356800000)), "5,356,800,000"),
        (lambda: time.number_text(F.lit(-8.859)), "-8.86"),
        (lambda: time.number_text(F.lit(46.296)), "46.3"),
        (lambda: time.number_text(F.lit(2419.997)), "2,420"),
        (lambda: time.number_text(F.lit(0.004)), "0"),
        (lambda: F.to_json(time.calendar_span(F.lit("2024-02-29 10:00:00").cast("timestamp"), F.lit("2026-04-15 09:59:59.5").cast("timestamp"))), '{"sign":1,"years":2,"months":1,"weeks":2,"days":3,"hours":23,"minutes":59,"seconds":59,"millis":500}'),
        (lambda: time.relative_phrase(F.lit(-86400000)), "yesterday"),
        (lambda: time.relative_phrase(F.lit(-8 * 86400000)), "last week"),
        (lambda: time.relative_phrase(F.lit(0)), "now"),
        (lambda: time.relative_phrase(F.lit(40 * 86400000), "zh"), "下个月"),
        (lambda: time.relative_phrase(F.lit(8711999000), "zh"), "3个月后"),
        (lambda: time.relative_phrase(F.lit(86400000), named=False), "in 1 day"),
        (lambda: time.duration_words(F.lit(-90061001)), "-1 day, 1 hour, 1 minute, 1 seconds, 1 millisecond"),
        (lambda: time.duration_words(F.lit(3735000), "zh"), "1小时2分15秒"),
        (lambda: time.duration_spoken(F.lit(5400000)), "2 hours"),
        (lambda: time.duration_spoken(F.lit(-9 * 86400000), "zh"), "1周"),
        (lambda: time.span_text(F.lit(None).cast("struct<sign:int,years:int,months:int,weeks:int,days:int,hours:int,minutes:int,seconds:int,millis:int>")), None),
        (lambda: enc.unescape_html(F.lit("&lt;&#x26;&#38;&foo; &amp; &nbsp;&#128512;&")), "<&&&foo; & \u00a0\U0001f600&"),
        (lambda: enc.unescape_html(F.lit("a &foo &amp; b")), "a &foo &amp; b"),
        (lambda: enc.unescape_html(F.lit("&#xD800;")), None),
        (lambda: enc.escape_html(F.lit("5 € ≠ '\n'")), "5 &euro; &#8800; &apos;&#10;&apos;"),
        (lambda: enc.from_radix(F.lit("mzxw-6ytb oi=="), enc.BASE32).cast("string"), "foobar"),
        (lambda: enc.from_radix(F.lit("csqpyrkLe8"), enc.BASE32_CROCKFORD, True).cast("string"), "foobar"),
        (lambda: enc.from_radix(F.lit("iLoO"), enc.BASE32_CROCKFORD, True) == enc.from_radix(F.lit("1100"), enc.BASE32_CROCKFORD), True),
        (lambda: enc.from_radix(F.lit("MZ1"), enc.BASE32), None),
        (lambda: enc.from_radix(F.lit("118WR"), enc.BASE58), b"\0\0b\xa6"),
        (lambda: enc.from_radix(F.lit("ZIK0ZJ"), enc.BASE36) == enc.from_radix(F.lit("zik0zj"), enc.BASE36), True),
        (lambda: time.relative_phrase(F.lit(8711999000)), "in 3 months"),
        (lambda: time.relative_phrase(F.lit(-8711999000)), "3 months ago"),
        (lambda: F.date_format(time.parse_instant(F.lit("1700000000123")), "yyyy-MM-dd HH:mm:ss.SSS"), "2023-11-14 22:13:20.123"),
        (lambda: F.date_format(time.parse_instant(F.lit("02/03/2024")), "yyyy-MM-dd"), "2024-02-03"),
        (lambda: F.date_format(time.parse_instant(F.lit("13/03/2024")), "yyyy-MM-dd"), "2024-03-13"),
        (lambda: F.date_format(time.local_to_instant(F.lit("2024-03-10 02:30:00").cast("timestamp"), "America/New_York"), "HH:mm"), "07:00"),
        (lambda: F.date_format(time.local_to_instant(F.lit("2024-11-03 01:30:00").cast("timestamp"), "America/New_York"), "HH:mm"), "05:30"),
        (lambda: F.date_format(time.add_calendar(F.lit("2024-01-31 12:00:00").cast("timestamp"), months=1), "yyyy-MM-dd HH:mm:ss"), "2024-02-29 12:00:00"),
        (lambda: F.to_json(time.date_difference(F.lit("2026-01-05").cast("timestamp"), F.lit("2026-03-08").cast("timestamp"))), '{"millis":5356800000,"days":62,"months_part":2,"days_part":3}'),
        (lambda: text.amount_in_words(F.lit("1234.05").cast("decimal(18,2)")), "壹仟贰佰叁拾肆元零伍分"),
        (lambda: text.amount_in_words(F.lit("10000").cast("decimal(18,2)")), "壹万元整"),
        (lambda: text.amount_in_words(F.lit("-100203.5").cast("decimal(18,2)")), "负壹拾万零贰佰零叁元伍角整"),
        (lambda: text.amount_in_words(F.lit("0").cast("decimal(18,2)")), "零元整"),
        (lambda: text.amount_in_words(F.lit("0.29").cast("decimal(18,2)")), "零元贰角玖分"),
        (lambda: text.amount_in_words(F.lit("-0.05").cast("decimal(18,2)")), "负零元零伍分"),
        (lambda: text.amount_of_words(text.amount_in_words(F.lit("-0.05").cast("decimal(18,2)"))).cast("string"), "-0.05"),
        (lambda: text.amount_of_words(text.amount_in_words(F.lit("0.30").cast("decimal(18,2)"))).cast("string"), "0.30"),
        (lambda: text.change_case(F.lit("fooBar baz-1X"), "snake"), "foo_bar_baz_1_x"),
        (lambda: text.change_case(F.lit("fooBar baz"), "camel"), "fooBarBaz"),
        (lambda: F.to_json(text.rgb(F.lit("#0fA"))), '{"r":0,"g":255,"b":170}'),
        (lambda: F.to_json(text.hsl(F.lit(255), F.lit(0), F.lit(0))), '{"h":0,"s":100,"l":50}'),
        (lambda: F.to_json(text.password_strength(F.lit(""))), '{"score":0,"length":0,"tips":["length","variety"]}'),
        (lambda: F.to_json(text.password_strength(F.lit("My-passw0rd-2026"))), '{"score":0,"length":16,"tips":["common"]}'),
        (lambda: F.to_json(text.password_strength(F.lit("aaaaaaaa"))), '{"score":0,"length":8,"tips":["length","variety","repeated"]}'),
        (lambda: F.to_json(text.password_strength(F.lit("CorrectHorse7!x"))), '{"score":4,"length":15,"tips":[]}'),
        (lambda: text.password_strength(F.lit("abcdef"))["score"], 0),
        (lambda: text.password_strength(F.lit("xKlpoi9!éZz"))["score"], 3),
        (lambda: text.password_strength(F.lit("xKlpoiu9!éZz"))["score"], 1),
        (lambda: text.amount_of_words(F.lit("人民币 负壹拾万零贰佰零叁元伍角整")).cast("string"), "-100203.50"),
        (lambda: text.amount_of_words(F.lit("十二万")).cast("string"), "120000.00"),
        (lambda: text.amount_of_words(F.lit("壹兆零壹元零伍分")).cast("string"), "1000000000001.05"),
        (lambda: text.amount_of_words(F.lit("佰元")), None),
        (lambda: text.amount_of_words(F.lit("壹元贰元")), None),
        (lambda: enc.from_radix(F.lit("MZXW6YTBOI"), enc.BASE32).cast("string"), "foobar"),
        (lambda: F.hex(enc.from_radix(F.lit("118wr"), enc.BASE58)), "00006869"),
        (lambda: enc.from_radix(F.lit("0"), enc.BASE58), None),
        (lambda: enc.unescape_unicode(F.lit("a\\u00e9\\ud83d\\ude00\\u12")), "aé😀\\u12"),
        (lambda: enc.escape_html(F.lit("<é&😀>"), True), "<&#233;&&#128512;>"),
        (lambda: enc.unescape_html(F.lit("&lt;a&gt; &amp;lt; &copy;")), "<a> &lt; ©"),
        (lambda: enc.from_binary_text(F.lit("01101000 01101001")), "hi"),
        (lambda: codes.totp(F.lit("not base32!"), F.lit(59)), None),
        (lambda: codes.totp(F.lit("GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ"), F.lit(1111111109), 8), "07081804"),
        (lambda: enc.jwt_parts(F.lit("e30.e30"))["alg"], None),
        (lambda: enc.jwt_parts(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.x"))["sub"], "1"),
        (lambda: enc.jwt_parts(F.lit("bm8.eyJzdWIiOiIxIn0.x"))["sub"], None),
        (lambda: time.format_tokens(F.lit("2024-03-10 02:30:00").cast("timestamp"), "YYYY/MM/DDD"), "2024/03/DDD"),
        (lambda: time.relative_instant(F.lit("tomorrow +1y"), F.lit("2024-02-28 10:00:00").cast("timestamp")).cast("string"), "2025-02-28 00:00:00"),
        (lambda: time.relative_instant(F.lit("tomorrow or so"), F.lit("2024-02-28").cast("timestamp")), None),
        (lambda: text.csv_line([F.lit("b,c"), F.lit('say "hi"')]), '"b,c","say ""hi"""'),
        (lambda: text.output_name(None, F.lit("a/b"), "x..y", "pdf"), "a_b-x-y.pdf"),
        (lambda: text.output_name("_{i}.{total}_{range}{date}{time}-", F.lit("a"), "t", "pdf", F.lit(3), F.lit(12), F.lit("1-3 "), F.lit("2024-01-02 03:04:05").cast("timestamp")), "03.12_1-3 20240102030405.pdf"),
        (lambda: text.output_name("---", F.lit("  "), "t", "pdf"), "document.pdf"),
        (lambda: text.json_text(F.lit('{"b": 1, "a": [1, "é"]}')), '{"b":1,"a":[1,"é"]}'),
        (lambda: text.json_text(F.lit('{"b": [1]}'), 2), '{\n  "b": [\n    1\n  ]\n}'),
        (lambda: text.json_text(F.lit("{")), None),
        (lambda: F.to_json(text.regex_found(F.lit("aB ab"), "ab", "gi")), '{"n":2,"first_at":0,"found":["aB","ab"]}'),
        (lambda: text.regex_found(F.lit("x"), "ab")["first_at"], None),
        (lambda: text.regex_replaced(F.lit("a1b2"), "([a-z])([0-9])", "$2$1[$&]$$$3\\\\"), "1a[a1]$$3\\\\2b[b2]$$3\\\\"),
        (lambda: text.regex_replaced(F.lit("a1"), "(?<l>[a-z])([0-9])", "$<l>$12$<no>"), "aa2"),
        (lambda: text.uuid_text("nil", "urn"), "urn:uuid:00000000-0000-0000-0000-000000000000"),
        (lambda: text.uuid_text().rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), True),
        (lambda: net.spf_record(True, True, F.lit(None).cast("array<string>"), F.array(*[F.lit(f"h{k}.org") for k in range(9)])), None),
        (lambda: net.spf_record(False, False, F.array(F.lit("10.0.0.0/33")), F.lit(None).cast("array<string>")), None),
        (lambda: net.spf_record(False, False, F.array(F.lit("10.0.0.0/8")), F.array(F.lit("Include:a-b.org")), "-all"), "v=spf1 ip4:10.0.0.0/8 include:a-b.org -all"),
        (lambda: net.with_query(F.lit("http://x/?a=1#f"), F.array(F.struct(F.lit("b c").alias("name"), F.lit("é").alias("value")))), "http://x/?a=1&b%20c=%C3%A9#f"),
        (lambda: F.to_json(net.query_pairs(F.lit("a=1+2&b&c=%zz"))), '[{"name":"a","value":"1 2"},{"name":"b","value":""},{"name":"c","value":"%zz"}]'),
        (lambda: net.ipv4_number(F.lit("10.0.0.256")), None),
        (lambda: net.ipv6_expand(F.lit("::ffff:1.2.3.4")), "0000:0000:0000:0000:0000:ffff:0102:0304"),
        (lambda: net.ipv6_compress(F.lit("2001:0db8:0:0:1:0:0:1")), "2001:db8::1:0:0:1"),
        (lambda: net.ipv6_compress(F.lit("0:0:0:0:0:0:0:0")), "::"),
        (lambda: net.ipv6_expand(F.lit("1:2")), None),
        (lambda: net.dmarc_record(F.lit("odd"), F.lit(120), F.lit("a@b.org")), "v=DMARC1; p=quarantine; pct=100; rua=mailto:a@b.org"),
        (lambda: net.spf_record(True, False, F.array(F.lit("1.2.3.4")), F.array(F.lit("x.org"))), "v=spf1 mx ip4:1.2.3.4 include:x.org ~all"),
        (lambda: net.robots_txt(F.lit("*"), F.array(F.lit("a")), F.array(F.lit("/b")), F.lit("https://x/s")), "User-agent: *\nAllow: /a\nDisallow: /b\nSitemap: https://x/s"),
        (lambda: F.to_json(net.user_agent(F.lit("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537 Edg/120.1"))), '{"browser":"Microsoft Edge 120.1","system":"Windows 10/11","device":"Desktop"}'),
        (lambda: F.to_json(net.user_agent(F.lit("OPR/9 edge"))), '{"browser":"Opera 9","system":"Unknown","device":"Unknown"}'),
        (lambda: rel.range_text(F.array(*map(F.lit, [5, 1, 2, 3, 5]))), "1-3,5"),
    ],
)
def test_value(spark, column, expected):
    assert one(spark, column()) == expected


@pytest.mark.parametrize("selector, total, pages", [("1-3,5", 9, [1, 2, 3, 5]), ("-3", 9, [1, 2, 3]), ("7-", 9, [7, 8, 9]), ("1-99", 4, [1, 2, 3, 4]), ("99-", 4, [4]), ("0", 4, None), ("4", 3, None), ("3-1", 4, None), ("1-2-3", 4, None), ("x", 4, None), ("odd、2", 5, [1, 3, 5, 2]), ("", 2, [1, 2])])
def test_page_selector(spark, selector, total, pages):
    assert one(spark, rel.selected_pages(F.lit(selector), F.lit(total))) == pages


def test_natural_order(spark):
    names = ["a10", "a2", "a02", "b1", "A1"]
    got = [r.name for r in spark.createDataFrame([(n,) for n in names], "name string").orderBy(rel.natural_key(F.col("name")), F.length("name")).collect()]
    assert got == ["A1", "a2", "a02", "a10", "b1"]


def test_workdays(spark):
    friday = F.lit("2024-03-01").cast("date")
    assert str(one(spark, rel.nth_workday(friday, 1, []))) == "2024-03-04"
    assert str(one(spark, rel.nth_workday(friday, 2, ["2024-03-04"]))) == "2024-03-06"
    assert str(one(spark, rel.nth_workday(friday, -5, []))) == "2024-02-23"


def test_keep_first_and_ties(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 2)], "k string, v int")
    assert sorted((r.k or "", r.v) for r in rel.keep_first(df, [F.col("k")], [F.col("v")]).collect()) == [("", 2), ("a", 1)]
    sizes = spark.createDataFrame([("f", 12, 5, 2), ("f", 10, 5, 1), ("f", 8, 4, 0)], "f string, s int, n int, pos int")
    assert rel.weighted_mode(sizes, ["f"], F.col("s"), F.col("n"), F.col("pos")).first()["mode"] == 10
    assert rel.weighted_mode(sizes.where("pos > 0"), ["f"], F.col("s"), F.col("n"), -F.col("pos")).first()["mode"] == 12


def test_natural_rank(spark):
    names = [f"f{k}" for k in (10, 9, 2, 100, 1)] + ["a", "f02", None]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string")
    for parts in (1, 3, 200):
        got = [r.name for r in rel.natural_rank(df, "name", "k", parts).orderBy("rank").collect()]
        assert got == [None, "a", "f1", "f2", "f02", "f9", "f10", "f100"]


def test_day_tally(spark):
    row = spark.range(1).select(rel.day_tally(F.lit("2024-02-28").cast("date"), F.lit("2024-03-10").cast("date"), ["2024-03-01", "2024-03-02"]).alias("t"), rel.day_tally(F.lit("2024-02-28").cast("date"), F.lit("2024-02-27").cast("date"), []).alias("e")).first()
    assert tuple(row.t) == (12, 4, 1, 7) and tuple(row.e) == (0, 0, 0, 0)
    assert str(one(spark, rel.rolled(F.lit("2024-03-01").cast("date"), ["2024-03-01", "2024-03-04"]))) == "2024-03-05"


@pytest.mark.parametrize(
    "expression, runs",
    [
        ("0 0 29 2 *", ["2024-02-29 00:00:00", "2028-02-29 00:00:00"]),
        ("0 9 15W * *", ["2023-02-15 09:00:00", "2023-03-15 09:00:00", "2023-04-14 09:00:00"]),
        ("0 9 1W 4,7 *", ["2023-04-03 09:00:00", "2023-07-03 09:00:00"]),
        ("0 0 L feb *", ["2023-02-28 00:00:00", "2024-02-29 00:00:00"]),
        ("0 0 * * L", ["2023-02-25 00:00:00", "2023-03-25 00:00:00"]),
        ("5 4 * * mon-tue 7,8", ["2023-02-14 04:05:07", "2023-02-14 04:05:08", "2023-02-20 04:05:07"]),
        ("@hourly", ["2023-02-13 11:00:00", "2023-02-13 12:00:00"]),
        ("20 10 13 * 0", ["2023-02-19 10:20:00", "2023-02-26 10:20:00"]),
    ],
)
def test_cron(spark, expression, runs):
    df = spark.createDataFrame([(1, "2023-02-13 10:20:30"), (2, None)], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = rel.cron_next(df, ["k"], "t", expression, len(runs)).orderBy("n").select(F.col("run").cast("string").alias("run")).collect()
    assert [r.run for r in got] == runs


def test_cron_fields(spark):
    bits = lambda *k: sum(1 << x for x in k)
    for field, low, high, want in [("*/20", 0, 59, bits(0, 20, 40)), ("1-3,7", 0, 7, bits(1, 2, 3, 7)), (" 5/2 ", 0, 9, bits(5, 7, 9)), ("61", 0, 59, None), ("*/0", 0, 59, None), ("3-1", 0, 59, None), ("", 0, 59, None), ("1,", 0, 59, None), ("99999999999", 0, 59, None), ("a", 0, 59, None)]:
        assert one(spark, schedules.field_mask(F.lit(field), low, high)) == want
