"""Case, colours, money in words, passwords, names and field extraction as Column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Capital numerals and units of amounts.
NUMERALS, UNITS, GROUPS = "零壹贰叁肆伍陆柒捌玖", ["", "拾", "佰", "仟"], ["", "万", "亿", "兆"]
#: Signs that amounts are read from, plain and traditional ones too.
PLAIN_NUMERALS = {
    "零": "0", "〇": "0", "壹": "1", "一": "1", "贰": "2", "弍": "2", "二": "2", "叁": "3", "參": "3", "三": "3", "肆": "4", "四": "4", "伍": "5", "五": "5", "陆": "6", "陸": "6", "六": "6", "柒": "7", "七": "7",
    "捌": "8", "八": "8", "玖": "9", "九": "9", "拾": "S", "十": "S", "佰": "B", "百": "B", "仟": "Q", "千": "Q", "万": "W", "萬": "W", "亿": "Y", "億": "Y", "兆": "Z", "圆": "元", "圓": "元",
}


def words(text: Column) -> Column:
    """Words: split at what is neither letter nor digit, and between a small letter or digit and a capital."""
    split = F.split(F.regexp_replace(text, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2"), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda w: w != "")


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def change_case(text: Column, style: str) -> Column:
    """upper, lower, title, camel, pascal, snake or kebab."""
    if style in ("upper", "lower"):
        return F.upper(text) if style == "upper" else F.lower(text)
    w = words(text)
    if style in ("snake", "kebab"):
        return F.array_join(F.transform(w, F.lower), "_" if style == "snake" else "-")
    if style == "camel":
        return F.array_join(F.transform(w, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(capital(x))), "")
    return F.array_join(F.transform(w, capital), " " if style == "title" else "")


def rgb(text: Column) -> Column:
    """r, g, b of #RGB, #RRGGBB, the same without #, or rgb(r, g, b); null for anything else."""
    t = F.lower(F.trim(text))
    bare = F.regexp_replace(t, "^#", "")
    six = F.when(bare.rlike("^[0-9a-f]{3}$"), F.regexp_replace(bare, "(.)", "$1$1")).when(bare.rlike("^[0-9a-f]{6}$"), bare)
    pattern = r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"
    part = lambda k: F.coalesce(F.conv(F.substring(six, 2 * k + 1, 2), 16, 10).cast("int"), F.try_to_number(F.regexp_extract(t, pattern, k + 1), F.lit("999")).cast("int"))
    found = F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))
    return F.when(found["r"].between(0, 255) & found["g"].between(0, 255) & found["b"].between(0, 255), found)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)])


def hsl(r: Column, g: Column, b: Column) -> Column:
    """h in degrees, s and l in per cent, rounded."""
    x, y, z = (c / 255.0 for c in (r, g, b))
    top, low = F.greatest(x, y, z), F.least(x, y, z)
    d, s = top - low, top + low
    hue = F.when(d == 0, F.lit(0.0)).when(top == x, F.pmod((y - z) / d, F.lit(6.0))).when(top == y, (z - x) / d + 2).otherwise((x - y) / d + 4)
    sat = F.when(d == 0, F.lit(0.0)).otherwise(d / (1 - F.abs(s - 1)))
    return F.struct(F.round(hue * 60).cast("int").alias("h"), F.round(sat * 100).cast("int").alias("s"), F.round(s * 50).cast("int").alias("l"))


def amount_in_words(amount: Column) -> Column:
    """An amount with at most two decimals in capital numerals: groups of four digits with 万, 亿, 兆; 零元 where there is no whole one, 整 where there are no cents."""
    cents = F.round(F.abs(amount) * 100).cast("decimal(20,0)")
    whole, rest = F.floor(cents / 100).cast("decimal(18,0)").cast("string"), (cents % 100).cast("int")
    n = F.length(whole)
    place = lambda i: n - 1 - i

    def digit(i: Column) -> Column:
        d = F.substring(whole, i + 1, F.lit(1)).cast("int")
        group = F.element_at(F.array(*map(F.lit, GROUPS)), (F.floor(place(i) / 4) + 1).cast("int"))
        start = F.greatest(F.lit(0), n - 4 * (F.floor(place(i) / 4) + 1)).cast("int")
        empty = F.substring(whole, start + 1, i + 1 - start).rlike("^0+$")
        unit = F.element_at(F.array(*map(F.lit, UNITS)), (place(i) % 4 + 1).cast("int"))
        said = F.when(d == 0, F.lit("零")).otherwise(F.concat(F.substring(F.lit(NUMERALS), d + 1, F.lit(1)), unit))
        return F.concat(said, F.when((place(i) % 4 == 0) & (place(i) > 0) & ~empty, F.concat(F.lit("|"), group)).otherwise(""))

    text = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), digit), "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "零+", "零"), "零\\|", "|"), "\\|", "")
    text = F.regexp_replace(text, "零$", "")
    jiao, fen = F.floor(rest / 10).cast("int"), rest % 10
    numeral = lambda d: F.substring(F.lit(NUMERALS), d + 1, F.lit(1))
    head = F.when(whole == "0", F.lit("零元")).otherwise(F.concat(text, F.lit("元")))
    tail = F.when(rest == 0, F.lit("整")).otherwise(F.concat(F.when(jiao > 0, F.concat(numeral(jiao), F.lit("角"))).otherwise(F.lit("零")), F.when(fen > 0, F.concat(numeral(fen), F.lit("分"))).otherwise(F.lit(""))))
    tail = F.when((rest > 0) & (fen == 0), F.concat(tail, F.lit("整"))).otherwise(tail)
    return F.concat(F.when((amount < 0) & (cents > 0), "负").otherwise(""), F.when(cents == 0, F.lit("零元整")).otherwise(F.concat(head, tail)))


def password_classes(text: Column) -> Column:
    """Number of kinds of characters: small, capital, digit, other."""
    return sum((F.when(text.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))


#: What makes a password common wherever it stands, and the rows of keys and signs that it may follow.
COMMON = ["password", "passw0rd", "admin", "welcome", "letmein", "qwerty", "iloveyou", "monkey", "dragon", "123456", "123456789", "abc123", "111111", "000000"]
SEQUENCES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "qwertyuiop", "asdfghjkl", "zxcvbnm"]
#: Kinds of characters: small, capital, number, neither letter nor number, beyond ASCII.
KINDS = [r"\p{IsLowercase}", r"\p{IsUppercase}", r"\p{N}", r"[^\p{IsAlphabetic}\p{N}]", r"[^\x00-\x7F]"]


def password_strength(text: Column) -> Column:
    """score (0 to 4), length and tips (length, variety, common, repeated) of a password.

    A common word anywhere gives 0; four equal characters in a row, or four that follow a sequence either way, 1 at most.
    """
    n, low = F.length(text), F.lower(text)
    kinds = sum((F.when(text.rlike(k), 1).otherwise(0) for k in KINDS), F.lit(0))
    fours = sorted({x for q in SEQUENCES for i in range(len(q) - 3) for x in (q[i : i + 4], q[i : i + 4][::-1])})
    common = low.rlike("|".join(COMMON))
    repeated = text.rlike(r"(?s)^(.)\1*$|(.)\2{3}") | low.rlike("|".join(fours))
    score = sum((F.when(n >= k, 1).otherwise(0) for k in (8, 10, 14, 20)), F.lit(0)) + F.when((kinds >= 4) & (n >= 10), 1).otherwise(0)
    score = F.greatest(score - F.when(kinds == 1, 1).otherwise(0), F.lit(0))
    score = F.least(F.when(common, 0).when(repeated, F.least(score, F.lit(1))).otherwise(score), F.lit(4))
    none = n == 0
    tips = {"length": n < 14, "variety": kinds < 3, "common": common & ~none, "repeated": repeated & ~none}
    said = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in tips.items()]), lambda x: x.isNotNull())
    return F.when(text.isNotNull(), F.struct(F.when(none, 0).otherwise(score).alias("score"), n.alias("length"), said.alias("tips")))


def amount_of_words(text: Column) -> Column:
    """The number that an amount in capital (or plain) numerals names, with two decimals; null if it is none.

    The inverse of amount_in_words(): digits gather in sections up to 万, 亿 or 兆; what follows 元 is 角 and 分.
    """
    bare = F.replace(F.regexp_replace(F.regexp_replace(F.trim(text), "^(人民币)+", ""), "^[¥￥]+", ""), F.lit(" "))
    plain = F.translate(bare, "".join(PLAIN_NUMERALS), "".join(PLAIN_NUMERALS.values()))
    minus = plain.rlike("^[负-]")
    part = F.split(F.regexp_replace(plain, "^[负-]", ""), "元", -1)
    whole, rest = part[0], F.coalesce(F.get(part, 1), F.lit(""))
    good = whole.rlike(r"^[0-9SBQWYZ]*$") & ~whole.rlike("(^|[^1-9])[BQ]") & rest.rlike(r"^整*(0(?=[0-9]))*([0-9]角)?整*(0(?=[0-9]))*([0-9]分)?整*$") & (F.size(part) <= 2)
    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("t"), F.lit(0).cast("decimal(38,0)").alias("s"), F.lit(0).cast("decimal(38,0)").alias("d"))
    big = lambda c: c.cast("decimal(38,0)")

    def fold(acc: Column, c: Column) -> Column:
        one = lambda v: F.when(v == 0, big(F.lit(1))).otherwise(v)
        small = F.when(c == "S", 10).when(c == "B", 100).otherwise(1000)
        large = F.when(c == "W", F.lit(10_000)).when(c == "Y", F.lit(100_000_000)).otherwise(F.lit(1_000_000_000_000))
        made = lambda t, s, d: F.struct(big(t).alias("t"), big(s).alias("s"), big(d).alias("d"))
        zero = F.lit(0)
        return F.when(c.rlike("[0-9]"), made(acc["t"], acc["s"], c.try_cast("decimal(38,0)"))).when(c.isin("S", "B", "Q"), made(acc["t"], acc["s"] + one(acc["d"]) * small, zero)).otherwise(
            made(acc["t"] + one(acc["s"] + acc["d"]) * large, zero, zero)
        )

    signs = F.filter(F.split(whole, ""), lambda c: c != "")
    n = F.aggregate(signs, start, fold, lambda acc: acc["t"] + acc["s"] + acc["d"])
    cents = lambda u: F.coalesce(F.regexp_extract(rest, f"([0-9]){u}", 1).try_cast("int"), F.lit(0))
    value = (n + cents("角") * F.lit("0.1").cast("decimal(2,1)") + cents("分") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")
    return F.when(good & (n <= 999_999_999_999_999), F.when(minus, -value).otherwise(value))


def unique_names(df: DataFrame, keys: list[str], name: str, order: list[Column]) -> DataFrame:
    """df with `unique_name`: of equal names of a key all but the first get ` (2)`, ` (3)` .. before the extension."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    stem, ext = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^.+?(\.[^.]*)?$", 1)
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext)))


def safe_file_name(name: Column) -> Column:
    """Forbidden and control characters as _, white space as single spaces, 120 characters at most, `document` if nothing is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f\x7f-\u009f]', "_"), r"\s+", " "))
    short = F.substring(clean, 1, 120)
    return F.when(short == "", "document").otherwise(short)


def output_name(pattern: str | None, name: Column, tool: str, extension: str, index: Column | None = None, total: Column | None = None, pages: Column | None = None, at: Column | None = None) -> Column:
    """A file name from a pattern of {name} {tool} {index} {i} (two digits) {total} {range} {date} {time}, `{name}-{tool}` if there is none.

    Runs of two or more of - _ . become one -, and these go from both ends; what is empty then is the name itself.
    """
    one, moment = F.lit(1), F.current_timestamp() if at is None else at
    number = one if index is None else F.coalesce(index, one)
    values = {
        "name": name, "tool": F.lit(tool), "index": number.cast("string"), "i": F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string")),
        "total": (one if total is None else F.coalesce(total, one)).cast("string"), "range": F.lit("") if pages is None else F.coalesce(pages, F.lit("")), "date": F.date_format(moment, "yyyyMMdd"), "time": F.date_format(moment, "HHmmss"),
    }
    out = F.lit((pattern or "").strip() or "{name}-{tool}")
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    out = F.regexp_replace(F.regexp_replace(out, "[-_.]{2,}", "-"), "^[-_.]+|[-_.]+$", "")
    return F.concat(safe_file_name(F.when(out == "", name).otherwise(out)), F.lit("." + extension))


#: Sizes of identity photos (id, width and height in mm, width and height in pixels, dots an inch if not 300).
PHOTO_SIZES = [
    ("one-inch", 25, 35, 295, 413, None), ("small-one-inch", 22, 32, 260, 378, None), ("large-one-inch", 33, 48, 390, 567, None), ("small-two-inch", 33, 48, 390, 567, None), ("china-entry-exit", 33, 48, 390, 567, None),
    ("china-visa", 33, 48, 390, 567, None), ("china-id-card", 26, 32, 358, 441, 350), ("china-driving-license", 22, 32, 260, 378, None), ("two-inch", 35, 49, 413, 579, None), ("large-two-inch", 35, 53, 413, 626, None),
    ("china-law-qualification", 35, 53, 413, 626, None), ("three-by-four", 30, 40, 354, 472, None), ("uk-passport", 35, 45, 413, 531, None), ("schengen-visa", 35, 45, 413, 531, None), ("japan-visa", 35, 45, 413, 531, None),
    ("india-passport", 35, 45, 413, 531, None), ("australia-passport", 35, 45, 413, 531, None), ("canada-passport", 50, 70, 591, 827, None), ("bangladesh-passport", 45, 55, 531, 650, None), ("bangladesh-visa", 38, 48, 449, 567, None), ("us-visa", 51, 51, 600, 600, None),
]


def with_photo_size(df: DataFrame, kind: str) -> DataFrame:
    """df with width_mm, height_mm, width_px, height_px and dpi of a kind of identity photo; null where it isn't listed."""
    known = df.sparkSession.createDataFrame([(*r[:5], r[5] or 300) for r in PHOTO_SIZES], "_kind string, width_mm int, height_mm int, width_px int, height_px int, dpi int")
    return df.join(F.broadcast(known), F.col(kind) == F.col("_kind"), "left").drop("_kind")  # the fixed list


def json_text(text: Column, indent: int | None = None) -> Column:
    """JSON text minified, or with so many spaces a level (1 to 8); keys stay in order; null if it is no JSON."""

    @F.pandas_udf(StringType())
    def convert(values: pd.Series) -> pd.Series:
        def one(t):
            try:
                pairs = json.loads(t)
            except (TypeError, ValueError):
                return None
            return json.dumps(pairs, ensure_ascii=False, indent=None if indent is None else max(1, min(8, indent)), separators=(",", ":") if indent is None else (",", ": "))

        return values.map(one)

    return convert(text)


def uuid_text(version: str = "v4", style: str = "plain", at_millis: Column | None = None) -> Column:
    """A v4 (random), v7 (of a time in milliseconds, then random) or nil identifier; plain, upper, braces, urn or bare (without hyphens)."""
    if version == "nil":
        out = F.lit("-".join("0" * n for n in (8, 4, 4, 4, 12)))
    elif version == "v7":
        ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()) if at_millis is None else at_millis)), 12, "0")
        out = F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(F.uuid(), 16, 21))
    else:
        out = F.uuid()
    return {"upper": F.upper(out), "braces": F.concat(F.lit("{"), out, F.lit("}")), "urn": F.concat(F.lit("urn:uuid:"), out), "bare": F.replace(out, F.lit("-"))}.get(style, out)


def flagged(pattern: str, flags: str) -> str:
    """A pattern with the flags i, m and s; g, d and u change nothing here."""
    if unknown := set(flags) - set("dgimsu"):
        raise ValueError(f"unknown flags {sorted(unknown)}")
    on = "".join(f for f in "ims" if f in flags)
    return f"(?{on})" + pattern if on else pattern


def regex_found(text: Column, pattern: str, flags: str = "", most: int = 1000) -> Column:
    """n, first_at (from 0, null if there is none) and the first `most` matches of a pattern."""
    p = F.lit(flagged(pattern, flags))
    at = F.regexp_instr(text, p)
    return F.when(text.isNotNull(), F.struct(F.regexp_count(text, p).alias("n"), F.when(at > 0, at - 1).alias("first_at"), F.slice(F.regexp_extract_all(text, p, F.lit(0)), 1, most).alias("found")))


def regex_replaced(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """All matches replaced; in the replacement $1, $12 (if there are so many groups), $<name>, $& and $$ mean what they do in a browser."""
    groups, out, at = re.compile(pattern.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!")), "", 0
    while at < len(replacement):
        rest = replacement[at:]
        if m := re.match(r"\$\$", rest):
            out += r"\$"
        elif m := re.match(r"\$&", rest):
            out += "$0"
        elif groups.groupindex and (m := re.match(r"\$<([^>]*)>", rest)):
            out += f"${{{m[1]}}}" if m[1] in groups.groupindex else ""
        elif (m := re.match(r"\$([1-9][0-9]?)", rest)) and int(m[1][0]) <= groups.groups:
            number = m[1] if int(m[1]) <= groups.groups else m[1][0]
            m = re.match(r"\$" + number, rest)
            out += f"${number}"
        else:
            m = re.match(r"(?s).", rest)
            out += "\\" + m[0] if m[0] in "\\$" else m[0]
        at += len(m[0])
    return F.regexp_replace(text, flagged(pattern, flags), out)


def csv_line(cells: list[Column]) -> Column:
    """Cells joined by commas; quoted where they hold a quote, comma, semicolon, tab or line break."""
    quoted = [F.when(c.rlike('[",\\n\\r;\\t]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.coalesce(x.cast("string"), F.lit("")) for x in cells)]
    return F.concat_ws(",", *quoted)
