"""Tables of the matches of a pattern, and replacements that name the text around a match."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.net import bound
from quarry.functions.text import flagged


def group_names(pattern: str) -> list[str | None]:
    """The name, or None, of each group of a pattern in order; brackets that are escaped, in a class or group nothing don't count."""
    tokens = re.finditer(r"\\Q.*?(?:\\E|$)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?<(?P<name>[A-Za-z][A-Za-z0-9]*)>|(?P<plain>\((?!\?))", pattern, re.DOTALL)
    return [t["name"] for t in tokens if t["name"] or t["plain"]]


def whole_characters(pattern: str, flags: str) -> str:
    """The pattern with its flags, which doesn't match nothing amid the two units of a character."""
    return flagged(r"(?![\x{DC00}-\x{DFFF}])(?:" + pattern + ")", flags)


def found_and_between(text: Column, pattern: str, flags: str) -> tuple[Column, Column]:
    """The matches, and the texts before each and after the last: always one more."""
    p = F.lit(whole_characters(pattern, flags))
    found, between = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
    # an empty match at the very start isn't split at
    return found, F.when(F.size(between) == F.size(found), F.concat(F.array(F.lit("")), between)).otherwise(between)


def units(text: Column, utf16: bool) -> Column:
    """Length in UTF-16 units, or in characters."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long") if utf16 else F.length(text).cast("long")


def match_table(df: DataFrame, keys: list[str], text: str, pattern: str, flags: str = "", utf16: bool = True) -> DataFrame:
    """One row a match: the keys, n (from 1), start and stop (from 0, in UTF-16 units or characters), value, groups and named (a map).

    Keys tell rows apart: rows that repeat them must be made one before. A group that took no part is an empty text.
    Null texts and texts without a match have no rows. Places are running sums over what stands before a match and
    the matches, in a window of the keys: lengths travel there, not the texts.
    """
    if not pattern:
        raise ValueError("no pattern")
    names = group_names(pattern)
    found, between = found_and_between(F.col(text), pattern, flags)
    group = [F.regexp_extract_all(F.col(text), F.lit(whole_characters(pattern, flags)), F.lit(k + 1)).alias(f"g{k}") for k in range(len(names))]
    zipped = F.arrays_zip(found.alias("value"), F.slice(F.transform(between, lambda b: units(b, utf16)), F.lit(1), F.size(found)).alias("gap"), *group)
    each = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.posexplode(zipped).alias("_n", "_m"))
    own = [f"_k{i}" for i in range(len(keys))]
    past = Window.partitionBy(*own).orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = units(F.col("_m.value"), utf16)
    at = each.withColumn("_stop", F.sum(F.col("_m.gap") + size).over(past))
    group_columns = [F.col(f"_m.g{k}") for k in range(len(names))]
    pairs = [x for n, g in zip(names, group_columns, strict=True) if n for x in (F.lit(n), g)]
    return at.select(
        *[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)],
        (F.col("_n") + 1).alias("n"),
        (F.col("_stop") - size).alias("start"),
        F.col("_stop").alias("stop"),
        F.col("_m.value").alias("value"),
        (F.array(*group_columns) if names else F.array().cast("array<string>")).alias("groups"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("named"),
    )


def replacement_parts(replacement: str, names: list[str | None]) -> list[tuple[str, str | int]]:
    """What a replacement puts together: ("text", its text), ("group", number, 0 the match), ("before", "") or ("after", "").

    $$, $&, $`, $' , $1 to $99 (two digits if there are so many groups) and $<name> (if any group has a name; nothing
    for an unknown one) mean what they do in a browser; any other $ is itself.
    """
    parts: list[tuple[str, str | int]] = []
    for m in re.finditer(r"\$(?:(?P<sign>[$&`'])|<(?P<name>[^>]*)>|(?P<number>[0-9]{1,2}))|.", replacement, re.DOTALL):
        if sign := m["sign"]:
            parts.append({"$": ("text", "$"), "&": ("group", 0), "`": ("before", ""), "'": ("after", "")}[sign])
        elif m["name"] is not None and any(names):
            if m["name"] in names:
                parts.append(("group", names.index(m["name"]) + 1))
        elif number := m["number"]:
            if 0 < int(number) <= len(names):
                parts.append(("group", int(number)))
            elif len(number) == 2 and 0 < int(number[0]) <= len(names):
                parts += [("group", int(number[0])), ("text", number[1])]
            else:
                parts.append(("text", m[0]))
        else:
            parts.append(("text", m[0]))
    return parts


def regex_rewritten(text: Column, pattern: str, replacement: str, flags: str = "g") -> Column:
    """The text with its first match, or with the flag g each match, replaced, where the replacement may hold the text before and after a match.

    All in one row: what comes out is as long as the replacements say, up to the square of the text's length.
    """
    if not pattern:
        raise ValueError("no pattern")
    names, everywhere = group_names(pattern), "g" in flags
    found, between = found_and_between(text, pattern, flags)
    parts = replacement_parts(replacement, names)
    used = sorted({k for kind, k in parts if kind == "group"} - {0})
    groups = {k: F.regexp_extract_all(text, F.lit(whole_characters(pattern, flags)), F.lit(k)) for k in used}
    all_of = F.struct(found.alias("found"), between.alias("between"), *[g.alias(f"g{k}") for k, g in groups.items()])

    def put(x: Column) -> Column:
        woven = F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["found"])), lambda i: F.when(i < F.size(x["found"]), F.array(F.get(x["between"], i), F.get(x["found"], i))).otherwise(F.array(F.get(x["between"], i)))))

        def one(w: Column, i: Column) -> Column:
            said = {
                "text": lambda v: F.lit(v),
                "group": lambda k: F.get(w, i * 2 + 1) if k == 0 else F.get(x[f"g{k}"], i),
                "before": lambda _: F.array_join(F.slice(w, F.lit(1), i * 2 + 1), ""),
                "after": lambda _: F.array_join(F.slice(w, i * 2 + 3, F.size(w)), ""),
            }
            return F.concat(F.get(w, i * 2), *[said[kind](v) for kind, v in parts])

        def whole(w: Column) -> Column:
            n = F.size(x["found"]) if everywhere else F.least(F.size(x["found"]), F.lit(1))
            made = F.transform(F.slice(x["found"], F.lit(1), n), lambda _, i: one(w, i))
            return F.concat(F.array_join(made, ""), F.array_join(F.slice(w, n * 2 + 1, F.size(w)), ""))

        return bound(woven, whole)

    return F.when(text.isNotNull(), bound(all_of, put))
