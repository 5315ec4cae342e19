"""Text runs of pages (file_id, page, idx, text, x, y, w, h, size, weight) to rows, lines, cells, blocks and table text.

A page's runs stand together in one row of Spark, as an array `runs`: a page has a few hundred. folded() makes such rows of a table of runs, by
its only shuffle; who has pages in rows already (the words of a text) passes them to the page_ functions, which need none. A file's own
sums and numbers take one shuffle of rows of pages or blocks. Pages without runs give nothing; runs of equal place stay in the order of idx.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from quarry.functions.text import csv_line
from quarry.operators.relational import weighted_mode

#: Signs between which words have no spaces.
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}　-〿＀-￯]"
#: How a list item begins; numbers make an ordered list.
NUMBERED = r"^\s*(\(\d{1,3}\)|\d{1,3}[.)]|[一二三四五六七八九十]+[、.])\s+"
BULLET = r"^\s*([•·▪◦‣*o●-]|\(\d{1,3}\)|\d{1,3}[.)]|[一二三四五六七八九十]+[、.])\s+"
#: Least ratios of a heading's size to the text's, by level.
HEADINGS = [(1, 1.7), (2, 1.35), (3, 1.12)]
RUN = ["idx", "text", "x", "y", "w", "h", "size", "weight"]


def structs(**types) -> ArrayType:
    out = StructType()
    for name, kind in types.items():
        out = out.add(name, kind)
    return ArrayType(out)


def run_struct(d: DataFrame) -> Column:
    """A run of a row of d, places as doubles; its row too, if d has it."""
    return F.struct(F.col("idx").cast("long").alias("idx"), "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "size")], "weight", *(["row"] if "row" in d.columns else []))


def folded(runs: DataFrame) -> DataFrame:
    """file_id, page, runs: a row a page."""
    return runs.groupBy("file_id", "page").agg(F.collect_list(run_struct(runs)).alias("runs"))


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The structs of all lists one after the other, with the number of the list that each is of."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()


def numbers(run: pa.StructArray, name: str) -> np.ndarray:
    """A field as numbers; null as one that nothing is near to."""
    return run.field(name).to_numpy(zero_copy_only=False)


def nested(of: np.ndarray, count: int, values: pa.Array) -> pa.ListArray:
    """Values as `count` lists, given the number of the list of each, in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(count + 1)), pa.int32()), values)


def downwards(page: np.ndarray, run: pa.StructArray) -> np.ndarray:
    """The order of runs by page, y, x and idx."""
    return np.lexsort((numbers(run, "idx"), numbers(run, "x"), numbers(run, "y"), page))


def placed(page: np.ndarray, run: pa.StructArray, down: np.ndarray | None = None) -> np.ndarray:
    """The row of each run: by y, then x, each joins the first row whose first run is nearer in y than 0.55 of the lesser height, or 2."""
    if run.type.get_field_index("row") >= 0:
        return numbers(run, "row").astype(np.int64)
    left = downwards(page, run) if down is None else down
    rows, row = np.empty(len(left), np.int64), 0
    p, y, h = page[left], numbers(run, "y")[left], numbers(run, "h")[left]
    # of all pages at once: what is left of a page begins its next row, and all that is near to that joins it
    while len(left):
        begins = changes(p)
        first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        reach = np.where(h < h[first], h, h[first]) * 0.55
        joins = begins | (np.abs(y[first] - y) < np.where(reach < 2.0, 2.0, reach))
        rows[left[joins]] = row
        left, p, y, h = (v[~joins] for v in (left, p, y, h))
        row += 1
    return rows


def changes(*keys: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it, in any of the keys; the first does."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


@F.arrow_udf(ArrayType(IntegerType()))
def _rows(runs: pa.Array) -> pa.Array:
    page, run = flat(runs)
    return nested(page, len(runs), pa.array(placed(page, run), pa.int32()))


def across(page: np.ndarray, row: np.ndarray, run: pa.StructArray) -> np.ndarray | None:
    """The order of runs by pages, rows, x and idx; None if they stand in it."""
    x, idx = numbers(run, "x"), numbers(run, "idx")
    later = (x[1:] > x[:-1]) | (x[1:] == x[:-1]) & (idx[1:] >= idx[:-1])
    if np.all((page[1:] != page[:-1]) | (row[1:] > row[:-1]) | (row[1:] == row[:-1]) & later):
        return None
    return np.lexsort((idx, x, row, page))


def cut(runs: pa.Array, gap: float) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """The page and the row number of each row, and the texts of its cells."""
    page, run = flat(runs)
    row = placed(page, run)
    order = across(page, row, run)
    if order is not None:
        page, row, run = page[order], row[order], run.take(pa.array(order))
    first = changes(page, row)
    new = first.copy()
    new[1:] |= numbers(run, "x")[1:] - (numbers(run, "x") + numbers(run, "w"))[:-1] > gap
    starts, lines = np.flatnonzero(new), np.flatnonzero(first)
    text = pc.fill_null(run.field("text"), "")
    if len(starts) < len(page):
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(page)), pa.int32()), text), " ")
    return page[lines], row[lines], pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(starts, lines), len(starts)), pa.int32()), pc.utf8_trim(text, " "))


def _cells(gap: float):
    @F.arrow_udf(structs(row=IntegerType(), texts=ArrayType(StringType())))
    def of(runs: pa.Array) -> pa.Array:
        page, row, texts = cut(runs, gap)
        return nested(page, len(runs), pa.StructArray.from_arrays([pa.array(row, pa.int32()), texts], ["row", "texts"]))

    return of


def _csv_lines(gap: float):
    @F.arrow_udf(ArrayType(StringType()))
    def of(runs: pa.Array) -> pa.Array:
        """Cells are quoted as csv_line() does."""
        page, _, texts = cut(runs, gap)
        text = texts.values
        quoted = pc.binary_join_element_wise('"', pc.replace_substring(text, '"', '""'), '"', "")
        text = pc.if_else(pc.match_substring_regex(text, '[",\n\r;\t]'), quoted, text)
        return nested(page, len(runs), pc.binary_join(pa.ListArray.from_arrays(texts.offsets, text), ","))

    return of


#: The signs of CJK and white space at a text's end or begin, as Arrow's expressions have them.
_SIGN = r"(?s:[\t\n\x0B\f\r \p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}])"


def spaced(run: pa.StructArray, lines: np.ndarray) -> np.ndarray:
    """Whether a space stands before a run, given the places of the lines' first ones: where the gap to all before it in its line is wide enough,
    a text was there, and neither a space nor a sign that needs none stands between them."""
    at, x, text = np.arange(len(run)), numbers(run, "x"), run.field("text")
    begin = np.repeat(lines, np.diff(np.append(lines, len(run))))
    # the right end of the runs up to here, by steps of 1, 2, 4 and so on
    right, step = np.fmax(x + numbers(run, "w"), -1e300), 1
    while (there := np.flatnonzero(at - begin >= step)).size:
        right[there] = np.maximum(right[there], right[there - step])
        step *= 2
    wide = np.zeros(len(run), bool)
    wide[1:] = x[1:] - right[:-1] > np.maximum(numbers(run, "size") * 0.16, 1.0)[1:]
    known = lambda v: pc.fill_null(v, False).to_numpy(zero_copy_only=False)
    head, tail = (known(pc.match_substring_regex(text, p)) for p in (f"^{_SIGN}", f"{_SIGN}$"))
    filled = known(pc.greater(pc.binary_length(text), 0))
    # the last run with a text before this one
    last = np.full(len(run), -1)
    last[1:] = np.maximum.accumulate(np.where(filled, at, -1))[:-1]
    space = wide & (last >= begin) & ~tail[last] & ~head
    # runs without text may have taken it
    taken = np.cumsum(space & ~filled)
    space[1:] &= taken[:-1] == taken[last[1:]]
    return space


def lined(runs: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array], np.ndarray]:
    """The page of each line, its fields, and whether it begins a block."""
    page, run = flat(runs)
    down = downwards(page, run)
    row = placed(page, run, down)
    rank = np.empty(len(down), np.int64)
    rank[down] = np.arange(len(down))
    y, h = numbers(run, "y"), numbers(run, "h")
    order = across(page, row, run)
    if order is not None:
        page, row, rank, run = page[order], row[order], rank[order], run.take(pa.array(order))
    lines = np.flatnonzero(changes(page, row))
    parts = pc.binary_join_element_wise(pc.if_else(pa.array(spaced(run, lines)), " ", ""), run.field("text"), "")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(lines, len(page)), pa.int32()), parts), "")
    # a row stands where its first run by y, x and idx does
    top = down[np.minimum.reduceat(rank, lines)] if len(lines) else lines
    y, h, p = y[top], h[top], page[lines]
    begins = changes(p)
    begins[1:] |= y[1:] - y[:-1] > np.maximum(h[1:], h[:-1]) * 1.45
    block = np.cumsum(begins) - 1
    block -= block[np.searchsorted(p, p)] if len(p) else 0
    at = pa.array(lines)
    fields = {"row": pa.array(row[lines], pa.int32()), "text": pc.utf8_trim(text, " \t\n\x0b\f\r"), "x": pa.array(numbers(run, "x")[lines]), "y": pa.array(y), "h": pa.array(h), "size": pa.array(numbers(run, "size")[lines]), "weight": run.field("weight").take(at), "block": pa.array(block, pa.int32())}
    return p, fields, begins


@F.arrow_udf(structs(row=IntegerType(), text=StringType(), **dict.fromkeys(("x", "y", "h", "size"), DoubleType()), weight=StringType(), block=IntegerType()))
def _lines(runs: pa.Array) -> pa.Array:
    page, fields, _ = lined(runs)
    return nested(page, len(runs), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


@F.arrow_udf(structs(block=IntegerType(), _l=structs(row=IntegerType(), text=StringType(), size=DoubleType(), weight=StringType())))
def _blocks(runs: pa.Array) -> pa.Array:
    page, fields, begins = lined(runs)
    starts = np.flatnonzero(begins)
    names = ["row", "text", "size", "weight"]
    held = pa.ListArray.from_arrays(pa.array(np.append(starts, len(page)), pa.int32()), pa.StructArray.from_arrays([fields[c] for c in names], names))
    return nested(page[starts], len(runs), pa.StructArray.from_arrays([fields["block"].take(pa.array(starts)), held], ["block", "_l"]))


def clustered(runs: DataFrame) -> DataFrame:
    """runs with `row` (from 0, downwards): by y, then x, each joins the first row whose first run is nearer in y than 0.55 of the lesser height, or 2."""
    return page_rows(folded(runs))


def page_rows(pages: DataFrame) -> DataFrame:
    """clustered() of pages."""
    d = pages.withColumn("_o", _rows("runs")).select("file_id", "page", F.explode(F.arrays_zip("runs", "_o")).alias("_z"))
    return d.select("file_id", "page", F.col("_z._o").alias("row"), *[F.col(f"_z.runs.{c}").alias(c) for c in RUN])


def cells(rows: DataFrame, gap: float = 8.0) -> DataFrame:
    """file_id, page, row, cell, text of clustered runs: a new cell starts where the gap to the run before exceeds `gap`; else runs are joined by a space."""
    return page_cells(folded(rows), gap)


def page_cells(pages: DataFrame, gap: float = 8.0) -> DataFrame:
    """cells() of pages."""
    return pages.select("file_id", "page", F.explode(_cells(gap)("runs")).alias("_r")).select("file_id", "page", F.col("_r.row").alias("row"), F.posexplode("_r.texts").alias("cell", "text"))


def csv_rows(cell_rows: DataFrame) -> DataFrame:
    """file_id, seq (from 0), line: a file's table rows as CSV lines; with `# page n` before and an empty line after each page if it has more than one."""
    line = cell_rows.groupBy("file_id", "page", "row").agg(F.array_sort(F.collect_list(F.struct("cell", "text"))).alias("_c")).withColumn("line", csv_cells(F.col("_c.text")))
    return framed_lines(framed(line.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("_l")).withColumn("_l", F.col("_l.line"))))


def framed(pages: DataFrame) -> DataFrame:
    """file_id, page, _l, _before: a page's lines within their frame, and how many lines of its file are before them."""
    file = Window.partitionBy("file_id")
    d = pages.repartition("file_id").withColumn("_n", F.count(F.lit(1)).over(file))
    d = d.withColumn("_l", F.when(F.col("_n") > 1, F.concat(F.array(F.concat(F.lit("# page "), F.col("page").cast("string"))), F.col("_l"), F.array(F.lit("")))).otherwise(F.col("_l")))
    return d.withColumn("_before", F.sum(F.size("_l")).over(file.orderBy("page").rowsBetween(Window.unboundedPreceding, 0)) - F.size("_l"))


def framed_lines(frames: DataFrame) -> DataFrame:
    return frames.select("file_id", "_before", F.posexplode("_l").alias("_i", "line")).select("file_id", (F.col("_before") + F.col("_i")).cast("int").alias("seq"), "line")


def page_lines_of_csv(pages: DataFrame, gap: float) -> DataFrame:
    """file_id, page, _l: the CSV lines of each page."""
    return pages.select("file_id", "page", _csv_lines(gap)("runs").alias("_l")).where(F.size("_l") > 0)


def page_csv_rows(pages: DataFrame, gap: float = 8.0) -> DataFrame:
    """csv_rows() of the cells of pages."""
    return framed_lines(framed(page_lines_of_csv(pages, gap)))


def page_csv_document(pages: DataFrame, gap: float = 8.0) -> DataFrame:
    """csv_document() of the cells of pages."""
    d = framed(page_lines_of_csv(pages, gap)).select("file_id", "page", F.array_join("_l", "\r\n").alias("_t"))
    one = d.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("page", "_t"))).alias("_p"))
    return one.select("file_id", F.concat(F.lit("\ufeff"), F.array_join(F.col("_p._t"), "\r\n"), F.lit("\r\n")).alias("text"))


def csv_document(rows: DataFrame) -> DataFrame:
    """file_id, text of csv_rows(): a byte order mark, then each line with CR and LF."""
    one = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("_l"))
    return one.select("file_id", F.concat(F.lit("\ufeff"), F.array_join(F.col("_l.line"), "\r\n"), F.lit("\r\n")).alias("text"))


def csv_cells(values: Column) -> Column:
    """An array of cells as a CSV line."""
    return F.array_join(F.transform(values, lambda c: csv_line([c])), ",")


def lines(rows: DataFrame) -> DataFrame:
    """file_id, page, row, text, x, y, h, size, weight, block of clustered runs; a block ends at a gap of over 1.45 heights between rows.

    Runs are joined with a space where the gap exceeds 0.16 of the size, and 1, unless white space or a CJK sign stands there.
    """
    return page_lines(folded(rows))


def told(pages: DataFrame, of) -> DataFrame:
    """file_id, page and the fields of what a function tells of a page's runs, null where that is nothing.

    The function has its column and `outer`, so that one that makes the runs is called together with it, and neither is called once more to see whether there is a row.
    """
    return pages.select("file_id", "page", of("runs").alias("_o")).select("file_id", "page", F.inline_outer("_o"))


def page_lines(pages: DataFrame) -> DataFrame:
    """lines() of pages."""
    return told(pages, _lines).where("row is not null")


def joined_text(parts: Column) -> Column:
    """Lines as one text: a hyphen at an end goes, CJK signs meet without a space, all else with one."""
    tail, head = F.lit(rf"(?s){CJK}$"), F.lit(rf"(?s)^{CJK}")

    def put(s: Column, p: Column) -> Column:
        return F.when(s == "", p).when(s.endswith("-"), F.concat(F.regexp_replace(s, "-$", ""), p)).when(F.regexp_like(s, tail) | F.regexp_like(p, head), F.concat(s, p)).otherwise(F.concat(s, F.lit(" "), p))

    return F.aggregate(parts, F.lit(""), put)


def body_sizes(page_lines: DataFrame) -> DataFrame:
    """file_id, mode: the rounded size of most characters of a file's lines, the first seen on ties."""
    return weighted_mode(page_lines, ["file_id"], F.round("size"), F.length("text"), F.struct("page", "row")).select("file_id", "mode")


def blocks(page_lines: DataFrame) -> DataFrame:
    """file_id, page, block, kind (heading, list, paragraph), level, ordered, bold, text, items of lines.

    A lone line of up to 120 characters is a heading by its size against the file's text (10 if there is none), or if
    bold and of up to 60; blocks with bullets on at least 60 per cent of their lines are lists.
    """
    return judged(page_lines.groupBy("file_id", "page", "block").agg(F.array_sort(F.collect_list(F.struct("row", "text", "size", "weight"))).alias("_l")))


def page_blocks(pages: DataFrame) -> DataFrame:
    """blocks() of the lines of pages."""
    return judged(told(pages, _blocks).where("block is not null"))


def with_body_sizes(d: DataFrame) -> DataFrame:
    """Blocks (file_id, page, block, _l, and more) with `mode`, as body_sizes() has it of their lines.

    Blocks are dealt by file once, with a row more for each size of a block's lines beside that of its first, and sums are windows; so lines are made once.
    """
    sizes = F.transform("_l", lambda x: F.struct(F.round(x["size"]).alias("v"), F.length(x["text"]).alias("w"), x["row"].alias("row")))
    of = lambda v: F.filter("_s", lambda x: x["v"].eqNullSafe(v))
    each = F.transform(F.array_distinct(F.col("_s.v")), lambda v: F.struct(v.alias("v"), F.aggregate(of(v), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["w"], F.lit(0))).alias("w"), F.get(of(v), F.lit(0))["row"].alias("row")))
    more = [c for c in d.columns if c not in ("file_id", "page")]
    # a block has a line; without `outer` its sizes would be made once more to see that
    s = d.withColumn("_s", sizes).withColumn("_s", each).select("file_id", "page", *more, F.posexplode_outer("_s").alias("_i", "_s"))
    s = s.select("file_id", "page", *[F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in more], "_i", F.col("_s.v").alias("_v"), F.col("_s.w").alias("_w"), F.struct("page", F.col("_s.row").alias("row")).alias("_o")).repartition("file_id")
    same = Window.partitionBy("file_id", "_v")
    s = s.select("file_id", "page", *more, "_i", F.struct((-F.sum("_w").over(same)).alias("w"), F.min("_o").over(same).alias("o"), F.col("_v").alias("v")).alias("_m"))
    return s.withColumn("mode", F.min("_m").over(Window.partitionBy("file_id"))["v"]).where("_i = 0").select(*d.columns, "mode")


def judged(d: DataFrame) -> DataFrame:
    """blocks() of file_id, page, block, _l (its lines in order). What lines tell is taken from them before blocks are dealt by file, so that only what is asked for is dealt."""
    texts, first = F.col("_l.text"), F.col("_l")[0]
    bold, bullets = F.forall(F.col("_l.weight"), lambda w: w == "bold"), F.filter(texts, lambda t: t.rlike(BULLET))
    d = with_body_sizes(d.withColumns({"text": joined_text(texts), "_size": first["size"], "_bold": first["weight"] == "bold", "_chars": F.length(first["text"]), "_n": F.size("_l"), "bold": bold, "_bullets": bullets}))
    ratio = F.col("_size") / F.greatest(F.coalesce("mode", F.lit(10.0)), F.lit(1.0))
    level = F.when(F.col("_bold") & (ratio >= 0.95) & (F.col("_chars") <= 60), 4).otherwise(0)
    for k, least in reversed(HEADINGS):
        level = F.when(ratio >= least, k).otherwise(level)
    level = F.when((F.col("_n") == 1) & (F.col("_chars") <= 120), level).otherwise(0)
    many = F.size("_bullets") >= F.greatest(F.col("_n") * 0.6, F.lit(1.0))
    d = d.withColumn("level", level).withColumn("bold", F.col("bold") & (F.col("level") == 0)).withColumn("kind", F.when(F.col("level") > 0, "heading").when(~F.col("bold") & many, "list").otherwise("paragraph"))
    a_list = F.col("kind") == "list"
    items = F.when(a_list, F.transform("_bullets", lambda t: F.trim(F.regexp_replace(t, BULLET, ""))))
    ordered = F.when(a_list, F.exists("_bullets", lambda t: t.rlike(NUMBERED)))
    return d.select("file_id", "page", "block", "kind", "level", ordered.alias("ordered"), "bold", "text", items.alias("items"))


def markdown(flow: DataFrame) -> DataFrame:
    """file_id, text: blocks as Markdown, with a rule between pages."""
    number = F.transform("items", lambda t, i: F.concat(F.when(F.col("ordered"), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), t))
    said = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).when(F.col("kind") == "list", F.array_join(number, "\n")).when(F.col("bold"), F.concat(F.lit("**"), F.col("text"), F.lit("**"))).otherwise(F.col("text"))
    page = flow.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(F.struct("block", said.alias("t")))).alias("_b")).select("file_id", "page", F.array_join(F.col("_b.t"), "\n\n").alias("t"))
    return page.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("_p")).select("file_id", F.concat(F.array_join(F.col("_p.t"), "\n\n---\n\n"), F.lit("\n")).alias("text"))


def document_text(pages: DataFrame, markers: bool = True) -> DataFrame:
    """file_id, text of page texts (file_id, page, text): pages in order with an empty line between, with `--- n ---` before each if there is more than one."""
    d = pages.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("_p"))
    one = lambda p: F.concat(F.lit("--- "), p["page"].cast("string"), F.lit(" ---\n"), p["text"])
    parts = F.when(F.size("_p") > 1, F.transform("_p", one)).otherwise(F.col("_p.text")) if markers else F.col("_p.text")
    return d.select("file_id", F.regexp_replace(F.array_join(parts, "\n\n"), r"^\s+|\s+$", "").alias("text"))


def recognized_tables(boxes: DataFrame, width: float | str = 0.0) -> DataFrame:
    """file_id, page, row, column, text of recognised lines (file_id, page, idx, text, left, top, right, bottom); width: of all pages, or the name of a column.

    A line joins the first row whose centre is within 0.55 of the greater height, which grows with it. Columns are running averages of left
    edges, apart by over 18 or 0.018 of the page width; a line takes the nearest, the next free one to its right if that is taken
    and it stands that far off, or is joined to what is there. A page's lines stand together in one row of Spark, as its runs do.
    """
    some = boxes.where("trim(text) <> ''").withColumn("_w", F.col(width) if isinstance(width, str) else F.lit(width))
    line = F.struct(F.col("idx").cast("long").alias("idx"), F.col("text"), *[F.col(c).cast("double").alias(c) for c in ("left", "top", "bottom")])
    page = some.groupBy(F.col("file_id").cast("long").alias("file_id"), F.col("page").cast("int").alias("page")).agg(F.collect_list(line).alias("boxes"), F.max("_w").cast("double").alias("width"))
    return page_tables(page)


def page_tables(pages: DataFrame) -> DataFrame:
    """recognized_tables() of pages (file_id, page, boxes: an array of idx, text, left, top, bottom; width)."""
    d = pages.select("file_id", "page", F.inline(_tables("boxes", F.greatest(F.col("width") * 0.018, F.lit(18.0)))))
    return d.select("file_id", "page", "row", "column", "text")


def table_of(lines: list[tuple], apart: float) -> list[tuple[int, int, str]]:
    """row, column and text of the lines (top, left, idx, bottom, text) of a page, in order."""
    tops, bottoms, held = [], [], []
    for line in lines:
        top, bottom = line[0], line[3]
        for k, (a, b) in enumerate(zip(tops, bottoms, strict=True)):
            if abs((top + bottom) / 2 - (a + b) / 2) <= max(bottom - top, b - a) * 0.55:
                tops[k], bottoms[k] = min(a, top), max(b, bottom)
                held[k].append(line)
                break
        else:
            tops.append(top)
            bottoms.append(bottom)
            held.append([line])
    columns: list[float] = []
    for left in sorted(x[1] for x in lines):
        for k, c in enumerate(columns):
            if abs(c - left) <= apart:
                columns[k] = (c + left) / 2
                break
        else:
            columns.append(left)
    columns.sort()
    out = []
    # rows by their tops, equal ones as they came
    for row, k in enumerate(sorted(range(len(tops)), key=tops.__getitem__)):
        cells: dict[int, str] = {}
        for _, left, _, _, text in sorted(held[k], key=lambda x: (x[1], x[0], x[2], x[4])):
            at = min(range(len(columns)), key=lambda c: abs(columns[c] - left))
            if at in cells and left - columns[at] > apart:
                at = next((c for c in range(at + 1, len(columns)) if c not in cells), at)
            cells[at] = f"{cells[at]} {text}" if at in cells else text
        out += [(row, c, t) for c, t in cells.items()]
    return out


@F.arrow_udf(structs(row=IntegerType(), column=IntegerType(), text=StringType()))
def _tables(boxes: pa.Array, apart: pa.Array) -> pa.Array:
    page, box = flat(boxes)
    text = pc.utf8_trim(box.field("text"), " ")
    keep = pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False)
    top, left, idx, bottom = (numbers(box, c) for c in ("top", "left", "idx", "bottom"))
    order = np.lexsort((bottom, idx, left, top, page))
    order = order[keep[order]]
    lines = list(zip(top[order].tolist(), left[order].tolist(), idx[order].tolist(), bottom[order].tolist(), text.take(pa.array(order)).to_pylist(), strict=True))
    cuts = np.searchsorted(page[order], np.arange(len(boxes) + 1))
    said, ends = [], [0]
    for k, gap in enumerate(apart.to_pylist()):
        said += table_of(lines[cuts[k] : cuts[k + 1]], gap)
        ends.append(len(said))
    row, column, text = zip(*said, strict=True) if said else ((), (), ())
    values = pa.StructArray.from_arrays([pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(text, pa.string())], ["row", "column", "text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
