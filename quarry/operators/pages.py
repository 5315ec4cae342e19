"""Operators on a page table (file_id, page, width, height, rotation): groups, plans, turns, labels, boxes, sheets, blank pages.

Sizes are in points. Rows are independent where not said otherwise; a null size gives null boxes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.relational import keep_first, natural_key, selected_pages

#: Sheet sizes in points (width, height).
PRESETS = {"a4": (595.28, 841.89), "a5": (419.53, 595.28), "letter": (612.0, 792.0)}
POINTS_PER_MM = 72 / 25.4


def split_groups(page: Column, total: Column, mode: str, every: int = 2) -> Column:
    """The number (from 0) of the part a page falls into: each-page, every-n or halves (the first one has the odd page)."""
    if mode == "each-page":
        return page - 1
    if mode == "every-n":
        return F.floor((page - 1) / max(1, int(every))).cast("int")
    if mode == "halves":
        return F.when(page <= F.ceil(total / 2), 0).otherwise(1)
    raise ValueError(f"unknown mode {mode}")


def range_groups(df: DataFrame, keys: list[str], selector: str, total: Column, as_one: bool = False) -> DataFrame:
    """keys, part, pos, page: each part of a selector (`1-3,4`) is a part of the split, or all one after another are one."""
    parts = F.filter(F.transform(F.split(F.col(selector), "[,;，、]"), lambda p: F.trim(p)), lambda p: p != "")
    rows = df.select(*keys, total.alias("_total"), F.posexplode(parts).alias("part", "_sel"))
    rows = rows.select(*keys, "part", F.posexplode(selected_pages(F.col("_sel"), F.col("_total"))).alias("pos", "page"))
    if as_one:
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("part", "pos")) - 1).withColumn("part", F.lit(0))
    return rows


def extracted(pages: DataFrame, selector: Column) -> DataFrame:
    """Pages that the selector (a column or literal) names, in its order, repeats kept, with pos from 0. selector must be the same for a file.

    The selector is read once a file, and pages are joined to it: no page of another file meets it.
    """
    files = pages.groupBy("file_id").agg(F.max("page").alias("_total"), F.first(selector).alias("_sel"))
    wanted = files.select("file_id", F.posexplode(selected_pages(F.col("_sel"), F.col("_total"))).alias("pos", "page"))
    return wanted.join(pages, ["file_id", "page"])


def without(pages: DataFrame, selector: Column) -> DataFrame:
    """Pages that the selector doesn't name, renumbered from 1. A file of which it names all, or none by an empty text, stays whole."""
    files = pages.groupBy("file_id").agg(F.max("page").alias("_total"), F.first(selector).alias("_sel"))
    gone = files.where("trim(_sel) not in ('', 'all', '*')").select("file_id", "_total", F.array_distinct(selected_pages(F.col("_sel"), F.col("_total"))).alias("_gone"))
    gone = gone.where("size(_gone) < _total").select("file_id", F.explode("_gone").alias("page"))
    return pages.join(gone, ["file_id", "page"], "left_anti").withColumn("new_page", F.row_number().over(Window.partitionBy("file_id").orderBy("page")))


def planned(plan: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a plan (pos, file_id, page, turn) with their pages and new rotation, those of files that aren't there, and those of pages that a file hasn't."""
    named = plan.join(pages, ["file_id", "page"], "left").withColumn("_there", F.col("width").isNotNull() | F.col("rotation").isNotNull())
    files = pages.select("file_id").distinct()
    bad = named.where(~F.col("_there")).select(*plan.columns)
    good = named.where("_there").drop("_there").withColumn("rotation", turned(F.coalesce("rotation", F.lit(0)), F.coalesce("turn", F.lit(0))))
    return good, bad.join(files, "file_id", "left_anti"), bad.join(files, "file_id", "left_semi")


def turned(rotation: Column, angle: Column) -> Column:
    """Rotation after a turn, 0 to 359."""
    return F.pmod(rotation + angle, F.lit(360))


def page_label(form: str, page: Column, total: Column, start: int = 1, skip_first: bool = False, name: Column | None = None) -> Column:
    """The label of a page: {n}, {total} (without a skipped first page, 1 at least) and {name} in `form`; null on a skipped page."""
    out = F.replace(F.replace(F.lit(form), F.lit("{n}"), (page - 1 + start).cast("string")), F.lit("{total}"), F.greatest(total - int(skip_first), F.lit(1)).cast("string"))
    if name is not None:
        out = F.replace(out, F.lit("{name}"), name)
    return F.when((page > 1) if skip_first else F.lit(True), out)


def points(mm: Column) -> Column:
    return mm * POINTS_PER_MM


def placed(width: Column, height: Column, box_w: Column, box_h: Column, inset: Column) -> Column:
    """scale (1 at most), x, y of a page in the middle of a box, with an inset on all sides."""
    free_w, free_h = F.greatest(box_w - inset * 2, F.lit(1.0)), F.greatest(box_h - inset * 2, F.lit(1.0))
    scale = F.least(free_w / width, free_h / height, F.lit(1.0))
    return F.struct(box_w.alias("box_width"), box_h.alias("box_height"), scale.alias("scale"), (inset + (free_w - width * scale) / 2).alias("x"), (inset + (free_h - height * scale) / 2).alias("y"))


def oriented(width: Column, height: Column, orientation: str) -> tuple[Column, Column]:
    long, short = F.greatest(width, height), F.least(width, height)
    return (long, short) if orientation == "landscape" else (short, long) if orientation == "portrait" else (width, height)


def resized(width: Column, height: Column, target: str, orientation: str = "keep", margin: float = 0, scale: float = 100, first: tuple[Column, Column] | None = None) -> Column:
    """A page on a sheet of a preset size, of its file's first page (match-first) or of its own size times a scale (25 to 800 per cent)."""
    box = first if target == "match-first" and first else tuple(map(F.lit, PRESETS[target])) if target in PRESETS else (width, height)
    box = oriented(*box, orientation)
    if target == "scale":
        factor = min(max(scale, 25) / 100, 8)
        box = (box[0] * factor, box[1] * factor)
    return placed(width, height, *box, F.lit(float(max(margin, 0))))


def with_margins(width: Column, height: Column, edge: float = 24, sides: str = "all", keep_size: bool = True) -> Column:
    """A page shrunk within its own size by the greater margin, or on a sheet grown by the margins of the sides (all, vertical, horizontal)."""
    v, h = (float(max(edge, 0)) if sides in ("all", k) else 0.0 for k in ("vertical", "horizontal"))
    return placed(width, height, width, height, F.lit(max(v, h))) if keep_size else placed(width, height, width + 2 * h, height + 2 * v, F.lit(0.0))


def cropped(width: Column, height: Column, edges: tuple[Column, Column, Column, Column]) -> Column:
    """The crop box (x0, y0, x1, y1) after cutting edges (left, bottom, right, top), of which at least 20 points a side stay."""
    left, right = (F.least(F.greatest(e, F.lit(0.0)), F.greatest(width - 20, F.lit(0.0))) for e in (edges[0], edges[2]))
    bottom, top = (F.least(F.greatest(e, F.lit(0.0)), F.greatest(height - 20, F.lit(0.0))) for e in (edges[1], edges[3]))
    return F.struct(left.alias("x0"), bottom.alias("y0"), F.greatest(width - left - right, F.lit(20.0)).alias("x1"), F.greatest(height - bottom - top, F.lit(20.0)).alias("y1"))


def grid(per_sheet: int) -> tuple[int, int]:
    """Columns and rows of a sheet of so many pages."""
    columns = 3 if per_sheet >= 9 or per_sheet == 6 else 2 if per_sheet >= 4 or per_sheet == 2 else 1
    return columns, math.ceil(per_sheet / columns)


def on_sheets(place: Column, width: Column, height: Column, per_sheet: int, sheet: tuple[float, float] = PRESETS["a4"], gap: float = 8, margin: float = 12, orientation: str = "auto", column_first: bool = False, most: float | None = None) -> Column:
    """sheet, slot, x, y (from the top), cell_width, cell_height, scale of the page at a place (from 0) of a file: plain arithmetic."""
    w, h = sheet
    if orientation == "landscape" or orientation == "auto" and per_sheet >= 4:
        w, h = max(sheet), min(sheet)
    elif orientation == "portrait":
        w, h = min(sheet), max(sheet)
    columns, rows = grid(per_sheet)
    cell_w, cell_h = (w - 2 * margin - gap * (columns - 1)) / columns, (h - 2 * margin - gap * (rows - 1)) / rows
    slot = place % per_sheet
    col, row = (F.floor(slot / rows), slot % rows) if column_first else (slot % columns, F.floor(slot / columns))
    scale = F.least(F.lit(cell_w) / width, F.lit(cell_h) / height, *([F.lit(float(most))] if most else []))
    return F.struct(
        F.floor(place / per_sheet).cast("int").alias("sheet"), slot.cast("int").alias("slot"), (margin + col * (cell_w + gap)).alias("x"), (margin + row * (cell_h + gap)).alias("y"),
        F.lit(cell_w).alias("cell_width"), F.lit(cell_h).alias("cell_height"), scale.alias("scale"),
    )


def on_shelves(tiles: DataFrame, keys: list[str], order: str, sheet: tuple[float, float], gap: float = 8, margin: float = 12) -> DataFrame:
    """Rows of tiles (keys, order, width, height) with sheet, x, y, scale: put in order on shelves from the left, a new shelf where one is full, a new sheet likewise.

    A fold over each key's tiles, of which a key has few: those of one printed job.
    """
    a, b = sheet[0] - 2 * margin, sheet[1] - 2 * margin
    g, m = F.lit(float(gap)), F.lit(float(margin))
    one = F.struct(F.col(order).alias("o"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"), F.struct("*").alias("row"))
    jobs = tiles.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_t")).withColumn("_s", F.transform("_t", lambda t: F.struct(t["w"].alias("w"), t["h"].alias("h"))))
    zero = F.lit(0.0)
    slot = "array<struct<sheet:int,x:double,y:double,scale:double>>"
    start = F.struct(F.lit(0).alias("sheet"), F.lit(0).alias("n"), zero.alias("along"), zero.alias("used"), zero.alias("band"), F.array().cast(slot).alias("out"))

    def put(s: Column, t: Column) -> Column:
        scale = F.least(F.lit(1.0), F.lit(a) / t["w"], F.lit(b) / t["h"])
        w, h = t["w"] * scale, t["h"] * scale
        wraps = (s["n"] > 0) & (s["along"] + g + w > a)
        used, band, along = F.when(wraps, s["used"] + s["band"] + g).otherwise(s["used"]), F.when(wraps, zero).otherwise(s["band"]), F.when(wraps, zero).otherwise(s["along"])
        turns = (used + h > b) & (s["n"] > 0)
        used, band, along = (F.when(turns, zero).otherwise(v) for v in (used, band, along))
        number = s["sheet"] + turns.cast("int")
        here = F.struct(number.alias("sheet"), (m + along).alias("x"), (m + used).alias("y"), scale.alias("scale"))
        return F.struct(number.alias("sheet"), F.when(turns, 1).otherwise(s["n"] + 1).alias("n"), (along + w + g).alias("along"), used.alias("used"), F.greatest(band, h).alias("band"), F.concat(s["out"], F.array(here)).alias("out"))

    jobs = jobs.withColumn("_o", F.aggregate("_s", start, put, lambda s: s["out"]))
    return jobs.select(F.explode(F.arrays_zip("_t", "_o")).alias("_z")).select("_z._t.row.*", "_z._o.*")


def without_blank(ratios: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Rows of ratios (file_id, page, ink) with is_blank (ink at most the tolerance in per cent) and new_page; null on blank pages.

    A file of which all pages are blank, or of which an ink ratio is missing, keeps all its pages.
    """
    limit = max(tolerance, 0) / 100
    blank = F.col("ink") <= limit
    files = ratios.groupBy("file_id").agg((F.bool_and(blank) | F.bool_or(F.col("ink").isNull())).alias("_whole"))
    rows = ratios.join(files, "file_id").withColumn("is_blank", F.coalesce(blank, F.lit(False)) & ~F.col("_whole")).drop("_whole")
    number = F.row_number().over(Window.partitionBy("file_id", "is_blank").orderBy("page"))
    return rows.withColumn("new_page", F.when(~F.col("is_blank"), number))


def merge_plan(files: DataFrame, sheet: tuple[float, float] = PRESETS["a4"], per_sheet: int = 2, gap: float = 8, margin: float = 12) -> tuple[DataFrame, DataFrame]:
    """Where the bills of each job (job, file_id, name, size, width, height) go when they are printed together, and how many repeats of a job were left out.

    Files are repeats if their lower-cased names and sizes are equal; the first in natural order stays.
    """
    key = natural_key(F.col("name"))
    keyed = files.withColumn("_same", F.concat(F.lower("name"), F.lit(":"), F.col("size").cast("string"))).withColumn("_k", key).withColumn("_n", F.octet_length("name"))
    first = keep_first(keyed, [F.col("job"), F.col("_same")], [F.col("_k"), F.col("_n"), F.col("file_id")])
    order = Window.partitionBy("job").orderBy("_k", "_n", "file_id")
    placed_at = first.withColumn("_p", F.row_number().over(order) - 1)
    spot = on_sheets(F.col("_p"), F.col("width"), F.col("height"), per_sheet, sheet, gap, margin, most=1.0)
    dropped = keyed.groupBy("job").agg((F.count(F.lit(1)) - F.count_distinct("_same")).alias("repeats"))
    return placed_at.select("job", "file_id", spot.alias("_s")).select("job", "file_id", "_s.*"), dropped
