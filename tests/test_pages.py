import random

from pyspark.sql import functions as F

import __spark_entry__
from quarry.functions.fields import invoice_fields
from quarry.operators import layout, pages
from quarry.sources.files import file_digests, scan_files

RUN = "file_id long, page int, idx int, text string, x double, y double, w double, h double, size double, weight string"


def runs(spark, rows):
    return spark.createDataFrame([(1, 1, k, t, x, y, w, 10.0, size, weight) for k, (t, x, y, w, size, weight) in enumerate(rows)], RUN)


def test_rows(spark):
    df = runs(spark, [("b", 30.0, 10.4, 10.0, 10.0, "normal"), ("a", 10.0, 10.0, 10.0, 10.0, "normal"), ("c", 10.0, 30.0, 10.0, 10.0, "normal")])
    got = layout.clustered(df).orderBy("row", "x").collect()
    assert [(r.row, r.text) for r in got] == [(0, "a"), (0, "b"), (1, "c")]
    assert layout.clustered(df.limit(0)).collect() == []


def test_lines_and_cells(spark):
    for x, text in ((5.2, "ab"), (7.0, "a b")):
        d = layout.clustered(runs(spark, [("a", 0.0, 0.0, 5.0, 10.0, "normal"), ("b", x, 0.0, 5.0, 10.0, "normal")]))
        assert layout.lines(d).first().text == text
    d = layout.clustered(runs(spark, [("a", 0.0, 0.0, 5.0, 10.0, "normal"), ("b", 0.0, 20.0, 5.0, 10.0, "normal")]))
    assert [r.block for r in layout.lines(d).orderBy("row").collect()] == [0, 1]
    d = layout.clustered(runs(spark, [("ab", 0.0, 0.0, 5.0, 10.0, "normal"), ("cd", 15.0, 0.0, 5.0, 10.0, "normal")]))
    assert [r.text for r in layout.cells(d, 8.0).orderBy("cell").collect()] == ["ab", "cd"]
    assert [r.text for r in layout.cells(d, 20.0).collect()] == ["ab cd"]
    joined = lambda *t: spark.range(1).select(layout.joined_text(F.array(*map(F.lit, t))).alias("v")).first().v
    assert (joined("ab-", "cd"), joined("中文", "续"), joined("ab", "cd")) == ("abcd", "中文续", "ab cd")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pages_are_not_shuffled(spark):
    """Pages in rows pass all steps there; a file's own sums take one shuffle, and give what runs in a table give."""
    rows = [(f, p, k, t, x, y, 10.0, 10.0, size, "normal") for f in (1, 2) for p in (1, 2) for k, (t, x, y, size) in enumerate([(" a,", 0.0, 0.0, 24.0), ("b", 12.0, 3.0, 24.0), ("", 30.0, 1.0, 10.0), ("c", 0.0, 40.0, 9.0), ('"', 40.0, 44.0, 9.0), ("中", 52.0, 41.0, 9.0)])]
    runs = spark.createDataFrame(rows, RUN)
    pages = spark.createDataFrame([(f, p, [r[2:] for r in rows if r[:2] == (f, p)]) for f in (1, 2) for p in (1, 2)], f"file_id long, page int, runs array<struct<{', '.join(f'{c}: {t}' for c, t in (x.split() for x in RUN.split(', ')[2:]))}>>")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    cells = layout.cells(layout.clustered(runs), 8.0)
    lines = layout.lines(layout.clustered(runs))
    for a, b, n in [(layout.page_cells(pages, 8.0), cells, 0), (layout.page_lines(pages), lines, 0), (layout.page_blocks(pages), layout.blocks(lines), 1), (layout.page_csv_rows(pages, 8.0), layout.csv_rows(cells), 1), (layout.page_csv_document(pages, 8.0), layout.csv_document(layout.csv_rows(cells)), 1)]:
        assert shuffles(a) == n and same(a, b)
    assert [r.text for r in lines.where("file_id = 1 and page = 1").orderBy("row").collect()] == ["a,b", 'c "中']
    assert layout.page_csv_document(pages, 8.0).where("file_id = 2").first().text == "\ufeff" + "\r\n".join(f'# page {p}\r\n"a, b"\r\nc,""" 中"\r\n' for p in (1, 2)) + "\r\n"
    sizes = layout.with_body_sizes(lines.groupBy("file_id", "page", "block").agg(F.array_sort(F.collect_list(F.struct("row", "text", "size", "weight"))).alias("_l")))
    assert same(sizes.select("file_id", "mode").distinct(), layout.body_sizes(lines))


def test_headings_tell_lines_once(spark):
    """Runs and their blocks come from one call of Python, which isn't made again to see whether there is a block, and no text is dealt by file."""
    plan = __spark_entry__.queries()["headings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    calls = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
    assert len(calls) == 1 and "_blocks(_runs(" in calls[0]
    dealt = plan.splitlines()[[k for k, x in enumerate(plan.splitlines()) if "hashpartitioning(file_id" in x][0] + 1]
    assert "_chars" in dealt and "_l#" not in dealt and "text#" not in dealt


def plain_lines(runs):
    """row, text, y, block of the runs (idx, text, x, y, w, h, size, weight) of a page, one run after the other."""
    starts, held = [], []
    for r in sorted(runs, key=lambda r: (r[3], r[2], r[0])):
        k = next((k for k, s in enumerate(starts) if abs(s[3] - r[3]) < max(min(s[5], r[5]) * 0.55, 2.0)), len(starts))
        if k == len(starts):
            starts.append(r)
            held.append([])
        held[k].append(r)
    out, block = [], 0
    for k, row in enumerate(held):
        said, right, full, closed = "", -1e300, False, False
        for _, t, x, _, w, _, size, _ in sorted(row, key=lambda r: (r[2], r[0])):
            if full and x - right > max(size * 0.16, 1.0) and not closed and not (t and t[0] in " 中"):
                said, closed = said + " ", True
            said += t
            if t:
                full, closed = True, t[-1] in " 中"
            right = max(right, x + w)
        block += k > 0 and starts[k][3] - starts[k - 1][3] > max(starts[k][5], starts[k - 1][5]) * 1.45
        out.append((k, said.strip(" "), starts[k][3], block))
    return out


def test_lines_of_odd_runs(spark):
    """Rows and spaces of all pages at once are those of one run after the other: runs without text, that overlap, at equal places, in any order."""
    r = random.Random(4)
    pages = [[(k, r.choice(["", "", "a", "b-", "中", "x中", "中x", " ", "q ", " q"]), r.randrange(9) * 5.0, r.randrange(6) * r.choice([1.5, 9.0]), r.choice([0.0, 4.0, 12.0]), r.choice([3.0, 10.0]), r.choice([6.0, 24.0]), "normal") for k in r.sample(range(n), n)] for n in (1, 2, 5, 40) for _ in range(20)]
    d = spark.createDataFrame([(1, p, page) for p, page in enumerate([*pages, []])], f"file_id long, page int, runs array<struct<{', '.join(f'{c}: {t}' for c, t in (x.split() for x in RUN.split(', ')[2:]))}>>")
    got = {}
    for x in layout.page_lines(d).orderBy("page", "row").collect():
        got.setdefault(x.page, []).append((x.row, x.text, x.y, x.block))
    assert got == {p: plain_lines(page) for p, page in enumerate(pages)}
    assert {(x.page, x.block) for x in layout.page_blocks(d).collect()} == {(p, x[3]) for p, page in got.items() for x in page}


def test_blocks_and_markdown(spark):
    rows = [("Title", 0.0, 0.0, 50.0, 24.0, "normal"), ("body text here", 0.0, 30.0, 80.0, 10.0, "normal"), ("1. first", 0.0, 60.0, 40.0, 10.0, "normal"), ("2. second", 0.0, 72.0, 40.0, 10.0, "normal"), ("Bold words", 0.0, 100.0, 40.0, 10.0, "bold"), ("more bold", 0.0, 112.0, 40.0, 10.0, "bold")]
    flow = layout.blocks(layout.lines(layout.clustered(runs(spark, rows))))
    got = flow.orderBy("block").collect()
    assert [(r.kind, r.level, r.bold) for r in got] == [("heading", 1, False), ("paragraph", 0, False), ("list", 0, False), ("paragraph", 0, True)]
    assert got[2].ordered and got[2]["items"] == ["first", "second"]
    assert layout.markdown(flow).first().text == "# Title\n\nbody text here\n\n1. first\n2. second\n\n**Bold words more bold**\n"


def test_recognized_tables(spark):
    box = lambda k, t, x, y: (1, 1, k, t, x, y, x + 30.0, y + 10.0)
    rows = [box(0, "a", 0.0, 0.0), box(1, " b ", 103.0, 2.0), box(2, "c", 5.0, 30.0), box(3, "d", 100.0, 31.0), box(4, "", 0.0, 60.0), box(5, "e", 25.0, 30.0)]
    df = spark.createDataFrame(rows, "file_id long, page int, idx int, text string, left double, top double, right double, bottom double")
    got = layout.recognized_tables(df).orderBy("row", "column").collect()
    assert [(r.row, r.column, r.text) for r in got] == [(0, 0, "a"), (0, 2, "b"), (1, 0, "c"), (1, 1, "e"), (1, 2, "d")]
    assert layout.recognized_tables(df.limit(0)).collect() == []


def test_shelves_and_blank_pages(spark):
    tiles = spark.createDataFrame([(1, k, w, h) for k, (w, h) in enumerate([(60.0, 30.0), (50.0, 20.0), (40.0, 50.0), (200.0, 10.0), (10.0, 80.0)])], "file_id long, page int, width double, height double")
    got = pages.on_shelves(tiles, ["file_id"], "page", (120.0, 120.0), gap=5, margin=10).orderBy("page").collect()
    assert [(r.sheet, r.x, r.y, r.scale) for r in got] == [(0, 10.0, 10.0, 1.0), (0, 10.0, 45.0, 1.0), (0, 65.0, 45.0, 1.0), (0, 10.0, 100.0, 0.5), (1, 10.0, 10.0, 1.0)]
    ink = spark.createDataFrame([(1, 1, 0.02), (1, 2, 0.03), (2, 1, 0.0), (2, 2, 0.01), (3, 1, 0.0), (3, 2, None)], "file_id long, page int, ink double")
    got = pages.without_blank(ink).orderBy("file_id", "page").collect()
    assert [(r.is_blank, r.new_page) for r in got] == [(True, None), (False, 1), (False, 1), (False, 2), (False, 1), (False, 2)]


def test_bill_fields(spark):
    said = "电子发票\n发票号码： 12345678901\n销售方名称:\t甲  公司 |\n合计金额(小写)：￥1,234.50\n填开日期 2024 年 1 月 2 日"
    got = spark.range(1).select(invoice_fields(F.lit(said)).alias("v"), invoice_fields(F.lit(None).cast("string")).alias("n")).first()
    assert got.v.asDict() == {"date": "2024 年 1 月 2 日", "seller": "甲 公司", "buyer": "", "invoice_no": "12345678901", "amount": "1,234.50", "type": "电子发票"} and got.n is None


def test_file_scan(spark, tmp_path):
    (tmp_path / "a" / "old").mkdir(parents=True)
    for name, size in (("a/x.PDF", 10), ("a/y.pdf", 500), ("a/z.png", 20), ("a/n.txt", 5), ("a/old/q.pdf", 7), ("b.pdf", 30)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = scan_files(spark, f"file://{tmp_path}", most_files=3, most_bytes=100, most_total=1000, excluded="a/old").orderBy("path").collect()
    assert [(r.relative_path, r.extension, r.size, r.status) for r in got] == [("a/x.PDF", "pdf", 10, "ok"), ("a/y.pdf", "pdf", 500, "too-large"), ("a/z.png", "png", 20, "ok"), ("b.pdf", "pdf", 30, "ok")]
    got = scan_files(spark, f"file://{tmp_path}", most_files=2, most_total=35).orderBy("path").collect()
    assert [r.status for r in got] == ["ok", "ok", "over-limit", "over-limit", "over-limit"]
    assert file_digests(spark, f"file://{tmp_path}", "b.*").first().size == 30
