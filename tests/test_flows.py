import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import flows, layout


def blocks(spark, *texts):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "file_id int, text string, block int")
    return flows.markdown_blocks(df).orderBy("file_id", "block").collect()


def test_markdown_blocks(spark):
    text = "# 标题\r\n\r\n正文 **加粗** 和 `code`。\r\n- 项目一\r\n- 项目二\r\n\r\n```js\r\nlet a = 1;\r\n```\r\n![图片](a.png)\r\n---\r\n"
    got = blocks(spark, text, "> one\n> two\n\nthree", None, "", ">\n> ", "```\nopen\n# no", "1. a\n- b\n2) c\nd\n\n - e", "####### x\n#y\n ## z\n```a b\n***\n___ \n```\n```")
    by = lambda k: [(r.kind, r.level, r.ordered, r.text, r["items"], r.src) for r in got if r.file_id == k]
    assert by(0) == [("heading", 1, None, "标题", None, None), ("paragraph", None, None, "正文 **加粗** 和 `code`。", None, None), ("list", None, False, None, ["项目一", "项目二"], None), ("paragraph", None, None, "let a = 1;", None, None), ("image", None, None, "图片", None, "a.png"), ("page_break", None, None, None, None, None)]
    assert [x[3] for x in by(1)] == ["one two", "three"]
    assert by(2) == by(3) == by(4) == []
    assert by(5) == [("paragraph", None, None, "open\n# no", None, None)]
    assert [(x[0], x[2], x[4] or x[3]) for x in by(6)] == [("list", True, ["a"]), ("list", False, ["b"]), ("list", True, ["c"]), ("paragraph", None, "d"), ("list", False, ["e"])]
    assert [(x[0], x[3]) for x in by(7)] == [("paragraph", "####### x #y ## z ```a b"), ("page_break", None), ("page_break", None), ("paragraph", "")]
    assert [r.block for r in got if r.file_id == 0] == list(range(6))


def test_titles(spark):
    df = spark.createDataFrame([(0, "hello\n# H"), (1, "字" * 100), (2, "## a\n- b"), (3, "```\nx\n```\n# T")], "file_id int, text string")
    assert {r.file_id: r.title for r in flows.markdown_titles(flows.markdown_blocks(df)).collect()} == {0: "hello", 1: "字" * 80, 3: "T"}


@pytest.mark.parametrize("text, runs", [("a **b** c *d* `e` [f](g)", [("a ", ""), ("b", "b"), (" c ", ""), ("d", "i"), (" ", ""), ("e", "c"), (" ", ""), ("f", "")]), ("", [("", "")]), ("__x__y", [("x", "b"), ("y", "")]), ("2 * 3 ** 4", [("2 ", ""), (" 3 ", "i"), ("* 4", "")]), ("[a] (b)", [("[a] (b)", "")])])
def test_inline_runs(spark, text, runs):
    got = spark.createDataFrame([(text,)], "t string").select(flows.inline_runs(F.col("t")).alias("r")).first().r
    assert [(x.text, "b" * x.bold + "i" * x.italic + "c" * x.code) for x in got] == runs


FLOW = [("heading", 3, None, False, "a", None, 0), ("paragraph", None, None, True, "p <&>", None, 1), ("heading", 1, None, False, "T{1}", None, 1), ("heading", 2, None, False, "U", None, 2), ("list", None, True, False, None, ["x", "é一阿😀"], 2), ("page_break", None, None, False, None, None, 0), ("list", None, True, False, None, ["y"], 3), ("list", None, True, False, None, ["z"], 3)]


def flow(spark):
    rows = [(1, k, *r, None) for k, r in enumerate(FLOW)] + [(2, k, "page_break", None, None, False, None, None, 0, None) for k in range(2)]
    return spark.createDataFrame(rows, "file_id int, block int, kind string, level int, ordered boolean, bold boolean, text string, items array<string>, page int, src string")


def test_chapters(spark):
    said = lambda by: sorted(tuple(r) for r in flows.chapters(flow(spark), by).collect())
    assert said("heading") == [(1, 1, "正文", [0, 1]), (1, 2, "T{1}", []), (1, 3, "U", [4, 6, 7]), (2, 1, "正文", [0, 1])]
    assert said("page") == [(1, 1, "第 1 页", [0]), (1, 2, "第 1 页", [1, 2]), (1, 3, "第 2 页", [3, 4]), (1, 4, "第 3 页", [6, 7]), (2, 1, "正文", [0, 1])]


def test_texts_are_read_and_shuffled_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(k):
        read.add(1)
        return (k, f"# a{k}\r\u3000\r\n> b \u2003\n---" if k else "---")

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(8), 2).map(seen), "file_id int, text string")
    flow = flows.markdown_blocks(df).withColumn("page", F.lit(1)).withColumn("bold", F.lit(False))
    both = flows.chapters_by(flow, ["heading", "page"])
    got = sorted(tuple(r) for r in both.where("file_id < 2").collect())
    assert got == [("heading", 0, 1, "正文", [0]), ("heading", 1, 1, "a1", [1]), ("page", 0, 1, "正文", [0]), ("page", 1, 1, "第 1 页", [0, 1])]
    assert read.value == 8
    for one in (both, flows.html(flow), flows.rtf(flow)):
        assert str(one._jdf.queryExecution().executedPlan().toString()).count("Exchange ") == 1


def test_html_and_rtf(spark):
    text = {r.file_id: r.text for r in flows.html(flow(spark)).collect()}[1]
    body = text.split("<body>\n")[1]
    assert body == "<h3>a</h3>\n<p><strong>p &lt;&amp;&gt;</strong></p>\n<h1>T{1}</h1>\n<h2>U</h2>\n<ol>\n  <li>x</li>\n  <li>é一阿😀</li>\n</ol>\n<hr>\n<ol>\n  <li>y</li>\n  <li>z</li>\n</ol>\n</body></html>\n"
    rtf = {r.file_id: r.text for r in flows.rtf(flow(spark)).collect()}[1]
    assert rtf.split("\\uc1\n")[1] == "\\pard\\sb240\\sa120\\b\\fs26 a\\b0\\par\n\\pard\\sa120\\b p <&>\\b0\\par\n\\pard\\sb240\\sa120\\b\\fs38 T\\{1\\}\\b0\\par\n\\pard\\sb240\\sa120\\b\\fs32 U\\b0\\par\n\\pard\\fi-360\\li360 - x\\par\n\\pard\\fi-360\\li360 - \\u233?\\u19968?\\u-27073?\\u-10179?\\u-8704?\\par\n\\page\n\\pard\\fi-360\\li360 - y\\par\n\\pard\\fi-360\\li360 - z\\par\n}\n"


def plain_table(lines, apart):
    rows, columns, out = [], [], []
    for line in sorted(lines, key=lambda x: (x[0], x[1], x[2])):  # top, left, idx, bottom, text
        for row in rows:
            top, bottom = min(x[0] for x in row), max(x[3] for x in row)
            if abs((line[0] + line[3]) / 2 - (top + bottom) / 2) <= max(line[3] - line[0], bottom - top) * 0.55:
                row.append(line)
                break
        else:
            rows.append([line])
    for left in sorted(x[1] for x in lines):
        near = next((k for k, c in enumerate(columns) if abs(c - left) <= apart), None)
        if near is None:
            columns.append(left)
        else:
            columns[near] = (columns[near] + left) / 2
    columns.sort()
    for k, row in enumerate(sorted(rows, key=lambda r: min(x[0] for x in r))):
        taken = {}
        for line in sorted(row, key=lambda x: (x[1], x[0], x[2])):
            at = min(range(len(columns)), key=lambda c: (abs(columns[c] - line[1]), c))
            free = next((c for c in range(at + 1, len(columns)) if c not in taken), None)
            if at in taken and free is not None and line[1] - columns[at] > apart:
                at = free
            taken[at] = f"{taken[at]} {line[4]}" if at in taken else line[4]
        out += [(k, c, t) for c, t in taken.items()]
    return sorted(out)


def test_recognized_tables_against_plain(spark):
    draw = random.Random(6)
    pages = {p: [(float(draw.randint(0, 90)), float(draw.randint(0, 300)), k, 0.0, f"t{k}") for k in range(draw.randint(1, 25))] for p in range(12)}
    pages = {p: [(a, b, k, a + draw.randint(6, 20), t) for a, b, k, _, t in v] for p, v in pages.items()}
    rows = [(1, p, k, f" {t} ", b, a, b + 30, z, 3000.0 if p % 2 else 100.0) for p, v in pages.items() for a, b, k, z, t in v] + [(1, 0, 900, "  ", 5.0, 5.0, 9.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "file_id int, page int, idx int, text string, left double, top double, right double, bottom double, width double")
    got = layout.recognized_tables(df, "width").collect()
    for p, v in pages.items():
        assert sorted((r.row, r.column, r.text) for r in got if r.page == p) == plain_table(v, max(18.0, 0.018 * (3000 if p % 2 else 100)))
