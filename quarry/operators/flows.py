"""Flows of blocks (file_id, block, kind, level, ordered, bold, text, items, src, page): Markdown texts read into them, chapters, HTML and RTF written of them.

Kinds are heading, paragraph, list, image and page_break. A file's lines and blocks are ordered by windows over the file, so files are
dealt to tasks, by one shuffle of their texts, which all that follows keeps to; a file's text that is written is one row. Null texts are read as empty ones and have no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space as Markdown's readers take it, and the lines that aren't plain text.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
FENCE, RULE = r"^```[0-9A-Za-z_]*$", r"^(?:-{3,}|\*{3,}|_{3,})$"
HEADING, IMAGE = rf"^(#{{1,6}}){SPACE}+(.*)$", r"^!\[([^\]]*)\]\(([^)]+)\)$"
BULLET, QUOTE = rf"^{SPACE}*([-*+\u2022]|[0-9]+[.)]){SPACE}+(.*)$", rf"^>{SPACE}?(.*)$"
MARKS = [("bold", r"\*\*([^*]+)\*\*"), ("bold", r"__([^_]+)__"), ("italic", r"\*([^*]+)\*"), ("code", r"`([^`]+)`"), ("link", r"\[([^\]]+)\]\([^)]+\)")]
#: The title of a text before the first heading, of a page, and characters of a title that is the head of a paragraph.
UNTITLED, PAGE_TITLE, TITLE_UNITS = "正文", ("第 ", " 页"), 80
#: The head of an HTML text, and the begin of an RTF text.
STYLE = """<style>body{max-width:46em;margin:3em auto;padding:0 1.2em;font:15px/1.75 -apple-system,"Segoe UI",Roboto,"PingFang SC","Microsoft YaHei",sans-serif;color:#1f2430}
img{max-width:100%;height:auto}h1,h2,h3{line-height:1.35}hr{margin:2.5em 0;border:0;border-top:1px solid #dfe3ea}
figure{margin:1.5em 0}code{background:#f2f4f8;padding:.1em .35em;border-radius:4px}</style>"""
RTF_HEAD = "{\\rtf1\\ansi\\ansicpg1252\\deff0\\deflang1033\n{\\fonttbl{\\f0\\froman\\fcharset0 Times New Roman;}{\\f1\\fnil\\fcharset134 SimSun;}}\n\\viewkind4\\uc1\n"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def markdown_blocks(files: DataFrame) -> DataFrame:
    """file_id, block (from 0), kind, level, ordered, text, items, src of files (file_id, text in Markdown).

    Lines between fences are a paragraph as they stand; whether a line is in one is told by the number of fences before it. Lines of text and quotes
    that follow each other are a paragraph, bullets that follow each other a list, as long as all are numbered or none is.
    """
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    down = Window.partitionBy("file_id").orderBy("_k")
    d = files.select("file_id", text.alias("_text")).repartition("file_id").select("file_id", F.posexplode(F.split("_text", "\n", -1)).alias("_k", "_raw"))
    d = d.withColumn("_fence", F.col("_raw").contains("```") & trimmed(F.col("_raw")).rlike(FENCE))
    inside = F.coalesce(F.sum(F.col("_fence").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    d = d.withColumn("_in", inside).withColumns({"_line": F.rtrim("_raw", F.lit(SPACES)), "_t": trimmed(F.col("_raw"))})
    mark = F.regexp_extract("_line", BULLET, 1)
    kind = F.when(F.col("_fence"), F.when(F.col("_in"), "close").otherwise("open")).when(F.col("_in"), "code").when(F.col("_t") == "", "blank").when(F.col("_t").rlike(RULE), "page_break").when(F.col("_line").rlike(HEADING), "heading").when(F.col("_t").rlike(IMAGE), "image")
    d = d.withColumn("_kind", kind.when(mark.rlike("^[0-9]"), "ordered").when(mark != "", "plain").otherwise("text"))
    begins = F.col("_kind").isin("open", "page_break", "heading", "image") | F.col("_kind").isin("ordered", "plain", "text") & (F.col("_kind") != F.lag("_kind", 1, "").over(down))
    d = d.withColumn("_b", F.sum(begins.cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("_kind").isin("blank", "close"))
    quoted = F.regexp_extract("_line", QUOTE, 1)
    said = F.when(F.col("_kind") == "code", F.col("_raw")).when(F.col("_kind") == "heading", trimmed(F.regexp_extract("_line", HEADING, 2))).when(F.col("_kind") == "image", F.regexp_extract("_t", IMAGE, 1)).when(F.col("_kind").isin("ordered", "plain"), trimmed(F.regexp_extract("_line", BULLET, 2)))
    said = said.when(F.col("_kind") == "text", F.when(F.col("_line").rlike(QUOTE), trimmed(quoted)).otherwise(F.col("_t")))
    # of a block's first line only a heading's level and an image's source are held, not its text again
    level = F.when(F.col("_kind") == "heading", F.length(F.regexp_extract("_line", HEADING, 1)))
    src = F.when(F.col("_kind") == "image", trimmed(F.regexp_extract("_t", IMAGE, 2)))
    one = F.struct("_k", "_kind", said.alias("_said"), level.alias("_level"), src.alias("_src"))
    b = d.groupBy("file_id", "_b").agg(F.array_sort(F.collect_list(one)).alias("_l")).withColumn("_first", F.get("_l", F.lit(0)))
    first, texts = F.col("_first._kind"), F.filter(F.col("_l._said"), lambda x: x.isNotNull())
    code, a_list = first == "open", first.isin("ordered", "plain")
    joined = F.when(code, F.array_join(texts, "\n")).when(first == "text", trimmed(F.array_join(texts, " "))).when(first.isin("heading", "image"), F.get(texts, F.lit(0)))
    b = b.select(
        "file_id", "_b", F.when(code | (first == "text"), "paragraph").when(a_list, "list").otherwise(first).alias("kind"), code.alias("code"),
        F.col("_first._level").alias("level"), F.when(a_list, first == "ordered").alias("ordered"), joined.alias("text"), F.when(a_list, texts).alias("items"), F.col("_first._src").alias("src"),
    ).where("kind <> 'paragraph' or code or text <> ''")
    return b.withColumn("block", F.row_number().over(Window.partitionBy("file_id").orderBy("_b")) - 1).select("file_id", "block", "kind", "level", "ordered", "code", "text", "items", "src")


def markdown_titles(blocks: DataFrame) -> DataFrame:
    """file_id, title of markdown_blocks(): the first heading of level 1, or the head of the first paragraph that isn't code, whichever comes first; files without either are left out."""
    units = F.decode(F.substring(F.encode("text", "UTF-16BE"), 1, 2 * TITLE_UNITS), "UTF-16BE")
    named = blocks.where("kind = 'heading' and level = 1 or kind = 'paragraph' and not code")
    return named.groupBy("file_id").agg(F.min_by(F.when(F.col("kind") == "heading", F.col("text")).otherwise(units), "block").alias("title"))


def inline_runs(text: Column) -> Column:
    """An array of text, bold, italic, code: parts of a Markdown text by its marks, which don't nest; a link gives its text."""
    any_mark = "|".join(p.replace("(", "(?:", 1) if k != "link" else r"\[[^\]]+\]\([^)]+\)" for k, p in MARKS)
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s)((?:{any_mark})|(?:(?!{any_mark}).)+)"), F.lit(1))

    def run(t: Column) -> Column:
        out, style = t, {k: F.lit(False) for k in ("bold", "italic", "code")}
        for kind, pattern in reversed(MARKS):
            hit = t.rlike(f"^(?:{pattern})$")
            out = F.when(hit, F.regexp_extract(t, f"^(?:{pattern})$", 1)).otherwise(out)
            style = {k: F.when(hit, F.lit(k == kind)).otherwise(v) for k, v in style.items()}
        return F.struct(out.alias("text"), *[v.alias(k) for k, v in style.items()])

    plain = F.struct(text.alias("text"), *[F.lit(False).alias(k) for k in ("bold", "italic", "code")])
    return F.when(F.size(tokens) > 0, F.transform(tokens, run)).otherwise(F.array(plain))


def chapters(flow: DataFrame, by: str = "heading") -> DataFrame:
    """file_id, chapter (from 1), title, blocks (their numbers, in order) of a flow (file_id, block, kind, level, text, page).

    by heading: one of level 1 or 2 begins a chapter, which has its text as title and doesn't hold it; what stands before the first is a chapter without title.
    by page: a chapter begins where the page is another than that of the block before; page 0 is named by the chapter's number. Page breaks are left
    out, but a file that has nothing else is one chapter of them.
    """
    return chapters_by(flow, [by]).drop("way")


def chapters_by(flow: DataFrame, ways: list[str]) -> DataFrame:
    """way, file_id, chapter, title, blocks of chapters() by each of some ways; the flow is read once."""
    down = Window.partitionBy("file_id").orderBy("block")
    to_here = down.rowsBetween(Window.unboundedPreceding, 0)
    no_break, page = F.col("kind") != "page_break", F.col("page") if "page" in ways else F.lit(None).cast("int")
    d = flow.select("file_id", "block", "kind", "level", F.when(F.col("kind") == "heading", F.col("text")).alias("_text"), page.alias("page"))
    d = d.withColumn("_bare", ~F.coalesce(F.bool_or(no_break).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(False))).where(no_break | F.col("_bare"))
    begins = {"heading": (F.col("kind") == "heading") & (F.col("level") <= 2), "page": ~F.col("_bare") & F.coalesce(F.col("page") != F.lag("page").over(down), F.lit(True))}
    d = d.withColumns({f"_new_{w}": begins[w] for w in ways})
    d = d.withColumns({f"_c_{w}": F.coalesce(F.sum(F.col(f"_new_{w}").cast("int")).over(to_here), F.lit(0)) for w in ways})
    new = F.col("_new_heading")
    each = {
        "heading": lambda: [F.when(~new, F.col("block")).alias("_own"), F.when(new, F.col("_text")).alias("_text")],
        "page": lambda: [F.col("block").alias("_own"), F.lit(None).cast("string").alias("_text")],
    }
    d = d.select("file_id", "_bare", "page", F.explode(F.array(*[F.struct(F.lit(w).alias("way"), F.col(f"_c_{w}").alias("_c"), *each[w]()) for w in ways])).alias("_w")).select("file_id", "_bare", "page", "_w.*")
    c = d.groupBy("file_id", "way", "_c").agg(F.array_sort(F.collect_list("_own")).alias("blocks"), F.max("_text").alias("_text"), F.min("page").alias("_page"), F.first("_bare").alias("_bare"))
    c = c.withColumn("chapter", F.row_number().over(Window.partitionBy("file_id", "way").orderBy("_c")))
    named = F.concat(F.lit(PAGE_TITLE[0]), F.when(F.col("_page") == 0, F.col("chapter")).otherwise(F.col("_page")).cast("string"), F.lit(PAGE_TITLE[1]))
    title = F.when(F.col("_bare") | (F.col("way") == "heading") & (F.col("_c") == 0), UNTITLED).when(F.col("way") == "heading", F.col("_text")).otherwise(named)
    return c.select("way", "file_id", "chapter", title.alias("title"), "blocks")


def html_text(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def html(flow: DataFrame, title: str | None = None) -> DataFrame:
    """file_id, text: a flow (file_id, block, kind, level, ordered, bold, text, items, src, page) as an HTML text; title: the name of a column, the same for all blocks of a file.

    Lists of one kind that follow each other are one list, across blocks and pages alike; an image without src is left out, but ends a list.
    """
    down = Window.partitionBy("file_id").orderBy("block")
    tag = F.when(F.col("kind") == "list", F.when(F.col("ordered"), "ol").otherwise("ul"))
    d = flow.withColumn("_tag", tag)
    d = d.withColumn("_opens", ~F.col("_tag").eqNullSafe(F.lag("_tag").over(down))).withColumn("_closes", ~F.col("_tag").eqNullSafe(F.lead("_tag").over(down)))
    edge = lambda when, mark: F.when(when, F.array(F.concat(F.lit(mark), "_tag", F.lit(">")))).otherwise(F.array().cast("array<string>"))
    items = F.concat(edge(F.col("_opens"), "<"), F.transform("items", lambda i: F.concat(F.lit("  <li>"), html_text(i), F.lit("</li>"))), edge(F.col("_closes"), "</"))
    level, text = F.least("level", F.lit(6)).cast("string"), html_text(F.col("text"))
    lines = F.when(F.col("kind") == "heading", F.array(F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">")))).when(F.col("kind") == "list", items).when(F.col("kind") == "page_break", F.array(F.lit("<hr>")))
    lines = lines.when((F.col("kind") == "image") & F.col("src").isNotNull(), F.array(F.concat(F.lit('<figure><img src="'), html_text(F.col("src")), F.lit(f'" alt="{PAGE_TITLE[0]}'), F.col("page").cast("string"), F.lit(f'{PAGE_TITLE[1]}"></figure>'))))
    lines = lines.when(F.col("kind") == "paragraph", F.array(F.when(F.col("bold"), F.concat(F.lit("<p><strong>"), text, F.lit("</strong></p>"))).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))))
    named = F.first(title) if title else F.lit("")
    one = d.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("block", F.coalesce(lines, F.array().cast("array<string>")).alias("l")))).alias("_b"), named.alias("_title"))
    body = F.array_join(F.flatten(F.col("_b.l")), "\n")
    return one.select("file_id", F.concat(F.lit('<!doctype html>\n<html lang="zh-CN"><head><meta charset="utf-8">\n<title>'), html_text(F.coalesce("_title", F.lit(""))), F.lit(f"</title>\n{STYLE}</head><body>\n"), body, F.lit("\n</body></html>\n")).alias("text"))


def rtf_text(text: Column) -> Column:
    r"""Backslashes and braces escaped, lines as \par, UTF-16 units beyond printable ASCII as signed numbers of 16 bits."""
    for c, name in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\par\n")):
        text = F.replace(text, F.lit(c), F.lit(name))
    others = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)([^\x00-\x7e])"), F.lit(1)))

    def units(c: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda u: F.conv(u, 16, 10).cast("int"))
        return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("\\u"), F.when(n > 32767, n - 65536).otherwise(n).cast("string"), F.lit("?"))), "")

    return F.aggregate(others, text, lambda s, c: F.replace(s, c, units(c)))


def rtf(flow: DataFrame) -> DataFrame:
    """file_id, text: a flow (file_id, block, kind, level, ordered, bold, text, items) as an RTF text, without images."""
    text = rtf_text(F.col("text"))
    size = F.greatest(44 - F.col("level") * 6, F.lit(20)).cast("string")
    lines = F.when(F.col("kind") == "heading", F.array(F.concat(F.lit("\\pard\\sb240\\sa120\\b\\fs"), size, F.lit(" "), text, F.lit("\\b0\\par"))))
    lines = lines.when(F.col("kind") == "paragraph", F.array(F.concat(F.lit("\\pard\\sa120"), F.when(F.col("bold"), "\\b").otherwise(""), F.lit(" "), text, F.when(F.col("bold"), "\\b0").otherwise(""), F.lit("\\par"))))
    lines = lines.when(F.col("kind") == "list", F.transform("items", lambda i: F.concat(F.lit("\\pard\\fi-360\\li360 "), F.when(F.col("ordered"), "-").otherwise("\u2022"), F.lit(" "), rtf_text(i), F.lit("\\par"))))
    lines = lines.when(F.col("kind") == "page_break", F.array(F.lit("\\page"))).otherwise(F.array().cast("array<string>"))
    one = flow.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("block", lines.alias("l")))).alias("_b"))
    return one.select("file_id", F.concat(F.lit(RTF_HEAD), F.array_join(F.flatten(F.col("_b.l")), "\n"), F.lit("\n}\n")).alias("text"))
