"""Queries of Markdown texts, chapters, HTML and RTF, over texts that are written of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import flows
from quarry.plans.registry import query

#: What stands before the sentences of a document, in turns; None: a line of its own instead.
BEFORE = [("# ", True), ("- ", True), ("* ", True), ("2. ", True), ("3) ", True), ("> ", True), ("", True), ("", True), ("```py", False), ("", False), ("## ", True), ("   + ", True), ("---", False), ("![pic](a.png) ", False), ("### ", True), ("**", True)]
#: The texts, their lines with what they are, and their blocks.
TEXTS_SQL = f"""w AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), '. '), lambda p, k: {[b for b, _ in BEFORE]}[(k + doc_id) % {len(BEFORE)} + 1] || CASE WHEN {[s for _, s in BEFORE]}[(k + doc_id) % {len(BEFORE)} + 1] THEN p ELSE '' END) AS l FROM documents),
t AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN array_to_string(l, chr(13) || chr(10)) ELSE array_to_string(l, chr(10)) END AS text FROM w)"""
_S = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
BLOCKS_SQL = TEXTS_SQL + rf""", s AS (SELECT file_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM t),
l AS (SELECT file_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS raw FROM s),
f AS (SELECT *, regexp_replace(raw, '{_S}+$', '') AS line, regexp_replace(raw, '^{_S}+|{_S}+$', '', 'g') AS t FROM l),
i AS (SELECT *, regexp_matches(t, '^```[0-9A-Za-z_]*$') AS fence, coalesce(sum(regexp_matches(t, '^```[0-9A-Za-z_]*$')::INTEGER) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
c AS (SELECT *, CASE WHEN fence AND inside THEN 'close' WHEN fence THEN 'open' WHEN inside THEN 'code' WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^(---+|\*\*\*+|___+)$') THEN 'page_break' WHEN regexp_matches(line, '^#{{1,6}}{_S}') THEN 'heading' WHEN regexp_matches(t, '^!\[[^\]]*\]\([^)]+\)$') THEN 'image' WHEN regexp_matches(line, '^{_S}*[0-9]+[.)]{_S}+') THEN 'ordered' WHEN regexp_matches(line, '^{_S}*[-*+•]{_S}+') THEN 'plain' ELSE 'text' END AS class FROM i),
n AS (SELECT *, (class IN ('open', 'page_break', 'heading', 'image') OR class IN ('ordered', 'plain', 'text') AND class <> coalesce(lag(class) OVER (PARTITION BY file_id ORDER BY k), ''))::INTEGER AS begins FROM c),
g AS (SELECT *, sum(begins) OVER (PARTITION BY file_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS b, CASE class WHEN 'code' THEN raw WHEN 'heading' THEN regexp_replace(line, '^#+{_S}+', '') WHEN 'image' THEN regexp_extract(t, '^!\[([^\]]*)\]', 1) WHEN 'ordered' THEN regexp_replace(line, '^{_S}*[0-9]+[.)]{_S}+', '') WHEN 'plain' THEN regexp_replace(line, '^{_S}*[-*+•]{_S}+', '') WHEN 'text' THEN regexp_replace(CASE WHEN line[1] = '>' THEN line[2:] ELSE t END, '^{_S}+|{_S}+$', '', 'g') END AS said FROM n),
a AS (SELECT file_id, b, arg_min(class, k) AS class, arg_min(line, k) AS line, arg_min(t, k) AS t, list(said ORDER BY k) FILTER (said IS NOT NULL) AS said FROM g WHERE class NOT IN ('blank', 'close') GROUP BY file_id, b),
j AS (SELECT file_id, b, CASE WHEN class IN ('open', 'text') THEN 'paragraph' WHEN class IN ('ordered', 'plain') THEN 'list' ELSE class END AS kind, class = 'open' AS code, CASE WHEN class = 'heading' THEN length(regexp_extract(line, '^(#+)', 1))::INTEGER END AS level, CASE WHEN class IN ('ordered', 'plain') THEN class = 'ordered' END AS ordered,
  CASE class WHEN 'open' THEN coalesce(array_to_string(said, chr(10)), '') WHEN 'text' THEN regexp_replace(array_to_string(said, ' '), '^{_S}+|{_S}+$', '', 'g') WHEN 'heading' THEN said[1] WHEN 'image' THEN said[1] END AS text, CASE WHEN class IN ('ordered', 'plain') THEN said END AS items, CASE WHEN class = 'image' THEN regexp_extract(t, '\]\(([^)]+)\)', 1) END AS src FROM a),
blocks AS (SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY b) - 1)::INTEGER AS block, kind, level, ordered, code, text, items, src FROM j WHERE kind <> 'paragraph' OR code OR text <> '')"""


def texts(documents: DataFrame) -> DataFrame:
    before, said = F.array(*[F.lit(b) for b, _ in BEFORE]), F.array(*[F.lit(s) for _, s in BEFORE])
    at = lambda k: ((k + 1 + F.col("doc_id")) % len(BEFORE)).cast("int")
    line = F.transform(F.split(F.coalesce("text", F.lit("")), r"\. ", -1), lambda p, k: F.concat(F.get(before, at(k)), F.when(F.get(said, at(k)), p).otherwise("")))
    return documents.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 3 == 0, F.array_join(line, "\r\n")).otherwise(F.array_join(line, "\n")).alias("text"))


def paged(blocks: DataFrame) -> DataFrame:
    """Blocks with a page (a new one each seven blocks, none for the first) and bold ones."""
    return blocks.withColumn("page", F.floor(F.col("block") / 7).cast("int")).withColumn("bold", F.col("block") % 5 == 0)


@query("documents", f"WITH {BLOCKS_SQL} SELECT file_id, block, kind, level, ordered, code, text, array_to_string(items, '|') AS items, src FROM blocks")
def markdown_blocks(d, read):
    return flows.markdown_blocks(texts(d)).withColumn("items", F.array_join("items", "|"))


@query("documents", f"""WITH {BLOCKS_SQL} SELECT file_id, arg_min(CASE WHEN kind = 'heading' THEN text ELSE left(text, 80) END, block) AS title FROM blocks WHERE kind = 'heading' AND level = 1 OR kind = 'paragraph' AND NOT code GROUP BY file_id""")
def markdown_titles(d, read):
    return flows.markdown_titles(flows.markdown_blocks(texts(d)))


CHAPTERS_SQL = """p AS (SELECT *, block // 7 AS page FROM blocks), o AS (SELECT * FROM p WHERE kind <> 'page_break'),
h AS (SELECT *, (kind = 'heading' AND level <= 2)::INTEGER AS new FROM o), hc AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY block ROWS UNBOUNDED PRECEDING) AS c FROM h),
by_heading AS (SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY c))::INTEGER AS chapter, CASE WHEN c = 0 THEN '正文' ELSE max(text) FILTER (new = 1) END AS title, coalesce(array_to_string(list(block ORDER BY block) FILTER (new = 0), ' '), '') AS blocks FROM hc GROUP BY file_id, c),
q AS (SELECT *, coalesce(page <> lag(page) OVER (PARTITION BY file_id ORDER BY block), true)::INTEGER AS new FROM o), qc AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY block ROWS UNBOUNDED PRECEDING) AS c FROM q),
by_page AS (SELECT file_id, c::INTEGER AS chapter, '第 ' || CASE WHEN min(page) = 0 THEN c ELSE min(page) END || ' 页' AS title, array_to_string(list(block ORDER BY block), ' ') AS blocks FROM qc GROUP BY file_id, c),
bare AS (SELECT file_id, 1 AS chapter, '正文' AS title, array_to_string(list(block ORDER BY block), ' ') AS blocks FROM p GROUP BY file_id HAVING bool_and(kind = 'page_break'))"""


@query("documents", f"WITH {BLOCKS_SQL}, {CHAPTERS_SQL} SELECT 'heading' AS way, * FROM by_heading UNION ALL SELECT 'heading', * FROM bare UNION ALL SELECT 'page', * FROM by_page UNION ALL SELECT 'page', * FROM bare")
def flow_chapters(d, read):
    flow = paged(flows.markdown_blocks(texts(d)))
    return flows.chapters_by(flow, ["heading", "page"]).select("way", "file_id", "chapter", "title", F.array_join("blocks", " ").alias("blocks"))


_H = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("documents", f"""WITH {BLOCKS_SQL}, p AS (SELECT *, block // 7 AS page, block % 5 = 0 AS bold, CASE WHEN kind = 'list' THEN CASE WHEN ordered THEN 'ol' ELSE 'ul' END END AS tag FROM blocks),
o AS (SELECT *, tag IS DISTINCT FROM lag(tag) OVER w AS opens, tag IS DISTINCT FROM lead(tag) OVER w AS closes FROM p WINDOW w AS (PARTITION BY file_id ORDER BY block)),
h AS (SELECT file_id, block, CASE kind WHEN 'heading' THEN '<h' || level || '>' || {_H.format('text')} || '</h' || level || '>' WHEN 'page_break' THEN '<hr>' WHEN 'image' THEN '<figure><img src="' || {_H.format('src')} || '" alt="第 ' || page || ' 页"></figure>'
  WHEN 'paragraph' THEN CASE WHEN bold THEN '<p><strong>' ELSE '<p>' END || {_H.format('text')} || CASE WHEN bold THEN '</strong></p>' ELSE '</p>' END
  ELSE CASE WHEN opens THEN '<' || tag || '>' || chr(10) ELSE '' END || array_to_string(list_transform(items, lambda i: '  <li>' || {_H.format('i')} || '</li>'), chr(10)) || CASE WHEN closes THEN chr(10) || '</' || tag || '>' ELSE '' END END AS html FROM o)
SELECT file_id, '<!doctype html>' || chr(10) || '<html lang="zh-CN"><head><meta charset="utf-8">' || chr(10) || '<title>text ' || file_id || ' &amp; more</title>' || chr(10) || '{flows.STYLE}</head><body>' || chr(10) || string_agg(html, chr(10) ORDER BY block) || chr(10) || '</body></html>' || chr(10) AS text FROM h GROUP BY file_id""")
def flow_html(d, read):
    flow = paged(flows.markdown_blocks(texts(d)))
    return flows.html(flow.withColumn("title", F.concat(F.lit("text "), F.col("file_id").cast("string"), F.lit(" & more"))), "title")


_R = "replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), '{{', chr(92) || '{{'), '}}', chr(92) || '}}'), chr(10), chr(92) || 'par' || chr(10))"
_U = "array_to_string(list_transform(string_split(" + _R + ", ''), lambda c: CASE WHEN c = '' OR unicode(c) <= 126 THEN c WHEN unicode(c) < 65536 THEN chr(92) || 'u' || CASE WHEN unicode(c) > 32767 THEN unicode(c) - 65536 ELSE unicode(c) END || '?' ELSE chr(92) || 'u' || (55296 + (unicode(c) - 65536) // 1024 - 65536) || '?' || chr(92) || 'u' || (56320 + (unicode(c) - 65536) % 1024 - 65536) || '?' END), '')"


@query("documents", rf"""WITH {BLOCKS_SQL}, h AS (SELECT file_id, block, CASE kind WHEN 'heading' THEN '\pard\sb240\sa120\b\fs' || greatest(44 - level * 6, 20) || ' ' || {_U.format('text')} || '\b0\par' WHEN 'page_break' THEN '\page'
  WHEN 'paragraph' THEN '\pard\sa120' || CASE WHEN block % 5 = 0 THEN '\b' ELSE '' END || ' ' || {_U.format('text')} || CASE WHEN block % 5 = 0 THEN '\b0' ELSE '' END || '\par'
  WHEN 'list' THEN array_to_string(list_transform(items, lambda i: '\pard\fi-360\li360 ' || CASE WHEN ordered THEN '-' ELSE '•' END || ' ' || {_U.format('i')} || '\par'), chr(10)) END AS r FROM blocks)
SELECT file_id, '{flows.RTF_HEAD.replace(chr(92), chr(92)).replace("'", "''")}' || coalesce(string_agg(r, chr(10) ORDER BY block), '') || chr(10) || '}}' || chr(10) AS text FROM h GROUP BY file_id""")
def flow_rtf(d, read):
    return flows.rtf(paged(flows.markdown_blocks(texts(d))))
