"""Fields of invoices and other bills, by label, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the fields and what may follow them.
FIELDS = {
    "date": r"(?:开票日期|开票时间|填开日期)\s*[:：]?\s*((?:20\d{2})\s*[年./-]\s*\d{1,2}\s*[月./-]\s*\d{1,2}\s*日?)",
    "seller": r"(?:销售方名称|销方名称|销售方)\s*[:：]?\s*([^\n\r]{2,80})",
    "buyer": r"(?:购买方名称|购方名称|购买方)\s*[:：]?\s*([^\n\r]{2,80})",
    "invoice_no": r"(?i)(?:发票号码|票据号码|发票\s*No\.?|发票编号)\s*[:：]?\s*([0-9０-９]{8,30})",
    "amount": r"(?:价税合计|小写合计|合计金额)\s*(?:\([^\n)]*\))?\s*[:：]?\s*[¥￥]?\s*([0-9,]+\.\d{2})",
}
#: Kinds of bills, the first that a text names.
KINDS = [("数电发票", "电子发票"), ("电子发票", "电子发票"), ("增值税专用发票", "增值税专用发票"), ("增值税普通发票", "增值税普通发票")]


def invoice_fields(text: Column) -> Column:
    """date, seller, buyer, invoice_no, amount and type of a bill's text, empty where it has none; values have up to 160 characters."""
    lines = F.split(F.replace(F.replace(text, F.lit("\r")), F.lit("\t"), F.lit(" ")), "\n", -1)
    even = F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\s 　]+", " "))), "\n")
    value = lambda p: F.substring(F.regexp_replace(F.trim(F.regexp_extract(even, p, 1)), r"[ |]+$", ""), 1, 160)
    kind = F.lit("")
    for sign, name in reversed(KINDS):
        kind = F.when(even.contains(sign), name).otherwise(kind)
    return F.when(text.isNotNull(), F.struct(*[value(p).alias(k) for k, p in FIELDS.items()], kind.alias("type")))
