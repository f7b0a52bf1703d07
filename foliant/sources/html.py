"""Web pages as positioned spans: headings large and bold, paragraphs and list items as body.
Tags are found by built-in expressions; each element is a line on one tall page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1\s*>"
# Named character references that are resolved.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, seq, tag, text)."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(ELEMENT), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(ELEMENT), F.lit(2)).alias("inner"))
    rows = pages.filter("html is not null").select("page_id", F.posexplode(found).alias("seq", "e"))
    return rows.select("page_id", F.col("seq").cast("long").alias("seq"), F.lower("e.tag").alias("tag"), plain(F.col("e.inner")).alias("text")).filter("text <> ''")


def spans(pages: DataFrame) -> DataFrame:
    """Spans keyed by page_id as doc_id; sizes 18 down to 11 for h1 to h6, 10 for text."""
    e = elements(pages)
    level = F.try_to_number(F.substring("tag", 2, 1), F.lit("9")).cast("int")
    head = F.col("tag").rlike("^h[1-6]$")
    size = F.when(head, F.greatest(F.lit(11.0), 20.0 - 2.0 * level)).otherwise(10.0)
    top = F.lit(100000.0) - 24.0 * F.col("seq")
    return e.select(
        F.col("page_id").alias("doc_id"), F.col("seq").alias("span_seq"), F.lit(0).alias("page"), "text", F.when(head, "Sans-Bold").otherwise("Sans").alias("font_name"), size.alias("font_size"),
        head.alias("is_bold"), F.lit(False).alias("is_italic"), F.lit(72.0).alias("left"), top.alias("top"), (F.lit(72.0) + F.least(F.octet_length("text") * size * 0.5, F.lit(468.0))).alias("right"), (top - size).alias("bottom"),
    )
