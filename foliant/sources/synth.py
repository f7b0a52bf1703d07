"""Fixture: positioned spans made from ``documents`` by arithmetic on (doc_id, line number).
Not an engine source; it lets layout queries run where no page files exist.

Line i of a document (of its non-empty lines) is on page i div 8, row i mod 8.  Odd documents have
two columns of four rows.  Every fourth line is special, by (i div 4) mod 5: three kinds of
numbered bold headers, a figure caption, a table caption.  Each page has a running head and a
page number; each figure caption has an image above it, unless doc_id mod 7 is 3.

A special line gives its first 40 letters to the header or caption; the rest of the line is a body
span of its own, one row below, so every letter of a document but the white space around a cut is
in a span.  Null and empty texts make no span, and an empty table none; repeated rows repeat their
spans; other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 8
HEAD = 40  # letters of a special line that make its header or caption


def _lines(docs: DataFrame) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = docs.filter("text is not null").select("doc_id", F.posexplode(parts).alias("i", "t"))
    k, n = F.col("i") % 4 == 0, F.floor(F.col("i") / 20) + 1
    kind = F.when(k, F.floor(F.col("i") / 4) % 5).otherwise(-1).cast("int")
    head = F.trim(F.substring("t", 1, HEAD))
    num = n.cast("string")
    text = (
        F.when(kind == 0, F.concat(num, F.lit(" "), head))
        .when(kind == 1, F.concat(num, F.lit(".1 "), head))
        .when(kind == 2, F.concat(F.lit("IV. "), head))
        .when(kind == 3, F.concat(F.lit("Fig. "), num, F.lit(": "), head))
        .when(kind == 4, F.concat(F.lit("Table "), num, F.lit(". "), head))
        .otherwise(F.col("t"))
    )
    big = kind.isin(0, 1, 2)
    row = F.col("i") % ROWS
    two = F.col("doc_id") % 2 == 1
    rest = F.when(kind >= 0, F.trim(F.expr(f"substring(t, {HEAD + 1})"))).otherwise("")
    d = d.select("doc_id", "i", kind.alias("kind"), text.alias("text"), rest.alias("rest"), F.floor(F.col("i") / ROWS).cast("int").alias("page"), row.alias("row"), two.alias("two"), big.alias("big"))
    size = F.when(F.col("big"), 14.0).otherwise(10.0)
    left = F.when(F.col("two") & (F.col("row") >= 4), 320.0).otherwise(72.0)
    top = F.lit(720.0) - 14.0 * F.when(F.col("two"), F.col("row") % 4).otherwise(F.col("row")) - F.when(F.col("two"), 0.0).otherwise(F.when(F.col("row") >= 4, 60.0).otherwise(0.0))
    top = top - F.when(F.col("row") % 4 == 0, 0.0).otherwise(14.0)  # the row below a special line is its rest's
    reach = F.when(F.col("two"), 220.0).otherwise(450.0)
    return d.select("doc_id", "i", "kind", "text", "rest", "page", "row", size.alias("font_size"), F.col("big").alias("is_bold"), left.alias("left"), top.alias("top"), reach.alias("reach"))


def spans(docs: DataFrame) -> DataFrame:
    d = _lines(docs)
    rest = d.filter("rest <> ''").withColumns({"text": F.col("rest"), "top": F.col("top") - 14.0, "font_size": F.lit(10.0), "is_bold": F.lit(False), "below": F.lit(1)})
    n, b = 2 * F.col("row") + 1 + F.col("below"), d.withColumn("below", F.lit(0)).unionByName(rest)
    body = b.select(
        "doc_id",
        (F.col("page").cast("long") * 100 + n).alias("span_seq"),
        "page",
        "text",
        F.when(F.col("is_bold"), "Times-Bold").otherwise("Times-Roman").alias("font_name"),
        "font_size",
        "is_bold",
        F.lit(False).alias("is_italic"),
        "left",
        "top",
        (F.col("left") + F.least(F.octet_length("text") * F.col("font_size") * 0.5, F.col("reach"))).alias("right"),
        (F.col("top") - F.col("font_size")).alias("bottom"),
    )
    pages = d.select("doc_id", "page").distinct()
    fixed = lambda seq, text, size, left, top, right: pages.select(
        "doc_id", (F.col("page").cast("long") * 100 + seq).alias("span_seq"), "page", text.alias("text"), F.lit("Times-Roman").alias("font_name"), F.lit(size).alias("font_size"), F.lit(False).alias("is_bold"),
        F.lit(False).alias("is_italic"), F.lit(left).alias("left"), F.lit(top).alias("top"), F.lit(right).alias("right"), F.lit(top - size).alias("bottom"),
    )
    head = fixed(0, F.lit("Journal of Synthetic Layout"), 10.0, 200.0, 780.0, 335.0)
    foot = fixed(90, (F.col("page") + 1).cast("string"), 10.0, 300.0, 40.0, 310.0)
    return body.unionByName(head).unionByName(foot)


def images(docs: DataFrame) -> DataFrame:
    """An image of 100 by 20 points just above each figure caption, but for every seventh document."""
    d = _lines(docs).filter("kind = 3 and doc_id % 7 <> 3")
    return d.select(
        "doc_id", F.col("i").cast("long").alias("image_seq"), "page", F.format_string("images/p%03d_img%03d.png", "page", "row").alias("path"), "left", (F.col("top") + 30.0).alias("top"),
        (F.col("left") + 100.0).alias("right"), (F.col("top") + 10.0).alias("bottom"), F.lit(100).alias("width_px"), F.lit(20).alias("height_px"), F.lit("png").alias("format"),
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


SPANS_SQL = """
l0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, unnest(p) AS t, unnest(range(0, len(p))) AS i FROM l0),
l2 AS (SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN (i // 4) % 5 ELSE -1 END AS kind, t, trim(substr(t, 1, 40), ' ') AS h, trim(substr(t, 41), ' ') AS rest, CAST(i // 20 + 1 AS VARCHAR) AS n, CAST(i // 8 AS INT) AS page, i % 8 AS row_, doc_id % 2 = 1 AS two FROM l1),
l3 AS (SELECT *, CASE kind WHEN 0 THEN n || ' ' || h WHEN 1 THEN n || '.1 ' || h WHEN 2 THEN 'IV. ' || h WHEN 3 THEN 'Fig. ' || n || ': ' || h WHEN 4 THEN 'Table ' || n || '. ' || h ELSE t END AS text,
              CASE WHEN kind IN (0, 1, 2) THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS font_size, kind IN (0, 1, 2) AS is_bold,
              CASE WHEN two AND row_ >= 4 THEN 320.0::DOUBLE ELSE 72.0::DOUBLE END AS "left",
              720.0::DOUBLE - 14.0::DOUBLE * (CASE WHEN two THEN row_ % 4 ELSE row_ END) - (CASE WHEN NOT two AND row_ >= 4 THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN row_ % 4 = 0 THEN 0.0::DOUBLE ELSE 14.0::DOUBLE END) AS top,
              CASE WHEN two THEN 220.0::DOUBLE ELSE 450.0::DOUBLE END AS reach FROM l2),
pg AS (SELECT DISTINCT doc_id, page FROM l3),
spans AS (
  SELECT doc_id, page * 100 + 2 * row_ + 1 AS span_seq, page, text, CASE WHEN is_bold THEN 'Times-Bold' ELSE 'Times-Roman' END AS font_name, font_size, is_bold, "left", top,
         "left" + least(strlen(text) * font_size * 0.5::DOUBLE, reach) AS "right", top - font_size AS bottom FROM l3
  UNION ALL SELECT doc_id, page * 100 + 2 * row_ + 2, page, rest, 'Times-Roman', 10.0::DOUBLE, FALSE, "left", top - 14.0::DOUBLE,
         "left" + least(strlen(rest) * 10.0::DOUBLE * 0.5::DOUBLE, reach), top - 14.0::DOUBLE - 10.0::DOUBLE FROM l3 WHERE kind >= 0 AND rest <> ''
  UNION ALL SELECT doc_id, page * 100, page, 'Journal of Synthetic Layout', 'Times-Roman', 10.0::DOUBLE, FALSE, 200.0::DOUBLE, 780.0::DOUBLE, 335.0::DOUBLE, 770.0::DOUBLE FROM pg
  UNION ALL SELECT doc_id, page * 100 + 90, page, CAST(page + 1 AS VARCHAR), 'Times-Roman', 10.0::DOUBLE, FALSE, 300.0::DOUBLE, 40.0::DOUBLE, 310.0::DOUBLE, 30.0::DOUBLE FROM pg)"""
