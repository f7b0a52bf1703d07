"""The engine's registered queries and their SQL, all over whole tables and whole texts.  Names with ``synth`` run on spans that
``sources.synth`` makes from documents; ``literal`` ones on rows given here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkConfig, Config, LlmTextConfig, MarkdownConfig, MathConfig, TableConfig
from ..functions import geometry, mathtext
from ..functions import text as T
from ..operators import chunks as C
from ..operators import diagnostics, figures, layout, sections, structure, tables
from ..sources import html, synth
from .api import DocumentSet

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DocumentSet:
    d = synth.load(spark, sf_dir)
    return DocumentSet(synth.spans(d), images=synth.images(d)).persist()


# ------------------------------------------------------------------ text functions on documents

TOKENS_SQL = r"""(len(regexp_extract_all({t}, '[\x00-\x7F]')) // 4 + len(regexp_extract_all({t}, '[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}\x{{FF00}}-\x{{FFEF}}]'))
 + (length({t}) - len(regexp_extract_all({t}, '[\x00-\x7F]')) - len(regexp_extract_all({t}, '[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}\x{{FF00}}-\x{{FFEF}}]'))) // 2)"""


@query("SELECT lang, COUNT(*) AS docs, CAST(SUM(" + TOKENS_SQL.format(t="text") + ") AS BIGINT) AS tokens FROM documents GROUP BY lang")
def tokens_by_lang(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(T.tokens(F.col("text"))).alias("tokens"))


@query(
    r"SELECT source, CAST(SUM(len(regexp_extract_all(text, '[\x00-\x7F]')) // 4 + CAST(FLOOR((length(text) - len(regexp_extract_all(text, '[\x00-\x7F]'))) / 1.5::DOUBLE) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY source"
)
def toc_token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.sum(T.toc_tokens(F.col("text"))).alias("tokens"))


@query(
    r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS BIGINT) AS sentences FROM documents"""
)
def sentence_split_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '(?i)\\band\\b', ',', 'g'), '[,\n]'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: strlen(x) > 1) AS names FROM conversations".replace("\\b", "\\b"))
def author_split(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", T.split_authors(F.col("text")).alias("names"))


QUERIES["author_split"] = lambda spark, sf_dir: author_split(spark, sf_dir).select("conv_id", "turn", F.array_join("names", "|").alias("names"))
ORACLES["author_split"] = ORACLES["author_split"].replace(" AS names FROM", " AS nm FROM").replace("SELECT conv_id", "SELECT conv_id, turn, array_to_string(nm, '|') AS names FROM (SELECT conv_id") + ")"


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '](', ']\\(') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.escape_markdown(F.col("html")).alias("escaped"))


@query(
    r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<(h1)\b[^>]*>.*?</h1\s*>')) AS BIGINT) AS headings,
 CAST(len(regexp_extract_all(html, '(?is)<(h1|h2|h3|h4|h5|h6)\b[^>]*>.*?</h[1-6]\s*>')) AS BIGINT) AS all_headings FROM pages"""
)
def html_heading_counts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    e = p.select("page_id", F.regexp_extract_all("html", F.lit(html.ELEMENT), F.lit(1)).alias("tags"))
    count = lambda f: F.size(F.filter("tags", f)).cast("long")
    return e.select("page_id", count(lambda t: F.lower(t) == "h1").alias("headings"), count(lambda t: F.lower(t).rlike("^h")).alias("all_headings"))


@query()
def html_toc(spark, sf_dir):
    """Web pages through layout, headers and the section tree."""
    return DocumentSet(html.spans(spark.read.parquet(f"{sf_dir}/pages.parquet"))).toc()


@query()
def bpe_token_counts(spark, sf_dir):
    import public_tokenizers

    return docs(spark, sf_dir).select("doc_id", C.bpe_tokens(public_tokenizers.path("byte_bpe_50k.json"))("text").alias("tokens"))


# ------------------------------------------------------------------ literal rows

HEADINGS = [
    "1 Intro", "2.1 Data", "3.1.1.2 X", "IV. RESULTS", "A. Proofs", "C. Roman or alpha", "Appendix B Tables", "2020 was", "I am", "Appendix C. More", "1. ", "12", "IIII. Odd", "AB. none", "  3  Space",
]


def _literal(spark, rows, schema):
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"id int, {schema}")


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in (i, *(r if isinstance(r, tuple) else (r,)))) + ")" for i, r in enumerate(rows)) + ")"


@query(
    r"""WITH v AS (SELECT id, ltrim(text) AS t FROM """
    + _values(HEADINGS)
    + r""" x(id, text)), m AS (SELECT id, t,
 CASE WHEN regexp_matches(t, '^Appendix\s+[A-Z]\b\.?') THEN 'appendix' WHEN regexp_matches(t, '^\d+(\.\d+)*\.?(\s+|$)') THEN 'arabic'
      WHEN regexp_matches(t, '^[IVXLCDM]+\.(\s+|$)') THEN 'roman' WHEN regexp_matches(t, '^[A-Z]\.(\s+|$)') THEN 'alpha' END AS kind FROM v),
 p AS (SELECT *, CASE kind WHEN 'appendix' THEN regexp_extract(t, '^Appendix\s+[A-Z]\b\.?', 0) WHEN 'arabic' THEN regexp_extract(t, '^\d+(\.\d+)*\.?(\s+|$)', 0)
                      WHEN 'roman' THEN regexp_extract(t, '^[IVXLCDM]+\.(\s+|$)', 0) WHEN 'alpha' THEN regexp_extract(t, '^[A-Z]\.(\s+|$)', 0) END AS whole FROM m)
 SELECT id, kind = 'appendix' AS is_appendix, CASE WHEN kind = 'arabic' THEN CAST(len(regexp_extract_all(whole, '\d+')) AS INT) WHEN kind IS NOT NULL THEN 1 END AS depth,
        trim(whole) AS prefix, trim(substr(t, length(whole) + 1)) AS rest FROM p WHERE kind IS NOT NULL"""
)
def literal_numbering(spark, sf_dir):
    d = _literal(spark, HEADINGS, "text string").withColumn("k", T.numbering(F.col("text"))).filter("k is not null")
    return d.select("id", F.col("k.is_appendix").alias("is_appendix"), F.col("k.depth").alias("depth"), F.col("k.prefix").alias("prefix"), F.col("k.rest").alias("rest"))


ROMANS = [("I", 1), ("IV", 4), ("IX", 9), ("XIV", 14), ("XL", 40), ("MCMXCIV", 1994), ("IIII", 4), ("VX", 5), ("", -1), ("ABC", -1)]


@query("SELECT id, CASE WHEN want > 0 THEN CAST(want AS INT) END AS value FROM " + _values(ROMANS) + " x(id, numeral, want)")
def literal_roman(spark, sf_dir):
    return _literal(spark, ROMANS, "numeral string, want int").select("id", T.roman_value(F.col("numeral")).alias("value"))


CAPTIONS = ["Fig. 1: a", "Figure 2 b", "FIG 3. c", "Table 1 shows the results", "Tab. 4: d", "Table of contents", "Table 12. long", "fig 99999999999: big", "See Fig. 1", "Figure 10"]


@query(
    r"""WITH v AS (SELECT id, text, regexp_matches(text, '(?i)^(Fig\.?|Figure)\s*\d+') AS f, regexp_matches(text, '(?i)^(Table|Tab\.)\s*\d+') AS b FROM """
    + _values(CAPTIONS)
    + r""" x(id, text)), r AS (SELECT *, CASE WHEN f THEN '(?i)^(Fig\.?|Figure)\s*(\d+)\s*[:.]?\s*(.*)' ELSE '(?i)^(Table|Tab\.)\s*(\d+)\s*[:.]?\s*(.*)' END AS p FROM v WHERE f OR b)
 SELECT id, CASE WHEN f THEN 'Figure' ELSE 'Table' END AS caption_type, regexp_extract(text, p, 1) AS prefix, CASE WHEN CAST(regexp_extract(text, p, 2) AS HUGEINT) <= 4294967295 THEN CAST(regexp_extract(text, p, 2) AS BIGINT) END AS number,
        regexp_extract(text, p, 3) AS description, regexp_matches(lower(text), '^(figure|fig\.|table|tab\.)\s*[0-9]+\s*[:.]') AS strict FROM r"""
)
def literal_captions(spark, sf_dir):
    d = _literal(spark, CAPTIONS, "text string").withColumn("c", T.caption(F.col("text"))).filter("c is not null")
    return d.select("id", "c.caption_type", "c.prefix", "c.number", "c.description", T.is_caption(F.col("text")).alias("strict"))


DOIS = ["doi:10.1234/abc.def", "https://doi.org/10.5555/12345678.", "none here", "10.1234/a b", "x 10.12/short 10.99999/(ok);y,", "10.1000/xyz..."]


@query(r"SELECT id, CASE WHEN m <> '' THEN regexp_replace(m, '\.+$', '') END AS doi FROM (SELECT id, regexp_extract(regexp_replace(text, '\s+', ' ', 'g'), '10\.\d{4,9}/[-._;()/:A-Za-z0-9]+', 0) AS m FROM " + _values(DOIS) + " x(id, text))")
def literal_doi(spark, sf_dir):
    return _literal(spark, DOIS, "text string").select("id", T.doi(F.col("text")).alias("doi"))


FONTS = ["Times-Bold", "Arial-BD", "Heavy", "BlackItalic", "Times-Italic", "Oblique", "Foo-it", "CMMI10", "cmr7", "CM9", "STIXGeneral", "MTSY", "Symbol", "MathJax", "Times"]


@query(
    "SELECT id, regexp_matches(lower(name), 'bold|-bd|heavy|black') AS bold, regexp_matches(lower(name), 'italic|oblique|-it') AS italic, regexp_matches(upper(name), '^CM[A-Z]|MATH|SYMBOL|^MT|STIX') AS math FROM "
    + _values(FONTS)
    + " x(id, name)"
)
def literal_fonts(spark, sf_dir):
    n = F.col("name")
    return _literal(spark, FONTS, "name string").select("id", T.is_bold_font(n).alias("bold"), T.is_italic_font(n).alias("italic"), T.is_math_font(n).alias("math"))


RECTS = [(0.0, 10.0, 10.0, 0.0, 5.0, 8.0, 15.0, 2.0), (0.0, 10.0, 10.0, 0.0, 10.0, 10.0, 20.0, 0.0), (0.0, 30.0, 10.0, 20.0, 0.0, 10.0, 10.0, 0.0), (1.0, 4.0, 3.0, 3.5, 0.0, 9.0, 9.0, 0.0)]


@query(
    f"""SELECT id, ar - al AS width, a_t - ab AS height, (al + ar) / 2 AS cx, (a_t + ab) / 2 AS cy,
 CASE WHEN ab > bt THEN ab - bt WHEN bb > a_t THEN bb - a_t ELSE -(least(a_t, bt) - greatest(ab, bb)) END AS gap,
 al < br AND ar > bl AND ab < bt AND a_t > bb AS meets, least(al, bl) AS u_left, greatest(a_t, bt) AS u_top,
 CASE WHEN a_t - ab < 2 AND ar - al > 5 THEN 'Horizontal' WHEN ar - al < 2 AND a_t - ab > 5 THEN 'Vertical' WHEN ar - al > 5 AND a_t - ab > 5 THEN 'Rectangle' ELSE 'Other' END AS kind
 FROM (SELECT column0 AS id, CAST(column1 AS DOUBLE) AS al, CAST(column2 AS DOUBLE) AS a_t, CAST(column3 AS DOUBLE) AS ar, CAST(column4 AS DOUBLE) AS ab, CAST(column5 AS DOUBLE) AS bl, CAST(column6 AS DOUBLE) AS bt, CAST(column7 AS DOUBLE) AS br, CAST(column8 AS DOUBLE) AS bb
       FROM {_values(RECTS)} x(column0, column1, column2, column3, column4, column5, column6, column7, column8))"""
)
def literal_geometry(spark, sf_dir):
    d = _literal(spark, RECTS, ", ".join(f"{p}_{s} double" for p in "ab" for s in ("left", "top", "right", "bottom")))
    c = F.col
    w, h = c("a_right") - c("a_left"), c("a_top") - c("a_bottom")
    return d.select(
        "id", geometry.width(c("a_left"), c("a_right")).alias("width"), geometry.height(c("a_top"), c("a_bottom")).alias("height"), geometry.center(c("a_left"), c("a_right")).alias("cx"),
        geometry.center(c("a_top"), c("a_bottom")).alias("cy"), geometry.vertical_gap(c("a_top"), c("a_bottom"), c("b_top"), c("b_bottom")).alias("gap"), geometry.overlaps("a_", "b_").alias("meets"),
        F.least("a_left", "b_left").alias("u_left"), F.greatest("a_top", "b_top").alias("u_top"), geometry.path_type(w, h).alias("kind"),
    )


EQUATIONS = ["x = y (1)", "a (2.3)", "(iv)", "f(x)", "x ()", "y (12345678901)", "none"]


@query(
    r"SELECT id, CASE WHEN regexp_matches(m, '^[\p{L}\p{N}.]+$') AND strlen(m) <= 10 THEN '(' || m || ')' END AS number FROM (SELECT id, regexp_extract(text, '\(([^(]*)\)$', 1) AS m FROM " + _values(EQUATIONS) + " x(id, text))"
)
def literal_equation_numbers(spark, sf_dir):
    return _literal(spark, EQUATIONS, "text string").select("id", T.equation_number(F.col("text")).alias("number"))


GRID = [(r, c, f"r{r}c{c}" if (r, c) != (2, 1) else "") for r in range(4) for c in range(3)]


@query()
def literal_table_grid(spark, sf_dir):
    """A ruled table of text blocks: region, grid and its three texts."""
    d = _table_set(spark)
    found = tables.detect(d["blocks"], d["paths"], d["captions"], TableConfig())
    g = tables.grids(found, d["blocks"])
    h, r, n = F.col("header"), F.col("rows"), F.col("column_count")
    return g.select("doc_id", "table_seq", n, tables.to_markdown(h, r, n).alias("markdown"), tables.to_csv(h, r, n).alias("csv"), tables.to_plain(h, r).alias("plain"))


def _table_set(spark) -> dict[str, DataFrame]:
    blocks = [(1, i, 0, f"{t}", 72.0 + 100 * c, 700.0 - 20 * r, 72.0 + 100 * c + 40, 690.0 - 20 * r, "BodyText", 1, False) for i, (r, c, t) in enumerate(x for x in GRID if x[2])]
    b = spark.createDataFrame(blocks, "doc_id long, global_index long, page int, text string, left double, top double, right double, bottom double, block_type string, n_lines int, is_bold boolean")
    rules = [(1, 0, 60.0, 705.0 - 20 * k + 0.5, 360.0, 705.0 - 20 * k, "Horizontal", 0.5) for k in range(5)] + [(1, 0, x, 706.0, x + 0.5, 624.0, "Vertical", 0.5) for x in (60.0, 160.0, 260.0, 360.0)]
    p = spark.createDataFrame(rules, "doc_id long, page int, left double, top double, right double, bottom double, path_type string, line_width double")
    c = spark.createDataFrame([(1, 99, "Table", "Table", 7, "x", "Table 7: x", 0, 72.0, 730.0, 200.0, 715.0)], "doc_id long, block_index long, caption_type string, prefix string, number long, description string, full_text string, page int, left double, top double, right double, bottom double")
    return {"blocks": b, "paths": p, "captions": c}


MATH_SPANS = [[("x", "CMMI10", 10.0, 0.0), ("2", "CMR7", 7.0, 4.0), ("≤", "CMSY10", 10.0, 0.0), ("α", "Times", 10.0, 0.0)], [("for ", "Times", 10.0, 0.0), ("β", "Times", 10.0, 0.0), ("i", "MTMI", 6.0, -4.0)]]


@query()
def literal_math(spark, sf_dir):
    """Lines of mathematics in every notation."""
    span = "struct<text string, font_name string, font_size double, bottom double>"
    d = spark.createDataFrame([(i, [(i, s)]) for i, s in enumerate(MATH_SPANS)], f"id int, lines array<struct<n int, spans array<{span}>>>")
    run = lambda kind: mathtext.render_block_udf(MathConfig(representation=kind), True)(F.lit(""), F.col("lines"))
    return d.select("id", *[run(k).alias(k) for k in ("auto", "latex", "unicode", "plain")])


# ------------------------------------------------------------------ layout on synthetic spans

WITH_SPANS = "WITH " + synth.SPANS_SQL
LINES_SQL = (
    WITH_SPANS
    + """,
sp AS (SELECT *, LAG(top) OVER w AS pt, LAG(font_size) OVER w AS pf FROM spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY top DESC, "left", span_seq)),
sn AS (SELECT *, SUM(CASE WHEN abs(pt - top) > pf * 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY top DESC, "left", span_seq ROWS UNBOUNDED PRECEDING) AS ln FROM sp),
so AS (SELECT *, LAG("right") OVER w AS pr, LAG(font_size) OVER w AS ps FROM sn WINDOW w AS (PARTITION BY doc_id, page, ln ORDER BY "left", span_seq)),
lg AS (SELECT doc_id, page, ln, string_agg(CASE WHEN "left" - pr > ps * 0.5 * 0.3 THEN ' ' ELSE '' END || text, '' ORDER BY "left", span_seq) AS text,
              MIN("left") AS "left", MAX(top) AS top, MAX("right") AS "right", MIN(bottom) AS bottom,
              arg_max(font_size, (strlen(text), "left", span_seq)) AS font_size, 2 * SUM(CASE WHEN is_bold THEN strlen(text) ELSE 0 END) >= SUM(strlen(text)) AS is_bold FROM so GROUP BY ALL),
lines AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY page, ln) - 1 AS line_seq FROM lg)"""
)
R = "round({0}, 6) AS {0}"
BOX = ', '.join(f'round("{c}", 6) AS "{c}"' for c in ("left", "top", "right", "bottom"))


def boxed(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, *[F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")])


@query(WITH_SPANS + f" SELECT doc_id, CAST(span_seq AS BIGINT) AS span_seq, page, text, font_name, font_size, {BOX} FROM spans")
def synth_spans(spark, sf_dir):
    return boxed(layout.clean_spans(synth.spans(synth.load(spark, sf_dir))), "doc_id", "span_seq", "page", "text", "font_name", "font_size")


@query(LINES_SQL + f" SELECT doc_id, page, CAST(line_seq AS BIGINT) AS line_seq, text, font_size, is_bold, {BOX} FROM lines")
def synth_lines(spark, sf_dir):
    return boxed(corpus(spark, sf_dir).lines, "doc_id", "page", "line_seq", "text", "font_size", "is_bold")


REGIONS_SQL = (
    LINES_SQL
    + """,
dims AS (SELECT doc_id, page, MAX("right") AS w, MAX(top) AS h FROM spans GROUP BY ALL),
zl AS (SELECT doc_id, page, w, "left", CASE WHEN m > h - 0.0 * (h / 4.0) THEN NULL WHEN m >= h - 0.0 * (h / 4.0) - h / 4.0 THEN 0 WHEN m <= h - 1.0 * (h / 4.0) AND m >= h - 1.0 * (h / 4.0) - h / 4.0 THEN 1
       WHEN m <= h - 2.0 * (h / 4.0) AND m >= h - 2.0 * (h / 4.0) - h / 4.0 THEN 2 WHEN m <= h - 3.0 * (h / 4.0) AND m >= h - 3.0 * (h / 4.0) - h / 4.0 THEN 3 END AS z
       FROM (SELECT l.*, d.w, d.h::DOUBLE AS h, (l.top + l.bottom) / 2.0 AS m FROM lines l JOIN dims d USING (doc_id, page))),
zb AS (SELECT doc_id, page, w, z, floor("left" / 10.0) AS b, COUNT(*) AS n FROM zl WHERE z IS NOT NULL GROUP BY ALL),
zt AS (SELECT *, SUM(n) OVER (PARTITION BY doc_id, page, z) AS total FROM zb),
zp AS (SELECT *, b * 10.0 + 5.0 AS xx FROM zt WHERE n >= ceil(total * 0.2)),
zc AS (SELECT *, SUM(CASE WHEN xx - pa > w * 0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, z ORDER BY xx ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, LAG(xx) OVER (PARTITION BY doc_id, page, z ORDER BY xx) AS pa FROM zp)),
zm AS (SELECT doc_id, page, z, c, SUM(xx) / COUNT(*) AS mean FROM zc GROUP BY ALL),
zs AS (SELECT doc_id, page, z, CASE WHEN COUNT(*) = 2 THEN (MIN(mean) + MAX(mean)) / 2.0 END AS split FROM zm GROUP BY ALL),
zg AS (SELECT d.doc_id, d.page, d.w, d.h, i.z, s.split FROM dims d CROSS JOIN (SELECT unnest(range(0, 4)) AS z) i LEFT JOIN zs s ON s.doc_id = d.doc_id AND s.page = d.page AND s.z = i.z),
zr AS (SELECT *, SUM(CASE WHEN (split IS NULL) <> pn THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY z ROWS UNBOUNDED PRECEDING) AS region FROM (SELECT *, LAG(split IS NULL) OVER (PARTITION BY doc_id, page ORDER BY z) AS pn FROM zg)),
regions AS (SELECT doc_id, page, CAST(region AS INT) AS region, MAX(h - z * (h / 4.0)) AS y_top, MIN(h - z * (h / 4.0) - h / 4.0) AS y_bottom, MIN(CASE WHEN z = fz THEN split END) AS split, MIN(w) AS width
            FROM (SELECT *, MIN(z) OVER (PARTITION BY doc_id, page, region) AS fz FROM zr) GROUP BY ALL)"""
)


@query(REGIONS_SQL + " SELECT doc_id, page, region, round(y_top, 6) AS y_top, round(y_bottom, 6) AS y_bottom, round(split, 6) AS split, round(width, 6) AS width FROM regions")
def synth_columns(spark, sf_dir):
    r = corpus(spark, sf_dir).regions
    return r.select("doc_id", "page", "region", *[F.round(c, 6).alias(c) for c in ("y_top", "y_bottom", "split", "width")])


BLOCKS_SQL = (
    REGIONS_SQL
    + """,
la AS (SELECT l.*, r.region, r.split, r.width, (l."left" + l."right") / 2.0 AS cx,
              ROW_NUMBER() OVER (PARTITION BY l.doc_id, l.line_seq ORDER BY CASE WHEN (l.top + l.bottom) / 2.0 > r.y_top THEN (l.top + l.bottom) / 2.0 - r.y_top WHEN (l.top + l.bottom) / 2.0 < r.y_bottom THEN r.y_bottom - (l.top + l.bottom) / 2.0 ELSE 0 END, r.region) AS k
       FROM lines l JOIN regions r USING (doc_id, page)),
lb AS (SELECT *, CASE WHEN split IS NOT NULL AND (CASE WHEN cx < split THEN split - cx WHEN cx >= width THEN cx - width ELSE 0 END) < (CASE WHEN cx < 0 THEN -cx WHEN cx >= split THEN cx - split ELSE 0 END) THEN 1 ELSE 0 END AS col FROM la WHERE k = 1),
lc AS (SELECT *, LAG(bottom) OVER w AS pb, LAG(font_size) OVER w AS pf, LAG(is_bold) OVER w AS pk FROM lb WINDOW w AS (PARTITION BY doc_id, page, region, col ORDER BY top DESC, line_seq)),
ld AS (SELECT *, SUM(CASE WHEN pb - top > pf * 1.2 * 1.8 OR abs(pf - font_size) > 1.0 OR pk <> is_bold THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, region, col ORDER BY top DESC, line_seq ROWS UNBOUNDED PRECEDING) AS run FROM lc),
bg AS (SELECT doc_id, page, region, col, run, string_agg(text, ' ' ORDER BY top DESC, line_seq) AS text, MIN("left") AS "left", MAX(top) AS top, MAX("right") AS "right", MIN(bottom) AS bottom, COUNT(*) AS n_lines,
              arg_min(font_size, (-top, line_seq)) AS font_size, arg_min(is_bold, (-top, line_seq)) AS is_bold FROM ld GROUP BY ALL),
blocks AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY page, region, col, run) - 1 AS global_index FROM bg)"""
)


@query(BLOCKS_SQL + f" SELECT doc_id, CAST(global_index AS BIGINT) AS global_index, page, region, col AS column_index, text, CAST(n_lines AS INT) AS n_lines, font_size, is_bold, {BOX} FROM blocks")
def synth_blocks(spark, sf_dir):
    return boxed(corpus(spark, sf_dir).raw_blocks, "doc_id", "global_index", "page", "region", "column_index", "text", "n_lines", "font_size", "is_bold")


TYPED_SQL = (
    BLOCKS_SQL
    + r""",
bf AS (SELECT doc_id, COALESCE(arg_max(bin, (n, -bin)), 20) * 0.5::DOUBLE AS body FROM (SELECT doc_id, CAST(round(font_size / 0.5) AS BIGINT) AS bin, SUM(strlen(text)) AS n FROM blocks WHERE font_size > 0 GROUP BY ALL) GROUP BY doc_id),
bt AS (SELECT b.*, f.body, b.font_size / f.body AS ratio, trim(b.text) AS t FROM blocks b JOIN bf f USING (doc_id)),
bk AS (SELECT *, strlen(t) <= 120 AND n_lines <= 3 AND (is_bold OR ratio > 1.05) AND t <> '' AS head,
              regexp_matches(upper(t), 'ABSTRACT|INTRODUCTION|BACKGROUND|RELATED WORK|METHOD|APPROACH|EXPERIMENT|RESULT|DISCUSSION|ANALYSIS|CONCLUSION|SUMMARY|REFERENCES|BIBLIOGRAPHY|ACKNOWLEDGMENT|APPENDIX|SUPPLEMENTARY|SUPPORTING INFORMATION') AS known FROM bt),
b1 AS (SELECT *, CASE WHEN length(t) <= 240 AND regexp_matches(lower(t), '^(figure|fig\.|table|tab\.)\s*[0-9]+\s*[:.]') THEN 'Caption'
   WHEN regexp_matches(t, '^[0-9 ]*[0-9][0-9 ]*$') AND strlen(t) <= 4 THEN 'PageNumber' WHEN n_lines = 1 AND font_size / greatest(body, 1.0) < 0.85 AND length(t) <= 60 THEN 'RunningHeader'
   WHEN ratio < 0.85 AND n_lines <= 4 THEN 'Footnote' WHEN ratio > 1.5 AND n_lines <= 3 THEN 'Title' WHEN head AND (ratio >= 1.15 OR known) THEN 'SectionHeader' WHEN head THEN 'SubsectionHeader' ELSE 'BodyText' END AS bt1 FROM bk),
b2 AS (SELECT *, MAX(top) OVER (PARTITION BY doc_id, page) AS ph, lower(t) AS lt FROM b1),
b3 AS (SELECT *, CASE WHEN bt1 <> 'PageNumber' AND ph > 0 AND lt <> '' THEN CASE WHEN bottom >= ph - ph * 0.1 THEN 'head' WHEN top <= ph * 0.1 THEN 'foot' END END AS zone FROM b2),
rp AS (SELECT doc_id, lt, zone FROM b3 WHERE zone IS NOT NULL GROUP BY ALL HAVING COUNT(DISTINCT page) >= 3),
typed AS (SELECT b.*, CASE WHEN h.lt IS NOT NULL AND b.bt1 <> 'PageNumber' AND b.bottom >= b.ph - b.ph * 0.1 THEN 'RunningHeader' WHEN f.lt IS NOT NULL AND b.bt1 <> 'PageNumber' AND b.top <= b.ph * 0.1 THEN 'RunningFooter' ELSE b.bt1 END AS block_type
          FROM b3 b LEFT JOIN rp h ON h.doc_id = b.doc_id AND h.lt = b.lt AND h.zone = 'head' LEFT JOIN rp f ON f.doc_id = b.doc_id AND f.lt = b.lt AND f.zone = 'foot')"""
)


@query(TYPED_SQL + " SELECT doc_id, body AS body_size FROM bf")
def synth_body_font(spark, sf_dir):
    return structure.body_font(corpus(spark, sf_dir).raw_blocks)


@query(TYPED_SQL + " SELECT doc_id, CAST(global_index AS BIGINT) AS global_index, bt1 AS block_type FROM typed")
def synth_classify(spark, sf_dir):
    return structure.classify(corpus(spark, sf_dir).raw_blocks).select("doc_id", "global_index", "block_type")


@query(TYPED_SQL + " SELECT doc_id, CAST(global_index AS BIGINT) AS global_index, block_type, block_type <> bt1 AS reclassified FROM typed")
def synth_running_heads(spark, sf_dir):
    return corpus(spark, sf_dir).blocks.select("doc_id", "global_index", "block_type", "reclassified")


HEADERS_SQL = (
    TYPED_SQL
    + r""",
h0 AS (SELECT *, CASE WHEN regexp_matches(t, '^Appendix\s+[A-Z]\b\.?') THEN regexp_extract(t, '^Appendix\s+[A-Z]\b\.?', 0) WHEN regexp_matches(t, '^\d+(\.\d+)*\.?(\s+|$)') THEN regexp_extract(t, '^\d+(\.\d+)*\.?(\s+|$)', 0)
   WHEN regexp_matches(t, '^[IVXLCDM]+\.(\s+|$)') THEN regexp_extract(t, '^[IVXLCDM]+\.(\s+|$)', 0) WHEN regexp_matches(t, '^[A-Z]\.(\s+|$)') THEN regexp_extract(t, '^[A-Z]\.(\s+|$)', 0) END AS pre
   FROM typed WHERE block_type NOT IN ('Caption', 'PageNumber', 'RunningHeader', 'RunningFooter', 'Footnote', 'Reference') AND length(t) <= 120 AND n_lines <= 3 AND NOT regexp_matches(t, '^[0-9\s]*$')),
h1 AS (SELECT *, CAST(round(font_size / 0.5) AS BIGINT) AS bin,
   (CASE WHEN pre IS NOT NULL THEN 3 ELSE 0 END) + (CASE WHEN regexp_matches(t, '\p{L}') AND t = upper(t) AND NOT regexp_matches(t, '[ßªº]') THEN 2 ELSE 0 END) + (CASE WHEN is_bold THEN 2 ELSE 0 END) + (CASE WHEN ratio > 1.1 THEN 1 ELSE 0 END)
   + (CASE WHEN len(list_filter(['ABSTRACT','INTRODUCTION','BACKGROUND','RELATED WORK','METHOD','METHODS','METHODOLOGY','APPROACH','EXPERIMENT','EXPERIMENTS','EXPERIMENTAL','RESULTS','RESULT','RESULTS AND DISCUSSION','DISCUSSION','ANALYSIS','CONCLUSION','CONCLUSIONS','SUMMARY','REFERENCES','BIBLIOGRAPHY','ACKNOWLEDGMENT','ACKNOWLEDGMENTS','APPENDIX','SUPPLEMENTARY','SUPPORTING INFORMATION'], lambda x: length(t) <= length(x) + 8 AND contains(upper(t), x))) > 0 THEN 2 ELSE 0 END)
   + (CASE WHEN n_lines = 1 THEN 1 ELSE 0 END) AS score FROM h0),
h2 AS (SELECT * FROM h1 WHERE score >= 4 AND ratio <= 1.8),
hb AS (SELECT doc_id, bin, SUM(CASE WHEN pb - bin > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) + 1 AS rk FROM (SELECT *, LAG(bin) OVER (PARTITION BY doc_id ORDER BY bin DESC) AS pb FROM (SELECT DISTINCT doc_id, bin FROM h2))),
headers AS (SELECT h.doc_id, h.global_index, h.t AS text, CASE WHEN pre IS NULL THEN t ELSE trim(substr(t, length(pre) + 1)) END AS clean_text, trim(pre) AS numbering,
   CAST(greatest(1, least(6, CASE WHEN pre IS NULL THEN b.rk WHEN regexp_matches(pre, '^\d') THEN len(regexp_extract_all(pre, '\d+')) ELSE 1 END)) AS INT) AS level, h.score, h.page FROM h2 h JOIN hb b USING (doc_id, bin))"""
)


@query(HEADERS_SQL + " SELECT doc_id, CAST(global_index AS BIGINT) AS block_index, text, clean_text, level, numbering, CAST(score AS INT) AS score, page FROM headers")
def synth_headers(spark, sf_dir):
    return corpus(spark, sf_dir).headers.select("doc_id", "block_index", "text", "clean_text", "level", "numbering", "score", "page")


SECTIONS_SQL = (
    HEADERS_SQL
    + """,
ro AS (SELECT b.*, ROW_NUMBER() OVER (PARTITION BY b.doc_id ORDER BY b.page, b.top DESC, CASE WHEN b."right" - b."left" >= d.w * 0.6 THEN 0 ELSE 1 END, CASE WHEN b."right" - b."left" >= d.w * 0.6 THEN 0 ELSE b.col END, b."left", b.global_index) - 1 AS rs FROM typed b JOIN dims d USING (doc_id, page)),
rh AS (SELECT r.*, h.clean_text, h.level, h.numbering, h.text AS header_raw, SUM(CASE WHEN h.level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r.doc_id ORDER BY r.rs ROWS UNBOUNDED PRECEDING) AS n FROM ro r LEFT JOIN headers h USING (doc_id, global_index)),
ri AS (SELECT *, n - MIN(n) OVER (PARTITION BY doc_id) AS section_id FROM rh),
sh AS (SELECT doc_id, section_id, clean_text AS header, header_raw, level, numbering, page FROM ri WHERE level IS NOT NULL),
sb AS (SELECT * FROM ri WHERE level IS NULL),
se AS (SELECT doc_id, section_id, arg_min(page, rs) AS p0, arg_max(page, rs) AS p1, COUNT(*) AS n_blocks FROM sb GROUP BY ALL),
s0 AS (SELECT COALESCE(h.doc_id, e.doc_id) AS doc_id, COALESCE(h.section_id, e.section_id) AS section_id, h.header, h.header_raw, h.numbering, COALESCE(h.level, 1) AS level, COALESCE(e.p0, h.page, 0) AS page_start, COALESCE(e.p1, e.p0, h.page, 0) AS page_end, COALESCE(e.n_blocks, 0) AS n_blocks
       FROM sh h FULL JOIN se e ON h.doc_id = e.doc_id AND h.section_id = e.section_id),
s1 AS (SELECT s.*, (SELECT MAX(p.section_id) FROM s0 p WHERE p.doc_id = s.doc_id AND p.section_id < s.section_id AND p.level < s.level) AS parent_id FROM s0 s),
sections AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, parent_id ORDER BY section_id) - 1 AS sibling FROM s1)"""
)


@query(SECTIONS_SQL + " SELECT doc_id, CAST(section_id AS BIGINT) AS section_id, CAST(parent_id AS BIGINT) AS parent_id, header, numbering, level, page_start, page_end, CAST(n_blocks AS BIGINT) AS n_blocks FROM sections")
def synth_section_tree(spark, sf_dir):
    return corpus(spark, sf_dir).sections.select("doc_id", "section_id", "parent_id", "header", "numbering", "level", "page_start", "page_end", "n_blocks")


TOC_SQL = (
    SECTIONS_SQL
    + r""",
ft AS (SELECT doc_id, section_id, string_agg(text, chr(10) || chr(10) ORDER BY rs) AS body FROM sb WHERE block_type NOT IN ('Caption', 'PageNumber', 'RunningHeader', 'RunningFooter') GROUP BY ALL),
tt AS (SELECT doc_id, section_id, body, len(regexp_extract_all(body, '[\x00-\x7F]')) AS a, length(body) AS n FROM ft)"""
)


@query(
    TOC_SQL
    + """ SELECT s.doc_id, CAST(s.section_id AS BIGINT) AS section_id, CAST(s.sibling AS BIGINT) AS index, COALESCE(s.numbering, s.header, 'section_' || CAST(s.sibling AS VARCHAR)) AS path, COALESCE(s.header, '') AS header, s.level,
 s.page_start, s.page_end, CAST(COALESCE(t.a // 4 + CAST(FLOOR((t.n - t.a) / 1.5::DOUBLE) AS BIGINT), 0) AS BIGINT) AS estimated_tokens FROM sections s LEFT JOIN tt t ON s.doc_id = t.doc_id AND s.section_id = t.section_id"""
)
def synth_toc(spark, sf_dir):
    """Flagship: spans, lines, columns, blocks, types, headers, section tree, tokens."""
    d = corpus(spark, sf_dir)
    none_f, none_t = spark.createDataFrame([], "doc_id long, section_id long"), spark.createDataFrame([], "doc_id long, section_id long")
    t = sections.toc(d.sections, d.section_blocks, none_f, none_t)
    return t.select("doc_id", "section_id", "index", "path", "header", "level", "page_start", "page_end", "estimated_tokens")


@query(TOC_SQL + " SELECT s.doc_id, CAST(s.section_id AS BIGINT) AS section_id FROM sections s WHERE s.level = 2")
def synth_select_level(spark, sf_dir):
    return sections.by_level(corpus(spark, sf_dir).sections, 2).select("doc_id", "section_id")


@query(TOC_SQL + " SELECT s.doc_id, CAST(s.section_id AS BIGINT) AS section_id FROM sections s WHERE s.page_start <= 1 AND s.page_end >= 1")
def synth_select_pages(spark, sf_dir):
    return sections.by_pages(corpus(spark, sf_dir).sections, 1, 1).select("doc_id", "section_id")


@query(
    "WITH RECURSIVE "
    + TOC_SQL[len("WITH ") :]
    + """, up AS (SELECT doc_id, section_id, parent_id FROM sections UNION ALL SELECT u.doc_id, u.section_id, s.parent_id FROM up u JOIN sections s ON s.doc_id = u.doc_id AND s.section_id = u.parent_id WHERE u.parent_id IS NOT NULL),
 mt AS (SELECT doc_id, section_id FROM sections WHERE contains(upper(COALESCE(header, '')), 'THE'))
 SELECT m.doc_id, CAST(m.section_id AS BIGINT) AS section_id FROM mt m WHERE NOT EXISTS (SELECT 1 FROM up u JOIN mt p ON p.doc_id = u.doc_id AND p.section_id = u.parent_id WHERE u.doc_id = m.doc_id AND u.section_id = m.section_id)"""
)
def synth_select_names(spark, sf_dir):
    return sections.by_names(corpus(spark, sf_dir).sections, ["the"]).select("doc_id", "section_id")


@query(TOC_SQL + " SELECT s.doc_id, CAST(p.pick AS BIGINT) AS pick, CAST(s.section_id AS BIGINT) AS section_id FROM sections s JOIN (VALUES (0, 2), (1, 0), (2, 2), (3, 99)) p(pick, k) ON p.k = s.section_id")
def synth_select_indices(spark, sf_dir):
    return sections.by_indices(corpus(spark, sf_dir).sections, [2, 0, 2, 99])


@query(TOC_SQL + " SELECT s.doc_id, CAST(s.section_id AS BIGINT) AS section_id FROM sections s LEFT JOIN tt t USING (doc_id, section_id) WHERE COALESCE(t.a // 4 + CAST(FLOOR((t.n - t.a) / 1.5::DOUBLE) AS BIGINT), 0) > 50 AND s.level = 1")
def synth_select_where(spark, sf_dir):
    return corpus(spark, sf_dir).select_sections_where((F.col("estimated_tokens") > 50) & (F.col("level") == 1)).picks.select("doc_id", "section_id")


@query(TOC_SQL + " SELECT s.doc_id, CAST(SUM(COALESCE(" + TOKENS_SQL.format(t="t.body") + ", 0)) AS BIGINT) AS total_tokens FROM sections s LEFT JOIN tt t USING (doc_id, section_id) WHERE s.level = 1 GROUP BY s.doc_id")
def synth_selection_tokens(spark, sf_dir):
    return corpus(spark, sf_dir).select_sections_by_level(1).total_tokens()


@query(TOC_SQL + " SELECT doc_id, CAST(section_id AS BIGINT) AS section_id, body AS text FROM ft")
def synth_full_text(spark, sf_dir):
    return sections.full_text(corpus(spark, sf_dir).section_blocks)


ANOMALIES_SQL = r""",
n0 AS (SELECT doc_id, global_index, page, CASE WHEN regexp_matches(numbering, '^\d') THEN 'n' || regexp_replace(numbering, '\.$', '') WHEN regexp_matches(numbering, '^[IVXLCDM]+\.') THEN 'r' || numbering ELSE 'a' || numbering END AS sig FROM headers WHERE numbering IS NOT NULL),
n1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, sig ORDER BY global_index) AS again, CASE WHEN sig LIKE 'n%.%' THEN regexp_replace(sig, '\.[0-9]+$', '') ELSE '' END AS parent,
        CASE WHEN sig LIKE 'n%' THEN CAST(regexp_extract(sig, '(\d+)$', 1) AS INT) WHEN sig = 'rIV.' THEN 4 WHEN sig = 'rI.' THEN 1 ELSE 0 END AS ord, sig[1] AS variant FROM n0),
n2 AS (SELECT *, LAG(ord) OVER w AS po, LAG(variant) OVER w AS pv FROM n1 WHERE again = 1 WINDOW w AS (PARTITION BY doc_id, parent ORDER BY global_index)),
anomalies AS (SELECT doc_id, CAST(global_index AS BIGINT) AS block_index, page, 'Duplicate' AS kind FROM n1 WHERE again > 1
UNION ALL SELECT doc_id, CAST(global_index AS BIGINT), page, CASE WHEN ord <= po THEN 'NonMonotonic' ELSE 'SkippedNumber' END FROM n2 WHERE pv = variant AND (ord <= po OR ord > po + 1))"""


@query(HEADERS_SQL + ANOMALIES_SQL + " SELECT * FROM anomalies")
def synth_numbering_anomalies(spark, sf_dir):
    return structure.numbering_anomalies(corpus(spark, sf_dir).headers)


@query(
    TYPED_SQL
    + r""", c0 AS (SELECT *, regexp_matches(t, '(?i)^(Fig\.?|Figure)\s*\d+') AS f, regexp_matches(t, '(?i)^(Table|Tab\.)\s*\d+') AS tb FROM typed)
 SELECT doc_id, CAST(global_index AS BIGINT) AS block_index, CASE WHEN f THEN 'Figure' ELSE 'Table' END AS caption_type, CAST(CASE WHEN f THEN regexp_extract(t, '(?i)^(Fig\.?|Figure)\s*(\d+)', 2) ELSE regexp_extract(t, '(?i)^(Table|Tab\.)\s*(\d+)', 2) END AS BIGINT) AS number, t AS full_text FROM c0 WHERE f OR tb"""
)
def synth_captions(spark, sf_dir):
    return corpus(spark, sf_dir).captions.select("doc_id", "block_index", "caption_type", "number", "full_text")


FIGURES_SQL = (
    TOC_SQL
    + r""",
cap AS (SELECT doc_id, page, global_index, t AS full_text, "left" AS cl, top AS ct, "right" AS cr, bottom AS cb, regexp_extract(t, '(?i)^(Fig\.?|Figure)\s*(\d+)', 1) AS prefix, CAST(regexp_extract(t, '(?i)^(Fig\.?|Figure)\s*(\d+)', 2) AS BIGINT) AS number
        FROM typed WHERE regexp_matches(t, '(?i)^(Fig\.?|Figure)\s*\d+')),
img AS (SELECT doc_id, page, i AS image_seq, format('images/p{:03d}_img{:03d}.png', page, row_) AS path, "left" AS il, top + 30.0::DOUBLE AS it, "left" + 100.0::DOUBLE AS ir, top + 10.0::DOUBLE AS ib FROM l3 WHERE kind = 3 AND doc_id % 7 <> 3),
pair AS (SELECT c.*, i.image_seq, i.path, i.ib, least(abs(ib - ct), abs(cb - it)) AS v, abs((il + ir) / 2.0 - (cl + cr) / 2.0) AS h FROM cap c JOIN img i USING (doc_id, page)),
-- a page of the fixture has one image at most, so the first caption in reach takes it
took AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, page ORDER BY global_index, v * 10.0 + h) AS k FROM pair WHERE v <= 50),
near AS (SELECT t.doc_id, t.global_index, list(b.text ORDER BY b.global_index) AS p FROM took t JOIN typed b ON b.doc_id = t.doc_id AND b.global_index BETWEEN t.global_index - 3 AND t.global_index + 3 AND b.global_index <> t.global_index
         WHERE k = 1 AND b.block_type IN ('BodyText', 'Abstract') GROUP BY ALL),
raw AS (SELECT t.doc_id, ROW_NUMBER() OVER (PARTITION BY t.doc_id ORDER BY t.global_index) - 1 AS figure_seq, prefix || ' ' || CAST(number AS VARCHAR) AS figure_id, full_text AS caption_text,
          COALESCE(substr(trim(list_reduce(list_prepend('', p), lambda acc, x: CASE WHEN strlen(acc) + strlen(x) < 500 THEN acc || x || ' ' ELSE acc END)), 1, 500), '') AS context_text,
          path AS image_path, page, CASE WHEN t.global_index > 0 THEN t.global_index - 1 END AS after_block_index, ib AS y_position FROM took t LEFT JOIN near n USING (doc_id, global_index) WHERE k = 1),
figs AS (SELECT r.*, COALESCE(b.section_id, 0) AS section_id, b.rs AS anchor_seq FROM raw r LEFT JOIN sb b ON b.doc_id = r.doc_id AND b.global_index = r.after_block_index WHERE r.after_block_index IS NULL OR b.section_id IS NOT NULL)"""
)


@query(FIGURES_SQL + " SELECT doc_id, CAST(section_id AS BIGINT) AS section_id, CAST(figure_seq AS BIGINT) AS figure_seq, figure_id, caption_text, context_text, image_path, page, CAST(after_block_index AS BIGINT) AS after_block_index, y_position FROM figs")
def synth_figures(spark, sf_dir):
    return corpus(spark, sf_dir).figures.select("doc_id", "section_id", "figure_seq", "figure_id", "caption_text", "context_text", "image_path", "page", "after_block_index", "y_position")


@query(FIGURES_SQL + " SELECT doc_id, CAST(global_index AS BIGINT) AS block_index, full_text FROM cap c WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.doc_id = c.doc_id AND r.caption_text = c.full_text)")
def synth_unmatched_captions(spark, sf_dir):
    d = corpus(spark, sf_dir)
    return figures.unmatched_captions(d.captions, d.raw_figures).select("doc_id", "block_index", "full_text")


@query(FIGURES_SQL + " SELECT doc_id, CAST(image_seq AS BIGINT) AS image_seq, path FROM img i WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.doc_id = i.doc_id AND r.image_path = i.path)")
def synth_unmatched_images(spark, sf_dir):
    d = corpus(spark, sf_dir)
    return diagnostics.unmatched_images(d._images, d.raw_figures).select("doc_id", "image_seq", "path")


@query(
    "WITH "
    + synth.SPANS_SQL
    + """, im AS (SELECT doc_id, page, 100.0::DOUBLE AS w FROM l3 WHERE kind = 3 AND doc_id % 7 <> 3), mx AS (SELECT doc_id, page, MAX(w) AS w FROM im GROUP BY ALL), dm AS (SELECT doc_id, page, MAX("right") AS width FROM spans GROUP BY ALL)
 SELECT doc_id, page, 1.0::DOUBLE AS scale, NOT (w / width BETWEEN 0.8 AND 1.2 OR abs(w - width) < width * 0.2) AS fallback FROM mx JOIN dm USING (doc_id, page)"""
)
def synth_image_scale(spark, sf_dir):
    return corpus(spark, sf_dir).scales


@query()
def synth_tables(spark, sf_dir):
    return corpus(spark, sf_dir).raw_tables.select("doc_id", "table_seq", "table_id", "caption", "text", "page", "after_block_index", "y_position")


METADATA_SQL = r""",
gt AS (SELECT doc_id, arg_min(t, global_index) AS title FROM typed WHERE block_type = 'Title' AND t <> '' GROUP BY doc_id),
p0 AS (SELECT *, MIN(bottom) OVER w + (MAX(top) OVER w - MIN(bottom) OVER w) * 0.6::DOUBLE AS cut FROM typed WHERE page = 0 WINDOW w AS (PARTITION BY doc_id)),
lt AS (SELECT doc_id, arg_max(t, (font_size, global_index)) AS title FROM p0 WHERE top >= cut AND n_lines <= 3 AND block_type NOT IN ('Caption', 'PageNumber', 'RunningHeader', 'RunningFooter', 'Footnote', 'Reference') AND t <> '' GROUP BY doc_id),
dm AS (SELECT doc_id, global_index, regexp_replace(regexp_extract(regexp_replace(text, '\s+', ' ', 'g'), '10\.\d{4,9}/[-._;()/:A-Za-z0-9]+', 0), '\.+$', '') AS doi FROM typed),
dd AS (SELECT doc_id, arg_min(doi, global_index) AS doi FROM dm WHERE doi <> '' GROUP BY doc_id),
md AS (SELECT d.doc_id, d.pages, COALESCE(g.title, l.title) AS title, x.doi FROM (SELECT doc_id, MAX(page) + 1 AS pages FROM typed GROUP BY doc_id) d LEFT JOIN gt g USING (doc_id) LEFT JOIN lt l USING (doc_id) LEFT JOIN dd x USING (doc_id)),
ta AS (SELECT p.doc_id, arg_min(p.bottom, global_index) AS b, arg_min(p.font_size, global_index) AS s FROM p0 p JOIN md USING (doc_id) WHERE p.t = md.title GROUP BY p.doc_id),
un AS (SELECT p.doc_id, arg_min(t, (-top, global_index)) AS line FROM p0 p JOIN ta USING (doc_id) WHERE top < b AND b - top <= 50 AND font_size < s * 0.99::DOUBLE AND t <> ''
       AND block_type NOT IN ('SectionHeader', 'SubsectionHeader', 'Caption', 'PageNumber', 'RunningHeader', 'RunningFooter', 'Footnote') GROUP BY p.doc_id),
au AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(line, '(?i)\band\b', ',', 'g'), '[,\n]'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: strlen(x) > 1) AS names FROM un)"""


@query(TYPED_SQL + METADATA_SQL + """ SELECT m.doc_id, title, COALESCE(array_to_string(names, '|'), '') AS authors, doi, CAST(pages AS INT) AS pages FROM md m LEFT JOIN au USING (doc_id)""")
def synth_metadata(spark, sf_dir):
    return corpus(spark, sf_dir).metadata.withColumn("authors", F.array_join("authors", "|"))


COVERAGE_SQL = (
    FIGURES_SQL
    + """,
cv AS (SELECT d.doc_id, COALESCE(x.n, 0) AS extracted_chars, COALESCE(b.n, 0) + COALESCE(h.n, 0) + COALESCE(f.n, 0) AS emitted_chars, COALESCE(o.n, 0) AS dropped_blocks FROM (SELECT DISTINCT doc_id FROM sections) d
  LEFT JOIN (SELECT doc_id, SUM(length(text)) AS n FROM spans GROUP BY doc_id) x USING (doc_id) LEFT JOIN (SELECT doc_id, SUM(length(body)) AS n FROM ft GROUP BY doc_id) b USING (doc_id)
  LEFT JOIN (SELECT doc_id, SUM(length(header)) AS n FROM sections GROUP BY doc_id) h USING (doc_id) LEFT JOIN (SELECT doc_id, SUM(length(caption_text)) AS n FROM figs GROUP BY doc_id) f USING (doc_id)
  LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM typed WHERE block_type IN ('Caption', 'PageNumber', 'RunningHeader', 'RunningFooter') GROUP BY doc_id) o USING (doc_id)),
cover AS (SELECT doc_id, CAST(extracted_chars AS BIGINT) AS extracted_chars, CAST(emitted_chars AS BIGINT) AS emitted_chars, CAST(dropped_blocks AS BIGINT) AS dropped_blocks,
  round(CASE WHEN extracted_chars = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, emitted_chars::DOUBLE / extracted_chars::DOUBLE) END, 6) AS ratio FROM cv)"""
)


@query(COVERAGE_SQL + " SELECT * FROM cover")
def synth_coverage(spark, sf_dir):
    return corpus(spark, sf_dir).coverage.withColumn("ratio", F.round("ratio", 6))


@query(
    COVERAGE_SQL
    + ANOMALIES_SQL
    + """
SELECT doc_id, 'LowCoverage' AS kind, CAST(NULL AS INT) AS page, CAST(ratio AS VARCHAR) AS detail FROM cover WHERE ratio < 0.9
UNION ALL SELECT doc_id, 'RepeatedRunningReclassified', NULL, CAST(COUNT(*) AS VARCHAR) FROM typed WHERE block_type <> bt1 GROUP BY doc_id
UNION ALL SELECT doc_id, 'SectionNumberingAnomaly', page, kind FROM anomalies
UNION ALL SELECT doc_id, 'UnmatchedCaption', page, prefix || ' ' || CAST(number AS VARCHAR) FROM cap c WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.doc_id = c.doc_id AND r.caption_text = c.full_text)
UNION ALL SELECT doc_id, 'PageDimensionsFallback', page, CAST(w AS VARCHAR) || 'x' || CAST(h AS VARCHAR) FROM dims
UNION ALL SELECT doc_id, 'CoordinateFallback', page, '1.0' FROM (SELECT DISTINCT doc_id, page FROM img) i JOIN dims USING (doc_id, page) WHERE NOT (100.0::DOUBLE / w BETWEEN 0.8 AND 1.2 OR abs(100.0::DOUBLE - w) < w * 0.2)"""
)
def synth_warnings(spark, sf_dir):
    return corpus(spark, sf_dir).warnings


@query()
def synth_span_merge(spark, sf_dir):
    return boxed(layout.merge_spans(layout.clean_spans(synth.spans(synth.load(spark, sf_dir)))), "doc_id", "page", "text")


ESCAPE = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '](', ']\\(')"


def _bodies_sql(block: str, figure: str) -> str:
    """``bd``: (doc_id, section_id, body), blocks and figures in turn."""
    return (
        FIGURES_SQL
        + f""",
fq AS (SELECT *, MAX(bad) OVER (PARTITION BY doc_id, section_id ORDER BY figure_seq) AS held FROM (SELECT *, CASE WHEN anchor_seq IS NULL OR COALESCE(anchor_seq < LAG(anchor_seq) OVER (PARTITION BY doc_id, section_id ORDER BY figure_seq), FALSE) THEN 1 ELSE 0 END AS bad, string_split(image_path, '/')[-1] AS file FROM figs)),
pc AS (SELECT doc_id, section_id, rs AS place, 0 AS kind, rs AS seq, {block} || chr(10) || chr(10) AS piece FROM sb WHERE block_type NOT IN ('Caption', 'PageNumber', 'RunningHeader', 'RunningFooter')
  UNION ALL SELECT doc_id, section_id, CASE WHEN held = 0 THEN anchor_seq ELSE 4611686018427387904 END, 1, figure_seq, {figure} FROM fq),
bd AS (SELECT doc_id, section_id, string_agg(piece, '' ORDER BY place, kind, seq) AS body FROM pc GROUP BY ALL),
below AS (SELECT doc_id, section_id AS pick, section_id FROM sections WHERE level = 1 UNION ALL SELECT b.doc_id, b.pick, s.section_id FROM below b JOIN sections s ON s.doc_id = b.doc_id AND s.parent_id = b.section_id)"""
    ).replace("WITH ", "WITH RECURSIVE ", 1)


MARKDOWN_SQL = _bodies_sql(ESCAPE.format("text"), "'![' || " + ESCAPE.format("figure_id") + " || '](./images/' || file || ')' || chr(10) || chr(10) || '*' || " + ESCAPE.format("caption_text") + " || '*' || chr(10) || chr(10)")
HEAD_SQL = "CASE WHEN s.header IS NOT NULL THEN repeat('#', greatest(1, least(6, s.level + 1))) || ' ' || " + ESCAPE.format("s.header") + " || chr(10) || chr(10) ELSE '' END"


YAML = r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
FRONT_SQL = (
    METADATA_SQL
    + """,
fm AS (SELECT m.doc_id, '---' || chr(10) || COALESCE('title: "' || """
    + YAML.format("title")
    + """ || '"' || chr(10), '') || CASE WHEN len(names) > 0 THEN 'authors:' || chr(10) || array_to_string(list_transform(names, lambda x: '  - "' || """
    + YAML.format("x")
    + """ || '"' || chr(10)), '') ELSE '' END || '---' || chr(10) || chr(10) AS front FROM md m LEFT JOIN au USING (doc_id))"""
)
PAGED_SQL = "string_agg(" + HEAD_SQL + " || '<!-- page ' || CAST(s.page_start AS VARCHAR) || ' -->' || chr(10) || chr(10) || COALESCE(b.body, ''), '' ORDER BY s.section_id)"


@query(MARKDOWN_SQL + FRONT_SQL + f" SELECT s.doc_id, COALESCE(any_value(front), '') || {PAGED_SQL} AS text FROM sections s LEFT JOIN bd b USING (doc_id, section_id) LEFT JOIN fm ON fm.doc_id = s.doc_id GROUP BY s.doc_id")
def synth_markdown(spark, sf_dir):
    return corpus(spark, sf_dir).to_markdown(MarkdownConfig(page_numbers=True, front_matter=True))


@query()
def synth_markdown_math(spark, sf_dir):
    return corpus(spark, sf_dir).to_markdown(MarkdownConfig(math=MathConfig(), caption_style="bold"))


@query(MARKDOWN_SQL + f" SELECT s.doc_id, {PAGED_SQL} AS text FROM sections s LEFT JOIN bd b USING (doc_id, section_id) GROUP BY s.doc_id")
def synth_markdown_pages(spark, sf_dir):
    return corpus(spark, sf_dir).to_markdown(MarkdownConfig(page_numbers=True))


@query(
    _bodies_sql("text", "'[IMAGE: ' || figure_id || ' ' || file || ']' || chr(10) || chr(10)")
    + """ SELECT s.doc_id, string_agg(CASE WHEN s.header IS NOT NULL THEN repeat('#', s.level + 1) || ' ' || s.header || chr(10) || chr(10) ELSE '' END || CASE WHEN COALESCE(rtrim(b.body, chr(10)), '') <> '' THEN rtrim(b.body, chr(10)) || chr(10) || chr(10) ELSE '' END, '' ORDER BY s.section_id) AS text
 FROM sections s LEFT JOIN bd b USING (doc_id, section_id) GROUP BY s.doc_id"""
)
def synth_llm_text(spark, sf_dir):
    return corpus(spark, sf_dir).to_llm_text(LlmTextConfig(math="plain"))


@query(MARKDOWN_SQL + " SELECT s.doc_id, string_agg(" + HEAD_SQL + " || COALESCE(b.body, ''), '' ORDER BY w.pick, s.section_id) AS text FROM below w JOIN sections s ON s.doc_id = w.doc_id AND s.section_id = w.section_id LEFT JOIN bd b ON b.doc_id = s.doc_id AND b.section_id = s.section_id GROUP BY s.doc_id")
def synth_selected_markdown(spark, sf_dir):
    return corpus(spark, sf_dir).select_sections_by_level(1).to_markdown()


@query()
def synth_json(spark, sf_dir):
    return corpus(spark, sf_dir).to_json()


@query()
def synth_content_json(spark, sf_dir):
    return corpus(spark, sf_dir).to_content_json()


@query()
def synth_column_order(spark, sf_dir):
    """Sections when columns are read one after another."""
    d = synth.load(spark, sf_dir)
    return DocumentSet(synth.spans(d), images=synth.images(d), config=Config(reading_order="column", keep_orphan_assets=True)).toc()


def _paragraphs(spark, sf_dir) -> DocumentSet:
    """Each line of a document a paragraph of one section: for the chunkers."""
    return corpus(spark, sf_dir)


@query()
def synth_chunk_section(spark, sf_dir):
    return _paragraphs(spark, sf_dir).to_chunks(ChunkConfig(max_tokens=200, overlap_tokens=20))


@query()
def synth_chunk_token(spark, sf_dir):
    return _paragraphs(spark, sf_dir).to_chunks(ChunkConfig(max_tokens=300, overlap_tokens=30, strategy="token"))


@query()
def synth_chunk_paragraph(spark, sf_dir):
    return _paragraphs(spark, sf_dir).to_chunks(ChunkConfig(max_tokens=120, overlap_tokens=10, strategy="paragraph"))


@query()
def synth_selected_chunks(spark, sf_dir):
    return corpus(spark, sf_dir).select_sections_by_level(1).to_chunks(ChunkConfig(max_tokens=200))


@query()
def synth_chunk_lines(spark, sf_dir):
    d = corpus(spark, sf_dir)
    return d.chunk_lines(d.to_chunks(ChunkConfig(max_tokens=200, overlap_tokens=20)))
