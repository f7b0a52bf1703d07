"""Block types, headers, numbering checks, sections and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENGLISH_SECTION_NAMES, HeaderConfig
from ..functions import text as T

OUT_OF_TEXT = ("Caption", "PageNumber", "RunningHeader", "RunningFooter")
NO_HEADER = (*OUT_OF_TEXT, "Footnote", "Reference")


def body_font(block_rows: DataFrame, bin_width: float = 0.5) -> DataFrame:
    """(doc_id, body_size): the size bin with most bytes, the smallest of equals; 10 if none."""
    sized = block_rows.select("doc_id", F.when(F.col("font_size") > 0, F.round(F.col("font_size") / bin_width).cast("long")).alias("bin"), F.octet_length("text").alias("n"))
    bins = sized.groupBy("doc_id", "bin").agg(F.sum("n").alias("n"))
    best = F.max_by("bin", F.when(F.col("bin").isNotNull(), F.struct(F.col("n"), -F.col("bin"))))
    return bins.groupBy("doc_id").agg((F.coalesce(best, F.lit(round(10 / bin_width))) * bin_width).alias("body_size"))


def with_body_font(block_rows: DataFrame, bin_width: float = 0.5) -> DataFrame:
    """Blocks with their document's body size: ``body_font`` as windows, so blocks are not read twice."""
    bin_ = F.when(F.col("font_size") > 0, F.round(F.col("font_size") / bin_width).cast("long"))
    rows = block_rows.withColumn("_bin", bin_).withColumn("_n", F.sum(F.octet_length("text")).over(Window.partitionBy("doc_id", "_bin")))
    best = F.max(F.when(F.col("_bin").isNotNull(), F.struct(F.col("_n").alias("n"), (-F.col("_bin")).alias("b")))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("body_size", F.coalesce(-best.b, F.lit(round(10 / bin_width))) * bin_width).drop("_bin", "_n")


def classify(block_rows: DataFrame, caption_max_chars: int = 240, running_max_chars: int = 60) -> DataFrame:
    rows = with_body_font(block_rows).withColumn("_t", T.trim(F.col("text")))
    t = F.col("_t")
    ratio = F.when(F.col("body_size") > 0, F.col("font_size") / F.col("body_size")).otherwise(1.0)
    known = F.upper(t).rlike("|".join(ENGLISH_SECTION_NAMES))
    header = (F.octet_length(t) <= 120) & (F.col("n_lines") <= 3) & (F.col("is_bold") | (ratio > 1.05)) & (t != "")
    kind = (
        F.when(T.is_caption(t, caption_max_chars), "Caption")
        .when(T.is_page_number(t), "PageNumber")
        .when((F.col("n_lines") == 1) & (F.col("font_size") / F.greatest("body_size", F.lit(1.0)) < 0.85) & (F.length(t) <= running_max_chars), "RunningHeader")
        .when((ratio < 0.85) & (F.col("n_lines") <= 4), "Footnote")
        .when((ratio > 1.5) & (F.col("n_lines") <= 3), "Title")
        .when(header & ((ratio >= 1.15) | known), "SectionHeader")
        .when(header, "SubsectionHeader")
        .otherwise("BodyText")
    )
    return rows.withColumn("block_type", kind).drop("_t")


def repeated_running(typed: DataFrame, zone: float = 0.1, pages: int = 3) -> DataFrame:
    """Texts that stand in the top or bottom zone of several pages become running heads or feet.
    ``reclassified`` tells where a type changed."""
    high = F.max("top").over(Window.partitionBy("doc_id", "page"))
    rows = typed.withColumn("_h", high).withColumn("_text", F.lower(T.trim(F.col("text"))))
    free = (F.col("block_type") != "PageNumber") & (F.col("_h") > 0) & (F.col("_text") != "")
    head, foot = F.col("bottom") >= F.col("_h") - F.col("_h") * zone, F.col("top") <= F.col("_h") * zone
    rows = rows.withColumn("_zone", F.when(free & head, "head").when(free & foot, "foot"))
    same = Window.partitionBy("doc_id", "_text")
    often = lambda z: F.size(F.collect_set(F.when(F.col("_zone") == z, F.col("page"))).over(same)) >= pages
    rows = rows.withColumn("_head", often("head")).withColumn("_foot", often("foot"))
    new = F.when(free & head & F.col("_head"), "RunningHeader").when(free & foot & F.col("_foot"), "RunningFooter").otherwise(F.col("block_type"))
    return rows.withColumn("reclassified", new != F.col("block_type")).withColumn("block_type", new).drop("_h", "_text", "_zone", "_head", "_foot")


def mark_headers(typed: DataFrame, cfg: HeaderConfig = HeaderConfig()) -> DataFrame:
    """Blocks with ``header``: null, or struct (text, clean_text, level, numbering, components,
    score).  Levels are numbering depth, else the rank of the size among the document's headers."""
    eligible = ~F.col("block_type").isin(*NO_HEADER) if cfg.respect_classification else F.lit(True)
    rows = typed.withColumn("_t", T.trim(F.col("text")))
    ratio = F.when(F.col("body_size") > 0, F.col("font_size") / F.col("body_size")).otherwise(1.0)
    short = (F.length("_t") <= cfg.max_chars) & (F.col("n_lines") <= cfg.max_lines) & ~F.col("_t").rlike(r"^[0-9\p{IsWhite_Space}]*$")
    # long texts are no headers: spare them the expressions below
    rows = rows.withColumn("_try", F.when(eligible & short, F.col("_t"))).withColumn("_ratio", ratio)
    rows = rows.withColumn("_known", T.is_known_name(F.col("_try"), cfg.known_names)).withColumn("_key", T.numbering(F.col("_try")))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        points(F.col("_key").isNotNull(), 3)
        + points(T.is_all_caps(F.col("_try")), 2)
        + points(F.col("is_bold"), 2)
        + points(F.col("_ratio") > 1.1, 1)
        + points(F.col("_known"), 2)
        + points(T.is_cjk_heading(F.col("_try"), cfg.max_chars), cfg.cjk_bonus)
        + points(F.col("n_lines") == 1, 1)
    )
    is_header = F.col("_try").isNotNull() & ((F.col("_ratio") <= 1.8) | F.col("_known")) & (F.col("_score") >= cfg.min_score)
    rows = rows.withColumn("_score", score).withColumn("_is", is_header)
    rows = rows.withColumn("_bin", F.when(F.col("_is"), F.round(F.col("font_size") / cfg.bin_width).cast("long")))
    # sizes rank by the gaps between the bins that a document's headers have
    merge = max(1, round(cfg.merge_gap / cfg.bin_width))
    down = Window.partitionBy("doc_id").orderBy(F.col("_bin").desc_nulls_last())
    rows = rows.withColumn("_step", F.coalesce((F.lag("_bin").over(down) - F.col("_bin") > merge).cast("int"), F.lit(0)))
    rank = F.least(F.sum("_step").over(down.rowsBetween(Window.unboundedPreceding, 0)) + 1, F.lit(cfg.max_level))
    rows = rows.withColumn("_rank", rank)
    level = F.greatest(F.lit(1), F.least(F.coalesce(F.col("_key.depth"), F.col("_rank")), F.lit(cfg.max_level))).cast("int")
    header = F.struct(
        F.col("_t").alias("text"), F.coalesce("_key.rest", "_t").alias("clean_text"), level.alias("level"), F.col("_key.prefix").alias("numbering"), F.col("_key.components").alias("components"), F.col("_score").alias("score")
    )
    return rows.withColumn("header", F.when(F.col("_is"), header)).drop("_t", "_try", "_ratio", "_known", "_key", "_score", "_is", "_bin", "_step", "_rank")


def headers(marked: DataFrame) -> DataFrame:
    """The headers among marked blocks, a row each."""
    return marked.filter("header is not null").select("doc_id", F.col("global_index").alias("block_index"), "header.*", "page", "left", "top", "right", "bottom")


def numbering_anomalies(header_rows: DataFrame) -> DataFrame:
    """Duplicate, NonMonotonic and SkippedNumber, in header order."""
    rows = header_rows.filter("components is not null and size(components) > 0")
    rows = rows.withColumn("_sig", F.to_json("components")).withColumn("_parent", F.to_json(F.slice("components", 1, F.size("components") - 1)))
    rows = rows.withColumn("_last", F.element_at("components", -1))
    again = F.row_number().over(Window.partitionBy("doc_id", "_sig").orderBy("block_index")) > 1
    rows = rows.withColumn("_again", again)
    by = Window.partitionBy("doc_id", "_parent").orderBy("block_index")
    first = rows.filter(~F.col("_again")).withColumn("_prev", F.lag("_last").over(by))
    same = F.col("_prev.variant") == F.col("_last.variant")
    kind = F.when(same & (F.col("_last.ord") <= F.col("_prev.ord")), "NonMonotonic").when(same & (F.col("_last.ord") > F.col("_prev.ord") + 1), "SkippedNumber")
    found = first.select("doc_id", "block_index", "page", kind.alias("kind")).filter("kind is not null")
    return found.unionByName(rows.filter("_again").select("doc_id", "block_index", "page", F.lit("Duplicate").alias("kind")))


def number_sections(ordered: DataFrame) -> DataFrame:
    """Marked blocks in reading order with ``section_id``, the flat, pre-order index of their section: one
    runs from a header to the next, and a preamble counts only with blocks."""
    run = Window.partitionBy("doc_id").orderBy("reading_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = ordered.withColumn("_n", F.sum(F.col("header").isNotNull().cast("int")).over(run))
    lead = F.min("_n").over(Window.partitionBy("doc_id"))
    return rows.withColumn("section_id", (F.col("_n") - lead).cast("long")).drop("_n")


def split_sections(rows: DataFrame, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, section_blocks) of the rows of ``number_sections``.  A document without blocks
    (``docs`` names all) has one empty section.  ``parent_id`` is the latest earlier smaller level."""
    is_header = F.col("header").isNotNull()
    seq = lambda when: F.when(when, F.col("reading_seq"))
    s = rows.groupBy("doc_id", "section_id").agg(
        F.first("header", ignorenulls=True).alias("_h"),
        F.first(F.when(is_header, F.struct("global_index", "page")), ignorenulls=True).alias("_at"),
        F.min_by("page", seq(~is_header)).alias("_first"),
        F.max_by("page", seq(~is_header)).alias("_last"),
        F.count(seq(~is_header)).alias("n_blocks"),
    )
    if docs is not None:
        s = s.join(docs.select("doc_id").distinct(), "doc_id", "full").withColumn("section_id", F.coalesce("section_id", F.lit(0).cast("long")))
    s = s.select(
        "doc_id",
        "section_id",
        F.col("_at.global_index").alias("header_index"),
        F.col("_h.text").alias("header_raw"),
        F.col("_h.clean_text").alias("header"),
        F.col("_h.numbering").alias("numbering"),
        F.coalesce("_h.level", F.lit(1)).alias("level"),
        F.coalesce("_first", "_at.page", F.lit(0)).alias("page_start"),
        F.coalesce("_last", "_first", "_at.page", F.lit(0)).alias("page_end"),
        F.coalesce("n_blocks", F.lit(0).cast("long")).alias("n_blocks"),
    )
    return tree(s), rows.filter(~is_header).drop("header")


def tree(sections: DataFrame, max_level: int = 6) -> DataFrame:
    """Add parent_id, ancestors, breadcrumb (headers of the ancestors) and sibling index."""
    before = Window.partitionBy("doc_id").orderBy("section_id").rowsBetween(Window.unboundedPreceding, -1)
    # the latest earlier section of each level; a parent is the latest of the smaller levels
    latest = [F.last(F.when(F.col("level") == k, F.struct("section_id", "header")), ignorenulls=True).over(before) for k in range(1, max_level)]
    s = sections
    for k, c in enumerate(latest, 1):
        s = s.withColumn(f"_l{k}", c)
    up = [F.when(F.col("level") > k, F.col(f"_l{k}.section_id")) for k in range(1, max_level)]
    s = s.withColumn("parent_id", F.greatest(*up))
    # the latest section of a level is an ancestor unless one of a smaller level came after it
    none = F.lit(-1).cast("long")

    def above(k):
        ident = F.col(f"_l{k}.section_id")
        closed = F.greatest(none, none, *[F.col(f"_l{j}.section_id") for j in range(1, k)]) > ident
        return F.when((F.col("level") > k) & ident.isNotNull() & ~closed, F.struct(ident.alias("id"), F.col(f"_l{k}.header").alias("header")))

    s = s.withColumn("ancestors", F.filter(F.array(*[above(k) for k in range(1, max_level)]), lambda x: x.isNotNull()))
    s = s.withColumn("breadcrumb", F.filter(F.transform("ancestors", lambda a: a.header), lambda x: x.isNotNull() & (x != "")))
    sib = Window.partitionBy("doc_id", F.coalesce("parent_id", F.lit(-1).cast("long"))).orderBy("section_id")
    return s.withColumn("sibling", (F.row_number().over(sib) - 1).cast("long")).drop(*[f"_l{k}" for k in range(1, max_level)])


def metadata(typed: DataFrame, n_pages: DataFrame | None = None) -> DataFrame:
    """doc_id, title, authors, doi, pages: title block or largest font high on the first page, the
    block just below it, the first identifier."""
    rows = typed.withColumn("_t", T.trim(F.col("text")))
    given = rows.filter((F.col("block_type") == "Title") & (F.col("_t") != "")).groupBy("doc_id").agg(F.min_by("_t", "global_index").alias("_title"))
    first = rows.filter("page = 0")
    extent = Window.partitionBy("doc_id")
    hi, lo = F.max("top").over(extent), F.min("bottom").over(extent)
    first = first.withColumn("_cut", lo + (hi - lo) * 0.6)
    large = first.filter((F.col("top") >= F.col("_cut")) & (F.col("n_lines") <= 3) & ~F.col("block_type").isin(*NO_HEADER) & (F.col("_t") != ""))
    large = large.groupBy("doc_id").agg(F.max_by("_t", F.struct("font_size", "global_index")).alias("_large"))
    dois = rows.withColumn("_doi", T.doi(F.col("text"))).filter("_doi is not null").groupBy("doc_id").agg(F.min_by("_doi", "global_index").alias("doi"))
    doc = rows.groupBy("doc_id").agg((F.max("page") + 1).alias("pages")) if n_pages is None else n_pages.select("doc_id", "pages")
    doc = doc.join(given, "doc_id", "left").join(large, "doc_id", "left").join(dois, "doc_id", "left").withColumn("title", F.coalesce("_title", "_large"))
    at = first.join(doc.select("doc_id", "title"), "doc_id").filter(F.col("_t") == F.col("title"))
    at = at.groupBy("doc_id").agg(F.min_by(F.struct(F.col("bottom").alias("b"), F.col("font_size").alias("s")), "global_index").alias("_at"))
    near = first.join(at, "doc_id").filter(
        (F.col("top") < F.col("_at.b")) & (F.col("_at.b") - F.col("top") <= 50.0) & (F.col("font_size") < F.col("_at.s") * 0.99) & (F.col("_t") != "")
        & ~F.col("block_type").isin("SectionHeader", "SubsectionHeader", "Caption", "PageNumber", "RunningHeader", "RunningFooter", "Footnote")
    )
    near = near.groupBy("doc_id").agg(F.min_by("_t", F.struct(-F.col("top"), F.col("global_index"))).alias("_by"))
    doc = doc.join(near, "doc_id", "left")
    return doc.select("doc_id", "title", F.coalesce(T.split_authors(F.col("_by")), F.array().cast("array<string>")).alias("authors"), "doi", F.col("pages").cast("int").alias("pages"))
