"""Assets in sections, rendered bodies, table of contents and selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LlmTextConfig, MarkdownConfig, MathConfig
from ..functions import text as T
from ..functions.mathtext import render_block_udf
from .structure import OUT_OF_TEXT

KEY = ["doc_id", "section_id"]


def assign_assets(assets: DataFrame, section_blocks: DataFrame, keep_orphans: bool = False) -> DataFrame:
    """Assets with the section and reading place of their anchor block.  No anchor: the first
    section.  An anchor in no section (a header): dropped, unless ``keep_orphans``."""
    b = section_blocks.select("doc_id", F.col("global_index").alias("after_block_index"), "section_id", F.col("reading_seq").alias("anchor_seq"))
    found = assets.filter("after_block_index is not null").join(b, ["doc_id", "after_block_index"], "left" if keep_orphans else "inner")
    found = found.withColumn("section_id", F.coalesce("section_id", F.lit(0).cast("long")))
    free = assets.filter("after_block_index is null").withColumn("section_id", F.lit(0).cast("long")).withColumn("anchor_seq", F.lit(None).cast("long"))
    return found.unionByName(free)


def full_text(section_blocks: DataFrame) -> DataFrame:
    """(doc_id, section_id, text): raw text of the blocks that count as text."""
    rows = section_blocks.filter(~F.col("block_type").isin(*OUT_OF_TEXT))
    parts = F.array_sort(F.collect_list(F.struct("reading_seq", "text")))
    return rows.groupBy(*KEY).agg(F.array_join(F.transform(parts, lambda x: x.text), "\n\n").alias("text"))


def _places(assets: DataFrame, seq: str) -> DataFrame:
    """When an asset's turn comes: queues are first in, first out, so one whose anchor is missing
    or lies behind holds up all that follow, to the end of the section."""
    q = Window.partitionBy(*KEY).orderBy(seq)
    bad = F.col("anchor_seq").isNull() | F.coalesce(F.col("anchor_seq") < F.lag("anchor_seq").over(q), F.lit(False))
    rows = assets.withColumn("_bad", bad.cast("int")).withColumn("_held", F.max("_bad").over(q.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("place", F.when(F.col("_held") == 0, F.col("anchor_seq")).otherwise(F.lit((1 << 62)))).drop("_bad", "_held")


def figure_text(fmt: str, base: str = "") -> Column | None:
    name = T.file_name(F.col("image_path"))
    path = F.concat(F.lit(f"{base}/"), name) if base else name
    return {
        "placeholder": F.concat(F.lit("[IMAGE: "), F.col("figure_id"), F.lit(" "), path, F.lit("]\n\n")),
        "link": F.concat(F.lit("!["), F.col("figure_id"), F.lit("]("), path, F.lit(")\n\n")),
        "caption": F.concat(F.lit("["), F.col("caption_text"), F.lit("]\n\n")),
        "omit": None,
    }[fmt]


def relative_path(image_dir: str, output_dir: str) -> str:
    import os

    rel = os.path.relpath(image_dir, output_dir).replace(os.sep, "/")
    return "." if rel == "." else rel


def markdown_figure(cfg: MarkdownConfig) -> Column:
    name = T.file_name(F.col("image_path"))
    if cfg.image_dir and cfg.output_dir:
        path = F.concat(F.lit(relative_path(cfg.image_dir, cfg.output_dir) + "/"), name)
    else:
        path = F.concat(F.lit(cfg.image_base + "/"), name) if cfg.image_base else name
    ident, text = T.escape_markdown(F.col("figure_id")), T.escape_markdown(F.col("caption_text"))
    style = {
        "italic": F.concat(F.lit("*"), text, F.lit("*\n\n")),
        "bold": F.concat(F.lit("**"), ident, F.lit("** "), T.escape_markdown(T.caption_description(F.col("caption_text"))), F.lit("\n\n")),
        "plain": F.concat(text, F.lit("\n\n")),
    }[cfg.caption_style]
    return F.concat(F.lit("!["), ident, F.lit("]("), path, F.lit(")\n\n"), style)


def table_text(markdown: bool) -> Column:
    nl = F.lit("\n\n")
    if not markdown:
        return F.concat(F.coalesce(F.concat(F.col("caption"), nl), F.lit("")), F.col("text"), nl)
    body = F.when(F.col("kind") == "Csv", F.concat(F.lit("```csv\n"), F.col("text"), F.lit("```"))).when(F.col("kind") == "PlainText", F.concat(F.lit("```\n"), F.col("text"), F.lit("```"))).otherwise(F.col("text"))
    return F.concat(F.coalesce(F.concat(F.lit("**"), T.escape_markdown(F.col("caption")), F.lit("**"), nl), F.lit("")), body, nl)


def bodies(section_blocks: DataFrame, figures: DataFrame, tables: DataFrame, *, markdown: bool, math: MathConfig | None, figure: Column | None, with_tables: bool = True, trim: bool = True) -> DataFrame:
    """(doc_id, section_id, body): blocks in reading order, each followed by its assets."""
    text = F.col("text")
    if math is not None:
        text = render_block_udf(math, markdown)(F.col("text"), F.col("lines"))
    elif markdown:
        text = T.escape_markdown(text)
    item = lambda kind, seq, piece, place="place": [*KEY, F.col(place).cast("long").alias("place"), F.lit(kind).alias("kind"), F.col(seq).cast("long").alias("seq"), piece.alias("piece")]
    rows = section_blocks.filter(~F.col("block_type").isin(*OUT_OF_TEXT)).select(*item(0, "reading_seq", F.concat(text, F.lit("\n\n")), "reading_seq"))
    if figure is not None:
        rows = rows.unionByName(_places(figures, "figure_seq").select(*item(1, "figure_seq", figure)))
    if with_tables:
        rows = rows.unionByName(_places(tables, "table_seq").select(*item(2, "table_seq", table_text(markdown))))
    parts = F.array_sort(F.collect_list(F.struct("place", "kind", "seq", "piece")))
    body = F.array_join(F.transform(parts, lambda x: x.piece), "")
    return rows.groupBy(*KEY).agg((F.regexp_replace(body, r"(?U)\s+$", "") if trim else body).alias("body"))


def toc(sections: DataFrame, section_blocks: DataFrame, figures: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per section, in order: path, header, level, pages, tokens of its own text, assets."""
    count = lambda t, name: t.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))
    s = sections.join(full_text(section_blocks).select(*KEY, T.toc_tokens(F.col("text")).alias("estimated_tokens")), KEY, "left")
    s = s.join(count(figures, "figure_count"), KEY, "left").join(count(tables, "table_count"), KEY, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    s = s.select(
        "doc_id",
        "section_id",
        "parent_id",
        F.col("sibling").alias("index"),
        F.coalesce("numbering", "header", F.concat(F.lit("section_"), F.col("sibling").cast("string"))).alias("path"),
        F.coalesce("header", F.lit("")).alias("header"),
        F.coalesce("header_raw", F.lit("")).alias("header_raw"),
        "level",
        F.size("ancestors").alias("depth"),
        "page_start",
        "page_end",
        zero("estimated_tokens"),
        zero("figure_count"),
        zero("table_count"),
    )
    return s.withColumn("has_figures", F.col("figure_count") > 0).withColumn("has_tables", F.col("table_count") > 0)


def toc_line(cli: bool = False) -> Column:
    """A table-of-contents line: zero-based pages and level indent, or as the command line shows it."""
    one = 1 if cli else 0
    depth = F.col("depth") if cli else F.greatest(F.col("level") - 1, F.lit(0))
    some = lambda c, label: F.when(F.col(c) > 0, F.concat(F.lit(f"  {label}:"), F.col(c).cast("string"))).otherwise("")
    return F.concat(
        F.repeat(F.lit("  "), depth), F.lit("["), F.col("level").cast("string"), F.lit("] "), F.col("header"), F.lit("  p."), (F.col("page_start") + one).cast("string"), F.lit("-"),
        (F.col("page_end") + one).cast("string"), F.lit("  ~"), F.col("estimated_tokens").cast("string"), F.lit(" tokens"), some("figure_count", "fig"), some("table_count", "tab"),
    )


# ------------------------------------------------------------------ selection: (doc_id, pick, section_id)


def _picked(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("section_id").alias("pick"), "section_id")


def by_names(sections: DataFrame, names: list[str]) -> DataFrame:
    """Sections whose header contains a name, whatever the case; nothing below a match."""

    def named(h: Column) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | F.upper(F.coalesce(h, F.lit(""))).contains(n.upper())
        return out

    return _picked(sections.filter(named(F.col("header")) & ~F.exists("ancestors", lambda a: named(a.header))))


def by_indices(sections: DataFrame, indices: list[int]) -> DataFrame:
    """In the caller's order, repeats kept, others ignored."""
    want = F.posexplode(F.array(*[F.lit(i).cast("long") for i in indices])) if indices else None
    if want is None:
        return _picked(sections.limit(0))
    wanted = sections.select("doc_id").distinct().select("doc_id", want.alias("pick", "section_id"))
    return sections.join(wanted, KEY).select("doc_id", F.col("pick").cast("long").alias("pick"), "section_id")


def by_level(sections: DataFrame, level: int) -> DataFrame:
    return _picked(sections.filter(F.col("level") == level))


def by_pages(sections: DataFrame, start: int, end: int) -> DataFrame:
    return _picked(sections.filter((F.col("page_start") <= end) & (F.col("page_end") >= start)))


def by_predicate(toc_rows: DataFrame, predicate: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """By a column over the table of contents, or a function that makes one."""
    return _picked(toc_rows.filter(predicate(toc_rows) if callable(predicate) and not isinstance(predicate, Column) else predicate))


def total_tokens(selection: DataFrame, section_blocks: DataFrame) -> DataFrame:
    t = full_text(section_blocks).select(*KEY, T.tokens(F.col("text")).alias("n"))
    return selection.join(t, KEY, "left").groupBy("doc_id").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_tokens"))


def subtree(selection: DataFrame, sections: DataFrame) -> DataFrame:
    """Each pick with all sections below it: (doc_id, pick, section columns)."""
    chain = sections.withColumn("_root", F.explode(F.concat(F.transform("ancestors", lambda a: a.id), F.array("section_id"))))
    return selection.select("doc_id", "pick", F.col("section_id").alias("_root")).join(chain, ["doc_id", "_root"]).drop("_root")


# ------------------------------------------------------------------ documents as text


def _joined(rows: DataFrame, piece: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pick", "section_id", piece.alias("piece"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x.piece), "").alias("text"))


def _all(sections: DataFrame) -> DataFrame:
    return sections.withColumn("pick", F.lit(0).cast("long"))


def to_markdown(sections: DataFrame, section_blocks: DataFrame, figures: DataFrame, tables: DataFrame, cfg: MarkdownConfig = MarkdownConfig(), selection: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, text)."""
    body = bodies(section_blocks, figures, tables, markdown=True, math=cfg.math, figure=markdown_figure(cfg), trim=False)
    rows = (_all(sections) if selection is None else subtree(selection, sections)).join(body, KEY, "left")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.col("level") + cfg.heading_offset))
    head = F.when(F.col("header").isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), T.escape_markdown(F.col("header")), F.lit("\n\n"))).otherwise("")
    page = F.concat(F.lit("<!-- page "), F.col("page_start").cast("string"), F.lit(" -->\n\n")) if cfg.page_numbers else F.lit("")
    out = _joined(rows, F.concat(head, page, F.coalesce("body", F.lit(""))))
    if cfg.front_matter and metadata is not None and selection is None:
        names = F.array_join(F.transform("authors", lambda a: F.concat(F.lit('  - "'), T.escape_yaml(a), F.lit('"\n'))), "")
        title = F.coalesce(F.concat(F.lit('title: "'), T.escape_yaml(F.col("title")), F.lit('"\n')), F.lit(""))
        front = F.concat(F.lit("---\n"), title, F.when(F.size("authors") > 0, F.concat(F.lit("authors:\n"), names)).otherwise(""), F.lit("---\n\n"))
        out = out.join(metadata.select("doc_id", front.alias("_front")), "doc_id", "left").select("doc_id", F.concat(F.coalesce("_front", F.lit("")), "text").alias("text"))
    return out


def to_llm_text(sections: DataFrame, section_blocks: DataFrame, figures: DataFrame, tables: DataFrame, cfg: LlmTextConfig = LlmTextConfig(), selection: DataFrame | None = None) -> DataFrame:
    math = None if cfg.math == "plain" else MathConfig(representation=cfg.math)
    figure = figure_text(cfg.figure_format, cfg.image_base) if cfg.figures else None
    body = bodies(section_blocks, figures, tables, markdown=False, math=math, figure=figure, with_tables=cfg.tables)
    rows = (_all(sections) if selection is None else subtree(selection, sections)).join(body, KEY, "left")
    head = F.when(F.col("header").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level") + 1), F.lit(" "), F.col("header"), F.lit("\n\n"))).otherwise("") if cfg.headers else F.lit("")
    text = F.when(F.coalesce("body", F.lit("")) != "", F.concat("body", F.lit("\n\n"))).otherwise("")
    return _joined(rows, F.concat(head, text))
