"""Whole documents as JSON: the full tree, and the content alone without geometry."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MathConfig
from .sections import KEY, bodies


def _gather(rows: DataFrame, keys: list[str], order: str, value, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.to_json(value, {"ignoreNullFields": "false"}).alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(parts, lambda x: x.v).alias(name))


def _rect(prefix: str = ""):
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("left", "top", "right", "bottom")])


def nest(pdf: pd.DataFrame, build) -> list[dict]:
    """Sections as a tree by parent_id, in flat order."""
    made, roots = {}, []
    for r in pdf.sort_values("section_id").to_dict("records"):
        node = made[r["section_id"]] = build(r)
        up = r["parent_id"]
        (roots if up is None or pd.isna(up) else made[int(up)]["children"]).append(node)
    return roots


def _text(x):
    return None if x is None or (isinstance(x, float) and pd.isna(x)) else x


def _list(x) -> list:
    return [] if x is None else [json.loads(v) for v in x]


def _dump(doc_id, value) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": [doc_id], "json": [json.dumps(value, indent=2, ensure_ascii=False)]})


def _meta(d: dict) -> dict:
    return {"title": _text(d["title"]), "authors": [] if d["authors"] is None else list(d["authors"]), "doi": _text(d["doi"])}


def content_json(sections: DataFrame, section_blocks: DataFrame, figures: DataFrame, tables: DataFrame, metadata: DataFrame, papers: DataFrame, math: MathConfig | None = None) -> DataFrame:
    """(doc_id, json): headers, breadcrumbs, rendered text, slim figures and tables."""
    body = bodies(section_blocks, figures, tables, markdown=False, math=math, figure=None, with_tables=False)
    fig = F.struct("figure_id", F.col("caption_text").alias("caption"), F.element_at(F.split("image_path", "/"), -1).alias("image_path"), "page")
    tab = F.struct("table_id", "caption", "text", "page")
    s = sections.join(body, KEY, "left").join(_gather(figures, KEY, "figure_seq", fig, "figures"), KEY, "left").join(_gather(tables, KEY, "table_seq", tab, "tables"), KEY, "left")
    s = s.select("doc_id", "section_id", "parent_id", "header_raw", "header", "numbering", "level", "breadcrumb", F.coalesce("body", F.lit("")).alias("text"), "page_start", "page_end", "figures", "tables")
    s = s.join(metadata, "doc_id", "left").join(papers.select("doc_id", "paper_id"), "doc_id", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        def build(r):
            head = None if _text(r["header"]) is None else {"text": r["header_raw"], "clean_text": r["header"], "numbering": _text(r["numbering"])}
            return {
                "header": head, "level": int(r["level"]), "breadcrumb": list(r["breadcrumb"]), "text": r["text"], "page_range": [int(r["page_start"]), int(r["page_end"])],
                "figures": _list(r["figures"]), "tables": _list(r["tables"]), "children": [],
            }

        d = pdf.iloc[0].to_dict()
        pages = 0 if pd.isna(d["pages"]) else int(d["pages"])
        return _dump(d["doc_id"], {"paper_id": _text(d["paper_id"]) or "", **_meta(d), "pages": pages, "sections": nest(pdf, build)})

    return s.groupBy("doc_id").applyInPandas(fold, "doc_id long, json string")


def full_json(sections: DataFrame, section_blocks: DataFrame, headers: DataFrame, figures: DataFrame, tables: DataFrame, metadata: DataFrame, papers: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): the whole tree with blocks and places; of a selection, the list of picked
    sections with what is below them."""
    block = F.struct("global_index", "text", _rect().alias("bbox"), "page", "column_index", "block_type", F.transform("lines", lambda x: F.struct(x.text.alias("text"), x.font_size.alias("primary_font_size"), x.is_bold.alias("is_bold"))).alias("lines"))
    point = F.struct("page", "after_block_index", "y_position").alias("insertion_point")
    fig = F.struct("figure_id", "figure_number", "caption_text", F.struct(F.col("image_path").alias("path"), "page").alias("image"), "context_text", point)
    form = F.struct(F.struct("header", "rows", "caption", F.col("text").alias("markdown_text"), "header_rows").alias("Markdown"))
    tab = F.struct("table_id", "table_number", "caption", form.alias("representation"), point, "page")
    head = headers.select("doc_id", F.col("text").alias("header_raw"), "clean_text", "block_index", F.to_json(F.struct("text", "clean_text", "level", "numbering", "page", _rect().alias("bbox"), "block_index"), {"ignoreNullFields": "false"}).alias("head"))
    s = sections.withColumn("_at", F.col("header_index")).join(head.select("doc_id", F.col("block_index").alias("_at"), "head"), ["doc_id", "_at"], "left")
    s = s.join(_gather(section_blocks, KEY, "reading_seq", block, "blocks"), KEY, "left").join(_gather(figures, KEY, "figure_seq", fig, "figures"), KEY, "left").join(_gather(tables, KEY, "table_seq", tab, "tables"), KEY, "left")
    s = s.select("doc_id", "section_id", "parent_id", "head", "level", "page_start", "page_end", "blocks", "figures", "tables").join(metadata, "doc_id", "left").join(papers.select("doc_id", "paper_id", "source_file"), "doc_id", "left")
    if selection is not None:
        s = s.join(selection.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", "section_id"))), lambda x: x.section_id).alias("picks")), "doc_id")
    else:
        s = s.withColumn("picks", F.lit(None).cast("array<long>"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = {}

        def build(r):
            node = {
                "header": json.loads(r["head"]) if _text(r["head"]) else None, "level": int(r["level"]), "blocks": _list(r["blocks"]), "figures": _list(r["figures"]), "tables": _list(r["tables"]),
                "children": [], "page_range": [int(r["page_start"]), int(r["page_end"])],
            }
            nodes[int(r["section_id"])] = node
            return node

        roots = nest(pdf, build)
        d = pdf.iloc[0].to_dict()
        if d["picks"] is not None:
            return _dump(d["doc_id"], [nodes[int(i)] for i in d["picks"]])
        meta = _meta(d) | {"pages": 0 if pd.isna(d["pages"]) else int(d["pages"])}
        order = [nodes[k] for k in sorted(nodes)]
        value = {
            "paper_id": _text(d["paper_id"]) or "", "source_file": _text(d["source_file"]) or "", "metadata": meta, "sections": roots,
            "all_figures": [f for n in order for f in n["figures"]], "all_tables": [t for n in order for t in n["tables"]],
        }
        return _dump(d["doc_id"], value)

    return s.groupBy("doc_id").applyInPandas(fold, "doc_id long, json string")
