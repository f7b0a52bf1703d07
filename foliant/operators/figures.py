"""Captions, figures and image coordinates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ["doc_id", "page"]
# Scales between image and page coordinates, in the order they are tried.
KNOWN_SCALES = (1.0, 1.0 / 72.0, 72.0, 1.0 / 96.0, 96.0, 0.001, 1000.0)


def image_scale(images: DataFrame, dims: DataFrame) -> DataFrame:
    """(doc_id, page, scale, fallback) for pages with images: by the widest image of the page."""
    w = images.groupBy(*PAGE).agg(F.greatest(F.max(F.col("right") - F.col("left")), F.lit(0.0)).alias("w")).join(dims.select(*PAGE, "width"), PAGE)
    ratio = F.col("w") / F.col("width")
    factor = F.col("width") / F.col("w")
    scale = F.when((F.col("w") > 0) & ratio.between(0.8, 1.2), 1.0).when((F.col("w") > 0) & (ratio > 1.0) & (factor >= 0.001) & (factor < 10.0), factor)
    for s in KNOWN_SCALES:
        scale = scale.when(F.abs(F.col("w") * s - F.col("width")) < F.col("width") * 0.2, s)
    return w.select(*PAGE, F.coalesce(scale, F.lit(1.0)).alias("scale"), scale.isNull().alias("fallback"))


def normalize_images(images: DataFrame, scales: DataFrame) -> DataFrame:
    box = ["left", "top", "right", "bottom"]
    rows = images.join(scales.select(*PAGE, "scale"), PAGE, "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    return rows.withColumns({f"raw_{c}": F.col(c) for c in box}).withColumns({c: F.col(c) * F.col("scale") for c in box}).drop("scale")


def captions(typed: DataFrame) -> DataFrame:
    """Figure and table captions of all blocks, whatever their type."""
    rows = typed.withColumn("_c", T.caption(F.col("text"))).filter("_c is not null")
    return rows.select("doc_id", F.col("global_index").alias("block_index"), "_c.*", "page", "left", "top", "right", "bottom")


def match_figures(caption_rows: DataFrame, images: DataFrame, typed: DataFrame, max_gap: float = 50.0) -> DataFrame:
    """Figures: each figure caption, in order, takes the nearest image of its page that is free.
    Pairs come from an equi-join on the page; only the taking in turn is a fold, page by page."""
    c = caption_rows.filter("caption_type = 'Figure'").select(
        *PAGE, "block_index", "prefix", "number", F.col("full_text").alias("caption_text"), F.col("left").alias("cl"), F.col("top").alias("ct"), F.col("right").alias("cr"), F.col("bottom").alias("cb")
    )
    i = images.select(*PAGE, "image_seq", "path", F.col("left").alias("il"), F.col("top").alias("it"), F.col("right").alias("ir"), F.col("bottom").alias("ib"))
    v = F.least(F.abs(F.col("ib") - F.col("ct")), F.abs(F.col("cb") - F.col("it")))
    h = F.abs((F.col("il") + F.col("ir")) / 2.0 - (F.col("cl") + F.col("cr")) / 2.0)
    pairs = c.join(i, PAGE).withColumn("v", v).filter(F.col("v") <= max_gap).select("doc_id", "page", "block_index", "image_seq", (F.col("v") * 10.0 + h).alias("cost"))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for block, group in pdf.sort_values(["block_index", "cost", "image_seq"]).groupby("block_index", sort=True):
            free = group[~group["image_seq"].isin(used)]
            if len(free):
                best = free.iloc[0]
                used.add(best["image_seq"])
                out.append((best["doc_id"], best["page"], block, best["image_seq"]))
        return pd.DataFrame(out, columns=["doc_id", "page", "block_index", "image_seq"])

    taken = pairs.groupBy(*PAGE).applyInPandas(take, "doc_id long, page int, block_index long, image_seq long")
    rows = taken.join(c, [*PAGE, "block_index"]).join(i.select(*PAGE, "image_seq", "path", "ib"), [*PAGE, "image_seq"])
    rows = rows.join(context(rows.select("doc_id", "block_index"), typed), ["doc_id", "block_index"], "left")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_index")) - 1
    return rows.select(
        "doc_id",
        seq.cast("long").alias("figure_seq"),
        F.concat_ws(" ", "prefix", F.coalesce("number", F.lit(0)).cast("string")).alias("figure_id"),
        F.col("number").alias("figure_number"),
        "caption_text",
        F.coalesce("context_text", F.lit("")).alias("context_text"),
        F.col("path").alias("image_path"),
        "page",
        F.when(F.col("block_index") > 0, F.col("block_index") - 1).alias("after_block_index"),
        F.col("ib").alias("y_position"),
    )


def context(at: DataFrame, typed: DataFrame, reach: int = 3, max_chars: int = 500) -> DataFrame:
    """Body text around captions: a block is added where the total stays under the limit, in
    bytes, and skipped where it does not."""
    near = at.withColumn("global_index", F.explode(F.expr(f"sequence(block_index - {reach}, block_index + {reach})"))).filter("global_index <> block_index")
    body = typed.filter(F.col("block_type").isin("BodyText", "Abstract")).select("doc_id", "global_index", "text")
    parts = near.join(body, ["doc_id", "global_index"]).groupBy("doc_id", "block_index").agg(F.array_sort(F.collect_list(F.struct("global_index", "text"))).alias("p"))
    joined = F.aggregate("p", F.lit(""), lambda acc, x: F.when(F.octet_length(acc) + F.octet_length(x.text) < max_chars, F.concat(acc, x.text, F.lit(" "))).otherwise(acc))
    return parts.select("doc_id", "block_index", F.substring(T.trim(joined), 1, max_chars).alias("context_text"))


def unmatched_captions(caption_rows: DataFrame, figures: DataFrame) -> DataFrame:
    """Figure captions whose text no figure has."""
    return caption_rows.filter("caption_type = 'Figure'").join(figures.select("doc_id", F.col("caption_text").alias("full_text")), ["doc_id", "full_text"], "left_anti")
