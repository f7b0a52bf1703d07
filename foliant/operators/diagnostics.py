"""Coverage and warnings.  Messages never hold document text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sections import full_text
from .structure import OUT_OF_TEXT


def coverage(spans: DataFrame, typed: DataFrame, sections: DataFrame, section_blocks: DataFrame, figures: DataFrame, tables: DataFrame) -> DataFrame:
    """extracted_chars, emitted_chars, dropped_blocks and their ratio, a row per document."""
    total = lambda df, c, name: df.groupBy("doc_id").agg(F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long").alias(name))
    out = sections.select("doc_id").distinct().join(total(spans, "text", "extracted_chars"), "doc_id", "left")
    parts = [(full_text(section_blocks), "text"), (sections, "header"), (figures, "caption_text"), (tables, "caption")]
    for i, (df, c) in enumerate(parts):
        out = out.join(total(df, c, f"_{i}"), "doc_id", "left")
    dropped = typed.filter(F.col("block_type").isin(*OUT_OF_TEXT)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("dropped_blocks"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = out.join(dropped, "doc_id", "left").select(
        "doc_id", zero("extracted_chars").alias("extracted_chars"), sum((zero(f"_{i}") for i in range(1, len(parts))), zero("_0")).alias("emitted_chars"), zero("dropped_blocks").alias("dropped_blocks")
    )
    ratio = F.when(F.col("extracted_chars") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("emitted_chars") / F.col("extracted_chars")))
    return out.withColumn("ratio", ratio)


def warnings(*, cover: DataFrame, min_coverage: float, typed: DataFrame, anomalies: DataFrame, unmatched: DataFrame, dims: DataFrame, scales: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, page, detail)."""
    row = lambda df, kind, page, detail: df.select("doc_id", F.lit(kind).alias("kind"), page.cast("int").alias("page"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    out = row(cover.filter(F.col("ratio") < min_coverage), "LowCoverage", none, F.round("ratio", 6))
    again = typed.filter("reclassified").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(row(again, "RepeatedRunningReclassified", none, F.col("n")))
    out = out.unionByName(row(anomalies, "SectionNumberingAnomaly", F.col("page"), F.col("kind")))
    out = out.unionByName(row(unmatched, "UnmatchedCaption", F.col("page"), F.concat_ws(" ", "prefix", F.coalesce(F.col("number").cast("string"), F.lit("?")))))
    out = out.unionByName(row(dims.filter("fallback"), "PageDimensionsFallback", F.col("page"), F.concat_ws("x", "width", "height")))
    if scales is not None:
        out = out.unionByName(row(scales.filter("fallback"), "CoordinateFallback", F.col("page"), F.col("scale")))
    if skipped is not None:
        out = out.unionByName(row(skipped, "PageSkipped", F.col("page"), F.col("reason")))
    return out


def unmatched_images(images: DataFrame, figures: DataFrame) -> DataFrame:
    """Images that no figure took."""
    return images.join(figures.select("doc_id", F.col("image_path").alias("path")), ["doc_id", "path"], "left_anti")
