"""Spans to lines, columns and blocks, as windows over (doc_id, page) and doc_id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import union_of
from ..schema import SPANS

PAGE = ["doc_id", "page"]


def clean_spans(raw: DataFrame) -> DataFrame:
    """Trim texts; drop empty ones and boxes without extent; bold and italic also by font name."""
    t = T.trim(F.col("text"))
    s = raw.withColumn("text", t).filter((F.col("text") != "") & (F.col("right") > F.col("left")) & (F.col("top") > F.col("bottom")))
    s = s.withColumn("is_bold", F.coalesce("is_bold", F.lit(False)) | F.coalesce(T.is_bold_font(F.col("font_name")), F.lit(False)))
    return s.withColumn("is_italic", F.coalesce("is_italic", F.lit(False)) | F.coalesce(T.is_italic_font(F.col("font_name")), F.lit(False)))


def merge_spans(spans: DataFrame, gap_factor: float = 0.5) -> DataFrame:
    """Join spans of one font that continue each other on a line.  A fold: a span is compared with
    what has been merged so far, so each page is walked once in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_neg=-pdf["top"]).sort_values(["_neg", "left", "span_seq"], kind="stable").drop(columns="_neg")
        out: list[dict] = []
        for s in pdf.to_dict("records"):
            a = out[-1] if out else None
            gap = s["left"] - a["right"] if a else 0.0
            if a and a["font_name"] == s["font_name"] and abs(a["font_size"] - s["font_size"]) <= 0.1 and abs(a["bottom"] - s["bottom"]) <= a["font_size"] * 0.3 and gap < a["font_size"] * gap_factor:
                a["text"] += (" " if gap > a["font_size"] * 0.15 else "") + s["text"]
                a |= {"left": min(a["left"], s["left"]), "top": max(a["top"], s["top"]), "right": max(a["right"], s["right"]), "bottom": min(a["bottom"], s["bottom"])}
            else:
                out.append(s)
        return pd.DataFrame(out, columns=pdf.columns)

    return spans.groupBy(*PAGE).applyInPandas(fold, SPANS)


def lines(spans: DataFrame, keep_spans: bool = True) -> DataFrame:
    """Group spans by height, in order; a line's text has spaces where spans lie apart."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("top"), "left", "span_seq")
    far = F.abs(F.lag("top").over(order) - F.col("top")) > F.lag("font_size").over(order) * 0.5
    rows = spans.withColumn("_new", F.coalesce(far, F.lit(False)).cast("int"))
    rows = rows.withColumn("_line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("left", "span_seq", "top", "right", "bottom", "text", "font_name", "font_size", "is_bold", "is_italic")
    weight = F.octet_length("text")
    grouped = rows.groupBy(*PAGE, "_line").agg(
        F.array_sort(F.collect_list(span)).alias("spans"),
        *union_of(),
        F.max_by("font_size", F.struct(weight, "left", "span_seq")).alias("font_size"),
        F.max_by("font_name", F.struct(weight, "left", "span_seq")).alias("font_name"),
        (F.sum(F.when(F.col("is_bold"), weight).otherwise(0)) * 2 >= F.sum(weight)).alias("is_bold"),
    )
    joined = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("r"), F.lit(0.0).alias("s")),
        lambda acc, s: F.struct(
            F.concat(acc.t, F.when(acc.r.isNotNull() & (s.left - acc.r > acc.s * 0.5 * 0.3), " ").otherwise(""), s.text).alias("t"), s.right.alias("r"), s.font_size.alias("s")
        ),
    ).t
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "_line")) - 1
    out = grouped.select("doc_id", "page", seq.cast("long").alias("line_seq"), joined.alias("text"), "left", "top", "right", "bottom", F.col("bottom").alias("baseline_y"), "font_size", "font_name", "is_bold", "spans")
    return out if keep_spans else out.drop("spans")


def page_dims(spans: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Width and height of pages: media box, else what spans reach, else Letter; ``fallback``
    tells which.  Swapped for quarter turns where ``media`` has a rotation."""
    reach = spans.groupBy(*PAGE).agg(F.max("right").alias("_r"), F.max("top").alias("_t"))
    if media is None:
        joined = reach.withColumns({"_w": F.lit(None).cast("double"), "_h": F.lit(None).cast("double")})
    else:
        turned = F.col("rotation").isin(90, 270) if "rotation" in media.columns else F.lit(False)
        m = media.select(*PAGE, F.when(turned, F.col("height")).otherwise(F.col("width")).alias("_w"), F.when(turned, F.col("width")).otherwise(F.col("height")).alias("_h"))
        joined = reach.join(m, PAGE, "full")
    boxed = (F.col("_w") > 0) & (F.col("_h") > 0)
    reached = (F.col("_r") > 0) & (F.col("_t") > 0)
    return joined.select(
        *PAGE,
        F.when(boxed, F.col("_w")).when(reached, F.col("_r")).otherwise(612.0).alias("width"),
        F.when(boxed, F.col("_h")).when(reached, F.col("_t")).otherwise(792.0).alias("height"),
        (~F.coalesce(boxed, F.lit(False))).alias("fallback"),
    )


def columns(line_rows: DataFrame, dims: DataFrame, bin_width: float = 10.0, zones: int = 4, peak: float = 0.2, gap: float = 0.15) -> DataFrame:
    """Regions of pages: horizontal zones with one or two columns, equal neighbours merged."""
    y_top = lambda i: F.col("height") - F.lit(float(i)) * (F.col("height") / float(zones))
    mid = (F.col("top") + F.col("bottom")) / 2.0
    zone = F.lit(None).cast("int")
    for i in reversed(range(zones)):
        zone = F.when((mid <= y_top(i)) & (mid >= y_top(i) - F.col("height") / float(zones)), F.lit(i)).otherwise(zone)
    z = line_rows.select(*PAGE, "left", "top", "bottom").join(dims.select(*PAGE, "width", "height"), PAGE).select(*PAGE, "width", zone.alias("zone"), F.floor(F.col("left") / bin_width).alias("bin")).filter("zone is not null")
    h = z.groupBy(*PAGE, "width", "zone", "bin").agg(F.count(F.lit(1)).alias("n"))
    by_zone = Window.partitionBy(*PAGE, "zone")
    h = h.withColumn("total", F.sum("n").over(by_zone)).filter(F.col("n") >= F.ceil(F.col("total") * peak))
    h = h.withColumn("at", F.col("bin") * bin_width + bin_width / 2.0)
    step = by_zone.orderBy("at")
    h = h.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(step) > F.col("width") * gap).cast("int"), F.lit(0)))
    h = h.withColumn("cluster", F.sum("new").over(step.rowsBetween(Window.unboundedPreceding, 0)))
    c = h.groupBy(*PAGE, "zone", "cluster").agg((F.sum("at") / F.count(F.lit(1))).alias("mean"))
    s = c.groupBy(*PAGE, "zone").agg(F.count(F.lit(1)).alias("k"), F.min("mean").alias("a"), F.max("mean").alias("b"))
    s = s.select(*PAGE, "zone", F.when(F.col("k") == 2, (F.col("a") + F.col("b")) / 2.0).alias("split"))
    grid = dims.select(*PAGE, "width", "height", F.explode(F.array(*[F.lit(i) for i in range(zones)])).alias("zone"))
    grid = grid.join(s, [*PAGE, "zone"], "left").withColumn("two", F.col("split").isNotNull())
    down = Window.partitionBy(*PAGE).orderBy("zone")
    grid = grid.withColumn("new", F.coalesce((F.lag("two").over(down) != F.col("two")).cast("int"), F.lit(0)))
    grid = grid.withColumn("region", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    top = lambda zn: F.col("height") - zn.cast("double") * (F.col("height") / float(zones))
    return grid.groupBy(*PAGE, "region").agg(
        F.max(top(F.col("zone"))).alias("y_top"),
        F.min(top(F.col("zone")) - F.col("height") / float(zones)).alias("y_bottom"),
        F.min_by("split", "zone").alias("split"),
        F.first("width").alias("width"),
    )


def assign(line_rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Each line with its nearest region and column; the first of equals.  A page has few regions,
    so they come as one array beside its lines; no line is lost."""
    packed = regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("region", "y_top", "y_bottom", "split", "width"))).alias("_regions"))
    joined = line_rows.join(packed, PAGE, "left")
    cy, cx = (F.col("top") + F.col("bottom")) / 2.0, (F.col("left") + F.col("right")) / 2.0
    away = lambda r: F.when(cy > r.y_top, cy - r.y_top).when(cy < r.y_bottom, r.y_bottom - cy).otherwise(0.0)
    best = F.array_min(F.transform("_regions", lambda r: F.struct(away(r).alias("d"), r.region.alias("region"), r.split.alias("split"), r.width.alias("width"))))
    joined = joined.withColumn("_r", best)
    first = F.when(cx < 0.0, -cx).when(cx >= F.col("_r.split"), cx - F.col("_r.split")).otherwise(0.0)
    second = F.when(cx < F.col("_r.split"), F.col("_r.split") - cx).when(cx >= F.col("_r.width"), cx - F.col("_r.width")).otherwise(0.0)
    column = F.when(F.col("_r.split").isNotNull() & (second < first), 1).otherwise(0)
    return joined.select(*line_rows.columns, F.coalesce("_r.region", F.lit(0)).alias("region"), column.alias("column_index"), F.col("_r.width").alias("page_width"))


def blocks(assigned: DataFrame, gap_multiplier: float = 1.8, size_step: float = 1.0) -> DataFrame:
    """Runs of lines of a column that are close and alike; ids count over page, region, column."""
    slot = Window.partitionBy(*PAGE, "region", "column_index").orderBy(F.desc("top"), "line_seq")
    lag = lambda c: F.lag(c).over(slot)
    cut = (lag("bottom") - F.col("top") > lag("font_size") * 1.2 * gap_multiplier) | (F.abs(lag("font_size") - F.col("font_size")) > size_step) | (lag("is_bold") != F.col("is_bold"))
    rows = assigned.withColumn("_new", F.coalesce(cut, F.lit(False)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(slot.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_at", F.row_number().over(slot))
    line = F.struct(*[F.col(c) for c in ("_at", "line_seq", "text", "left", "top", "right", "bottom", "font_size", "is_bold", *(["spans"] if "spans" in assigned.columns else []))])
    g = rows.groupBy(*PAGE, "region", "column_index", "_run").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.first("page_width").alias("page_width"), *union_of())
    ids = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "region", "column_index", "_run")) - 1
    return g.select(
        "doc_id",
        ids.cast("long").alias("global_index"),
        "page",
        "region",
        "column_index",
        F.array_join(F.transform("lines", lambda x: x.text), " ").alias("text"),
        "left",
        "top",
        "right",
        "bottom",
        F.size("lines").alias("n_lines"),
        F.col("lines")[0].font_size.alias("font_size"),
        F.col("lines")[0].is_bold.alias("is_bold"),
        "page_width",
        "lines",
    )


def reading_order(block_rows: DataFrame, mode: str = "top") -> DataFrame:
    """``reading_seq``: page, height, full width first, column, left, id.  ``mode="column"`` reads
    region by region and column by column instead.  A page without a width counts as Letter."""
    full = (F.col("right") - F.col("left")) >= F.coalesce("page_width", F.lit(612.0)) * 0.6
    keys = [F.desc("top"), F.when(full, 0).otherwise(1), F.when(full, 0).otherwise(F.col("column_index")), F.col("left"), F.col("global_index")]
    if mode == "column":
        keys = [F.col("region"), F.col("column_index"), *keys]
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", *keys)) - 1
    return block_rows.withColumn("reading_seq", seq.cast("long"))
