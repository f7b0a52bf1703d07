"""Table regions, grids and their texts.

Regions depend on the order in which clusters and captions are met, so a page's detection is a
fold over its blocks, paths and captions (a page is small); grids and texts are expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TableConfig
from ..functions import text as T
from ..schema import TABLE_REGIONS

PAGE = ["doc_id", "page"]
HEADERS = ("SectionHeader", "SubsectionHeader")
RULE_TOLERANCE, RULE_GAP, CAPTION_REACH, BELOW, NEAR = 3.0, 60.0, 100.0, 200.0, 5.0


def _cy(r) -> float:
    return (r["top"] + r["bottom"]) / 2.0


def _cx(r) -> float:
    return (r["left"] + r["right"]) / 2.0


def _around(rows) -> tuple:
    rows = list(rows)
    return min(r["left"] for r in rows), max(r["top"] for r in rows), max(r["right"] for r in rows), min(r["bottom"] for r in rows)


def _meet(a, b) -> bool:
    return a[0] < b[2] and a[2] > b[0] and a[3] < b[1] and a[1] > b[3]


def mean_clusters(items: list, value, tolerance: float) -> list[list]:
    """Each item joins the first cluster whose running mean is near; order matters."""
    groups: list[list] = []
    means: list[float] = []
    for x in items:
        v = value(x)
        k = next((k for k, m in enumerate(means) if abs(v - m) <= tolerance), None)
        if k is None:
            groups.append([x])
            means.append(v)
        else:
            groups[k].append(x)
            means[k] = sum(map(value, groups[k])) / len(groups[k])
    return groups


def bands(groups: list[list], at, gap: float) -> list[list[list]]:
    """Split groups, in downward order, where the step is larger than ``gap``."""
    out: list[list[list]] = []
    for g in groups:
        if out and at(out[-1][-1]) - at(g) <= gap:
            out[-1].append(g)
        else:
            out.append([g])
    return out


def x_clusters(xs: list[float], tolerance: float) -> int:
    xs = sorted(xs)
    return bool(xs) + sum(b - a > tolerance for a, b in zip(xs, xs[1:], strict=False))


def by_rules(blocks: list, paths: list) -> list[dict]:
    out = []
    level = lambda g: sum(map(_cy, g)) / len(g)
    flat = sorted(mean_clusters([p for p in paths if p["path_type"] == "Horizontal"], _cy, RULE_TOLERANCE), key=lambda g: -level(g))
    for band in bands(flat, level, RULE_GAP):
        if len(band) < 3:
            continue
        rules = [p for g in band for p in g]
        box = _around(rules)
        upright = [
            p
            for p in paths
            if p["path_type"] == "Vertical" and box[0] - RULE_TOLERANCE <= _cx(p) <= box[2] + RULE_TOLERANCE and p["top"] >= box[3] and p["bottom"] <= box[1]
        ]
        if len(mean_clusters(upright, _cx, RULE_TOLERANCE)) < 2:
            continue
        box = _around(rules + upright)
        inside = [b["global_index"] for b in blocks if _meet((b["left"], b["top"], b["right"], b["bottom"]), box)]
        out.append({"box": box, "ids": inside, "rules": True, "caption": None})
    return sorted(out, key=lambda r: -r["box"][1])


def below_caption(blocks: list, caption) -> list:
    found = []
    for b in blocks:
        if b["top"] >= caption["bottom"] - NEAR or caption["bottom"] - b["top"] > BELOW:
            continue
        n = len(b["text"].encode())
        if b["block_type"] in HEADERS or n > 150:
            break
        if n < 80 or b["n_lines"] <= 2:
            found.append(b)
    return found


def by_alignment(blocks: list, captions: list, cfg: TableConfig) -> list[dict]:
    out = []
    for c in captions:
        found = below_caption(blocks, c)
        if found and x_clusters([b["left"] for b in found], cfg.tolerance) >= cfg.min_columns:
            out.append({"box": _around(found), "ids": [b["global_index"] for b in found], "rules": False, "caption": None})
    return out


def without_caption(blocks: list, taken: list[dict], cfg: TableConfig) -> list[dict]:
    cells = [b for b in blocks if b["block_type"] not in HEADERS and (len(b["text"].encode()) < 80 or b["n_lines"] <= 2)]
    rows: list[list] = []
    for b in sorted(cells, key=lambda b: -_cy(b)):
        if rows and abs(_cy(b) - _cy(rows[-1][0])) <= cfg.tolerance:
            rows[-1].append(b)
        else:
            rows.append([b])
    out: list[dict] = []
    for band in bands(rows, lambda r: _cy(r[0]), cfg.row_gap):
        flat = [b for r in band for b in r]
        if len(band) < cfg.borderless_min_rows or x_clusters([b["left"] for b in flat], cfg.tolerance) < cfg.min_columns:
            continue
        box = _around(flat)
        if not any(_meet(r["box"], box) for r in [*taken, *out]):
            out.append({"box": box, "ids": [b["global_index"] for b in flat], "rules": False, "caption": None})
    return out


def name_regions(regions: list[dict], captions: list) -> None:
    """Each caption, in order, goes to the nearest region that has none."""
    for c in captions:
        best = None
        for r in regions:
            if r["caption"] is not None:
                continue
            _, top, _, bottom = r["box"]
            gap = c["bottom"] - top if c["bottom"] >= top else bottom - c["top"] if c["top"] <= bottom else 0.0
            if gap < CAPTION_REACH and (best is None or gap < best[0]):
                best = gap, r
        if best:
            best[1]["caption"] = c


def detect(typed: DataFrame, paths: DataFrame, captions: DataFrame, cfg: TableConfig = TableConfig()) -> DataFrame:
    """Table regions of every page that has paths or table captions (or, asked for, cells)."""
    box = ["left", "top", "right", "bottom"]
    none = lambda t: F.lit(None).cast(t)
    b = typed.select(*PAGE, F.lit("b").alias("kind"), "global_index", "text", "block_type", "n_lines", *box, none("string").alias("path_type"), none("int").alias("number"))
    p = paths.select(*PAGE, F.lit("p").alias("kind"), F.monotonically_increasing_id().alias("global_index"), none("string").alias("text"), none("string").alias("block_type"), none("int").alias("n_lines"), *box, "path_type", none("int").alias("number"))
    c = captions.filter("caption_type = 'Table'").select(*PAGE, F.lit("c").alias("kind"), F.col("block_index").alias("global_index"), F.col("full_text").alias("text"), none("string").alias("block_type"), none("int").alias("n_lines"), *box, none("string").alias("path_type"), F.col("number").cast("int").alias("number"))
    rows = b.unionByName(p).unionByName(c)
    if not cfg.captionless:  # pages without a rule or a caption have no table
        rows = rows.join(p.select(*PAGE).union(c.select(*PAGE)).distinct(), PAGE, "left_semi")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("global_index", kind="stable")
        got = {k: g.to_dict("records") for k, g in pdf.groupby("kind")}
        blocks, lines, caps = got.get("b", []), got.get("p", []), got.get("c", [])
        regions = by_rules(blocks, lines) if cfg.use_rules else []
        if cfg.use_alignment:
            more = by_alignment(blocks, caps, cfg)
            if cfg.captionless:
                more += without_caption(blocks, regions + more, cfg)
            for r in more:
                if not any(_meet(x["box"], r["box"]) for x in regions):
                    regions.append(r)
        name_regions(regions, caps)
        d, page = pdf["doc_id"].iloc[0], pdf["page"].iloc[0]
        out = []
        for k, r in enumerate(regions):
            cap = r["caption"]
            number = None if cap is None or pd.isna(cap["number"]) else int(cap["number"])
            out.append((d, k, page, *r["box"], r["ids"], None if cap is None else cap["global_index"], number, None if cap is None else cap["text"], r["rules"]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in TABLE_REGIONS.split(", ")])

    found = rows.groupBy(*PAGE).applyInPandas(fold, TABLE_REGIONS)
    # rule regions of all pages come before aligned ones
    order = Window.partitionBy("doc_id").orderBy(F.desc("has_rules"), "page", "table_seq")
    return found.withColumn("table_seq", (F.row_number().over(order) - 1).cast("long"))


def representatives(values: Column, step: float = 5.0) -> Column:
    """Of sorted values, those at least ``step`` from the last one kept."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.abs(x - F.element_at(acc, -1)) >= step), F.concat(acc, F.array(x))).otherwise(acc))


def nearest(value: Column, places: Column) -> Column:
    """Index of the nearest place, the first of equals."""
    return F.array_min(F.transform(places, lambda p, i: F.struct(F.abs(value - p).alias("d"), i.alias("i")))).i


def cells(regions: DataFrame, typed: DataFrame) -> DataFrame:
    """(doc_id, table_seq, row, col, text): blocks by nearest column left edge and row centre."""
    b = typed.select("doc_id", "global_index", T.trim(F.col("text")).alias("text"), "left", ((F.col("left") + F.col("right")) / 2.0).alias("cx"), ((F.col("top") + F.col("bottom")) / 2.0).alias("cy"), "is_bold")
    m = regions.select("doc_id", "table_seq", F.posexplode("block_ids").alias("at", "global_index")).join(b, ["doc_id", "global_index"])
    key = ["doc_id", "table_seq"]
    g = m.groupBy(*key).agg(F.sort_array(F.collect_list("left")).alias("xs"), F.sort_array(F.collect_list("cy"), asc=False).alias("ys"))
    g = g.select(*key, representatives(F.col("xs")).alias("xs"), representatives(F.col("ys")).alias("ys"))
    m = m.join(g, key).withColumn("row", nearest(F.col("cy"), F.col("ys"))).withColumn("col", nearest(F.col("cx"), F.col("xs")))
    joined = F.aggregate("parts", F.lit(""), lambda acc, x: F.concat(acc, F.when(acc != "", " ").otherwise(""), x.text))
    out = m.groupBy(*key, "row", "col").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"), F.first(F.size("xs")).alias("n_cols"), F.first(F.size("ys")).alias("n_rows"), F.collect_set(F.when(F.col("is_bold"), F.col("text"))).alias("bold"))
    return out.select(*key, "row", "col", joined.alias("text"), "n_cols", "n_rows", "bold")


def grids(regions: DataFrame, typed: DataFrame) -> DataFrame:
    """(doc_id, table_seq, column_count, header, rows, header_rows): full grids; the first row is
    the header, and the second too when each of its texts is a bold block's."""
    c = cells(regions, typed)
    g = c.groupBy("doc_id", "table_seq").agg(
        F.first("n_cols").alias("column_count"),
        F.first("n_rows").alias("n_rows"),
        F.map_from_entries(F.collect_list(F.struct(F.col("row") * F.lit(100000) + F.col("col"), F.col("text")))).alias("m"),
        F.array_distinct(F.flatten(F.collect_list("bold"))).alias("bold"),
    )
    at = lambda r, k: F.coalesce(F.try_element_at(F.col("m"), r * F.lit(100000) + k), F.lit(""))
    full = F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), lambda r: F.transform(F.sequence(F.lit(0), F.col("column_count") - 1), lambda k: at(r, k)))
    g = g.select("doc_id", "table_seq", "column_count", full.alias("all"), "bold")
    some = F.filter(F.try_element_at("all", F.lit(2)), lambda s: s != "")
    two = F.coalesce((F.size(some) > 0) & F.forall(some, lambda s: F.array_contains(F.col("bold"), s)), F.lit(False))
    n = F.when(two, 2).otherwise(1)
    g = g.select("doc_id", "table_seq", "column_count", F.slice("all", F.lit(1), n).alias("header"), F.slice("all", n + 1, F.size("all")).alias("rows"))
    empty = regions.select("doc_id", "table_seq").join(g, ["doc_id", "table_seq"], "left")
    none = F.array().cast("array<array<string>>")
    return empty.select("doc_id", "table_seq", F.coalesce("column_count", F.lit(0)).alias("column_count"), F.coalesce("header", none).alias("header"), F.coalesce("rows", none).alias("rows")).withColumn("header_rows", header_spans(F.col("header")))


def span_cells(header: list[list[str]] | None) -> list[list[dict]]:
    """Row spans over empty cells below, then column spans over empty cells to the right; covered
    cells have spans of zero."""
    cells_ = [[{"text": s, "colspan": 1, "rowspan": 1} for s in row] for row in header or []]
    for k in range(len(cells_[0]) if cells_ else 0):
        r = 0
        while r < len(cells_):
            end = r + 1
            if cells_[r][k]["text"]:
                while end < len(cells_) and not cells_[end][k]["text"]:
                    cells_[end][k] |= {"colspan": 0, "rowspan": 0}
                    end += 1
                cells_[r][k]["rowspan"] = end - r
            r = end
    for row in cells_:
        k = 0
        while k < len(row):
            end = k + 1
            if row[k]["colspan"] and row[k]["rowspan"] == 1 and row[k]["text"]:
                while end < len(row) and row[end]["colspan"] and not row[end]["text"]:
                    row[end] |= {"colspan": 0, "rowspan": 0}
                    end += 1
                row[k]["colspan"] = end - k
            k = end
    return cells_


def header_spans(header: Column) -> Column:
    return F.udf(span_cells, "array<array<struct<text string, colspan int, rowspan int>>>", useArrow=True)(header)


def _header_names(header: Column, n: Column) -> Column:
    return F.when(F.size(header) > 0, F.element_at(header, -1)).when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("Col"), i.cast("string")))).otherwise(F.array().cast("array<string>"))


def to_markdown(header: Column, rows: Column, n: Column) -> Column:
    line = lambda cells_: F.concat(F.lit("| "), F.array_join(cells_, " | "), F.lit(" |\n"))
    pad = lambda row: F.transform(F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), F.lit(1), n), T.escape_pipe)
    upper = F.transform(F.slice(header, F.lit(1), F.greatest(F.size(header) - 1, F.lit(0))), lambda r: F.transform(F.filter(r, lambda c: c != ""), T.escape_pipe))
    upper = F.transform(F.filter(upper, lambda r: F.size(r) > 0), lambda r: F.concat(F.lit("**"), F.array_join(r, " | "), F.lit("**\n\n")))
    names = _header_names(header, n)
    return F.concat(
        F.array_join(upper, ""), line(F.transform(names, T.escape_pipe)), line(F.transform(names, lambda _: F.lit("---"))), F.array_join(F.transform(rows, lambda r: line(pad(r))), "")
    )


def to_csv(header: Column, rows: Column, n: Column) -> Column:
    line = lambda cells_: F.concat(F.array_join(F.transform(cells_, T.escape_csv), ","), F.lit("\n"))
    pad = lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), F.lit(1), n)
    top = F.when(F.size(header) > 0, F.array_join(F.transform(header, line), "")).otherwise(line(_header_names(header, n)))
    return F.concat(top, F.array_join(F.transform(rows, lambda r: line(pad(r))), ""))


def to_plain(header: Column, rows: Column) -> Column:
    return F.array_join(F.transform(F.concat(header, rows), lambda r: F.concat(F.array_join(r, "\t"), F.lit("\n"))), "")


def table_infos(regions: DataFrame, grid_rows: DataFrame) -> DataFrame:
    rows = regions.join(grid_rows, ["doc_id", "table_seq"])
    return rows.select(
        "doc_id",
        "table_seq",
        F.concat(F.lit("Table "), F.coalesce("caption_number", F.lit(0)).cast("string")).alias("table_id"),
        F.col("caption_number").alias("table_number"),
        F.col("caption_text").alias("caption"),
        F.lit("Markdown").alias("kind"),
        _header_names(F.col("header"), F.col("column_count")).alias("header"),
        F.col("header").alias("header_rows"),
        "rows",
        to_markdown(F.col("header"), F.col("rows"), F.col("column_count")).alias("text"),
        "page",
        F.try_element_at("block_ids", F.lit(-1)).alias("after_block_index"),
        F.col("bottom").alias("y_position"),
    )
