"""Token-budgeted chunks.  Packing depends on what was packed before, so a document's sections are
one fold; documents are independent.  Rendering happens before, as expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import py_tokens
from ..schema import CHUNKS
from .sections import KEY, bodies, figure_text

Count = Callable[[str], int]
DOCS = 200  # documents whose sections are Python objects at a time
_SENTENCE = re.compile(r"(?<=[。！？])|(?<=[.!?])(?=\s)")


def bpe_counter(path: str) -> Callable[[], Count]:
    """A maker of exact counters by a tokenizer file; loaded once in each worker."""

    def make() -> Count:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True

        def count(text: str) -> int:
            try:
                return len(tok.encode(text, add_special_tokens=False).ids)
            except Exception:
                return 0

        return count

    return make


def bpe_tokens(path: str):
    """Column function: exact tokens of a text column."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        count = bpe_counter(path)()
        return texts.map(lambda t: 0 if t is None else count(t)).astype("int64")

    return run


def context_prefix(ancestors: list[str], own: str) -> str:
    way = [a for a in ancestors if a] + ([own] if own else [])
    if not way:
        return ""
    return f"[Context: {' > '.join(way)}]\n" + (f"# {own}\n\n" if own else "\n")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s]


def budget_end(text: str, start: int, most: int, count: Count) -> int:
    """End of the window from ``start``: a guess of four letters a token, moved down until it
    fits, then up while it does; one letter at least."""
    n = len(text)
    if count is py_tokens:  # counts grow with the window, so the longest that fits is found by halving
        low, high = start + 1, min(n, start + 4 * most + 4)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(text[start:mid]) <= most else (low, mid - 1)
        return low
    end = max(min(start + 4 * most, n), start + 1)
    while end > start + 1 and count(text[start:end]) > most:
        end -= 1
    while end < n and count(text[start : end + 1]) <= most:
        end += 1
    return end


def overlap(text: str, most: int, count: Count) -> str:
    """The longest end of ``text`` within ``most`` tokens, up to the first letter too many."""
    if most == 0 or not text:
        return ""
    if count is py_tokens:
        low, high = 0, len(text)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if count(text[mid:]) <= most else (mid + 1, high)
        return text[low:]
    start = len(text)
    while start > 0 and count(text[start - 1 :]) <= most:
        start -= 1
    return text[start:]


def split_paragraph(text: str, most: int, count: Count) -> list[str]:
    most, out, now = max(most, 1), [], ""
    for s in sentences(text):
        if count(s) > most:
            if now:
                out.append(now)
                now = ""
            at = 0
            while at < len(s):
                end = budget_end(s, at, most, count)
                out.append(s[at:end])
                at = end
        elif now and count(now + s) > most:
            out.append(now)
            now = s
        else:
            now += s
    return out + [now] if now else out


def split_section(text: str, prefix: str, cfg: ChunkConfig, count: Count) -> list[tuple[str, int, bool]]:
    """(text, tokens, continues) of the pieces of a section."""
    parts: list[str] = []
    for p in text.split("\n\n"):
        if p.strip():
            parts += split_paragraph(p, cfg.max_tokens, count) if count(p) > cfg.max_tokens else [p]
    out, now, held = [], "", 0
    for p in parts:
        n = count(p)
        if now and held + n > cfg.max_tokens:
            out.append(prefix + now.strip())
            now = overlap(now, cfg.overlap_tokens, count)
            held = count(now)
        now += ("\n\n" if now else "") + p
        held += n
    if now:
        out.append(prefix + now.strip())
    return [(t, count(t), i < len(out) - 1) for i, t in enumerate(out)]


def chunk_units(units: list[dict], cfg: ChunkConfig, count: Count) -> list[dict]:
    """Units: section_id, header, prefix, text, page_start, page_end, in order."""
    out: list[dict] = []

    def add(text, tokens, more, group, assets):
        out.append(
            {
                "chunk_id": len(out),
                "section": group[0]["header"],
                "page_start": min(u["page_start"] for u in group),
                "page_end": max(u["page_end"] for u in group),
                "text": text,
                "estimated_tokens": tokens,
                "has_continuation": more,
                "section_ids": [u["section_id"] for u in assets],
            }
        )

    def split(u):
        for k, (text, tokens, more) in enumerate(split_section(u["text"], u["prefix"], cfg, count)):
            add(text, tokens, more, [u], [u] if k == 0 else [])

    i = 0
    most = max(cfg.max_tokens, 1) if cfg.strategy == "token" else cfg.max_tokens
    while i < len(units):
        u = units[i]
        whole = u["prefix"] + u["text"]
        own = count(whole)
        if cfg.strategy == "paragraph" or own > most:
            split(u)
            i += 1
            continue
        end = i + 1
        if cfg.strategy == "token":
            held = own
            while end < len(units) and held + (n := count(units[end]["text"])) <= most:
                held += n
                end += 1
        group = units[i:end]
        text = "\n\n".join([whole] + [g["text"] for g in group[1:]])
        add(text, count(text), False, group, group)
        i = end
    return out


def chunks(sections: DataFrame, section_blocks: DataFrame, figures: DataFrame, tables: DataFrame, cfg: ChunkConfig = ChunkConfig(), selection: DataFrame | None = None, counter: Callable[[], Count] | None = None) -> DataFrame:
    """Chunks of all sections, or of a selection: then each picked section alone, without context,
    by section."""
    if cfg.max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    body = bodies(section_blocks, figures, tables, markdown=False, math=cfg.math, figure=figure_text("placeholder"))
    rows = sections.join(body, KEY, "left").select("doc_id", "section_id", F.coalesce("header", F.lit("")).alias("header"), "breadcrumb", "page_start", "page_end", F.coalesce("body", F.lit("")).alias("text"))
    if selection is None:
        rows = rows.withColumn("pick", F.col("section_id"))
    else:
        rows = rows.join(selection, KEY)
    if selection is not None:
        from dataclasses import replace

        cfg = replace(cfg, strategy="section", section_context=False)

    unit = F.struct("pick", "section_id", "header", "breadcrumb", "page_start", "page_end", "text")
    units = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(unit)).alias("units"))

    def fold(batches):
        count = counter() if counter else py_tokens
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                ids, cols = [], [[] for _ in names]
                for i, group in enumerate(part.column(1).to_pylist()):
                    for u in group:
                        u["prefix"] = context_prefix(u["breadcrumb"], u["header"]) if cfg.section_context else ""
                    for c in chunk_units(group, cfg, count):
                        ids.append(i)
                        for values, name in zip(cols, names, strict=True):
                            values.append(c[name])
                arrays = [part.column(0).take(pa.array(ids, pa.int64())), *[pa.array(v, t) for v, t in zip(cols, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names])

    names = [c.split()[0] for c in CHUNKS.split(", ")][1:]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    return units.mapInArrow(fold, CHUNKS)


def chunk_lines(chunk_rows: DataFrame, figures: DataFrame, tables: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_id, value): one slim JSON object per chunk; images by file name only."""
    at = chunk_rows.select("doc_id", "chunk_id", F.explode("section_ids").alias("section_id"))
    fig = F.struct("figure_id", F.col("caption_text").alias("caption"), F.element_at(F.split("image_path", "/"), -1).alias("image_path"), "page")
    tab = F.struct("table_id", "caption", "text", "page")
    key = ["doc_id", "chunk_id"]
    gather = lambda t, seq, s, name: at.join(t, KEY).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("section_id", seq, s.alias("v")))), lambda x: x.v).alias(name))
    rows = chunk_rows.join(gather(figures, "figure_seq", fig, "figures"), key, "left").join(gather(tables, "table_seq", tab, "tables"), key, "left")
    rows = rows.join(names.select("doc_id", "paper_id"), "doc_id", "left") if names is not None else rows.withColumn("paper_id", F.col("doc_id").cast("string"))
    line = F.to_json(
        F.struct(
            "chunk_id", F.coalesce("paper_id", F.lit("")).alias("paper_id"), "section", F.array("page_start", "page_end").alias("page_range"), "estimated_tokens", "has_continuation", "text",
            F.coalesce("figures", F.array()).alias("figures"), F.coalesce("tables", F.array()).alias("tables"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.select("doc_id", "chunk_id", line.alias("value"))
