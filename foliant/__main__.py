"""Command line: toc, markdown, json, chunks, llm-text over page files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import ChunkConfig, Config, LlmTextConfig, MarkdownConfig, MathConfig
from .operators.chunks import bpe_counter
from .operators.sections import toc_line
from .plans.api import analyze

MATH = ["auto", "latex", "unicode", "plain", "off"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foliant", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        p = subs.add_parser(name)
        p.add_argument("path", help="a file, a folder or a glob that Spark can read")
        p.add_argument("--image-dir", default="images")
        p.add_argument("--no-extract-images", action="store_true")
        return p

    def common(p, section=True, out=True):
        if section:
            p.add_argument("--section", action="append", default=[])
        p.add_argument("--math-format", choices=MATH, default="auto")
        if out:
            p.add_argument("-o", "--output", help="a folder for Spark's writer; standard output if absent")

    command("toc").add_argument("--figures-only", action="store_true")
    p = command("markdown")
    common(p)
    p.add_argument("--heading-offset", type=int, default=1)
    p.add_argument("--no-page-numbers", action="store_true")
    p.add_argument("--image-base", default="./images")
    p = command("json")
    common(p, section=False)
    p.add_argument("--content-only", action="store_true")
    p = command("chunks")
    common(p)
    p.add_argument("--max-tokens", type=int, default=4000)
    p.add_argument("--overlap", type=int, default=200)
    p.add_argument("--strategy", choices=["section", "token", "paragraph"], default="section")
    p.add_argument("--tokenizer", help="a tokenizer file, for exact counts")
    p.add_argument("--no-section-context", action="store_true")
    p = command("llm-text")
    common(p)
    p.add_argument("--no-figures", action="store_true")
    p.add_argument("--no-tables", action="store_true")
    p.add_argument("--figure-format", choices=["placeholder", "link", "caption", "omit"], default="placeholder")
    p.add_argument("--image-base", default="")
    return top


def math_of(kind: str) -> MathConfig | None:
    return None if kind == "off" else MathConfig(representation=kind)


def result(args, docs):
    """(rows, value column) of a command."""
    if args.command == "toc":
        t = docs.toc()
        if args.figures_only:
            t = t.filter("figure_count > 0")
        return t.select("doc_id", "section_id", toc_line(cli=True).alias("value")).orderBy("doc_id", "section_id")
    picked = docs.select_sections(args.section) if getattr(args, "section", None) else docs
    if args.command == "markdown":
        cfg = MarkdownConfig(heading_offset=args.heading_offset, page_numbers=not args.no_page_numbers, image_base=args.image_base, math=math_of(args.math_format))
        return picked.to_markdown(cfg).select("doc_id", F.col("text").alias("value")).orderBy("doc_id")
    if args.command == "json":
        out = docs.to_content_json(math_of(args.math_format)) if args.content_only else docs.to_json()
        return out.select("doc_id", F.col("json").alias("value")).orderBy("doc_id")
    if args.command == "chunks":
        if args.max_tokens < 1:
            raise SystemExit("--max-tokens must be positive")
        cfg = ChunkConfig(args.max_tokens, args.overlap, args.strategy, not args.no_section_context, math_of(args.math_format))
        rows = picked.to_chunks(cfg, bpe_counter(args.tokenizer) if args.tokenizer else None)
        return docs.chunk_lines(rows).orderBy("doc_id", "chunk_id")
    math = "plain" if args.math_format in ("off", "plain") else args.math_format
    cfg = LlmTextConfig(not args.no_figures, not args.no_tables, True, math, args.figure_format, args.image_base)
    return picked.to_llm_text(cfg).select("doc_id", F.col("text").alias("value")).orderBy("doc_id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("foliant").getOrCreate()
    docs = analyze(spark, args.path, Config(image_dir=args.image_dir, extract_images=not args.no_extract_images))
    rows = result(args, docs)
    if getattr(args, "output", None):
        rows.select("value").write.mode("overwrite").text(args.output)
    else:
        for r in rows.select("value").toLocalIterator():
            print(r.value)
    for w in docs.errors.select("paper_id", "reason").toLocalIterator():
        print(f"{w.paper_id}: {w.reason}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
