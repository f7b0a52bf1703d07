"""Analysis of many documents: spans in, a set of tables out.

Every stage is a DataFrame; page-local ones partition by (doc_id, page), the rest by doc_id, so a
corpus is analysed in parallel and the exchange on doc_id serves window after window."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkConfig, Config, LlmTextConfig, MarkdownConfig, MathConfig
from ..operators import chunks as C
from ..operators import diagnostics, documents, figures, layout, sections, structure, tables
from ..schema import IMAGES, PATHS
from ..sources import pdf


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


@dataclass
class DocumentSet:
    """Lazy tables of a corpus.  ``spans`` is the contract; the rest is optional."""

    spans: DataFrame
    paths: DataFrame | None = None
    images: DataFrame | None = None
    media: DataFrame | None = None
    papers: DataFrame | None = None  # doc_id, paper_id, pages
    errors: DataFrame | None = None
    config: Config = field(default_factory=Config)
    merge: bool = False  # join spans that continue each other
    cut: bool = False  # see persist

    def persist(self) -> DocumentSet:
        """Compute blocks, figures and tables once, when first asked for: most outputs read them
        several times.  With a checkpoint folder they are written there, which also keeps later plans
        short and outlives executors; without one they are cached."""
        self.cut = True
        return self

    def _once(self, df: DataFrame) -> DataFrame:
        if not self.cut:
            return df
        if df.sparkSession.sparkContext.getCheckpointDir():
            return df.checkpoint()
        return df.persist(StorageLevel.MEMORY_AND_DISK)

    # ---- layout

    @cached_property
    def clean(self) -> DataFrame:
        s = layout.clean_spans(self.spans)
        return layout.merge_spans(s) if self.merge else s

    @cached_property
    def dims(self) -> DataFrame:
        return layout.page_dims(self.clean, self.media)

    def page_dimensions(self, page: int) -> DataFrame:
        """(doc_id, page, width, height, reason) of one page, counted from 0, of every document.  A
        document with fewer pages has no size there and the reason PageOutOfRange."""
        if page < 0:
            raise ValueError(f"no page {page}")
        known = self.papers if self.papers is not None else self.spans.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
        sizes = self.dims.filter(F.col("page") == page).select("doc_id", "width", "height")
        reason = F.when(F.col("pages") <= page, "PageOutOfRange")
        return known.select("doc_id", "pages").join(sizes, "doc_id", "left").select("doc_id", F.lit(page).alias("page"), "width", "height", reason.alias("reason"))

    @cached_property
    def lines(self) -> DataFrame:
        return layout.lines(self.clean)

    @cached_property
    def regions(self) -> DataFrame:
        return layout.columns(self.lines, self.dims, self.config.column_bin)

    @cached_property
    def raw_blocks(self) -> DataFrame:
        return layout.blocks(layout.assign(self.lines, self.regions), self.config.block_gap)

    # ---- structure

    @cached_property
    def _numbered(self) -> DataFrame:
        """Blocks with their places in reading order and in sections: kept, so that no output sorts them again."""
        c = self.config
        typed = structure.classify(self.raw_blocks, c.caption_max_chars, c.running_header_max_chars)
        typed = structure.repeated_running(typed) if c.headers.detect_repeated_running else typed.withColumn("reclassified", F.lit(False))
        return self._once(structure.number_sections(layout.reading_order(structure.mark_headers(typed, c.headers), c.reading_order)))

    @cached_property
    def blocks(self) -> DataFrame:
        """Blocks with their types, and ``header`` where they are one."""
        return self._numbered.drop("reading_seq", "section_id")

    @cached_property
    def headers(self) -> DataFrame:
        return structure.headers(self.blocks)

    @cached_property
    def metadata(self) -> DataFrame:
        return structure.metadata(self.blocks, self.papers)

    @cached_property
    def captions(self) -> DataFrame:
        return figures.captions(self.blocks)

    @cached_property
    def scales(self) -> DataFrame:
        return figures.image_scale(self._images, self.dims)

    @cached_property
    def _images(self) -> DataFrame:
        return self.images if self.images is not None and self.config.extract_images else _empty(self.spans, IMAGES)

    @cached_property
    def raw_figures(self) -> DataFrame:
        images = figures.normalize_images(self._images, self.scales)
        return self._once(figures.match_figures(self.captions, images, self.blocks, self.config.caption_max_gap))

    @cached_property
    def raw_tables(self) -> DataFrame:
        paths = self.paths if self.paths is not None else _empty(self.spans, PATHS)
        caps = self.captions if self.config.detect_tables else self.captions.limit(0)
        blocks = self.blocks if self.config.detect_tables else self.blocks.limit(0)
        found = tables.detect(blocks, paths if self.config.detect_tables else paths.limit(0), caps, self.config.tables)
        found = self._once(found)
        return self._once(tables.table_infos(found, tables.grids(found, self.blocks)))

    @cached_property
    def _split(self) -> tuple[DataFrame, DataFrame]:
        return structure.split_sections(self._numbered, self.papers)

    @property
    def sections(self) -> DataFrame:
        return self._split[0]

    @property
    def section_blocks(self) -> DataFrame:
        return self._split[1]

    @cached_property
    def figures(self) -> DataFrame:
        return sections.assign_assets(self.raw_figures, self.section_blocks, self.config.keep_orphan_assets)

    @cached_property
    def tables(self) -> DataFrame:
        return sections.assign_assets(self.raw_tables, self.section_blocks, self.config.keep_orphan_assets)

    @cached_property
    def _papers(self) -> DataFrame:
        p = self.papers if self.papers is not None else self.spans.select("doc_id").distinct().withColumn("paper_id", F.col("doc_id").cast("string"))
        return p if "source_file" in p.columns else p.withColumn("source_file", F.col("paper_id"))

    # ---- diagnostics

    @cached_property
    def coverage(self) -> DataFrame:
        return diagnostics.coverage(self.clean, self.blocks, self.sections, self.section_blocks, self.figures, self.tables)

    @cached_property
    def warnings(self) -> DataFrame:
        return diagnostics.warnings(
            cover=self.coverage,
            min_coverage=self.config.min_coverage,
            typed=self.blocks,
            anomalies=structure.numbering_anomalies(self.headers),
            unmatched=figures.unmatched_captions(self.captions, self.raw_figures),
            dims=self.dims,
            scales=self.scales,
            skipped=None if self.errors is None else self.errors.filter("page is not null"),
        )

    # ---- selection and output

    def toc(self) -> DataFrame:
        return sections.toc(self.sections, self.section_blocks, self.figures, self.tables)

    def select_sections(self, names: list[str]) -> Selection:
        return Selection(self, sections.by_names(self.sections, names))

    def select_sections_by_index(self, indices: list[int]) -> Selection:
        return Selection(self, sections.by_indices(self.sections, indices))

    def select_sections_by_level(self, level: int) -> Selection:
        return Selection(self, sections.by_level(self.sections, level))

    def select_sections_by_pages(self, start: int, end: int) -> Selection:
        return Selection(self, sections.by_pages(self.sections, start, end))

    def select_sections_where(self, predicate) -> Selection:
        return Selection(self, sections.by_predicate(self.toc(), predicate))

    def to_markdown(self, cfg: MarkdownConfig = MarkdownConfig()) -> DataFrame:
        return sections.to_markdown(self.sections, self.section_blocks, self.figures, self.tables, cfg, metadata=self.metadata)

    def to_llm_text(self, cfg: LlmTextConfig = LlmTextConfig()) -> DataFrame:
        return sections.to_llm_text(self.sections, self.section_blocks, self.figures, self.tables, cfg)

    def to_json(self) -> DataFrame:
        return documents.full_json(self.sections, self.section_blocks, self.headers, self.figures, self.tables, self.metadata, self._papers)

    def to_content_json(self, math: MathConfig | None = None) -> DataFrame:
        return documents.content_json(self.sections, self.section_blocks, self.figures, self.tables, self.metadata, self._papers, math)

    def to_chunks(self, cfg: ChunkConfig = ChunkConfig(), counter=None) -> DataFrame:
        return C.chunks(self.sections, self.section_blocks, self.figures, self.tables, cfg, counter=counter)

    def chunk_lines(self, chunk_rows: DataFrame) -> DataFrame:
        """``chunk_rows`` are read three times, so they are kept like blocks."""
        return C.chunk_lines(self._once(chunk_rows), self.figures, self.tables, self._papers)


@dataclass
class Selection:
    """Picked sections of every document."""

    docs: DocumentSet
    picks: DataFrame

    def indices(self) -> DataFrame:
        return self.picks.select("doc_id", "pick", F.col("section_id").alias("index"))

    def count(self) -> DataFrame:
        return self.picks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))

    def total_tokens(self) -> DataFrame:
        return sections.total_tokens(self.picks, self.docs.section_blocks)

    def to_markdown(self, cfg: MarkdownConfig = MarkdownConfig()) -> DataFrame:
        d = self.docs
        return sections.to_markdown(d.sections, d.section_blocks, d.figures, d.tables, cfg, self.picks)

    def to_llm_text(self, cfg: LlmTextConfig = LlmTextConfig()) -> DataFrame:
        d = self.docs
        return sections.to_llm_text(d.sections, d.section_blocks, d.figures, d.tables, cfg, self.picks)

    def to_json(self) -> DataFrame:
        d = self.docs
        return documents.full_json(d.sections, d.section_blocks, d.headers, d.figures, d.tables, d.metadata, d._papers, self.picks)

    def to_chunks(self, cfg: ChunkConfig = ChunkConfig(), counter=None) -> DataFrame:
        d = self.docs
        return C.chunks(d.sections, d.section_blocks, d.figures, d.tables, cfg, self.picks, counter)


def analyze(spark: SparkSession, path: str, config: Config = Config()) -> DocumentSet:
    """Page files under ``path`` (a file, a folder or a glob), analysed together."""
    return analyze_files(pdf.scan(spark, path), config)


def analyze_files(files: DataFrame, config: Config = Config()) -> DocumentSet:
    """``files``: path, length, content (bytes)."""
    t = pdf.tables(pdf.rows_of(files, config.limits), config.image_dir)
    return DocumentSet(t["spans"], t["paths"], t["images"], t["media"], t["papers"], t["errors"], config, merge=True).persist()
