"""Settings, as frozen dataclasses; thresholds enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, field

# Section names that headers are known by.
ENGLISH_SECTION_NAMES = (
    "ABSTRACT", "INTRODUCTION", "BACKGROUND", "RELATED WORK", "METHOD", "METHODS", "METHODOLOGY", "APPROACH",
    "EXPERIMENT", "EXPERIMENTS", "EXPERIMENTAL", "RESULTS", "RESULT", "RESULTS AND DISCUSSION", "DISCUSSION",
    "ANALYSIS", "CONCLUSION", "CONCLUSIONS", "SUMMARY", "REFERENCES", "BIBLIOGRAPHY", "ACKNOWLEDGMENT",
    "ACKNOWLEDGMENTS", "APPENDIX", "SUPPLEMENTARY", "SUPPORTING INFORMATION",
)
JAPANESE_SECTION_NAMES = (
    "概要", "序論", "はじめに", "関連研究", "手法", "提案手法", "実験", "評価", "結果", "考察", "議論", "結論", "まとめ", "参考文献", "謝辞", "付録",
)


@dataclass(frozen=True)
class HeaderConfig:
    min_score: int = 4
    max_chars: int = 120
    max_lines: int = 3
    respect_classification: bool = True
    detect_repeated_running: bool = True
    cjk_bonus: int = 1
    bin_width: float = 0.5
    merge_gap: float = 0.5
    max_level: int = 6
    known_names: tuple[str, ...] = ENGLISH_SECTION_NAMES + JAPANESE_SECTION_NAMES


@dataclass(frozen=True)
class TableConfig:
    min_columns: int = 2
    tolerance: float = 5.0
    use_rules: bool = True
    use_alignment: bool = True
    captionless: bool = False
    borderless_min_rows: int = 3
    row_gap: float = 60.0


@dataclass(frozen=True)
class MathConfig:
    representation: str = "auto"  # auto, latex, unicode, plain
    inline: tuple[str, str] = ("$", "$")
    display: tuple[str, str] = ("$$\n", "\n$$")
    script_threshold: float = 0.3
    extra_fonts: tuple[str, ...] = ()


@dataclass(frozen=True)
class MarkdownConfig:
    image_base: str = "./images"
    image_dir: str | None = None
    output_dir: str | None = None
    page_numbers: bool = False
    heading_offset: int = 1
    front_matter: bool = False
    caption_style: str = "italic"  # italic, bold, plain
    math: MathConfig | None = None


@dataclass(frozen=True)
class LlmTextConfig:
    figures: bool = True
    tables: bool = True
    headers: bool = True
    math: str = "auto"  # plain turns math off
    figure_format: str = "placeholder"  # placeholder, link, caption, omit
    image_base: str = ""


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 4000
    overlap_tokens: int = 200
    strategy: str = "section"  # section, token, paragraph
    section_context: bool = True
    math: MathConfig | None = None

    def __post_init__(self):
        if self.strategy not in ("section", "token", "paragraph"):
            raise ValueError(f"unknown split strategy {self.strategy!r}")


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 200 << 20
    max_pages: int = 2000


@dataclass(frozen=True)
class Config:
    image_dir: str = "images"
    extract_images: bool = True
    detect_tables: bool = True
    caption_max_gap: float = 50.0
    column_bin: float = 10.0
    block_gap: float = 1.8
    caption_max_chars: int = 240
    running_header_max_chars: int = 60
    min_coverage: float = 0.9
    reading_order: str = "top"  # or "column": whole columns one after another
    keep_orphan_assets: bool = False
    headers: HeaderConfig = field(default_factory=HeaderConfig)
    tables: TableConfig = field(default_factory=TableConfig)
    limits: Limits = field(default_factory=Limits)
