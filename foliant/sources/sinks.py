"""Writers: text and Markdown files' worth of rows, JSON lines, Parquet.  All go through Spark's
committed writers, so a lost executor leaves no half file."""

from pyspark.sql import DataFrame


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    """One row after another, each ended by a line feed."""
    df.select(df[column].alias("value")).write.mode("overwrite").text(path)


def write_jsonl(lines: DataFrame, path: str) -> None:
    """Rows of chunk lines (``value``), in order of document and chunk."""
    lines.sortWithinPartitions("doc_id", "chunk_id").select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
