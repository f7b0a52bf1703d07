"""Page files as they arrive: a file stream, parsed file by file without state.

Layout and structure need all rows of a document at once; a document is one file, so each batch
holds whole documents and ``foreachBatch`` runs the batch plan on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..plans.api import DocumentSet, analyze_files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, folder: str, pattern: str = "*.pdf", files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).load(folder)


def start(files: DataFrame, checkpoint: str, sink: Callable[[DocumentSet, int], None], config: Config = Config(), available_now: bool = True):
    """Run ``sink(documents, batch)`` on every batch; the checkpoint makes batches resume."""
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: sink(analyze_files(df.select("path", "length", "content"), config), batch))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
