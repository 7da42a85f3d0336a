"""Streaming: packages that arrive in a folder, parsed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import model
from ..sources import docx
from ..sources.store import stored

FILES = "path string, modificationTime timestamp, length long, content binary"


def package_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """doc_id and content of new .docx files, at most ``per_trigger`` a batch."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.sha2("path", 256).alias("doc_id"), "path", "content")


def paragraph_sink(stream: DataFrame, out: str, checkpoint: str):
    """Start a query that writes the paragraphs of every arriving package to a Parquet table, partitioned by epoch.

    A batch that is tried again replaces its own epoch, so nothing is written twice.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        nodes = stored(docx.scan(rows, "document"))
        model.paragraphs(nodes, model.runs(nodes)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
