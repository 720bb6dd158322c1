"""Structured Streaming wrapper: the stateless text functions on a file stream.

The reference is batch only; every cleaner and the answer parser are plain
Column expressions, so the same chain runs unchanged on ``readStream``. The
sink is Parquet with a checkpoint folder, so a restarted or re-run query picks
up exactly where it stopped (file source + file sink = exactly once).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def text_stream(spark: SparkSession, source_dir: str, schema: StructType, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files under ``source_dir``; with ``glob`` its files of that name, and all files of its folders of that name."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if not glob:
        return r.parquet(source_dir)
    # in the path, not a filter of file names, which no part file of a folder passes; a plain name in braces stays a
    # pattern, as Spark takes the base path from a plain one and refuses a file there
    return r.parquet(os.path.join(source_dir, glob if set(glob) & set("*?[{") else "{%s}" % glob))


def start_text_job(stream: DataFrame, columns: dict[str, Column], keep: list[str], sink_dir: str,
                   checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Project ``keep`` plus the derived ``columns`` and append them to Parquet."""
    out = stream.select(*keep, *[c.alias(n) for n, c in columns.items()])
    w = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_completion(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for the end; a job that fails, or is still running after ``timeout_s``, raises, as its sink is not whole."""
    ended = query.awaitTermination(timeout_s)
    if query.exception():
        raise query.exception()
    if ended is False:
        query.stop()
        raise TimeoutError(f"the stream was still running after {timeout_s} seconds")

