"""Incremental ingest with Structured Streaming.

New files (or new Parquet parts of a document table) are picked up as they arrive; each
micro-batch is extracted (files only), chunked and appended to the index. ``availableNow``
processes the backlog in batches of ``max_files_per_trigger`` files and stops; with a
processing-time trigger the same query runs continuously. The checkpoint (in the shared
checkpoint folder) makes a restart resume exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunk import chunk_words
from quarry.operators.extract import extract_text
from quarry.plans.ingest import ingest_files
from quarry.sources.files import FILE_SCHEMA, with_file_columns


def file_stream(spark: SparkSession, directory: str, max_files_per_trigger: int = 100
                ) -> DataFrame:
    """Streaming ``files``: binaryFile source with derived filename and file_type."""
    s = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
         .option("recursiveFileLookup", "true")
         .option("maxFilesPerTrigger", max_files_per_trigger).load(directory))
    return with_file_columns(s)


def table_stream(spark: SparkSession, path_glob: str, schema, max_files_per_trigger: int = 1
                 ) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path_glob))


def chunk_stream(stream: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """Extract (when the stream carries file contents) and cut into word windows."""
    if "content" in stream.columns:
        stream = extract_text(stream.drop("modificationTime")).filter(F.col("error").isNull())
    return chunk_words(stream.drop("error") if "error" in stream.columns else stream,
                       "text", size, overlap)


def stream_files(stream: DataFrame, out: str, errors: str, checkpoint: str, now=None,
                 available_now: bool = True, processing_time: str = "30 seconds"):
    """Ingest a stream of files (``file_stream``) as the upload flow does: validation, archive
    members, extraction and word windows, with two sinks. Index rows go to ``out``, and the files
    or members that were refused or couldn't be read go to ``errors`` (path, filename, error).

    Both are tables with one folder ``batch_id=<n>`` per micro-batch, which a batch that runs again
    writes anew, so a replay after a failure adds nothing."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows, failed = ingest_files(batch, now=now)
        for table, path in ((rows, out), (failed, errors)):
            table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=processing_time))
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def stream_ingest(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                  processing_time: str = "30 seconds"):
    """Start the ingest query; with ``available_now`` wait for the backlog to finish."""
    writer = (chunk_stream(stream).writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=processing_time))
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
