"""Q8: document status kept current as progress events stream in.

Events (event_id, doc_id, seq, event_ts, processed_chunks, status) arrive in any order and
possibly twice. A streaming aggregate keeps, per doc_id, the latest event by (event_ts, seq)
with ``max_by`` (repeats do not change it) plus the last event time; in update mode every
micro-batch emits the documents it changed, and ``foreachBatch`` writes them to the sink's folder
``changes/batch_id=<n>``, which a batch that runs again writes anew. Every ``compact_every`` batches
the changes are merged into ``state/batch_id=<n>``, one row per document, so the sink's size follows
the documents and not the batches. The current state is the row of the highest batch per document,
joined to the catalog by ``current_status``. An optional watermark bounds the de-duplication state.

A state folder counts once its ``_SUCCESS`` file is there. Compaction keeps the state before the new
one and the changes after it, so that a reader who has listed them can finish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.catalog import current_status
from quarry.sources.index import _fs

EVENT_SCHEMA = ("event_id BIGINT, doc_id BIGINT, seq BIGINT, event_ts TIMESTAMP_NTZ, "
                "processed_chunks BIGINT, status STRING")


CHANGE_SCHEMA = ("doc_id BIGINT, _last STRUCT<processed_chunks: BIGINT, status: STRING>, "
                 "last_event_ts TIMESTAMP_NTZ")
COMPACT_EVERY = 10


def _folders(spark: SparkSession, path: str) -> dict[int, object]:
    """Complete ``batch_id=<n>`` folders below ``path`` by number: at most a few compactions' worth."""
    fs, root, jvm = _fs(spark, path)
    if not fs.exists(root):
        return {}
    found = {}
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("batch_id=") and fs.exists(
                jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found[int(name.split("=")[1])] = s.getPath()
    return found


def _read_changes(spark: SparkSession, sink: str, before: int | None = None) -> DataFrame:
    """Newest state (older than ``before`` if given) and the changes after it, with batch_id."""
    states = [n for n in _folders(spark, f"{sink}/state") if before is None or n < before]
    base = max(states, default=-1)
    parts = [(n, f"{sink}/changes/batch_id={n}") for n in _folders(spark, f"{sink}/changes")
             if n > base]
    if base >= 0:
        parts.append((base, f"{sink}/state/batch_id={base}"))
    out = spark.createDataFrame([], CHANGE_SCHEMA).withColumn("batch_id", F.lit(0).cast("bigint"))
    for n, p in sorted(parts):
        out = out.unionByName(spark.read.schema(CHANGE_SCHEMA).parquet(p).withColumn(
            "batch_id", F.lit(n).cast("bigint")))
    return out


def _newest(changes: DataFrame) -> DataFrame:
    return changes.groupBy("doc_id").agg(F.max_by(F.struct("_last", "last_event_ts"), "batch_id")
                                         .alias("r")).select("doc_id", "r._last", "r.last_event_ts")


def compact(spark: SparkSession, sink: str, upto: int) -> None:
    """Merge the sink's changes up to batch ``upto`` into one row per document; running it again
    gives the same state."""
    before = max((n for n in _folders(spark, f"{sink}/state") if n < upto), default=-1)
    changes = _read_changes(spark, sink, upto).filter(F.col("batch_id") <= upto)
    _newest(changes).write.mode("overwrite").parquet(f"{sink}/state/batch_id={upto}")
    fs, _, _ = _fs(spark, sink)
    for part in ("state", "changes"):
        for n, folder in _folders(spark, f"{sink}/{part}").items():
            if n < before or (part == "changes" and n == before):
                fs.delete(folder, True)


def latest_per_doc(events: DataFrame) -> DataFrame:
    order = F.struct("event_ts", "seq")
    return events.groupBy("doc_id").agg(
        F.max_by(F.struct("processed_chunks", "status"), order).alias("_last"),
        F.max("event_ts").alias("last_event_ts"))


def stream_status(events: DataFrame, sink: str, checkpoint: str,
                  watermark: str | None = None, available_now: bool = True,
                  compact_every: int = COMPACT_EVERY):
    """Run the status stream into ``sink`` (Parquet; merged every ``compact_every`` batches)."""
    sink = sink.rstrip("/")
    if watermark:
        # Watermarks need TIMESTAMP (event_ts is TIMESTAMP_NTZ): watermark a cast copy.
        events = (events.withColumn("_wm_ts", F.col("event_ts").cast("timestamp"))
                  .withWatermark("_wm_ts", watermark)
                  .dropDuplicatesWithinWatermark(["event_id"]).drop("_wm_ts"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/changes/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, sink, batch_id)

    q = (latest_per_doc(events).writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    handle = q.start()
    if available_now:
        handle.awaitTermination()
    return handle


def status_view(spark: SparkSession, catalog: DataFrame, sink: str) -> DataFrame:
    """Current catalog state from the sink: per document the newest batch's row."""
    last = _newest(_read_changes(spark, sink.rstrip("/")))
    # Rebuild an event-like frame with one row per document for the shared state rule.
    ev = last.select("doc_id", F.lit(1).cast("bigint").alias("seq"),
                     F.col("last_event_ts").alias("event_ts"),
                     F.col("_last.processed_chunks").alias("processed_chunks"),
                     F.col("_last.status").alias("status"))
    return current_status(catalog, ev)
