"""Document catalog: listing, filters and processing state.

Plain Parquet has no UPDATE, so state changes are an append-only event log and the current
state is a view: per document the latest event by (event_ts, seq), found with ``max_by`` (a
partial aggregate, so a document with a huge event history is combined map-side).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("file_type", T.StringType(), False),
    T.StructField("summary", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("processing_status", T.StringType()),
    T.StructField("total_chunks", T.LongType()),
    T.StructField("processed_chunks", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])
CATALOG_COLUMNS = [f.name for f in CATALOG_SCHEMA.fields]

# Status names.
PROCESSING, COMPLETED = "processing", "completed"


def catalog_view(catalog: DataFrame) -> DataFrame:
    """Q1: the ten catalog columns."""
    return catalog.select(*CATALOG_COLUMNS)


def newest_first(df: DataFrame) -> DataFrame:
    """Q2: created_at descending, id for ties."""
    return df.orderBy(F.desc("created_at"), F.asc("id"))


def filter_types(df: DataFrame, types) -> DataFrame:
    """V4: file_type = ANY(types); an empty list matches nothing."""
    types = list(types)
    return df.filter(F.col("file_type").isin(types) if types else F.lit(False))


def filter_dates(df: DataFrame, start, end) -> DataFrame:
    """V5: created_at between start and end, both inclusive."""
    return df.filter(F.col("created_at").between(F.lit(start).cast("timestamp_ntz"),
                                                 F.lit(end).cast("timestamp_ntz")))


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """V6: AND of the filters present; none → every row. Written as one predicate so the
    Parquet reader gets both pushed down."""
    conds = []
    if filters and "file_type" in filters:
        types = list(filters["file_type"])
        conds.append(F.col("file_type").isin(types) if types else F.lit(False))
    if filters and "date_range" in filters:
        dr = filters["date_range"]
        conds.append(F.col("created_at").between(F.lit(dr["start"]).cast("timestamp_ntz"),
                                                 F.lit(dr["end"]).cast("timestamp_ntz")))
    return df.filter(functools.reduce(operator.and_, conds)) if conds else df


def get_documents(catalog: DataFrame, filters: dict | None = None) -> DataFrame:
    """Q3 = Q1 + V6 + Q2."""
    return newest_first(apply_filters(catalog_view(catalog), filters))


def save_documents(rows: DataFrame, now=None, upload: Column | str | None = None) -> DataFrame:
    """Rows (filename, file_type, summary, metadata, total_chunks) → catalog rows.
    Status is 'processing' when total_chunks > 1, else 'completed'; processed_chunks 0;
    a struct/map metadata becomes JSON, a string passes through.

    Rows without an ``id`` get a hash of filename, type, metadata and ``upload`` (a value, or a
    column of values, that names the upload): a file uploaded again is another document, while a
    retry under the same ``upload`` gives the same ids. Without ``upload``, equal files are one."""
    md = rows.schema["metadata"].dataType if "metadata" in rows.columns else T.StringType()
    meta = (F.col("metadata") if isinstance(md, T.StringType) else F.to_json("metadata")
            ) if "metadata" in rows.columns else F.lit(None).cast("string")
    total = F.coalesce(F.col("total_chunks").cast("bigint"), F.lit(1).cast("bigint")
                       ) if "total_chunks" in rows.columns else F.lit(1).cast("bigint")
    ts = (F.current_timestamp().cast("timestamp_ntz") if now is None
          else F.lit(now).cast("timestamp_ntz"))
    created = F.coalesce(F.col("created_at").cast("timestamp_ntz"), ts) \
        if "created_at" in rows.columns else ts
    idcol = F.col("id").cast("bigint") if "id" in rows.columns else F.xxhash64(
        "filename", F.coalesce(meta, F.lit("")), *(
            [] if upload is None else [F.coalesce("file_type", F.lit("")), F.lit(upload)
             if isinstance(upload, str) else upload.cast("string")]))
    return rows.select(
        idcol.alias("id"), "filename", "file_type",
        (F.col("summary") if "summary" in rows.columns else F.lit(None)).cast("string").alias("summary"),
        meta.alias("metadata"),
        F.when(total > 1, PROCESSING).otherwise(COMPLETED).alias("processing_status"),
        total.alias("total_chunks"), F.lit(0).cast("bigint").alias("processed_chunks"),
        created.alias("created_at"), created.alias("updated_at"))


def create_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Create an empty catalog at ``path`` if none exists; return it."""
    try:
        return spark.read.schema(CATALOG_SCHEMA).parquet(path)
    except Exception:  # absent: write an empty, schema-carrying table
        spark.createDataFrame([], CATALOG_SCHEMA).write.mode("ignore").parquet(path)
        return spark.read.schema(CATALOG_SCHEMA).parquet(path)


def latest_events(events: DataFrame) -> DataFrame:
    """Per doc_id: the last event by (event_ts, seq) and the last event time."""
    order = F.struct("event_ts", "seq")
    return events.groupBy("doc_id").agg(
        F.max_by(F.struct("processed_chunks", "status"), order).alias("_last"),
        F.max("event_ts").alias("last_event_ts"))


def current_status(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """Q4 + Q5: catalog with the effect of every status update. An update sets
    processed_chunks and either the explicit status or completed/processing by comparison
    with total_chunks (so a status can go back); events for unknown ids change nothing;
    updated_at is the time of the last update."""
    last = latest_events(events)
    j = catalog.join(last, catalog["id"] == last["doc_id"], "left")
    has = F.col("_last").isNotNull()
    processed = F.when(has, F.col("_last.processed_chunks")).otherwise(F.col("processed_chunks"))
    auto = F.when(processed >= F.col("total_chunks"), COMPLETED).otherwise(PROCESSING)
    status = F.when(has, F.coalesce(F.col("_last.status"), auto)).otherwise(
        F.col("processing_status"))
    updated = F.when(has, F.greatest(F.col("created_at"), F.col("last_event_ts"))).otherwise(
        F.col("updated_at"))
    return j.select(*[c for c in CATALOG_COLUMNS if c not in
                      ("processing_status", "processed_chunks", "updated_at")],
                    status.alias("processing_status"),
                    processed.cast("bigint").alias("processed_chunks"),
                    updated.alias("updated_at")).select(*CATALOG_COLUMNS)


def upgrade_catalog(df: DataFrame) -> DataFrame:
    """Q6: add updated_at when an older table lacks it (default: created_at)."""
    if "updated_at" not in df.columns:
        df = df.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return df.withColumn("updated_at", F.coalesce("updated_at", "created_at"))


def progress(status: DataFrame, by: tuple[str, ...] = ("processing_status", "file_type")
             ) -> DataFrame:
    """Q7: documents and chunk progress per status and type, with the share of documents."""
    g = status.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("processed_chunks").cast("bigint").alias("processed_chunks"),
        F.sum("total_chunks").cast("bigint").alias("total_chunks"))
    from pyspark.sql import Window
    total = F.sum("n_docs").over(Window.partitionBy())  # one row per group: tiny
    return g.select(*by, "n_docs", "processed_chunks", "total_chunks",
                    F.round(F.col("n_docs") / total, 6).alias("share_docs"),
                    F.round(F.when(F.col("total_chunks") > 0,
                                   F.col("processed_chunks") / F.col("total_chunks")), 6
                            ).alias("chunk_progress"))
