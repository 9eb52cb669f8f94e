"""Registered catalog, validation and record-format queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.validate import validate_extension, validate_file
from quarry.operators import catalog as C
from quarry.registry import duck as D
from quarry.registry.oracle import CATALOG, STATUS_EVENTS, oracle, with_
from quarry.registry.queries import query
from quarry.session import scratch_path
from quarry.sources import derived, records
from quarry.sources.tables import table

FILTERS = {"file_type": ["pdf", "md"],
           "date_range": {"start": "2024-01-05 00:00:00", "end": "2024-01-30 00:00:00"}}

FILES_SQL = """files AS (
    SELECT doc_id, filename, lower(string_split(filename, '.')[-1]) AS file_type, length, text
    FROM (SELECT doc_id, text,
            CASE doc_id % 7 WHEN 0 THEN 'doc_' || CAST(doc_id AS VARCHAR) || '.pdf'
                            WHEN 1 THEN 'doc_' || CAST(doc_id AS VARCHAR) || '.MD'
                            WHEN 2 THEN 'notes.' || CAST(doc_id AS VARCHAR) || '.txt'
                            WHEN 3 THEN 'doc_' || CAST(doc_id AS VARCHAR) || '.html'
                            WHEN 4 THEN 'doc_' || CAST(doc_id AS VARCHAR) || '.exe'
                            WHEN 5 THEN 'README_' || CAST(doc_id AS VARCHAR)
                            ELSE 'bundle_' || CAST(doc_id AS VARCHAR) || '.ZIP' END AS filename,
            CAST(CASE WHEN doc_id % 50 = 0 THEN 10485760 WHEN doc_id % 50 = 1 THEN 10485761
                      ELSE strlen(text) END AS BIGINT) AS length
          FROM documents))"""

CATALOG_COLS = ", ".join(C.CATALOG_COLUMNS)


def _filters_sql() -> str:
    dr = FILTERS["date_range"]
    types = ", ".join(D.q(t) for t in FILTERS["file_type"])
    return (f"file_type IN ({types}) AND created_at BETWEEN TIMESTAMP '{dr['start']}' AND "
            f"TIMESTAMP '{dr['end']}'")


@query("s1_scan_files")
def s1(spark, sf):
    f = derived.files(spark, sf)
    return f.select("doc_id", "filename", "file_type", "length")


@oracle("s1_scan_files")
def s1_sql():
    return with_(FILES_SQL) + "SELECT doc_id, filename, file_type, length FROM files"


@query("v1_validate_extension")
def v1(spark, sf):
    f = derived.files(spark, sf)
    return f.select("doc_id", "filename", validate_extension("filename").alias("r")).select(
        "doc_id", "filename", "r.ok", "r.error")


@oracle("v1_validate_extension")
def v1_sql():
    return with_(FILES_SQL) + f"""
    SELECT doc_id, filename, file_type IN {D.allowed_list()} AS ok,
           CASE WHEN file_type IN {D.allowed_list()} THEN '' ELSE 'Invalid file type' END AS error
    FROM files"""


@query("v2_validate_file")
def v2(spark, sf):
    f = derived.files(spark, sf)
    return f.select("doc_id", "filename", "length",
                    validate_file("filename", "length").alias("r")).select(
        "doc_id", "filename", "length", "r.ok", "r.error")


@oracle("v2_validate_file")
def v2_sql():
    err = (f"CASE WHEN file_type NOT IN {D.allowed_list()} THEN 'Invalid file type' "
           f"WHEN length > 10485760 THEN 'File too large' END")
    return with_(FILES_SQL) + (f"SELECT doc_id, filename, length, ({err}) IS NULL AS ok, "
                               f"coalesce({err}, '') AS error FROM files")


@query("q1_catalog_view")
def q1(spark, sf):
    return C.catalog_view(derived.catalog(spark, sf))


@oracle("q1_catalog_view")
def q1_sql():
    return with_(CATALOG) + f"SELECT {CATALOG_COLS} FROM catalog"


@query("q2_newest_first")
def q2(spark, sf):
    return C.newest_first(derived.catalog(spark, sf)).select("id", "filename", "created_at")


@oracle("q2_newest_first")
def q2_sql():
    return with_(CATALOG) + "SELECT id, filename, created_at FROM catalog ORDER BY created_at DESC, id"


@query("q3_get_documents")
def q3(spark, sf):
    return C.get_documents(derived.catalog(spark, sf), FILTERS)


@oracle("q3_get_documents")
def q3_sql():
    return with_(CATALOG) + (f"SELECT {CATALOG_COLS} FROM catalog WHERE {_filters_sql()} "
                             f"ORDER BY created_at DESC, id")


@query("v4_filter_types")
def v4(spark, sf):
    return C.filter_types(derived.catalog(spark, sf), FILTERS["file_type"]).select(
        "id", "filename", "file_type")


@oracle("v4_filter_types")
def v4_sql():
    return with_(CATALOG) + "SELECT id, filename, file_type FROM catalog WHERE file_type IN ('pdf', 'md')"


@query("v5_filter_dates")
def v5(spark, sf):
    dr = FILTERS["date_range"]
    return C.filter_dates(derived.catalog(spark, sf), dr["start"], dr["end"]).select(
        "id", "filename", "created_at")


@oracle("v5_filter_dates")
def v5_sql():
    dr = FILTERS["date_range"]
    return with_(CATALOG) + (f"SELECT id, filename, created_at FROM catalog WHERE created_at "
                             f"BETWEEN TIMESTAMP '{dr['start']}' AND TIMESTAMP '{dr['end']}'")


@query("v6_apply_filters")
def v6(spark, sf):
    return C.apply_filters(derived.catalog(spark, sf), FILTERS).select(
        "id", "filename", "file_type", "created_at")


@oracle("v6_apply_filters")
def v6_sql():
    return with_(CATALOG) + f"SELECT id, filename, file_type, created_at FROM catalog WHERE {_filters_sql()}"


CURRENT_SQL = """current_status AS (
    SELECT c.id, c.filename, c.file_type, c.summary, c.metadata,
           CASE WHEN l.doc_id IS NULL THEN c.processing_status
                ELSE coalesce(l.status, CASE WHEN l.processed_chunks >= c.total_chunks
                                             THEN 'completed' ELSE 'processing' END) END
             AS processing_status,
           c.total_chunks,
           CASE WHEN l.doc_id IS NULL THEN c.processed_chunks ELSE l.processed_chunks END
             AS processed_chunks,
           c.created_at,
           CASE WHEN l.doc_id IS NULL THEN c.updated_at ELSE greatest(c.created_at, m.last_ts) END
             AS updated_at
    FROM catalog c
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
                 ORDER BY event_ts DESC, seq DESC) AS rn_ FROM status_events) WHERE rn_ = 1) l
      ON l.doc_id = c.id
    LEFT JOIN (SELECT doc_id, max(event_ts) AS last_ts FROM status_events GROUP BY doc_id) m
      ON m.doc_id = c.id)"""


def current(spark, sf):
    return C.current_status(derived.catalog(spark, sf), derived.status_events(spark, sf))


@query("q4_current_status")
def q4(spark, sf):
    return current(spark, sf)


@oracle("q4_current_status")
def q4_sql():
    return with_(CATALOG, STATUS_EVENTS, CURRENT_SQL) + f"SELECT {CATALOG_COLS} FROM current_status"


@query("q5_with_updated_at")
def q5(spark, sf):
    return current(spark, sf).select("id", "created_at", "updated_at")


@oracle("q5_with_updated_at")
def q5_sql():
    return with_(CATALOG, STATUS_EVENTS, CURRENT_SQL) + "SELECT id, created_at, updated_at FROM current_status"


@query("q6_upgrade_catalog")
def q6(spark, sf):
    """An older catalog part without updated_at and a newer part with it, read together."""
    cat = derived.catalog(spark, sf)
    path = scratch_path(spark, "catalog")
    cat.filter(F.col("file_type").isin("pdf", "md")).drop("updated_at").write.parquet(
        f"{path}/part=old")
    cat.filter(~F.col("file_type").isin("pdf", "md")).write.parquet(f"{path}/part=new")
    merged = spark.read.option("mergeSchema", "true").parquet(path).drop("part")
    return C.upgrade_catalog(merged).select(*C.CATALOG_COLUMNS)


@oracle("q6_upgrade_catalog")
def q6_sql():
    return with_(CATALOG) + f"SELECT {CATALOG_COLS} FROM catalog"


@query("q7_progress")
def q7(spark, sf):
    return C.progress(current(spark, sf))


@oracle("q7_progress")
def q7_sql():
    return with_(CATALOG, STATUS_EVENTS, CURRENT_SQL) + """
    SELECT processing_status, file_type, n_docs, processed_chunks, total_chunks,
           round(n_docs / sum(n_docs) OVER (), 6) AS share_docs,
           round(CASE WHEN total_chunks > 0 THEN processed_chunks / total_chunks END, 6)
             AS chunk_progress
    FROM (SELECT processing_status, file_type, count(*) AS n_docs,
                 CAST(sum(processed_chunks) AS BIGINT) AS processed_chunks,
                 CAST(sum(total_chunks) AS BIGINT) AS total_chunks
          FROM current_status GROUP BY processing_status, file_type)"""


def _save_rows(spark, sf):
    docs = table(spark, sf, "documents")
    cat = derived.catalog(spark, sf).select("id", "filename", "file_type", "total_chunks",
                                            "created_at")
    return cat.join(docs.select(F.col("doc_id").alias("id"), "lang", "source"), "id").select(
        "id", "filename", "file_type", F.lit(None).cast("string").alias("summary"),
        F.struct("lang", "source").alias("metadata"), "total_chunks", "created_at")


@query("s8_save_documents")
def s8(spark, sf):
    return C.save_documents(_save_rows(spark, sf))


@oracle("s8_save_documents")
def s8_sql():
    return with_(CATALOG) + f"SELECT {CATALOG_COLS} FROM catalog"


@query("s8_repeated_uploads")
def s8_uploads(spark, sf):
    """The documents uploaded twice, the second upload written twice (a retry): two ids a file."""
    rows = _save_rows(spark, sf).drop("id")
    first, second = (C.save_documents(rows, upload=x) for x in ("monday", "tuesday"))
    kept = first.unionByName(second).unionByName(second)
    return kept.groupBy("filename").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.count_distinct("id").alias("n_ids"))


@oracle("s8_repeated_uploads")
def s8_uploads_sql():
    return with_(CATALOG) + """SELECT filename, 3 * count(*) AS n_rows,
        2 * count(DISTINCT (file_type, metadata)) AS n_ids FROM catalog GROUP BY filename"""


@query("s7_create_catalog")
def s7(spark, sf):
    path = scratch_path(spark, "catalog")
    C.create_catalog(spark, path)
    C.save_documents(_save_rows(spark, sf)).write.mode("append").parquet(path)
    return C.create_catalog(spark, path)


@oracle("s7_create_catalog")
def s7_sql():
    return with_(CATALOG) + f"SELECT {CATALOG_COLS} FROM catalog"


@query("s9_vector_json")
def s9(spark, sf):
    emb = table(spark, sf, "embeddings")
    docs = emb.select(F.col("vec_id").cast("string").alias("id"),
                      F.col("embedding").alias("vector"),
                      F.to_json(F.struct("label")).alias("metadata"))
    back = records.from_vector_json(records.to_vector_json(docs), "json")
    return back.select("id", F.size("vector").cast("bigint").alias("dims"),
                       F.get_json_object("metadata", "$.label").cast("bigint").alias("label"),
                       F.round(F.aggregate("vector", F.lit(0.0).cast("double"),
                                           lambda a, x: a + x.cast("double")), 6).alias("vsum"))


@oracle("s9_vector_json")
def s9_sql():
    return """SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS BIGINT) AS dims,
                     CAST(label AS BIGINT) AS label,
                     round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)),
                                       lambda a, b: a + b), 6) AS vsum
              FROM embeddings"""


@query("s9_parse_props")
def s9b(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@oracle("s9_parse_props")
def s9b_sql():
    return "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
