"""Registered retrieval queries (R2-R5, R7, R8, L4, L5, L10) and oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cells as CE
from quarry.operators import prompts as P
from quarry.operators import search as S
from quarry.operators.approx import recall_at_k
from quarry.operators.catalog import apply_filters
from quarry.registry import duck as D
from quarry.registry.oracle import CATALOG, CHUNKS, EPOCH, c3_windows, oracle, with_
from quarry.registry.queries import query
from quarry.session import scratch_path
from quarry.sources import derived
from quarry.sources.tables import table

PAYLOAD = ["filename", "file_type", "created_at", "page_content"]
FILTERS = {"file_type": ["pdf", "md"],
           "date_range": {"start": "2024-01-05 00:00:00", "end": "2024-01-30 00:00:00"}}


def _queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")


def _dist_sql(a: str, b: str) -> str:
    return (f"list_sum(list_transform(generate_series(1, len({a})), lambda i_: "
            f"power(CAST({a}[i_] AS DOUBLE) - CAST({b}[i_] AS DOUBLE), 2)))")


def _pairs_sql(queries: str, chunks: str, qkeys: list[str], k: int, payload: list[str],
               score: bool = False) -> str:
    qsel = ", ".join(f"q_.{c}" for c in qkeys)
    pay = "".join(f", c_.{c}" for c in payload)
    sc = ", round(1 - d_ / 2, 6) AS score" if score else ""
    return f"""
    SELECT * FROM (
      SELECT {', '.join(qkeys)}, CAST(row_number() OVER (PARTITION BY {', '.join(qkeys)}
                    ORDER BY round(d_, 6), doc_id, pos) AS BIGINT) AS rank,
             doc_id, pos{''.join(', ' + c for c in payload)}, round(d_, 6) AS distance{sc}
      FROM (SELECT {qsel}, c_.doc_id, c_.pos{pay},
                   {_dist_sql('q_.embedding', 'c_.embedding')} AS d_
            FROM {queries} q_ CROSS JOIN {chunks} c_))
    WHERE rank <= {k}"""


QUERIES_SQL = "qs AS (SELECT vec_id AS qid, embedding FROM embeddings)"


@query("r2_search")
def r2(spark, sf):
    return S.search(_queries(spark, sf), derived.chunks(spark, sf), k=5, payload=PAYLOAD)


@oracle("r2_search")
def r2_sql():
    return with_(CATALOG, CHUNKS, QUERIES_SQL) + _pairs_sql("qs", "chunks", ["qid"], 5, PAYLOAD)


def _filters_sql(alias: str = "") -> str:
    dr = FILTERS["date_range"]
    types = ", ".join(D.q(t) for t in FILTERS["file_type"])
    return (f"{alias}file_type IN ({types}) AND {alias}created_at BETWEEN "
            f"TIMESTAMP '{dr['start']}' AND TIMESTAMP '{dr['end']}'")


@query("r3_filtered_search")
def r3(spark, sf):
    ch = apply_filters(derived.chunks(spark, sf), FILTERS)
    return S.search(_queries(spark, sf), ch, k=5, payload=PAYLOAD)


@oracle("r3_filtered_search")
def r3_sql():
    return with_(CATALOG, CHUNKS, QUERIES_SQL) + _pairs_sql(
        "qs", f"(SELECT * FROM chunks WHERE {_filters_sql()})", ["qid"], 5, PAYLOAD)


@query("r4_search_with_score")
def r4(spark, sf):
    return S.search(_queries(spark, sf), derived.chunks(spark, sf), k=5, payload=["filename"],
                    with_score=True)


@oracle("r4_search_with_score")
def r4_sql():
    return with_(CATALOG, CHUNKS, QUERIES_SQL) + _pairs_sql("qs", "chunks", ["qid"], 5,
                                                            ["filename"], score=True)


def source_index(spark, sf):
    """Index rows whose metadata is the document's origin: filename = source, file_type =
    lang, created_at = epoch. Copies of a text from one source are exact duplicates."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("filename"), F.col("lang").alias("file_type"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"), "text")
    from quarry.operators.chunk import chunk_words
    return chunk_words(docs).drop("doc_id", "pos")


SOURCE_INDEX_SQL = (
    "source_index AS (SELECT filename, file_type, created_at, page_content FROM ("
    + c3_windows(f"(SELECT doc_id, source AS filename, lang AS file_type, "
                 f"TIMESTAMP '{EPOCH}' AS created_at, text FROM documents)",
                 "doc_id, filename, file_type, created_at") + "))")


@query("r5_unique_union")
def r5(spark, sf):
    return S.unique_union(source_index(spark, sf),
                          ["page_content", "filename", "file_type", "created_at"], rank=None)


@oracle("r5_unique_union")
def r5_sql():
    return with_(SOURCE_INDEX_SQL) + (
        "SELECT DISTINCT page_content, filename, file_type, created_at FROM source_index")


def _variants(spark, sf):
    """Questions with several phrasings: every embedding is one phrasing of question
    vec_id % 100."""
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 100).alias("qid"), F.col("vec_id").alias("variant"), "embedding")


@query("r7_multi_query_search")
def r7(spark, sf):
    return S.multi_query_search(_variants(spark, sf), derived.chunks(spark, sf).drop(
        "created_at", "file_type"), k=5, content_keys=["filename", "page_content"])


@oracle("r7_multi_query_search")
def r7_sql():
    return with_(CATALOG, CHUNKS, """vs AS (
        SELECT vec_id % 100 AS qid, vec_id AS variant, embedding FROM embeddings)""") + f"""
    SELECT qid, doc_id, pos, filename, page_content, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, filename, page_content
                                   ORDER BY rank, doc_id, pos) AS r_ FROM (
      {_pairs_sql('vs', 'chunks', ['qid', 'variant'], 5, ['filename', 'page_content'])})
    ) WHERE r_ = 1"""


@query("r8_batch_search")
def r8(spark, sf):
    cent = S.label_centroids(table(spark, sf, "embeddings"))
    return S.search(cent, derived.chunks(spark, sf), k=5, qkeys="label", payload=["filename"])


CENTROIDS_SQL = """cent AS (
    SELECT label, list(x ORDER BY i) AS embedding FROM (
      SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (
        SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding) AS x
        FROM embeddings) GROUP BY label, i) GROUP BY label)"""


@oracle("r8_batch_search")
def r8_sql():
    return with_(CATALOG, CHUNKS, CENTROIDS_SQL) + _pairs_sql("cent", "chunks", ["label"], 5,
                                                              ["filename"])


@query("l4_build_context")
def l4(spark, sf):
    res = S.search(_queries(spark, sf), derived.chunks(spark, sf), k=5, payload=["page_content"])
    return P.build_context(res)


@oracle("l4_build_context")
def l4_sql():
    return with_(CATALOG, CHUNKS, QUERIES_SQL) + f"""
    SELECT qid, string_agg(page_content, ', ' ORDER BY rank) AS context FROM (
      {_pairs_sql('qs', 'chunks', ['qid'], 5, ['page_content'])}) GROUP BY qid"""


QUESTION = "Which passages are closest to vector {qid} of label {label}?"


@query("l5_answer_prompt")
def l5(spark, sf):
    res = S.search(_queries(spark, sf), derived.chunks(spark, sf), k=5, payload=["page_content"])
    ctx = P.build_context(res)
    q = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("qid"),
        P.format_template(QUESTION, qid=F.col("vec_id"), label=F.col("label")).alias("question"))
    return ctx.join(q, "qid").select("qid", P.answer_prompt("context", "question").alias("prompt"))


@oracle("l5_answer_prompt")
def l5_sql():
    ans = P.ANSWER_PROMPT.split("{context}")
    ans_mid, ans_end = ans[1].split("{query}")
    return with_(CATALOG, CHUNKS, QUERIES_SQL) + f"""
    SELECT c.qid, {D.q(ans[0])} || c.context || {D.q(ans_mid)} ||
           'Which passages are closest to vector ' || CAST(e.vec_id AS VARCHAR) || ' of label '
           || CAST(e.label AS VARCHAR) || '?' || {D.q(ans_end)} AS prompt
    FROM (SELECT qid, string_agg(page_content, ', ' ORDER BY rank) AS context FROM (
      {_pairs_sql('qs', 'chunks', ['qid'], 5, ['page_content'])}) GROUP BY qid) c
    JOIN embeddings e ON e.vec_id = c.qid"""


@query("l10_display_extract")
def l10(spark, sf):
    ch = derived.chunks(spark, sf)
    name, extract = P.display_extract("page_content", "filename")
    return ch.select("doc_id", "pos", name.alias("filename"), extract.alias("extract"))


@oracle("l10_display_extract")
def l10_sql():
    return with_(CATALOG, CHUNKS) + """
    SELECT doc_id, pos, coalesce(filename, 'Unknown') AS filename,
           CASE WHEN length(page_content) > 500 THEN substring(page_content, 1, 500) || '...'
                ELSE page_content END AS extract FROM chunks"""


def _cell_index(spark, sf):
    """The derived chunks written by cell, with the columns that the searches return."""
    ch = derived.chunks(spark, sf).select("doc_id", "pos", *PAYLOAD, "embedding")
    return CE.write_cells(ch, scratch_path(spark, "cells"))


@query("r2_cells_search")
def r2_cells(spark, sf):
    """R2 over the stored index: cells ruled out by the triangle inequality aren't read."""
    return CE.search_cells(_queries(spark, sf), _cell_index(spark, sf), k=5, payload=PAYLOAD)


@oracle("r2_cells_search")
def r2_cells_sql():
    return r2_sql()


@query("r3_cells_filtered")
def r3_cells(spark, sf):
    return CE.search_cells(_queries(spark, sf), _cell_index(spark, sf), k=5, payload=PAYLOAD,
                           filters=FILTERS)


@oracle("r3_cells_filtered")
def r3_cells_sql():
    return r3_sql()


@query("r8_cells_batch")
def r8_cells(spark, sf):
    cent = S.label_centroids(table(spark, sf, "embeddings"))
    return CE.search_cells(cent, _cell_index(spark, sf), k=5, qkeys="label",
                           payload=["filename"])


@oracle("r8_cells_batch")
def r8_cells_sql():
    return r8_sql()


@query("r9_cells_recall")
def r9_cells(spark, sf):
    """R9 over the stored index: mean share of the exact neighbours of all queries that the probed
    cells hold, against the wanted 0.9."""
    index, q = _cell_index(spark, sf), _queries(spark, sf)
    exact = CE.search_cells(q, index, k=5)
    near = CE.search_cells(q, index, k=5, n_probe=CE.measured_probes(q, index, 5))
    return recall_at_k(near, exact).agg(
        F.count(F.lit(1)).alias("n_queries"), (F.avg("recall") >= 0.9).alias("reached"))


@oracle("r9_cells_recall")
def r9_cells_sql():
    return "SELECT count(*) AS n_queries, true AS reached FROM embeddings"
