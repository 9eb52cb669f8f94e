"""Registered queries of the training-data operators, each over its whole table, and the DuckDB
SQL of those that SQL can express (exact definitions, written independently of the operators)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (crosstok, decontam, embeds, forest, langid, licenses, minhash, mixing,
                        quality, spans, tokencount, tokenfile, whiten)
from quarry.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeds.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op9-tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path,
                           public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.token_index(spark, path)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = tokencount.with_cleaning_edits(table(spark, sf_dir, "documents"))
    return tokencount.apply_edits(edited, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_reencoded")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return forest.nearest(vectors, asked, k=20)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.alignment_report(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_embedding_near_dedup, op3_license_scan, op4_language_id,
    op5_quality_classifier, op6_benchmark_decontamination, op7_substring_dedup, op8_mix_sources,
    op9_token_files, op10_token_counts, op11_nearest_neighbours,
    op12_embedding_whitening,
    op13_tokenizer_alignment)}

# ------------------------------------------------------------------ SQL

_LOWER = ("translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(t=text)}, '{pattern}')"


def _components(nodes: str, links: str) -> str:
    """WITH RECURSIVE parts: ``comp(n, c)`` over ``nodes(n)`` and symmetric ``links(a, b)``."""
    return f"""
reach AS (
    SELECT n, n AS c FROM ({nodes})
    UNION
    SELECT l.b, r.c FROM reach r JOIN {links} l ON l.a = r.n),
comp AS (SELECT n, min(c) AS c FROM reach GROUP BY n)"""


ORACLE = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {_words('text', _SPACED)} AS w FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, CASE WHEN len(w) < 4 THEN unnest([array_to_string(w, ' ')])
            ELSE unnest([array_to_string(w[i:i+3], ' ')]) END AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i
              FROM w WHERE len(w) > 0))),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_ AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)),
{_components('SELECT doc_id AS n FROM documents', 'links')}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN size s USING (doc_id) JOIN comp c ON c.n = d.doc_id""",
    "op2_embedding_near_dedup": f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
      ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_components('SELECT vec_id AS n FROM embeddings', 'links')}
SELECT e.vec_id, CAST((SELECT count(*) FROM links WHERE a = e.vec_id) AS BIGINT) AS n_links,
       c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN comp c ON c.n = e.vec_id""",
    "op6_benchmark_decontamination": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text', _ALNUM)} AS w
              FROM benchmark),
win AS (
    SELECT DISTINCT item, least(len(w), 10) AS k,
           array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
    FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i
          FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, coalesce({_words('text', _ALNUM)}, []) AS w FROM documents),
place AS (
    SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
          FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item FROM place JOIN win USING (k, s)),
hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
