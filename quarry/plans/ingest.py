"""Upload and crawl flows composed from the operators.

Upload: files → V1/V2 → S2 (archive members) → E0 → C3 or C1 → R1 → S4.
Crawl:  pages → W8-W13 scrape → W15 crawl from the starts → W16 index rows → S4.
Both return the index rows written (or to be written when ``index_path`` is None) and the
rejected/failed files with their reason, so nothing fails silently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.validate import validate_file
from quarry.operators.chunk import chunk_tokens, chunk_words
from quarry.operators.embed import embed
from quarry.operators.extract import extract_text
from quarry.operators.web import index_pages, scrape
from quarry.plans.crawl import crawl
from quarry.sources.files import expand_archives
from quarry.sources.index import write_index


def ingest_files(files: DataFrame, now=None, extractors: dict[str, Callable] | None = None,
                 embedder=None, index_path: str | None = None, recursive: bool = False
                 ) -> tuple[DataFrame, DataFrame]:
    """``files`` as from ``scan_files`` (path, filename, file_type, length, content).
    Returns (index rows, rejected rows with ``error``)."""
    checked = files.withColumn("_v", validate_file("filename", "length"))
    rejected = checked.filter(~F.col("_v.ok")).select(
        "path", "filename", F.col("_v.error").alias("error"))
    accepted = checked.filter(F.col("_v.ok")).drop("_v")
    expanded = expand_archives(accepted)
    broken = expanded.filter(F.col("error").isNotNull()).select(
        F.col("archive_path").alias("path"),
        F.element_at(F.split("archive_path", "/"), -1).alias("filename"), "error")
    members = expanded.filter(F.col("error").isNull())
    extracted = extract_text(members.drop("error", "modificationTime")
                             if "modificationTime" in members.columns else members.drop("error"),
                             extractors)
    failed = extracted.filter(F.col("error").isNotNull()).select("path", "filename", "error")
    created = (F.current_timestamp().cast("timestamp_ntz") if now is None
               else F.lit(now).cast("timestamp_ntz"))
    docs = extracted.filter(F.col("error").isNull()).select(
        "filename", "file_type", created.alias("created_at"), "text")
    chunks = chunk_tokens(docs) if recursive else chunk_words(docs)
    rows = embed(chunks, embedder, text="page_content") if embedder is not None else chunks
    if index_path is not None:
        write_index(rows, index_path)
    return rows, rejected.unionByName(failed).unionByName(broken)


def ingest_site(pages: DataFrame, links: DataFrame, starts, now=None,
                max_pages: int | None = None, embedder=None, index_path: str | None = None) -> DataFrame:
    """Crawl every start inside its host and index the successful pages (the first
    ``max_pages`` of each start, if given)."""
    scraped = scrape(pages, now=now)
    kept = crawl(pages, links, starts, max_pages=max_pages, ok_pages=scraped.select("url"))
    pages_in = scraped.join(kept.select(F.col("url")).distinct(), "url", "left_semi")
    rows = index_pages(pages_in, now=now)
    if embedder is not None:
        rows = embed(rows, embedder, text="page_content")
    if index_path is not None:
        write_index(rows, index_path)
    return rows
