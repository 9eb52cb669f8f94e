"""Registered chunking queries (C3, C4) and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chunk, web
from quarry.registry.oracle import SCRAPED, c3_windows, oracle, with_
from quarry.registry.queries import NOW, query
from quarry.sources.tables import table


@query("c3_chunk_words")
def c3(spark, sf):
    return chunk.chunk_words(table(spark, sf, "documents").select("doc_id", "text"))


@oracle("c3_chunk_words")
def c3_sql():
    return c3_windows("documents", "doc_id")


@query("c4_chunk_counts")
def c4(spark, sf):
    return chunk.chunk_counts(c3(spark, sf))


@oracle("c4_chunk_counts")
def c4_sql():
    return (f"SELECT doc_id, count(*) AS total_chunks, max(pos) AS last_pos FROM "
            f"({c3_windows('documents', 'doc_id')}) GROUP BY doc_id")


def flagship(spark, sf):
    """Pages → boilerplate removal → main region → blocks → clean → word windows."""
    scraped = web.scrape(table(spark, sf, "pages"), now=NOW)
    return chunk.chunk_words(scraped.select("url", "title", "text")).select(
        "url", "title", "pos", F.col("page_content").alias("chunk"))


@query("flagship_scrape_chunks")
def flagship_q(spark, sf):
    return flagship(spark, sf)


@oracle("flagship_scrape_chunks")
def flagship_sql():
    return with_(SCRAPED) + (
        "SELECT url, title, pos, page_content AS chunk FROM ("
        + c3_windows("(SELECT url, title, text FROM scraped)", "url, title") + ")")
