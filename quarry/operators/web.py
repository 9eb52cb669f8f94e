"""Web operators over fetched pages (W4-W14, W16). Every step is a narrow, native stage over
``pages(url, html)``; the only shuffle is the ``distinct`` of W7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions.urls import is_content_link, resolve_urls, url_host, url_ok
from quarry.operators.chunk import chunk_words


def _now(now) -> Column:
    if now is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.lit(now).cast("timestamp_ntz")


def page_metadata(pages: DataFrame, now=None, html: str = "html") -> DataFrame:
    """Url, title, description, scraped_at (a parameter for deterministic runs)."""
    stripped = H.strip_boilerplate(F.col(html))
    return pages.select("url", H.title(stripped).alias("title"),
                        H.description(stripped).alias("description"),
                        _now(now).alias("scraped_at"))


def scrape(pages: DataFrame, urls: DataFrame | None = None, now=None, min_words: int = 4,
           html: str = "html") -> DataFrame:
    """One row per page with at least one kept block (pages without one yield no
    row, W13). ``urls`` (a DataFrame with ``url``) restricts the scrape (W14, a semi-join)."""
    if urls is not None:
        pages = pages.join(urls.select("url").distinct(), "url", "left_semi")
    stripped = pages.select("*", H.strip_boilerplate(F.col(html)).alias("_doc"))
    region = H.main_region(F.col("_doc"))
    out = stripped.select(
        *[c for c in pages.columns if c != html],
        H.kept_blocks(region["html"], min_words).alias("_blocks"),
        H.title("_doc").alias("title"), H.description("_doc").alias("description"),
        _now(now).alias("scraped_at"))
    # A page without a kept block yields no row. Written as a 0/1-element explode rather than
    # a filter: Catalyst would push a filter on ``_blocks`` below the projection and evaluate
    # the whole block pipeline twice.
    text = F.explode(F.when(F.size("_blocks") > 0, F.array(F.array_join("_blocks", "\n\n")))
                     .otherwise(F.array().cast("array<string>")))
    return out.select(*[c for c in out.columns if c != "_blocks"], text.alias("text"))


def raw_links(pages: DataFrame, follow_nav: bool = False, html: str = "html") -> DataFrame:
    """(src, href, dst) for every <a href>, resolved against the page URL. By default
    boilerplate (nav, footer, ...) is removed first, as the reference does, so navigation
    links are not followed; ``follow_nav=True`` keeps them."""
    doc = F.col(html) if follow_nav else H.strip_boilerplate(F.col(html))
    hrefs = pages.select(F.col("url").alias("src"), F.explode(H.anchors(doc)).alias("href"))
    return resolve_urls(hrefs, "src", "href", "dst")


def same_host(links: DataFrame, host: str | None = None) -> DataFrame:
    """Keep links whose netloc equals the source's (``host=None``) or a given host."""
    ref = url_host("src") if host is None else F.lit(host)
    return links.filter(url_host("dst") == ref)


def content_links(links: DataFrame) -> DataFrame:
    """Drop links that look like assets, fragments, mail/phone/script or listing pages."""
    return links.filter(is_content_link("dst"))


def distinct_links(links: DataFrame) -> DataFrame:
    """W7."""
    return links.select("src", "dst").distinct()


def crawlable_links(links: DataFrame) -> DataFrame:
    """W1 + W5 + W6 + W7, the filters applied to every followed link."""
    return distinct_links(content_links(same_host(links.filter(url_ok("dst")))))


def extract_links(pages: DataFrame, follow_nav: bool = False) -> DataFrame:
    return crawlable_links(raw_links(pages, follow_nav))


def index_pages(scraped: DataFrame, now=None, size: int = 300, overlap: int = 50) -> DataFrame:
    """Scraped pages → index rows (filename = url, file_type 'web', title,
    description, created_at)."""
    docs = scraped.select(F.col("url").alias("filename"), F.lit("web").alias("file_type"),
                          "title", "description", _now(now).alias("created_at"), "text")
    return chunk_words(docs, "text", size, overlap)
