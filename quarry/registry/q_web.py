"""Registered web queries (S3, W1-W16) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions.urls import url_host, url_ok, validate_url
from quarry.operators import web
from quarry.plans.crawl import crawl
from quarry.registry import duck as D
from quarry.registry.oracle import (LINKS, LINKS_ALL, RAW_LINKS, SCRAPED, c3_windows, oracle,
                                    resolve_sql, scrape_sql, with_, with_rec)
from quarry.registry.queries import NOW, query
from quarry.sources import derived
from quarry.sources.tables import table


def _pages(spark, sf):
    return table(spark, sf, "pages")


def _hrefs(spark, sf):
    """Every anchor href of every page (navigation included) plus each page's own URL."""
    p = _pages(spark, sf)
    a = p.select("page_id", F.posexplode(H.anchors("html")).alias("pos", "href"))
    own = p.select("page_id", F.lit(-1).alias("pos"), F.col("url").alias("href"))
    return a.unionByName(own).withColumn("pos", F.col("pos").cast("bigint"))


HREFS_SQL = f"""hrefs AS (
    SELECT page_id, CAST(generate_subscripts(a_, 1) - 1 AS BIGINT) AS pos, unnest(a_) AS href
    FROM (SELECT page_id, {D.anchors('html')} AS a_ FROM pages)
    UNION ALL SELECT page_id, CAST(-1 AS BIGINT), url FROM pages)"""


@query("s3_scan_pages")
def s3(spark, sf):
    return _pages(spark, sf).select("page_id", "url", url_host("url").alias("host"),
                                    F.length("html").cast("bigint").alias("n_chars"))


@oracle("s3_scan_pages")
def s3_sql():
    return f"SELECT page_id, url, {D.url_netloc('url')} AS host, CAST(length(html) AS BIGINT) AS n_chars FROM pages"


@query("w1_url_ok")
def w1(spark, sf):
    return _hrefs(spark, sf).select("page_id", "pos", "href", url_ok("href").alias("ok"))


@oracle("w1_url_ok")
def w1_sql():
    return with_(HREFS_SQL) + f"SELECT page_id, pos, href, {D.url_ok('href')} AS ok FROM hrefs"


@query("w2_validate_url")
def w2(spark, sf):
    h = _hrefs(spark, sf)
    # Absolute forms of the same links with the page's scheme and host, and with a port.
    absolute = h.join(_pages(spark, sf).select("page_id", "url"), "page_id").select(
        "page_id", (F.col("pos") + 100000).alias("pos"),
        F.concat(F.regexp_extract("url", r"^([^:/?#]+://[^/?#]*)", 1),
                 F.when(F.col("pos") % 3 == 0, F.lit(":8080")).otherwise(F.lit("")),
                 F.col("href")).alias("href"))
    v = h.unionByName(absolute)
    return v.select("page_id", "pos", "href", validate_url("href").alias("r")).select(
        "page_id", "pos", "href", "r.ok", "r.error")


@oracle("w2_validate_url")
def w2_sql():
    return with_(HREFS_SQL, """v AS (
        SELECT page_id, pos, href FROM hrefs
        UNION ALL
        SELECT h.page_id, h.pos + 100000, regexp_extract(p.url, '^([^:/?#]+://[^/?#]*)', 1)
               || CASE WHEN h.pos % 3 = 0 THEN ':8080' ELSE '' END || h.href
        FROM hrefs h JOIN pages p USING (page_id))""") + f"""
    SELECT page_id, pos, href, ({D.validate_url_err('href')}) IS NULL AS ok,
           coalesce({D.validate_url_err('href')}, '') AS error FROM v"""


@query("w3_url_host")
def w3(spark, sf):
    return _pages(spark, sf).select("page_id", url_host("url").alias("host"))


@oracle("w3_url_host")
def w3_sql():
    return f"SELECT page_id, {D.url_netloc('url')} AS host FROM pages"


@query("w4_extract_links")
def w4(spark, sf):
    return web.raw_links(_pages(spark, sf), follow_nav=True)


@oracle("w4_extract_links")
def w4_sql():
    return with_(RAW_LINKS) + "SELECT src, href, dst FROM raw_links"


def _links_all(spark, sf):
    raw = web.raw_links(_pages(spark, sf), follow_nav=True).select("src", "dst")
    return raw.unionByName(derived.links(spark, sf))


@query("w5_same_host")
def w5(spark, sf):
    return web.same_host(_links_all(spark, sf))


@oracle("w5_same_host")
def w5_sql():
    return with_(RAW_LINKS, LINKS, LINKS_ALL) + (
        f"SELECT src, dst FROM links_all WHERE {D.url_netloc('dst')} = {D.url_netloc('src')}")


@query("w6_content_links")
def w6(spark, sf):
    return web.content_links(_links_all(spark, sf))


@oracle("w6_content_links")
def w6_sql():
    return with_(RAW_LINKS, LINKS, LINKS_ALL) + (
        f"SELECT src, dst FROM links_all WHERE {D.is_content_link('dst')}")


@query("w7_distinct_links")
def w7(spark, sf):
    return web.distinct_links(_links_all(spark, sf))


@oracle("w7_distinct_links")
def w7_sql():
    return with_(RAW_LINKS, LINKS, LINKS_ALL) + "SELECT DISTINCT src, dst FROM links_all"


@query("w8_strip_boilerplate")
def w8(spark, sf):
    return _pages(spark, sf).select("page_id", H.strip_boilerplate("html").alias("html"))


@oracle("w8_strip_boilerplate")
def w8_sql():
    return f"SELECT page_id, {D.strip_boilerplate('html')} AS html FROM pages"


@query("w9_main_region")
def w9(spark, sf):
    r = H.main_region(H.strip_boilerplate("html"))
    return _pages(spark, sf).select("page_id", r["kind"].alias("kind"), r["html"].alias("region"))


@oracle("w9_main_region")
def w9_sql():
    kind, region = D.main_region("_doc")
    return (f"SELECT page_id, {kind} AS kind, {region} AS region FROM "
            f"(SELECT page_id, {D.strip_boilerplate('html')} AS _doc FROM pages)")


@query("w10_text_blocks")
def w10(spark, sf):
    r = H.main_region(H.strip_boilerplate("html"))["html"]
    b = _pages(spark, sf).select("page_id", F.posexplode(H.block_texts(r)).alias("pos", "block"))
    from quarry.functions.text import word_count
    return (b.withColumn("n_words", word_count("block").cast("bigint"))
            .filter(F.col("n_words") >= 4).withColumn("pos", F.col("pos").cast("bigint")))


@oracle("w10_text_blocks")
def w10_sql():
    kind, region = D.main_region("_doc")
    return f"""
    SELECT page_id, pos, block, n_words FROM (
      SELECT page_id, CAST(generate_subscripts(b_, 1) - 1 AS BIGINT) AS pos, unnest(b_) AS block
      FROM (SELECT page_id, {D.block_texts(f'({region})')} AS b_
            FROM (SELECT page_id, {D.strip_boilerplate('html')} AS _doc FROM pages)))
      , LATERAL (SELECT CAST({D.word_count('block')} AS BIGINT) AS n_words)
    WHERE n_words >= 4"""


@query("w11_clean_text")
def w11(spark, sf):
    from quarry.functions.text import clean_text
    return table(spark, sf, "documents").select("doc_id", clean_text("text").alias("text"))


@oracle("w11_clean_text")
def w11_sql():
    return f"SELECT doc_id, {D.clean_text('text')} AS text FROM documents"


@query("w12_page_metadata")
def w12(spark, sf):
    return web.page_metadata(_pages(spark, sf), now=NOW)


@oracle("w12_page_metadata")
def w12_sql():
    return (f"SELECT url, {D.title('_doc')} AS title, {D.description('_doc')} AS description, "
            f"TIMESTAMP '{NOW}' AS scraped_at FROM "
            f"(SELECT url, {D.strip_boilerplate('html')} AS _doc FROM pages)")


@query("w13_drop_empty")
def w13(spark, sf):
    return web.scrape(_pages(spark, sf), now=NOW).select("url", "text")


@oracle("w13_drop_empty")
def w13_sql():
    return with_(SCRAPED) + "SELECT url, text FROM scraped"


@query("w14_scrape")
def w14(spark, sf):
    urls = derived.links(spark, sf).select(F.col("dst").alias("url"))
    return web.scrape(_pages(spark, sf), urls=urls, now=NOW).select(
        "url", "text", "title", "description", "scraped_at")


@oracle("w14_scrape")
def w14_sql():
    return with_(LINKS) + f"""
    SELECT * FROM ({scrape_sql('(SELECT * FROM pages WHERE url IN (SELECT dst FROM links))')})"""


def host_starts(spark, sf):
    """The first page (lowest page_id) of every host."""
    p = _pages(spark, sf).select("page_id", "url", url_host("url").alias("host"))
    return p.groupBy("host").agg(F.min_by("url", "page_id").alias("start"))


@query("w15_crawl")
def w15(spark, sf):
    pages = _pages(spark, sf)
    return crawl(pages, derived.links(spark, sf), host_starts(spark, sf), max_pages=100)


@oracle("w15_crawl")
def w15_sql():
    edges = (f"SELECT DISTINCT src, dst FROM links WHERE {D.url_ok('dst')} AND "
             f"{D.url_netloc('dst')} = {D.url_netloc('src')} AND {D.is_content_link('dst')}")
    return with_rec(LINKS, SCRAPED, f"edges AS ({edges})", f"""starts AS (
        SELECT arg_min(url, page_id) AS start FROM pages GROUP BY {D.url_netloc('url')})""",
                    """bfs(start, url, depth) AS (
        SELECT start, start, 0 FROM starts
        UNION
        SELECT b.start, e.dst, b.depth + 1 FROM bfs b
        JOIN scraped s ON s.url = b.url JOIN edges e ON e.src = b.url
        WHERE b.depth < (SELECT count(*) FROM pages))""") + """
    SELECT start, url, depth, rank FROM (
      SELECT start, url, depth, row_number() OVER (PARTITION BY start ORDER BY depth, url) AS rank
      FROM (SELECT start, url, CAST(min(depth) AS BIGINT) AS depth FROM bfs GROUP BY start, url)
      WHERE url IN (SELECT url FROM scraped))
    WHERE rank <= 100"""


@query("w16_index_pages")
def w16(spark, sf):
    return web.index_pages(web.scrape(_pages(spark, sf), now=NOW), now=NOW)


@oracle("w16_index_pages")
def w16_sql():
    src = (f"(SELECT url AS filename, 'web' AS file_type, title, description, "
           f"TIMESTAMP '{NOW}' AS created_at, text FROM scraped)")
    return with_(SCRAPED) + c3_windows(src, "filename, file_type, title, description, created_at")


# Nested pages: SQL knows how they are built, so each result is the plain page's between pieces
# that are written out here, without any matching of nested elements or quoted values.
_PLAIN = D.strip_boilerplate("replace(html, 'article', 'section')")
_DEEP = "CAST(page_id % 40 AS BIGINT)"
_REGION = (f"repeat('<div title=\"</div>\">', {_DEEP}) || {_PLAIN} || repeat('</div>', {_DEEP}) || "
           "'<p title=\"z > y\">closing words of page ' || page_id || '</p>'")


@query("w4_nested_links")
def w4_nested(spark, sf):
    return web.raw_links(derived.nested_pages(spark, sf), follow_nav=True)


@oracle("w4_nested_links")
def w4_nested_sql():
    return f"""
    SELECT url AS src, href, {resolve_sql('url', 'href')} AS dst
    FROM (SELECT url, unnest(list_prepend('/menu/' || page_id, {D.anchors('html')})) AS href
          FROM pages)"""


@query("w8_nested_boilerplate")
def w8_nested(spark, sf):
    """The links' titles are kept out: the SQL's plain patterns can't pass them."""
    pages = derived.nested_pages(spark, sf)
    return pages.select("page_id", F.replace(
        H.strip_boilerplate("html"), F.lit(' title="x > <a href=y>"'), F.lit("")).alias("html"))


@oracle("w8_nested_boilerplate")
def w8_nested_sql():
    return f"""
    SELECT page_id, '<html><head><title data-n="1 > 0">Page ' || page_id ||
           ' inside</title><meta title="a > b" name="description" content="more > less ' || page_id
           || '"></head><body class="x > y"><div title="<div class=content>">'
           || '<div data-t="p > q" class="page-content">' || {_REGION}
           || '</div><p>text outside of the region</p></div></body></html>' AS html
    FROM pages"""


@query("w9_nested_region")
def w9_nested(spark, sf):
    r = H.main_region(H.strip_boilerplate("html"))
    return derived.nested_pages(spark, sf).select("page_id", r["kind"].alias("kind"), F.replace(
        r["html"], F.lit(' title="x > <a href=y>"'), F.lit("")).alias("region"))


@oracle("w9_nested_region")
def w9_nested_sql():
    return f"SELECT page_id, 'div' AS kind, {_REGION} AS region FROM pages"


@query("w14_nested_scrape")
def w14_nested(spark, sf):
    return web.scrape(derived.nested_pages(spark, sf), now=NOW)


@oracle("w14_nested_scrape")
def w14_nested_sql():
    return f"""
    SELECT page_id, url, 'Page ' || page_id || ' inside' AS title,
           'more > less ' || page_id AS description, TIMESTAMP '{NOW}' AS scraped_at,
           array_to_string(list_append({D.kept_blocks(_PLAIN)}, 'closing words of page ' || page_id),
                           chr(10) || chr(10)) AS text
    FROM pages"""
