"""DuckDB SQL for every query that SQL can express (the correctness oracle).

Derived tables are common table expressions built from the same definitions as
quarry.sources.derived; column functions come from quarry.registry.duck.
"""

from __future__ import annotations

from quarry.registry import duck as D
from quarry.sources.derived import CATALOG_EXTS, EPOCH

ORACLE: dict[str, str] = {}

NOW = "2024-06-01 00:00:00"


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


def exts_list(exts) -> str:
    return "[" + ", ".join(D.q(e) for e in exts) + "]"


def window_count(n: str, size: int = 300, overlap: int = 50) -> str:
    stride = size - overlap
    return (f"CAST(CASE WHEN {n} = 0 THEN 0 ELSE 1 + ceil(greatest({n} - {size}, 0) / "
            f"{stride}.0) END AS BIGINT)")


def c3_windows(src: str, key_cols: str, text: str = "text", size: int = 300,
               overlap: int = 50) -> str:
    """SELECT key_cols..., pos, page_content over ``src``."""
    stride = size - overlap
    return f"""
    SELECT {key_cols}, CAST(start_ / {stride} AS BIGINT) AS pos,
           array_to_string(w_[start_ + 1 : start_ + {size}], ' ') AS page_content
    FROM (SELECT {key_cols}, w_, unnest(generate_series(0, ({window_count('len(w_)', size, overlap)} - 1) * {stride}, {stride})) AS start_
          FROM (SELECT *, {D.words(text)} AS w_ FROM {src}) WHERE len(w_) > 0)"""


CATALOG = f"""catalog AS (
    SELECT doc_id AS id,
           'doc_' || CAST(doc_id AS VARCHAR) || '.' || {exts_list(CATALOG_EXTS)}[doc_id % 4 + 1] AS filename,
           {exts_list(CATALOG_EXTS)}[doc_id % 4 + 1] AS file_type,
           CAST(NULL AS VARCHAR) AS summary,
           CAST(to_json({{'lang': lang, 'source': source}}) AS VARCHAR) AS metadata,
           CASE WHEN {window_count(D.word_count('text'))} > 1 THEN 'processing' ELSE 'completed' END AS processing_status,
           {window_count(D.word_count('text'))} AS total_chunks,
           CAST(0 AS BIGINT) AS processed_chunks,
           TIMESTAMP '{EPOCH}' + to_hours(CAST(doc_id AS BIGINT)) AS created_at,
           TIMESTAMP '{EPOCH}' + to_hours(CAST(doc_id AS BIGINT)) AS updated_at
    FROM documents)"""

STATUS_EVENTS = """status_events AS (
    SELECT CAST(id * 10 + k AS BIGINT) AS event_id, id AS doc_id, CAST(k AS BIGINT) AS seq,
           created_at + to_minutes(CAST(k * 7 AS BIGINT)) AS event_ts,
           CAST(CASE WHEN k = n AND id % 5 = 0 THEN greatest(total_chunks - 1, 0)
                     WHEN k = n THEN total_chunks
                     ELSE floor(total_chunks * k / n) END AS BIGINT) AS processed_chunks,
           CASE WHEN k = n AND id % 17 = 0 THEN 'failed' END AS status
    FROM (SELECT id, total_chunks, created_at, id % 3 + 1 AS n,
                 unnest(generate_series(1, id % 3 + 1)) AS k FROM catalog)
    UNION ALL
    SELECT CAST(id * 10 + 9 AS BIGINT), id + 1000000000, CAST(1 AS BIGINT), created_at,
           total_chunks, CAST(NULL AS VARCHAR)
    FROM catalog WHERE id % 50 = 0)"""

LINKS = f"""links AS (
    SELECT src, dst FROM (
      SELECT url AS src, lead(url, 1) OVER w AS d1, lead(url, 2) OVER w AS d2
      FROM (SELECT page_id, url, {D.url_netloc('url')} AS host FROM pages)
      WINDOW w AS (PARTITION BY host ORDER BY page_id)) , unnest([d1, d2]) AS t(dst)
    WHERE dst IS NOT NULL)"""

CHUNKS = f"""chunks AS (
    SELECT c.doc_id, c.pos, c.page_content, k.filename, k.file_type, k.created_at, e.embedding
    FROM ({c3_windows('documents', 'doc_id')}) c
    JOIN catalog k ON k.id = c.doc_id
    JOIN embeddings e ON e.vec_id = c.doc_id % (SELECT count(*) FROM embeddings))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def resolve_sql(base: str, href: str) -> str:
    """Native branch of the W4 resolver (the fixture has no dot-segment links)."""
    from quarry.functions.urls import SCHEME, _COMPLEX_HREF
    origin = D.rx(base, rf"^({SCHEME}://[^/?#]*)")
    bscheme = f"lower({D.rx(base, rf'^({SCHEME}):')})"
    bpath = D.rx(base, rf"^{SCHEME}://[^/?#]*([^?#]*)")
    bquery = D.rx(base, r"^[^?#]*(\?[^#]*)")
    bdir = D.rx(bpath, r"^(.*/)")
    hscheme = f"lower({D.rx(href, rf'^({SCHEME}):')})"
    return (f"CASE WHEN {href} = '' THEN {base} "
            f"WHEN {hscheme} <> '' AND {hscheme} <> {bscheme} THEN {href} "
            f"WHEN {hscheme} <> '' THEN NULL "
            f"WHEN {D.rm(href, _COMPLEX_HREF)} THEN NULL "
            f"WHEN {D.rm(href, '^//[^/?#]')} THEN {bscheme} || ':' || {href} "
            f"WHEN starts_with({href}, '//') THEN NULL "
            f"WHEN starts_with({href}, '/') THEN {origin} || {href} "
            f"WHEN {D.rm(bpath, r'//|(^|/)\.\.?(/|$)')} THEN NULL "
            f"WHEN starts_with({href}, '?') THEN {origin} || {bpath} || {href} "
            f"WHEN starts_with({href}, '#') THEN {origin} || {bpath} || {bquery} || {href} "
            f"ELSE {origin} || CASE WHEN {bdir} = '' THEN '/' ELSE {bdir} END || {href} END")


RAW_LINKS = f"""raw_links AS (
    SELECT src, href, {resolve_sql('src', 'href')} AS dst
    FROM (SELECT url AS src, unnest({D.anchors('html')}) AS href FROM pages))"""

LINKS_ALL = """links_all AS (
    SELECT src, dst FROM raw_links UNION ALL SELECT src, dst FROM links)"""


def scrape_sql(src: str = "pages", now: str = NOW) -> str:
    kind, region = D.main_region("_doc")
    return f"""
    SELECT url, array_to_string(_blocks, chr(10) || chr(10)) AS text, title, description, scraped_at
    FROM (SELECT url, {D.kept_blocks(f'({region})')} AS _blocks, {D.title('_doc')} AS title,
                 {D.description('_doc')} AS description, TIMESTAMP '{now}' AS scraped_at
          FROM (SELECT url, {D.strip_boilerplate('html')} AS _doc FROM {src}))
    WHERE len(_blocks) > 0"""


SCRAPED = f"scraped AS ({scrape_sql()})"
