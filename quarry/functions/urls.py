"""URL column functions (W1-W4, W6): shape check, strict validation, host, resolution.

Python's urlsplit is followed where it matters: tabs and newlines are removed, leading C0
controls and spaces are stripped, the scheme is matched case-insensitively and the netloc runs
to the first '/', '?' or '#'.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import col_

SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"

# The strict check's messages, in the order they are tested, and its domain pattern.
URL_EMPTY = "URL cannot be empty"
URL_TOO_LONG = "URL is too long"
URL_BAD_FORMAT = "Invalid URL format"
URL_BAD_SCHEME = "URL must start with http:// or https://"
URL_BAD_DOMAIN = "Invalid domain name"
URL_MAX_LEN = 2048
DOMAIN_RE = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"

# Substrings that mark a link as non-content (matched on the lower-cased URL).
NON_CONTENT_PATTERNS = [
    ".pdf", ".jpg", ".png", ".gif", ".css", ".js", "#", "mailto:", "tel:", "javascript:",
    "/tag/", "/category/", "/author/", "/search",
]


def _escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch for ch in s)


NON_CONTENT_RE = "|".join(_escape(p) for p in NON_CONTENT_PATTERNS)


def prep_url(c) -> Column:
    """urlsplit's input cleaning: drop tab/CR/LF anywhere, strip leading controls and spaces."""
    return F.regexp_replace(F.regexp_replace(col_(c), r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def url_scheme(c) -> Column:
    return F.lower(F.regexp_extract(prep_url(c), rf"^({SCHEME}):", 1))


def url_netloc(c) -> Column:
    """Netloc including userinfo and port, case kept ('' when there is none)."""
    return F.regexp_extract(prep_url(c), rf"^{SCHEME}://([^/?#]*)", 1)


url_host = url_netloc  # W3: the crawl compares the raw netloc


def url_ok(c) -> Column:
    """Scheme and netloc both non-empty."""
    return F.coalesce(prep_url(c).rlike(rf"^{SCHEME}://[^/?#]"), F.lit(False))


def validate_url(c) -> Column:
    """Ordered checks returning struct(ok, error)."""
    u = col_(c)
    err = (F.when(u.isNull() | (u == ""), F.lit(URL_EMPTY))
           .when(F.length(u) > URL_MAX_LEN, F.lit(URL_TOO_LONG))
           .when(~url_ok(u), F.lit(URL_BAD_FORMAT))
           .when(~url_scheme(u).isin("http", "https"), F.lit(URL_BAD_SCHEME))
           .when(~url_netloc(u).rlike(DOMAIN_RE), F.lit(URL_BAD_DOMAIN)))
    return F.struct(err.isNull().alias("ok"), F.coalesce(err, F.lit("")).alias("error"))


def is_content_link(c) -> Column:
    """False when the lower-cased URL contains any non-content pattern."""
    return ~F.lower(col_(c)).rlike(NON_CONTENT_RE)


# --- W4: resolution against a base URL -------------------------------------------------

# hrefs whose resolution needs dot-segment or empty-segment handling, or that urlunparse
# would re-serialise (empty query/fragment, params, scheme-carrying relative forms).
_COMPLEX_HREF = r"(^|/)\.\.?($|[/?#])|.//|[?#]$|\?#|;"


def _native_resolve(base: Column, href: Column) -> Column:
    origin = F.regexp_extract(base, rf"^({SCHEME}://[^/?#]*)", 1)
    bscheme = F.lower(F.regexp_extract(base, rf"^({SCHEME}):", 1))
    bpath = F.regexp_extract(base, rf"^{SCHEME}://[^/?#]*([^?#]*)", 1)
    bquery = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    bdir = F.regexp_extract(bpath, r"^(.*/)", 1)
    base_simple = ~bpath.rlike(r"//|(^|/)\.\.?(/|$)")
    hscheme = F.lower(F.regexp_extract(href, rf"^({SCHEME}):", 1))
    return (
        F.when(href == "", base)
        .when((hscheme != "") & (hscheme != bscheme), href)
        .when(hscheme != "", F.lit(None))  # same scheme: urlunparse re-serialises, use stdlib
        .when(href.rlike(_COMPLEX_HREF), F.lit(None))
        .when(href.rlike(r"^//[^/?#]"), F.concat(bscheme, F.lit(":"), href))
        .when(href.startswith("//"), F.lit(None))  # empty netloc: stdlib
        .when(href.startswith("/"), F.concat(origin, href))
        .when(~base_simple, F.lit(None))
        .when(href.startswith("?"), F.concat(origin, bpath, href))
        .when(href.startswith("#"), F.concat(origin, bpath, bquery, href))
        .otherwise(F.concat(origin, F.when(bdir == "", F.lit("/")).otherwise(bdir), href))
    )


def _urljoin_batch(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    out = []
    for b, h in zip(base, href):
        try:
            out.append(None if b is None or h is None else urljoin(b, h))
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)


def resolve_urls(df: DataFrame, base: str, href: str, out: str) -> DataFrame:
    """Add ``out`` = urljoin(base, href). Native for the common forms; rows that need dot-segment
    removal go through an Arrow-batched stdlib call. The input is read once: a resolved row
    crosses to the Python worker as nulls."""
    native = df.withColumn(out, _native_resolve(F.col(base), prep_url(href)))
    rest = F.when(F.col(out).isNull(), F.col(base))
    joined = F.pandas_udf(_urljoin_batch, "string")(rest, F.when(F.col(out).isNull(), F.col(href)))
    return native.withColumn(out, F.coalesce(F.col(out), joined))
