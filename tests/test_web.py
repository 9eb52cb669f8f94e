"""Web operators: goldens (FIXTURES §3, W*) and properties."""

import re
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions.text import clean_text
from quarry.functions.urls import resolve_urls, validate_url
from quarry.operators import web
from quarry.plans.crawl import crawl


def py_clean(text):
    text = re.sub(r"\s+", " ", text)
    text = re.sub(r"[^\w\s.,!?-]", "", text)
    return text.strip()


def test_w2_strict_url_messages(spark):
    urls = ["", "http://a.com/" + "a" * 2036, "x", "ftp://a.com", "http://localhost",
            "http://a.com:80", "https://a.co"]
    assert len(urls[1]) == 2049
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [r["r"] for r in df.select("i", validate_url("u").alias("r")).orderBy("i").collect()]
    assert [(r.ok, r.error) for r in got] == [
        (False, "URL cannot be empty"), (False, "URL is too long"),
        (False, "Invalid URL format"), (False, "URL must start with http:// or https://"),
        (False, "Invalid domain name"), (False, "Invalid domain name"), (True, "")]


def test_w4_resolution_matches_urljoin(spark):
    base = "http://h/a/b"
    hrefs = ["../c", "//o/x", "?q=1", "#f", "mailto:z", "/r", "c", "./d", "", "http:e"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "src string, href string")
    got = dict((r.href, r.dst) for r in resolve_urls(df, "src", "href", "dst").collect())
    assert got == {h: urljoin(base, h) for h in hrefs}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"\A(/|\.\./|\./|//|\?|#)?[a-z0-9./?#=_-]{0,12}\Z"), min_size=1,
                max_size=40))
def test_w4_property_urljoin(spark, hrefs):
    base = "https://ex.org/p/q/r?x=1#y"
    df = spark.createDataFrame([(i, base, h) for i, h in enumerate(hrefs)],
                               "i int, src string, href string")
    got = {r.i: r.dst for r in resolve_urls(df, "src", "href", "dst").collect()}
    assert got == {i: urljoin(base, h) for i, h in enumerate(hrefs)}


def test_w6_content_filter(spark):
    df = spark.createDataFrame([("http://h/", "http://h" + p) for p in
                                ["/data.json", "/p#x", "/search/1", "/ok"]], "src string, dst string")
    assert [r.dst for r in web.content_links(df).collect()] == ["http://h/ok"]


LONG = "one two three four"


def test_w9_region_order(spark):
    pages = {
        "main": f"<main><p>{LONG} main</p></main><article><p>{LONG} art</p></article>",
        "article": f"<p>{LONG} out</p><article><p>{LONG} art</p></article>",
        "div": f'<p>{LONG} out</p><div class="x main-content"><p>{LONG} div</p></div>',
        "page": f"<p>{LONG} page</p>",
    }
    df = spark.createDataFrame(list(pages.items()), "kind string, html string")
    got = {r.kind: (r.k, r.t) for r in df.select(
        "kind", H.main_region("html")["kind"].alias("k"), H.page_text("html").alias("t")).collect()}
    assert got == {"main": ("main", f"{LONG} main"), "article": ("article", f"{LONG} art"),
                   "div": ("div", f"{LONG} div"), "page": ("page", f"{LONG} page")}


def test_w10_min_words(spark):
    df = spark.createDataFrame([("<p>one two three</p><p>one two three four</p>",)], "html string")
    assert df.select(H.page_text("html")).first()[0] == "one two three four"


def test_w11_clean_golden_and_property(spark):
    s = "½ ² ① x\u001cy"
    samples = [s, "  a\tb\n\nc  ", "Héllo, wörld_1 @#$ ok?!", "a - b ; c", " x　y",
               "tab\there", "emoji 🙂 here", "x.y,z!", "", "日本語 テキスト", "áb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text("t").alias("c")).collect()}
    assert got[0] == "½ ² ① x y"
    assert got == {i: py_clean(t) for i, t in enumerate(samples)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=60))
def test_w11_property(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text("t").alias("c")).collect()}
    assert got == {i: py_clean(t) for i, t in enumerate(texts)}


def test_w12_og_description(spark):
    html = '<head><title> T &amp; U </title><meta property="og:description" content="  d  "></head>'
    df = spark.createDataFrame([("http://h/", html)], "url string, html string")
    r = web.page_metadata(df, now="2024-01-01 00:00:00").first()
    assert (r.title, r.description) == ("T & U", "d")


def test_e3_and_w8(spark):
    df = spark.createDataFrame([("<script>x</script><p>a</p><p>b</p>",)], "h string")
    assert df.select(H.html_text("h")).first()[0] == "a\n\nb"
    df2 = spark.createDataFrame([("<nav><a href='/x'>x</a></nav><footer>f</footer><p>k</p>",)], "h string")
    assert df2.select(H.strip_boilerplate("h")).first()[0] == "<p>k</p>"


def _pages(spark, items):
    return spark.createDataFrame(items, "url string, html string")


def test_w13_empty_page_not_followed(spark):
    body = f"<p>{LONG}</p>"
    pages = _pages(spark, [("http://h/a", body), ("http://h/b", "<p>too short</p><a href='/c'>c</a>"),
                           ("http://h/c", body)])
    links = spark.createDataFrame([("http://h/a", "http://h/b"), ("http://h/b", "http://h/c")],
                                  "src string, dst string")
    assert [r.url for r in web.scrape(pages).collect()] == ["http://h/a", "http://h/c"]
    got = crawl(pages, links, ["http://h/a"]).collect()
    assert [(r.url, r.depth) for r in got] == [("http://h/a", 0)]


def test_w15_cycle_dead_link_and_cap(spark):
    body = f"<p>{LONG}</p>"
    pages = _pages(spark, [("http://h/a", body), ("http://h/b", body), ("http://h/d", body)])
    links = spark.createDataFrame(
        [("http://h/a", "http://h/b"), ("http://h/b", "http://h/a"),
         ("http://h/a", "http://h/dead"), ("http://h/b", "http://h/d"),
         ("http://h/a", "http://other/x")], "src string, dst string")
    full = [(r.url, r.depth) for r in crawl(pages, links, ["http://h/a"]).orderBy("rank").collect()]
    assert full == [("http://h/a", 0), ("http://h/b", 1), ("http://h/d", 2)]
    one = crawl(pages, links, ["http://h/a"], max_pages=1).collect()
    two = crawl(pages, links, ["http://h/a"], max_pages=2).collect()
    assert [r.url for r in one] == ["http://h/a"]
    assert sorted(r.url for r in two) == ["http://h/a", "http://h/b"]


def test_w15_stops_level_by_level(spark):
    body = f"<p>{LONG}</p>"
    urls = [f"http://h/{i:04d}" for i in range(1, 256)]
    pages = _pages(spark, [(u, body) for u in urls])
    links = spark.createDataFrame(
        [(f"http://h/{i:04d}", f"http://h/{j:04d}") for i in range(1, 256)
         for j in (2 * i, 2 * i + 1)], "src string, dst string")
    got = crawl(pages, links, [urls[0]], max_pages=5).orderBy("rank").collect()
    assert [(r.url, r.rank) for r in got] == [(u, i + 1) for i, u in enumerate(urls[:5])]
    whole = crawl(pages, links, [urls[0], urls[2]]).collect()
    assert sorted((r.url, r.rank) for r in whole if r.start == urls[0]) == [
        (u, i + 1) for i, u in enumerate(urls)]
    assert sorted(r.rank for r in whole if r.start == urls[2]) == list(range(1, 128))


def test_w15_invalid_start(spark):
    import pytest
    pages = _pages(spark, [("http://h/a", "<p>x</p>")])
    links = spark.createDataFrame([], "src string, dst string")
    with pytest.raises(ValueError):
        crawl(pages, links, ["not a url"])


def test_w4_nav_links_not_followed_by_default(spark):
    pages = _pages(spark, [("http://h/a", "<nav><a href='/n'>n</a></nav><p><a href='/b'>b</a></p>")])
    assert [r.dst for r in web.raw_links(pages).collect()] == ["http://h/b"]
    assert sorted(r.dst for r in web.raw_links(pages, follow_nav=True).collect()) == [
        "http://h/b", "http://h/n"]


def test_scrape_plan_runs_blocks_once(spark):
    pages = _pages(spark, [("http://h/a", f"<p>{LONG}</p>")])
    plan = web.scrape(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan and "Python" not in plan


def test_numeric_references_match_unescape(spark):
    import html as pyhtml
    import duckdb
    from quarry.functions.text import decode_entities
    from quarry.registry import duck as D
    samples = ["caf&#233; &#xE9;t&#xe9;", "&#128578; x", "&#0; &#x80; keep", "a &amp;#233; b",
               "no refs", "&lt;p&gt; &#60;", "&#9999999;", "&#x10FFFF;"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: r.d for r in df.select("i", decode_entities("s").alias("d")).collect()}
    for i in (0, 1, 3, 4, 5):
        assert got[i] == pyhtml.unescape(samples[i]), samples[i]
    assert got[2] == "&#0; &#x80; keep" and got[6] == "&#9999999;"
    con = duckdb.connect()
    for i, s in enumerate(samples):
        assert con.execute(f"SELECT {D.decode_entities(D.q(s))}").fetchone()[0] == got[i]
