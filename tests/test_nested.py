"""Pages with nested elements, look-alike attributes and rare character references, against
results written by hand."""

import time
from html.entities import html5

from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions.arrays import let, running_fold
from quarry.functions.text import decode_entities


PAGES = [
    # (html, main region, page text of at least four words)
    ('<div class="content"><div>x</div><p>one two three four five</p></div><p>out of the region</p>',
     "div", "one two three four five"),
    ('<article><article><p>inner text of four</p></article><p>outer text of four</p></article>',
     "article", "inner text of four\n\nouter text of four"),
    ('<nav>menu <nav>sub menu</nav><p>still the menu here</p></nav><p>the text of page</p>',
     "page", "the text of page"),
    ('<div class="MainContent"><p>not the main part</p></div><div class="a main"><p>this is the part</p></div>',
     "div", "this is the part"),
    ('<div data-class="content"><p>first text of four</p></div><p>second text of four</p>',
     "page", "first text of four\n\nsecond text of four"),
    ('<main><p>before it <table><tr><td>x</td></tr></table> the tail</p></main>',
     "main", "before it x the tail"),
    ('<main><ul><li><p>one two three four</li></ul> not in the block</main>',
     "main", "one two three four"),
    ('<p>caf&eacute; M&uuml;ller &amp;eacute; &AMP &unknown; and &#00233;</p>',
     "page", "café Müller eacute  unknown and é"),
]


def test_nested_elements_and_references(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAGES)], "i int, html string")
    rows = df.select("i", H.main_region(H.strip_boilerplate("html"))["kind"].alias("kind"),
                     H.page_text("html").alias("text")).orderBy("i").collect()
    assert [(r.kind, r.text) for r in rows] == [(kind, text) for _, kind, text in PAGES]


def test_unclosed_and_stray_tags_stay(spark):
    cases = [("a<nav>b<nav>c</nav>d", "ad"), ("a<nav>b", "a<nav>b"), ("a</nav>b", "a</nav>b"),
             ("<NAV>x</Nav >y<navy>z</navy>", "y<navy>z</navy>"), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, html string")
    got = [r[0] for r in df.orderBy("i").select(H.strip_boilerplate("html")).collect()]
    assert got == [c[1] for c in cases]


def test_attributes_at_their_own_name(spark):
    row = spark.range(1).select(
        H.anchors(F.lit('<a data-href="/wrong" href="/right?a=1&copy=2">x</a><a data-href=x>')).alias("a"),
        H.description(F.lit('<meta data-name="description" content="no"><meta name="description" '
                            'data-content="no" content="caf&eacute;">')).alias("d")).first()
    assert row.a == ["/right?a=1&copy=2"] and row.d == "café"


def test_tags_in_attribute_values_are_no_tags(spark):
    html = ("""<title a="<title>no</title>">yes</title><meta content='1 > 0 "q"' name=description>"""
            """<a title="x > y" href="/r">r</a><img alt="<a href='/no'>"><a href=/b?c="d" t='>'>b</a>"""
            """<!-- <a href="/c"> --><script>"<a href='/s'>"</script><a title=it's href='/q'>q</a>"""
            """<a href>n</a><a HREF = "/u">u</a><area href="/area"><a href="/open>""")
    row = spark.range(1).select(H.anchors(F.lit(html)).alias("a"), H.title(F.lit(html)).alias("t"),
                                H.description(F.lit(html)).alias("d")).first()
    assert row.a == ["/r", '/b?c="d"', "/q", "/u"]
    assert (row.t, row.d) == ("yes", '1 > 0 "q"')
    cases = [
        ('<div data-t="a > b" class="main">x<p t="</p>">one two three four</p></div>y',
         "div", 'x<p t="</p>">one two three four</p>'),
        ('<div t="class=content"><p>a</p></div>', "page", None),
        ("<main t='</main>'><main>a</main>b</main>c", "main", "<main>a</main>b"),
        ('<div class=content><img alt="</div>">z</div>', "div", '<img alt="</div>">z'),
        ("<article>never closed <div>", "article", "never closed <div>")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, html string")
    got = df.orderBy("i").select(H.main_region("html").alias("r")).collect()
    assert [(r.r.kind, r.r.html) for r in got] == [(k, h or c) for c, k, h in cases]
    strip = [('a<nav t="</nav>">b</nav>c', "ac"), ('<i t="<nav>">a</i><nav/>b', '<i t="<nav>">a</i>b'),
             ("<nav><footer></nav>text</footer>", "text</footer>"), ("<iframe><nav></iframe>t", "t"),
             ('<p t="<!--">a</p>b<!-- c -->', '<p t="<!--">a</p>b')]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(strip)], "i int, html string")
    got = [r[0] for r in df.orderBy("i").select(H.strip_boilerplate("html")).collect()]
    assert got == [c[1] for c in strip]


def test_running_folds_of_any_length(spark):
    for n in (0, 1, 63, 64, 65, 4096, 4097, 9000):
        steps = [(i * 7919 % 5) - 2 for i in range(n)]
        row = spark.createDataFrame([(steps,)], "a array<int>").select(let("a", lambda a: running_fold(
            a, F.lit(0), lambda s, v: F.greatest(s + v, F.lit(0)))).alias("f")).first()
        want, s = [], 0
        for v in steps:
            want.append(s := max(s + v, 0))
        assert row.f == want


def test_work_grows_with_the_page(spark):
    """A page of 32,000 tags, nested or side by side, within seconds; it was minutes by folds that
    copied an array at every tag."""
    text = "<p>one two three four five</p>"
    pages = ["<div class=content>" + "<div>" * 16000 + text + "</div>" * 16001,
             "<nav>" * 16000 + "</nav>" * 16000 + text, "<nav>x</nav>" * 16000 + text]
    df = spark.createDataFrame([(p,) for p in pages], "html string").repartition(3)
    began = time.time()
    assert [r.t for r in df.select(H.page_text("html").alias("t")).collect()] == [
        "one two three four five"] * 3
    assert time.time() - began < 40


def test_references_follow_the_public_table(spark):
    names = [n for n in html5 if n.endswith(";")]
    df = spark.createDataFrame([(f"&{n}", html5[n]) for n in names], "ref string, want string")
    assert df.filter(decode_entities("ref") != F.col("want")).count() == 0
    odd = ["&#99999999999999999999;", "&#x;", "&amp;lt;", "&#xD800;", "&#65", "a&b", "&;", "&#0;"]
    got = [r[0] for r in spark.createDataFrame([(i, o) for i, o in enumerate(odd)], "i int, o string")
           .orderBy("i").select(decode_entities("o")).collect()]
    assert got == ["&#99999999999999999999;", "&#x;", "&lt;", "&#xD800;", "A", "a&b", "&;", "&#0;"]
