"""HTML column functions (E3, W4, W8-W12) as native regular-expression and array pipelines.

The page is never parsed into a tree: a scrape of millions of pages is one narrow stage. Tags are
scanned with their attributes, so a ``<`` or ``>`` inside a value is no tag (BODY). Elements are
matched by depth: the page is cut into the tags of some names and the pieces between them, and
depths are running sums over the array of tags, so the work grows with the page. Documented
deviations from a tree parser: an element to remove that is never closed stays, and an unclosed
<p> ends at the next block tag or at the close of the container around it instead of swallowing
the rest of the page (each text node belongs to its nearest block).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.arrays import let, running_fold
from quarry.functions.text import PY_WS, clean_text, col_, decode_entities, py_strip, word_count

MARK = "\x01"
# What follows a tag's name: everything up to the first ">" outside a quoted attribute value.
# Quotes count after "=" only; a quote that is never closed is an ordinary character.
BODY = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
ANY_TAG = rf"</?[A-Za-z]{BODY}>"
# An attribute with a value; its name is read where an attribute may start ("data-href" is
# another attribute than "href").
ATTRIBUTE = (r"""(?s)(?<=[\s"'/])[^\s"'<>/=]++\s*+=\s*+"""
             r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)""")

# Raw-text elements and comments are found together, leftmost first, like a parser does.
RAW_AND_COMMENTS = (rf"(?is)<!--.*?-->|<script(?=[\s/>]){BODY}>.*?</script\s*>"
                    rf"|<style(?=[\s/>]){BODY}>.*?</style\s*>")
# Subtrees removed before any extraction, in the order applied.
BOILERPLATE_TAGS = ["iframe", "nav", "footer"]
BLOCK_TAGS = r"p|h[1-6]"
# Elements whose close ends an unclosed block inside them.
CONTAINER_TAGS = (r"div|article|section|main|body|html|li|ul|ol|table|tr|td|th"
                  r"|blockquote|header|aside|form|dl|dt|dd")
# What marks the class of a div that may hold the main text.
MAIN_WORD = "content|main|article"


def _without_raw(x: Column, more: str = "") -> Column:
    """The page without scripts, styles, comments and what ``more`` matches. Other tags are matched
    too, and kept, so that nothing in an attribute value is taken for one of these."""
    return F.regexp_replace(x, rf"{RAW_AND_COMMENTS}{more}|({ANY_TAG})", "$1")


def _pieces(x: Column, names: str) -> Column:
    """The page as its opening and closing tags of ``names`` and the texts between them."""
    named = rf"/?(?:{names})(?=[\s/>])"
    return F.regexp_extract_all(x, F.lit(
        rf"(?is)<{named}{BODY}>|(?:[^<]++|<(?!{named})(?:/?[a-z]{BODY}>)?+)++|<"), F.lit(0))


def _key(piece: Column, names: str) -> Column:
    """``name`` of an opening tag, ``/name`` of a closing one, ``name/`` of one that closes itself,
    '' of a text."""
    name = F.lower(F.regexp_extract(piece, rf"(?i)^<(/?(?:{names}))(?=[\s/>])", 1))
    return F.when((name != "") & piece.endswith("/>"), F.concat(name, F.lit("/"))).otherwise(name)


def _keyed(x: Column, names: str) -> Column:
    return F.transform(_pieces(x, names), lambda p: F.struct(
        p.alias("piece"), _key(p, names).alias("key")))


def strip_boilerplate(c) -> Column:
    """Remove script, style, comments, then iframe, nav and footer subtrees."""
    names = "|".join(BOILERPLATE_TAGS)

    def kept(x: Column) -> Column:
        left = F.aggregate(F.array(*(F.lit(t) for t in BOILERPLATE_TAGS)), _keyed(x, names),
                           _without_element)
        return F.when(x.rlike(rf"(?i)<(?:{names})[\s/>]"), F.array_join(
            F.transform(left, lambda s: s["piece"]), "")).otherwise(x)
    return let(_without_raw(col_(c)), kept)


def _without_element(pieces: Column, tag: Column) -> Column:
    """The pieces without the elements ``tag``, nested ones included. A closing tag without an
    opening one stays, and so does what follows the last closing tag inside an element that is
    never closed."""
    closing, zero = F.concat(F.lit("/"), tag), F.lit(0)

    def deeper(depth: Column, s: Column) -> Column:
        return F.when(s["key"] == tag, depth + 1).when(
            s["key"] == closing, F.greatest(depth - 1, zero)).otherwise(depth)

    def kept(t: Column) -> Column:
        # The depth before a closing tag is one more than after it, or both are zero.
        ends = F.transform(pieces, lambda s, i: (s["key"] == closing) & (F.coalesce(
            F.get(t, i - 1), zero) > 0))
        return let(ends, lambda e: let(
            F.size(e) - F.array_position(F.reverse(e), F.lit(True)).cast("int"),
            lambda last: F.filter(pieces, lambda s, i: ~(
                (s["key"] == F.concat(tag, F.lit("/"))) | ((i <= last) & (last < F.size(e))
                                                           & ((F.get(t, i) > 0) | F.get(e, i)))))))
    some = F.exists(pieces, lambda s: (s["key"] == closing) | (s["key"] == F.concat(
        tag, F.lit("/"))))
    return F.when(some, let(running_fold(pieces, zero, deeper), kept)).otherwise(pieces)


def _upto_close(keys: Column, name: Column) -> Column:
    """How many of the pieces stand before the closing tag of ``name`` that none of them opened."""
    def step(s: Column, k: Column) -> Column:
        depth = F.when(s["depth"] < 0, -1).when(k == F.concat(F.lit("/"), name), s["depth"] - 1).when(
            k == name, s["depth"] + 1).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), (s["n"] + F.when(depth < 0, 0).otherwise(1)).alias("n"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))
    return F.aggregate(keys, start, step, lambda s: s["n"])


def main_region(c) -> Column:
    """struct(kind, html) - first <main>, else first <article>, else the first <div> whose
    class contains content|main|article (in lower case), else the whole page."""
    def region(x: Column) -> Column:
        some = x.rlike(r"(?i)<(?:main|article|div)[\s/>]")
        found = let(_keyed(x, "main|article|div"), lambda p: let(best(p), lambda b: inner(p, b)))
        return F.coalesce(F.when(some, found),
                          F.struct(F.lit("page").alias("kind"), x.alias("html")))

    def best(p: Column) -> Column:
        """kind, and the place of the opening tag (from 1): the least rank, then the first."""
        ranks = F.transform(p, lambda s, i: F.struct(
            F.when(s["key"] == "main", 0).when(s["key"] == "article", 1).when(
                (s["key"] == "div") & _attr(s["piece"], "class").rlike(MAIN_WORD), 2).alias("rank"),
            (i + 1).alias("at"), s["key"].alias("kind")))
        return F.array_min(F.filter(ranks, lambda r: r["rank"].isNotNull()))

    def inner(p: Column, b: Column) -> Column:
        after = F.transform(F.slice(p, b["at"] + 1, F.size(p)), lambda s: s["key"])
        inside = F.slice(p, b["at"] + 1, _upto_close(after, b["kind"]))
        return F.when(b.isNotNull(), F.struct(b["kind"].alias("kind"), F.array_join(
            F.transform(inside, lambda s: s["piece"]), "").alias("html")))
    return let(col_(c), region)


def block_texts(c) -> Column:
    """W10 input: text of every p/h1-h6 block in document order (tags dropped, entities
    decoded, not yet cleaned)."""
    # Without attributes, no value is taken for a tag below.
    bare = F.regexp_replace(col_(c), rf"(?i)<(/?[a-z][^\s/>]*+){BODY}>", "<$1>")
    marked = F.regexp_replace(bare, rf"(?i)<({BLOCK_TAGS})>", MARK + "<$1>")
    pieces = F.split(marked, MARK)
    blocks = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    inner = F.transform(blocks, lambda p: _before_container_close(
        F.regexp_extract(p, rf"(?is)^<[^>]*>(.*?)(?:</(?:{BLOCK_TAGS})>|\z)", 1)))
    return F.transform(inner, lambda p: decode_entities(
        F.regexp_replace(p, r"<[A-Za-z/!?][^>]*>", "")))


def _before_container_close(x: Column) -> Column:
    """The text of a block up to the close of a container that was opened before the block."""
    def cut(p: Column) -> Column:
        # Any container's close ends what the last container opened, as in the page's nesting.
        keys = F.transform(p, lambda t: F.when(t.rlike(rf"(?i)^</(?:{CONTAINER_TAGS})>"), "/c").when(
            t.rlike(rf"(?i)^<(?:{CONTAINER_TAGS})>"), "c").otherwise(""))
        return F.array_join(F.slice(p, F.lit(1), _upto_close(keys, F.lit("c"))), "")
    return F.when(x.rlike(rf"(?i)</(?:{CONTAINER_TAGS})>"),
                  let(_pieces(x, CONTAINER_TAGS), cut)).otherwise(x)


def kept_blocks(c, min_words: int = 4) -> Column:
    """W10 + W11: blocks with at least ``min_words`` whitespace words, each cleaned."""
    return F.transform(F.filter(block_texts(c), lambda b: word_count(b) >= min_words),
                       clean_text)


def page_text(c, min_words: int = 4) -> Column:
    """W10-W13 on raw HTML: the cleaned blocks of the main region joined by blank lines;
    NULL when no block is kept (the page yields no result)."""
    return let(kept_blocks(main_region(strip_boilerplate(c))["html"], min_words),
               lambda b: F.when(F.size(b) > 0, F.array_join(b, "\n\n")))


def _attr(tag: Column, name: str) -> Column:
    """The value of the first attribute ``name`` that has one; null without."""
    of_name = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)),
                       lambda a: a.rlike(rf"(?i)^{name}\s*="))
    value = F.regexp_replace(F.get(of_name, F.lit(0)), r"(?s)^[^=]*+=\s*+", "")
    return F.regexp_replace(value, r"""(?s)^"([^"]*)"$|^'([^']*)'$""", "$1$2")


def _tags(x: Column, name: str) -> Column:
    """All opening tags ``name`` in page order; tags inside attribute values are none."""
    found = F.regexp_extract_all(x, F.lit(rf"(?i)(<{name}(?=[\s/>]){BODY}>)|{ANY_TAG}"), F.lit(1))
    return F.filter(found, lambda t: t != "")


def title(c) -> Column:
    """W12 title: first <title> text, entities decoded, stripped; '' when absent."""
    x = col_(c)
    pat = rf"<title(?=[\s/>]){BODY}>(.*?)</title\s*>"
    # Tags before it are matched too: a title in an attribute value is none.
    found = F.filter(F.regexp_extract_all(x, F.lit(rf"(?is)({pat})|{ANY_TAG}"), F.lit(1)),
                     lambda t: t != "")
    inner = F.regexp_extract(F.get(found, F.lit(0)), rf"(?is){pat}", 1)
    t = py_strip(decode_entities(F.regexp_replace(inner, ANY_TAG + "|<[!?][^>]*>", "")))
    return F.when(x.isNotNull(), F.coalesce(t, F.lit("")))


def description(c) -> Column:
    """W12 description: meta name=description, else property=og:description; ''."""
    x = col_(c)

    def told(metas: Column) -> Column:
        def first(attr: str, value: str) -> Column:
            return F.get(F.transform(F.filter(metas, lambda t: F.lower(_attr(t, attr)) == value),
                                     lambda t: F.coalesce(_attr(t, "content"), F.lit(""))), F.lit(0))
        return F.coalesce(first("name", "description"), first("property", "og:description"),
                          F.lit(""))
    return F.coalesce(py_strip(decode_entities(let(_tags(x, "meta"), told))), F.lit(""))


def html_text(c) -> Column:
    """Text nodes joined by blank lines, stripped, blank-line runs collapsed."""
    x = _without_raw(col_(c), r"|<!DOCTYPE[^>]*>|<\?[^>]*>")
    nodes = F.filter(F.split(F.regexp_replace(x, rf"(?i)<[a-z/!]{BODY}>", MARK), MARK),
                     lambda n: n != "")
    joined = F.array_join(F.transform(nodes, decode_entities), "\n\n")
    return F.regexp_replace(py_strip(joined), rf"\n{PY_WS}*\n", "\n\n")


def anchors(c) -> Column:
    """W4 input: href values of every <a> that has one, entity-decoded, in page order."""
    hrefs = F.transform(_tags(_without_raw(col_(c)), "a"), lambda t: _attr(t, "href"))
    return F.transform(F.filter(hrefs, lambda h: h.isNotNull()), decode_entities)
