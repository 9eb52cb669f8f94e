"""SQL-text twins of the column functions, for the DuckDB oracle.

Simple patterns are those of quarry.functions. Element matching, blocks and character references
are written here on their own, as plain lazy matches and replacements that suffice for the given
tables; nested and rarer input is held to hand-made goldens in the tests.
"""

from __future__ import annotations

from quarry.functions import html as H
from quarry.functions import urls as U
from quarry.functions import validate as V
from quarry.functions.text import PY_WS, clean_drop_explicit

# The references that occur in the given tables, replaced one name at a time ("&amp;" last).
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"),
]
RAW_AND_COMMENTS = (r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>"
                    r"|<style\b[^>]*>.*?</style\s*>")
NUM_REF = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
# On the given pages, where no element is nested in one of its own name, a block ends at its own
# closing tag or at the close of a container.
BLOCK_END = (r"</(?:p|h[1-6]|div|article|section|main|body|html|li|ul|ol|table|tr|td|th"
             r"|blockquote|header|aside|form|dl|dt|dd)\s*>")


def q(s: str) -> str:
    """SQL string literal (control characters through chr())."""
    out, buf = [], []
    for ch in s:
        if ord(ch) < 32 and ch not in "\t\n\r":
            if buf:
                out.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            out.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not out:
        out.append("'" + "".join(buf).replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")" if len(out) > 1 else out[0]


def rr(x: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def rx(x: str, pat: str, grp: int = 1) -> str:
    return f"regexp_extract({x}, {q(pat)}, {grp})"


def rm(x: str, pat: str) -> str:
    return f"regexp_matches({x}, {q(pat)})"


def py_strip(x: str) -> str:
    return rr(x, rf"^{PY_WS}+|{PY_WS}+\z")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(PY_WS + '+')}), lambda w_: w_ <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def clean_text(x: str) -> str:
    return f"trim({rr(rr(x, PY_WS + '+', ' '), clean_drop_explicit())})"


def _num_ref_char(r: str) -> str:
    digits = rx(r, r"^&#[xX]?([0-9a-fA-F]+);")
    n = (f"(CASE WHEN {rm(r, '^&#[xX]')} THEN CAST(('0x' || {digits}) AS BIGINT) "
         f"ELSE CAST({digits} AS BIGINT) END)")
    valid = (f"({n} >= 32 AND {n} <> 127 AND NOT ({n} BETWEEN 128 AND 159) "
             f"AND NOT ({n} BETWEEN 55296 AND 57343) AND {n} <= 1114111)")
    return f"CASE WHEN {valid} THEN chr(CAST({n} AS INTEGER)) ELSE {r} END"


def decode_numeric_refs(x: str) -> str:
    pieces = f"string_split_regex({x}, {q(NUM_REF)})"
    refs = f"regexp_extract_all({x}, {q(NUM_REF)}, 0)"
    joined = (f"array_to_string(list_transform(list_zip({pieces}, {refs}), lambda z_: "
              f"coalesce(z_[1], '') || coalesce({_num_ref_char('z_[2]')}, '')), '')")
    return f"CASE WHEN contains({x}, '&#') THEN {joined} ELSE {x} END"


def decode_entities(x: str) -> str:
    for ent, ch in HTML_ENTITIES[:-1]:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    x = decode_numeric_refs(x)
    ent, ch = HTML_ENTITIES[-1]
    return f"replace({x}, {q(ent)}, {q(ch)})"


def strip_tags(x: str) -> str:
    return rr(x, r"<[A-Za-z/!?][^>]*>")


def strip_boilerplate(x: str) -> str:
    x = rr(x, RAW_AND_COMMENTS)
    for tag in H.BOILERPLATE_TAGS:
        x = rr(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>")
    return x


def _inner(x: str, open_re: str, tag: str) -> tuple[str, str]:
    pat = rf"(?is){open_re}(.*?)(?:</{tag}\s*>|\z)"
    return rm(x, pat), rx(x, pat)


def main_region(x: str) -> tuple[str, str]:
    """(kind, html) SQL expressions."""
    hm, m = _inner(x, r"<main\b[^>]*>", "main")
    ha, a = _inner(x, r"<article\b[^>]*>", "article")
    hd, d = _inner(x, r"""<div\b[^>]*\bclass\s*=\s*["']?[^"'>]*(?:content|main|article)[^>]*>""",
                   "div")
    kind = f"CASE WHEN {hm} THEN 'main' WHEN {ha} THEN 'article' WHEN {hd} THEN 'div' ELSE 'page' END"
    html = f"CASE WHEN {hm} THEN {m} WHEN {ha} THEN {a} WHEN {hd} THEN {d} ELSE {x} END"
    return kind, html


def block_texts(x: str) -> str:
    marked = f"regexp_replace({x}, {q('(?i)<(' + H.BLOCK_TAGS + r')\b')}, chr(1) || '<\\1', 'g')"
    pieces = f"string_split({marked}, chr(1))"
    inner = rx("p_", rf"(?is)^<[^>]*>(.*?)(?:{BLOCK_END}|\z)")
    return f"list_transform(({pieces})[2:], lambda p_: {decode_entities(strip_tags(inner))})"


def kept_blocks(x: str, min_words: int = 4) -> str:
    return (f"list_transform(list_filter({block_texts(x)}, lambda b_: "
            f"{word_count('b_')} >= {min_words}), lambda c_: {clean_text('c_')})")


def title(x: str) -> str:
    pat = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
    t = py_strip(decode_entities(strip_tags(rx(x, pat))))
    return f"CASE WHEN {rm(x, pat)} THEN {t} ELSE '' END"


def _attr(tag: str, name: str) -> str:
    dq = rx(tag, rf'(?is)\b{name}\s*=\s*"([^"]*)"')
    sq = rx(tag, rf"(?is)\b{name}\s*=\s*'([^']*)'")
    bare = rx(tag, rf"""(?is)\b{name}\s*=\s*([^\s"'>]+)""")
    return (f"CASE WHEN {rm(tag, rf'(?is)\b{name}\s*=\s*' + chr(34))} THEN {dq} "
            f"WHEN {rm(tag, rf'(?is)\b{name}\s*=\s*' + chr(39))} THEN {sq} ELSE {bare} END")


def _meta(x: str, attr: str, value: str) -> str:
    pat = rf"""(?is)<meta\b[^>]*\b{attr}\s*=\s*["']?{value}["'\s/>][^>]*>"""
    tag = rx(x, pat, 0)
    return f"CASE WHEN {rm(x, pat)} THEN {py_strip(decode_entities(_attr(tag, 'content')))} END"


def description(x: str) -> str:
    return (f"coalesce({_meta(x, 'name', 'description')}, "
            f"{_meta(x, 'property', 'og:description')}, '')")


def html_text(x: str) -> str:
    y = rr(x, RAW_AND_COMMENTS + r"|<!DOCTYPE[^>]*>|<\?[^>]*>")
    nodes = (f"list_filter(string_split(regexp_replace({y}, {q('<[A-Za-z/!][^>]*>')}, chr(1), 'g'),"
             f" chr(1)), lambda n_: n_ <> '')")
    joined = f"array_to_string(list_transform({nodes}, lambda e_: {decode_entities('e_')}), {q(chr(10) * 2)})"
    return rr(py_strip(joined), rf"\n{PY_WS}*\n", "\n\n")


def anchors(x: str) -> str:
    tags = f"regexp_extract_all({x}, {q(r'(?is)<a\s[^>]*>')}, 0)"
    with_href = f"list_filter({tags}, lambda t_: {rm('t_', r'(?is)\bhref\s*=')})"
    return f"list_transform({with_href}, lambda h_: {decode_entities(_attr('h_', 'href'))})"


# --- URLs ------------------------------------------------------------------------------

def prep_url(x: str) -> str:
    return rr(rr(x, r"[\t\r\n]"), r"^[\x00-\x20]+")


def url_netloc(x: str) -> str:
    return rx(prep_url(x), rf"^{U.SCHEME}://([^/?#]*)")


def url_scheme(x: str) -> str:
    return f"lower({rx(prep_url(x), rf'^({U.SCHEME}):')})"


def url_ok(x: str) -> str:
    return f"coalesce({rm(prep_url(x), rf'^{U.SCHEME}://[^/?#]')}, false)"


def validate_url_err(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN {q(U.URL_EMPTY)} "
            f"WHEN length({x}) > {U.URL_MAX_LEN} THEN {q(U.URL_TOO_LONG)} "
            f"WHEN NOT {url_ok(x)} THEN {q(U.URL_BAD_FORMAT)} "
            f"WHEN {url_scheme(x)} NOT IN ('http', 'https') THEN {q(U.URL_BAD_SCHEME)} "
            f"WHEN NOT {rm(url_netloc(x), U.DOMAIN_RE)} THEN {q(U.URL_BAD_DOMAIN)} END")


def is_content_link(x: str) -> str:
    return f"NOT {rm(f'lower({x})', U.NON_CONTENT_RE)}"


def file_type_of(x: str) -> str:
    return f"lower(string_split({x}, '.')[-1])"


def allowed_list() -> str:
    return "(" + ", ".join(q(e) for e in V.ALLOWED_EXTENSIONS) + ")"
