"""Column functions for text: whitespace, words, cleaning, HTML entities.

All of them are native Spark expressions (regexp_replace / split / transform), so they stay
inside whole-stage code generation.
"""

from __future__ import annotations

import functools
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's notion of whitespace (str.isspace / re's \s on str): ASCII controls \t-\r, the
# information separators U+001C-U+001F, NEL U+0085 and every Unicode separator (Z*).
PY_WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"

def _ranges(cps: list[int]) -> str:
    parts, start, prev = [], None, None
    for cp in cps:
        if start is not None and cp == prev + 1:
            prev = cp
            continue
        if start is not None:
            parts.append((start, prev))
        start = prev = cp
    if start is not None:
        parts.append((start, prev))
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in parts)


@functools.lru_cache(maxsize=1)
def _python_word_codepoints() -> tuple[int, ...]:
    """Python's \\w: str.isalnum() or '_', from the running Python's Unicode tables."""
    return tuple(cp for cp in range(0x110000)
                 if not 0xD800 <= cp <= 0xDFFF and (chr(cp).isalnum() or cp == 0x5F))




def clean_drop_explicit() -> str:
    return "[^ .,!?\\-" + _ranges(list(_python_word_codepoints())) + "]"


@functools.lru_cache(maxsize=1)
def clean_drop_jvm() -> str:
    """The same class for Java's regex engine: the fast \\p{L}\\p{N}_ plus the code points
    Python counts as word characters but the JVM's (older) Unicode tables do not. The delta
    is found once, on the driver, by one replaceAll in the JVM itself."""
    base = "[^ .,!?\\-\\p{L}\\p{N}_"
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    if sc is None:
        return base + "]"
    word = "".join(chr(cp) for cp in _python_word_codepoints())
    pattern = sc._jvm.java.util.regex.Pattern.compile("[\\p{L}\\p{N}_]")
    rest = pattern.matcher(word).replaceAll("")
    return base + _ranges(sorted({ord(ch) for ch in rest})) + "]"


@functools.lru_cache(maxsize=1)
def _named_refs() -> str:
    """The public table of named character references (``name;`` and the legacy ``name``) as one
    string for ``str_to_map``."""
    return "\x02".join(f"{name}\x03{chars}" for name, chars in html5.items())


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """str.strip(): remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col_(c), rf"^{PY_WS}+|{PY_WS}+\z", "")


def words(c) -> Column:
    """str.split(): the whitespace-separated words, empty pieces dropped."""
    return F.filter(F.split(col_(c), rf"{PY_WS}+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def collapse_ws(c) -> Column:
    return F.regexp_replace(col_(c), rf"{PY_WS}+", " ")


def clean_text(c) -> Column:
    """Whitespace runs to one space, drop characters outside [\\w\\s.,!?-], strip.

    The deletion runs after the collapse, so the only whitespace left is ' ' and trim()
    (spaces) equals Python's strip() here; double spaces left by the deletion stay.
    """
    return F.trim(F.regexp_replace(collapse_ws(c), clean_drop_jvm(), ""))


# A character reference: numeric, or a name. Without its semicolon it counts only where no "="
# or alphanumeric follows, so that a query string's "&copy=1" stays.
CHAR_REF = (r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*)"
            r"(?:;|(?![=;A-Za-z0-9]))")


def _num_ref_char(r: Column) -> Column:
    """'&#233;' / '&#xE9;' → 'é'; a reference to an invalid or control code point is kept
    as written."""
    digits = F.regexp_extract(r, r"^&#[xX]?0*([0-9a-fA-F]{1,7});?\z", 1)
    n = F.when(digits == "", F.lit(0)).when(
        r.rlike(r"^&#[xX]"), F.conv(digits, 16, 10).cast("bigint")).otherwise(
        digits.try_cast("bigint"))
    valid = ((n >= 32) & (n != 127) & ~n.between(0x80, 0x9F) & ~n.between(0xD800, 0xDFFF)
             & (n <= 0x10FFFF))
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "utf-32")).otherwise(r)


def _ref_char(r: Column) -> Column:
    named = F.str_to_map(F.lit(_named_refs()), F.lit("\x02"), F.lit("\x03"))
    return F.when(r.startswith("&#"), _num_ref_char(r)).otherwise(
        F.coalesce(F.try_element_at(named, F.substring(r, 2, 64)), r))


def decode_entities(c) -> Column:
    """Character references decoded natively in one pass: the text is split at the references
    and the pieces are zipped with the characters they name (no per-element re-evaluation; an
    escaped ampersand is never decoded twice). Unknown names are kept as written."""
    x = col_(c)
    pieces = F.split(x, CHAR_REF)
    refs = F.regexp_extract_all(x, F.lit(CHAR_REF), 0)
    joined = F.array_join(F.zip_with(pieces, refs, lambda p, r: F.concat(
        F.coalesce(p, F.lit("")), F.coalesce(_ref_char(r), F.lit("")))), "")
    return F.when(F.contains(x, F.lit("&")), joined).otherwise(x)


def strip_tags(c) -> Column:
    """Drop every tag; text nodes are concatenated as get_text() does."""
    return F.regexp_replace(col_(c), r"<[A-Za-z/!?][^>]*>", "")
