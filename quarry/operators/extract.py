"""Text extraction over a ``files`` table.

``extract_text(files)`` dispatches on ``file_type`` (lower-cased). Text formats (txt, md,
html/htm, rtf) and PNG headers are decoded by native expressions; JSON, XML, CSV, DOCX and
JPEG go through Arrow-batched stdlib parsers; PDF and any other format use a caller-supplied
decoder (``extractors={"pdf": fn}``). One pass over the input: the Python parser receives the
bytes only of the rows it must parse (NULL for the others) and a single projection picks the
native or parsed result. Failures become an ``error`` column, never text.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.html import html_text
from quarry.functions.text import col_, decode_entities, py_strip

MARK = "\x01"
NATIVE_TYPES = ["txt", "md", "html", "htm", "rtf", "png"]
PYTHON_TYPES = ["json", "xml", "csv", "docx", "jpg", "jpeg"]
# The handler table's keys (zip is an allowed upload type with no handler).
HANDLED_TYPES = ["pdf", "docx", "jpg", "jpeg", "png", "json", "xml", "csv", "md", "txt", "html",
                 "htm", "rtf"]
IMAGE_DESCRIPTIONS_HEADER = "\n\nImage Descriptions:\n"
UTF8_ERROR = "Invalid UTF-8 text"


def unsupported(t: Column) -> Column:
    return F.concat(F.lit("Unsupported file type: "), t)


# --- E1: strict UTF-8 -------------------------------------------------------------------

def decode_strict(content) -> Column:
    """Text when the bytes are valid UTF-8, else NULL."""
    return F.try_validate_utf8(col_(content).cast("string"))


def decode_lenient(content) -> Column:
    """decode(errors='ignore'): invalid sequences dropped."""
    return F.regexp_replace(F.make_valid_utf8(col_(content).cast("string")), "�", "")


# --- E2: Markdown -----------------------------------------------------------------------

# Line-level rules (each anchored on a single line) and inline rules, applied in order.
MD_LINE_RULES = [
    (r"^[ \t]*(?:[-*_][ \t]*){3,}\z", ""),          # horizontal rule
    (r"^[ \t]{0,3}#{1,6}[ \t]+", ""),                # ATX heading marker
    (r"[ \t]+#+[ \t]*\z", ""),                       # closing heading hashes
    (r"^[ \t]{0,3}>[ \t]?", ""),                     # block quote
    (r"^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+", ""),      # list item marker
    (r"^[ \t]*```[^\n]*\z", ""),                     # code fence line
]
MD_INLINE_RULES = [
    (r"!\[([^\]\n]*)\]\([^)\n]*\)", "$1"),           # image → alt text
    (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"),            # link → label
    (r"`([^`\n]*)`", "$1"),                          # code span
    (r"\*\*([^*\n]+)\*\*", "$1"),                    # strong
    (r"\*([^*\n]+)\*", "$1"),                        # emphasis
    (r"<[A-Za-z/!][^>\n]*>", ""),                    # inline HTML tag
    (r"\\([\\`*_{}\[\]()#+.!-])", "$1"),             # backslash escape
]


def markdown_text(c) -> Column:
    """Markdown to plain text: blocks (split at blank lines) with block and inline
    markup removed, entities decoded, each block stripped, joined by a blank line."""
    x = F.regexp_replace(col_(c), r"\r\n?", "\n")
    blocks = F.split(F.regexp_replace(x, r"\n(?:[ \t]*\n)+", MARK), MARK)

    def line(ln: Column) -> Column:
        for pat, rep in MD_LINE_RULES:
            ln = F.regexp_replace(ln, pat, rep)
        return ln

    def block(b: Column) -> Column:
        t = F.array_join(F.transform(F.split(b, "\n"), line), "\n")
        for pat, rep in MD_INLINE_RULES:
            t = F.regexp_replace(t, pat, rep)
        return py_strip(decode_entities(t))

    return F.array_join(F.filter(F.transform(blocks, block), lambda b: b != ""), "\n\n")


# --- E4: RTF ----------------------------------------------------------------------------

def rtf_text(c, strip_control_words: bool = False) -> Column:
    """Remove backslashes and braces (the reference's pattern only ever matches those
    single characters, so control words stay as letters). ``strip_control_words`` removes
    control words and hex escapes first."""
    x = col_(c)
    if strip_control_words:
        x = F.regexp_replace(x, r"\\'[0-9a-fA-F]{2}|\\[a-zA-Z]+-?[0-9]* ?|\\[^a-zA-Z]", "")
    return py_strip(F.regexp_replace(x, r"[\\{}]", ""))


# --- E10: image headers -----------------------------------------------------------------

PNG_SIGNATURE = "89504E470D0A1A0A"
JPEG_SIGNATURE = "FFD8"
IMAGE_TYPES = ["png", "jpg", "jpeg"]


def _be32(b: Column, pos: int) -> Column:
    return F.conv(F.hex(F.substring(b, pos, 4)), 16, 10).cast("bigint")


def png_dimensions(content) -> Column:
    """struct(width, height) from the IHDR chunk, NULL when not a PNG."""
    b = col_(content)
    ok = (F.hex(F.substring(b, 1, 8)) == PNG_SIGNATURE) & (F.length(b) >= 24)
    return F.when(ok, F.struct(_be32(b, 17).alias("width"), _be32(b, 21).alias("height")))


def image_kind(kind: Column, content) -> Column:
    """``kind``, or for an image the type that its signature shows (png, jpg), if it shows one."""
    head = F.hex(F.substring(col_(content), 1, 8))
    return F.when(kind.isin(*IMAGE_TYPES) & (head == PNG_SIGNATURE), F.lit("png")).when(
        kind.isin(*IMAGE_TYPES) & head.startswith(JPEG_SIGNATURE), F.lit("jpg")).otherwise(kind)


def image_text(width: Column, height: Column, fmt: str) -> Column:
    return F.concat(F.lit("Image dimensions: ("), width.cast("string"), F.lit(", "),
                    height.cast("string"), F.lit(f"), format: {fmt}"))


def _jpeg_size(data: bytes) -> tuple[int, int]:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    i = 2
    while i + 4 <= len(data):
        if data[i] != 0xFF:
            i += 1
            continue
        marker = data[i + 1]
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            i += 2
            continue
        seg = struct.unpack(">H", data[i + 2:i + 4])[0]
        if marker in (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            h, w = struct.unpack(">HH", data[i + 5:i + 9])
            return w, h
        i += 2 + seg
    raise ValueError("no frame header")


# --- Arrow-batched parsers (E5-E7, E9, E10 JPEG) ------------------------------------------

def _json_text(data: bytes) -> str:
    return json.dumps(json.loads(data), indent=2)


def _xml_text(data: bytes) -> str:
    return ET.tostring(ET.parse(io.BytesIO(data)).getroot(), encoding="unicode", method="xml")


def _csv_text(data: bytes) -> str:
    return pd.read_csv(io.BytesIO(data)).to_string()


W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(data: bytes) -> list[str]:
    """Texts of the body-level paragraphs of a .docx (tables, headers and footers left
    out), runs concatenated; tabs and breaks as \\t and \\n."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{W_NS}body")
    out = []
    for p in (body.findall(f"{W_NS}p") if body is not None else []):
        parts = []
        for el in p.iter():
            if el.tag == f"{W_NS}t":
                parts.append(el.text or "")
            elif el.tag == f"{W_NS}tab":
                parts.append("\t")
            elif el.tag in (f"{W_NS}br", f"{W_NS}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return out


def _docx_text(data: bytes) -> str:
    return "\n".join(docx_paragraphs(data))


def docx_images(data: bytes) -> list[bytes]:
    """Bytes of the images a .docx references (relationship targets under word/media)."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        try:
            rels = ET.fromstring(z.read("word/_rels/document.xml.rels"))
        except KeyError:
            return out
        for rel in rels:
            target = rel.get("Target", "")
            if "image" in target:
                path = target if target.startswith("word/") else "word/" + target.lstrip("/")
                if path in names:
                    out.append(z.read(path))
    return out


def docx_extractor(describe: Callable[[bytes], str] | None = None) -> Callable[[bytes], str]:
    """E9 with image descriptions: paragraphs joined by newlines, then (when ``describe``
    yields any) the descriptions under the Image Descriptions header. A description that
    fails is skipped, as in the reference."""
    def run(data: bytes) -> str:
        text = "\n".join(docx_paragraphs(data))
        if describe is None:
            return text
        found = []
        for img in docx_images(data):
            try:
                found.append(describe(img))
            except Exception:
                continue
        return text + IMAGE_DESCRIPTIONS_HEADER + "\n".join(found) if found else text
    return run


def image_describer(client: Callable[[str], str]) -> Callable[[bytes], str]:
    """E10 with a model: sends the image request (L9's JSON message) to ``client``."""
    import base64

    from quarry.operators.prompts import IMAGE_PROMPT, IMAGE_URL_PREFIX

    def run(data: bytes) -> str:
        msg = [{"type": "text", "text": IMAGE_PROMPT},
               {"type": "image_url", "image_url": {
                   "url": IMAGE_URL_PREFIX + base64.b64encode(data).decode("ascii"),
                   "detail": "high"}}]
        out = client(json.dumps(msg, separators=(",", ":")))
        return out if out else "No description available"
    return run


def _jpeg_text(data: bytes) -> str:
    w, h = _jpeg_size(data)
    return f"Image dimensions: ({w}, {h}), format: JPEG"


PY_PARSERS: dict[str, Callable[[bytes], str]] = {
    "json": _json_text, "xml": _xml_text, "csv": _csv_text, "docx": _docx_text,
    "jpg": _jpeg_text, "jpeg": _jpeg_text,
}


def _python_parse(parsers: dict[str, Callable]):
    """Arrow batch → struct(text, error). Rows without content (native or unsupported
    types, which the caller nulls out) cost only a NULL in the batch."""
    def run(types: pd.Series, data: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for t, d in zip(types, data):
            if d is None:
                texts.append(None)
                errors.append(None)
                continue
            try:
                texts.append(parsers[t](bytes(d)))
                errors.append(None)
            except Exception as e:  # the row fails, not the job
                texts.append(None)
                errors.append(f"Error processing {t}: {type(e).__name__}: {e}")
        return pd.DataFrame({"text": texts, "error": errors})
    return run


def extract_text(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None,
                 type_col: str = "file_type", content: str = "content") -> DataFrame:
    """(…, text, error) for every file, in one pass over the input. ``extractors`` maps
    further types (e.g. "pdf", or a native type to override) to a ``bytes → text`` function.

    The Arrow-batched parser receives the content only of rows whose type needs Python
    (NULL otherwise), so native rows never cross to the Python worker with their bytes and
    the file contents are read once.

    An image is read as what its first bytes say (a PNG named ``.jpg`` is a PNG), unless
    ``extractors`` takes an image type; ``file_type`` stays the name's."""
    extractors = dict(extractors or {})
    named = F.lower(F.col(type_col))
    t = named if set(IMAGE_TYPES) & set(extractors) else image_kind(named, content)
    native_types = [x for x in NATIVE_TYPES if x not in extractors]
    py_types = [x for x in PYTHON_TYPES if x not in extractors] + list(extractors)
    parsers = {**PY_PARSERS, **extractors}
    keep = [c for c in files.columns if c not in (content, type_col)]
    is_text = t.isin(*[x for x in ("txt", "md", "html", "htm") if x in native_types])
    py = F.pandas_udf(_python_parse(parsers), "text string, error string")(
        t, F.when(t.isin(*py_types), F.col(content)))
    stage = files.select(
        *keep, named.alias(type_col), t.alias("_kind"), F.col(content),
        F.when(is_text, decode_strict(content)).alias("_s"), py.alias("_py"))
    s_, c_, t = F.col("_s"), F.col(content), F.col("_kind")
    is_text = t.isin(*[x for x in ("txt", "md", "html", "htm") if x in native_types])
    png = png_dimensions(c_)
    native_text = (
        F.when(t == "txt", s_)
        .when(t == "md", markdown_text(s_))
        .when(t.isin("html", "htm"), html_text(s_))
        .when(t == "rtf", rtf_text(decode_lenient(c_)))
        .when(t == "png", image_text(png["width"], png["height"], "PNG")))
    native_error = (
        F.when(is_text & s_.isNull(), F.lit(UTF8_ERROR))
        .when((t == "png") & png.isNull(), F.lit("Error processing png: not a PNG file")))
    is_native, is_py = t.isin(*native_types), t.isin(*py_types)
    text = (F.when(is_native & native_error.isNull(), native_text)
            .when(is_py, F.col("_py.text")))
    error = (F.when(is_native, native_error).when(is_py, F.col("_py.error"))
             .otherwise(F.coalesce(unsupported(t), F.lit("Unsupported file type: "))))
    return stage.select(*keep, F.col(type_col), text.alias("text"), error.alias("error"))


# --- E11 / E12: page-structured formats ---------------------------------------------------

def join_pages(pages: list[str], images: list[tuple[int, int, str]] | None = None) -> str:
    """E12 for one document: stripped non-empty pages joined by a blank line; image
    descriptions ``[Page p, Image i]: text`` appended under a header."""
    text = "\n\n".join(s for s in (p.strip() for p in pages) if s)
    if images:
        text += IMAGE_DESCRIPTIONS_HEADER + "\n".join(
            f"[Page {p}, Image {i}]: {d}" for p, i, d in images)
    return text


def pages_decoder(split_pages: Callable[[bytes], list[str]],
                  describe: Callable[[bytes], list[tuple[int, int, str]]] | None = None
                  ) -> Callable[[bytes], str]:
    """Build an extractor from a caller's page splitter (and optional image
    describer); the page and image assembly is ours."""
    def run(data: bytes) -> str:
        return join_pages(split_pages(data), describe(data) if describe else None)
    return run


def assemble_text(pages: DataFrame, images: DataFrame | None = None, key: str = "doc_id",
                  page: str = "page", text: str = "text", image: str = "image",
                  description: str = "description", labelled: bool = True) -> DataFrame:
    """E12 as a Spark job: pages (key, page, text) and images (key, page, image,
    description) → (key, text). The page list of one document is its own output, so the
    per-document collect is bounded by the document."""
    p = pages.select(key, page, py_strip(text).alias("_t")).filter(F.col("_t") != "")
    pt = p.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(page, "_t"))), lambda s: s["_t"]), "\n\n"
    ).alias("_body"))
    docs = pages.select(key).distinct().join(pt, key, "left")
    if images is None:
        return docs.select(key, F.coalesce("_body", F.lit("")).alias(text))
    line = (F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit(", Image "),
                     F.col(image).cast("string"), F.lit("]: "), F.col(description))
            if labelled else F.col(description))
    it = images.select(key, page, image, line.alias("_l")).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, image, "_l"))),
                                 lambda s: s["_l"]), "\n").alias("_imgs"))
    out = docs.join(it, key, "left")
    body = F.coalesce("_body", F.lit(""))
    return out.select(key, F.when(F.col("_imgs").isNotNull(), F.concat(
        body, F.lit(IMAGE_DESCRIPTIONS_HEADER), F.col("_imgs"))).otherwise(body).alias(text))


def read_table(spark, path: str, fmt: str, schema=None, corrupt: str | None = None,
               **options) -> DataFrame:
    """JSON, XML or CSV files as typed rows (the schema is inferred over all files unless
    given). With ``corrupt``, a record that doesn't fit the schema stays as a row whose raw text is in
    that column (null in the other rows); without it such a record has nulls only."""
    defaults = {"csv": {"header": "true", "inferSchema": "true"}, "xml": {"rowTag": "row"}}
    reader = spark.read.format(fmt).options(**{**defaults.get(fmt, {}), **options})
    if corrupt:
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)
        found = schema if schema is not None else reader.load(path).schema
        if isinstance(found, str):
            found = T.StructType.fromDDL(found)
        schema = T.StructType([f for f in found.fields if f.name != corrupt]
                              + [T.StructField(corrupt, T.StringType())])
    return (reader if schema is None else reader.schema(schema)).load(path)
