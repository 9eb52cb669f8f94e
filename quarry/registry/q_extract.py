"""Registered extraction queries (E0-E12) over file contents built from documents/pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.html import html_text
from quarry.operators import extract as X
from quarry.registry import duck as D
from quarry.registry.builders import make_docx
from quarry.registry.oracle import oracle, with_
from quarry.registry.queries import query
from quarry.session import scratch_path
from quarry.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _enc(c):
    return F.encode(c, "UTF-8")


def md_sql(x: str) -> str:
    """SQL twin of markdown_text."""
    y = D.rr(x, r"\r\n?", "\n")
    blocks = f"string_split({D.rr(y, chr(92) + 'n(?:[ ' + chr(92) + 't]*' + chr(92) + 'n)+', chr(1))}, chr(1))"
    line = "ln_"
    for pat, rep in X.MD_LINE_RULES:
        line = D.rr(line, pat, rep.replace("$1", "\\1"))
    inner = f"array_to_string(list_transform(string_split(b_, chr(10)), lambda ln_: {line}), chr(10))"
    for pat, rep in X.MD_INLINE_RULES:
        inner = D.rr(inner, pat, rep.replace("$1", "\\1"))
    block = D.py_strip(D.decode_entities(inner))
    return (f"array_to_string(list_filter(list_transform({blocks}, lambda b_: {block}), "
            f"lambda k_: k_ <> ''), chr(10) || chr(10))")


# --- E1 ---------------------------------------------------------------------------------

@query("e1_extract_txt")
def e1(spark, sf):
    d = _docs(spark, sf)
    content = F.when(F.col("doc_id") % 97 == 0, F.concat(F.unhex(F.lit("FFFE")), _enc("text"))
                     ).otherwise(_enc("text"))
    files = d.select("doc_id", F.lit("txt").alias("file_type"), content.alias("content"))
    return X.extract_text(files).select("doc_id", "text", "error")


@oracle("e1_extract_txt")
def e1_sql():
    return (f"SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE text END AS text, "
            f"CASE WHEN doc_id % 97 = 0 THEN {D.q(X.UTF8_ERROR)} END AS error FROM documents")


# --- E2 ---------------------------------------------------------------------------------

def _md(c_text, c_source, c_lang):
    return F.concat(F.lit("# "), c_source, F.lit("\n\n"), c_text, F.lit("\n\n- `"), c_lang,
                    F.lit("`"))


@query("e2_extract_markdown")
def e2(spark, sf):
    d = _docs(spark, sf)
    files = d.select("doc_id", F.lit("md").alias("file_type"),
                     _enc(_md(F.col("text"), F.col("source"), F.col("lang"))).alias("content"))
    return X.extract_text(files).select("doc_id", "text", "error")


@oracle("e2_extract_markdown")
def e2_sql():
    md = "('# ' || source || chr(10) || chr(10) || text || chr(10) || chr(10) || '- `' || lang || '`')"
    return f"SELECT doc_id, {md_sql(md)} AS text, CAST(NULL AS VARCHAR) AS error FROM documents"


# --- E3 ---------------------------------------------------------------------------------

@query("e3_extract_html")
def e3(spark, sf):
    p = table(spark, sf, "pages")
    files = p.select("page_id", F.lit("html").alias("file_type"), _enc("html").alias("content"))
    return X.extract_text(files).select("page_id", "text", "error")


@oracle("e3_extract_html")
def e3_sql():
    return f"SELECT page_id, {D.html_text('html')} AS text, CAST(NULL AS VARCHAR) AS error FROM pages"


# --- E4 ---------------------------------------------------------------------------------

@query("e4_extract_rtf")
def e4(spark, sf):
    d = _docs(spark, sf)
    rtf = F.concat(F.lit("{\\rtf1\\ansi{\\b "), F.col("source"), F.lit("} "), F.col("text"),
                   F.lit("\\par}"))
    files = d.select("doc_id", F.lit("rtf").alias("file_type"), _enc(rtf).alias("content"))
    return X.extract_text(files).select("doc_id", "text", "error")


@oracle("e4_extract_rtf")
def e4_sql():
    rtf = "('{\\rtf1\\ansi{\\b ' || source || '} ' || text || '\\par}')"
    return (f"SELECT doc_id, {D.py_strip(D.rr(rtf, r'[' + chr(92) * 2 + '{}]'))} AS text, "
            f"CAST(NULL AS VARCHAR) AS error FROM documents")


# --- E5 / E6 / E7 -------------------------------------------------------------------------

@query("e5_extract_json")
def e5(spark, sf):
    d = _docs(spark, sf)
    j = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    files = d.select("doc_id", F.lit("json").alias("file_type"), _enc(j).alias("content"))
    return X.extract_text(files).select("doc_id", "text", "error")


@oracle("e5_extract_json")
def e5_sql():
    nl = "chr(10)"
    return (f"SELECT doc_id, '{{' || {nl} || '  \"doc_id\": ' || CAST(doc_id AS VARCHAR) || ',' || {nl}"
            f" || '  \"lang\": \"' || lang || '\",' || {nl} || '  \"source\": \"' || source || '\",' || {nl}"
            f" || '  \"n_chars\": ' || CAST(n_chars AS VARCHAR) || {nl} || '}}' AS text, "
            f"CAST(NULL AS VARCHAR) AS error FROM documents")


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


@query("e6_extract_xml")
def e6(spark, sf):
    d = _docs(spark, sf)
    x = F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('" lang="'),
                 F.col("lang"), F.lit('"><source>'), F.col("source"), F.lit("</source><text>"),
                 _xml_escape(F.col("text")), F.lit("</text></doc>"))
    files = d.select("doc_id", F.lit("xml").alias("file_type"), _enc(x).alias("content"))
    return X.extract_text(files).select("doc_id", "text", "error")


@oracle("e6_extract_xml")
def e6_sql():
    esc = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return (f"SELECT doc_id, '<doc id=\"' || CAST(doc_id AS VARCHAR) || '\" lang=\"' || lang || "
            f"'\"><source>' || source || '</source><text>' || {esc} || '</text></doc>' AS text, "
            f"CAST(NULL AS VARCHAR) AS error FROM documents")


@query("e7_extract_csv")
def e7(spark, sf):
    """A small CSV per document: one row per line (position, word count, first word)."""
    d = _docs(spark, sf)
    from quarry.functions.text import words
    lines = F.split("text", "\n")
    rows = F.transform(lines, lambda ln, i: F.concat(
        i.cast("string"), F.lit(","), F.size(words(ln)).cast("string"), F.lit(","),
        F.regexp_replace(F.coalesce(F.try_element_at(words(ln), F.lit(1)), F.lit("")),
                         r"[^\p{L}\p{N}]", "")))
    csv = F.concat(F.lit("pos,n_words,first_word\n"), F.array_join(rows, "\n"))
    files = d.select("doc_id", F.lit("csv").alias("file_type"), _enc(csv).alias("content"))
    return X.extract_text(files).select("doc_id", "text", "error")


# --- E8 ---------------------------------------------------------------------------------

@query("e8_read_table")
def e8(spark, sf):
    path = scratch_path(spark, "json")
    _docs(spark, sf).select("doc_id", "lang", "source", "n_chars").write.json(path)
    return X.read_table(spark, path, "json", schema=None).select("doc_id", "lang", "source",
                                                                 "n_chars")


@oracle("e8_read_table")
def e8_sql():
    return "SELECT doc_id, lang, source, n_chars FROM documents"


# Values survive a file: quotes doubled, line breaks and spaces kept.
CSV_OPTIONS = {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}
TABLE_COLS = ["doc_id", "lang", "source", "n_chars", "text"]


def _typed(read, d):
    return read.select(*[F.col(c).cast(d.schema[c].dataType).alias(c) for c in TABLE_COLS],
                       F.col("_bad").alias("error"))


@query("e8_read_csv")
def e8_csv(spark, sf):
    d, path = _docs(spark, sf).select(*TABLE_COLS), scratch_path(spark, "csv")
    d.write.options(header="true", **{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
                    ).csv(path)
    return _typed(X.read_table(spark, path, "csv", corrupt="_bad", **CSV_OPTIONS), d)


@oracle("e8_read_csv")
def e8_csv_sql():
    return f"SELECT {', '.join(TABLE_COLS)}, CAST(NULL AS VARCHAR) AS error FROM documents"


@query("e8_read_xml")
def e8_xml(spark, sf):
    d, path = _docs(spark, sf).select(*TABLE_COLS), scratch_path(spark, "xml")
    d.write.format("xml").option("rowTag", "row").save(path)
    return _typed(X.read_table(spark, path, "xml", corrupt="_bad",
                               ignoreSurroundingSpaces="false"), d)


@oracle("e8_read_xml")
def e8_xml_sql():
    return f"SELECT {', '.join(TABLE_COLS)}, CAST(NULL AS VARCHAR) AS error FROM documents"


# --- E9 ---------------------------------------------------------------------------------

@query("e9_extract_docx")
def e9(spark, sf):
    d = _docs(spark, sf)
    files = d.select("doc_id", F.lit("docx").alias("file_type"), make_docx("text").alias("content"))
    return X.extract_text(files).select("doc_id", "text", "error")


@oracle("e9_extract_docx")
def e9_sql():
    return "SELECT doc_id, text, CAST(NULL AS VARCHAR) AS error FROM documents"


# --- E10 --------------------------------------------------------------------------------

def _hex4(c, n):
    return F.lpad(F.hex(c), n, "0")


@query("e10_extract_image")
def e10(spark, sf):
    d = _docs(spark, sf)
    w = F.col("doc_id") % 640 + 1
    h = F.col("n_chars") % 480 + 1
    png = F.unhex(F.concat(F.lit(X.PNG_SIGNATURE + "0000000D49484452"), _hex4(w, 8), _hex4(h, 8),
                           F.lit("0802000000" + "00000000")))
    jpg = F.unhex(F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"),
                           _hex4(h, 4), _hex4(w, 4), F.lit("03012200021101031101FFD9")))
    is_png = F.col("doc_id") % 2 == 0
    files = d.select("doc_id", F.when(is_png, "png").otherwise("jpg").alias("file_type"),
                     F.when(is_png, png).otherwise(jpg).alias("content"))
    return X.extract_text(files).select("doc_id", "file_type", "text", "error")


@oracle("e10_extract_image")
def e10_sql():
    return """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS file_type,
                     'Image dimensions: (' || CAST(doc_id % 640 + 1 AS VARCHAR) || ', ' ||
                     CAST(n_chars % 480 + 1 AS VARCHAR) || '), format: ' ||
                     CASE WHEN doc_id % 2 = 0 THEN 'PNG' ELSE 'JPEG' END AS text,
                     CAST(NULL AS VARCHAR) AS error FROM documents"""


@query("e10_image_by_bytes")
def e10_bytes(spark, sf):
    """Images under names of any image type, and texts under such names."""
    d = _docs(spark, sf)
    w = F.col("doc_id") % 640 + 1
    h = F.octet_length("text") % 480 + 1
    png = F.unhex(F.concat(F.lit(X.PNG_SIGNATURE + "0000000D49484452"), _hex4(w, 8), _hex4(h, 8),
                           F.lit("0802000000" + "00000000")))
    jpg = F.unhex(F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"),
                           _hex4(h, 4), _hex4(w, 4), F.lit("03012200021101031101FFD9")))
    name = F.element_at(F.array(*[F.lit(x) for x in X.IMAGE_TYPES]),
                        (F.col("doc_id") % 3 + 1).cast("int"))
    files = d.select("doc_id", name.alias("file_type"), F.when(
        F.col("doc_id") % 11 == 0, F.concat(F.lit("#"), F.col("text")).cast("binary")).when(
        F.col("doc_id") % 2 == 0, png).otherwise(jpg).alias("content"))
    return X.extract_text(files).select("doc_id", "file_type", "text", "error")


@oracle("e10_image_by_bytes")
def e10_bytes_sql():
    names = "['png', 'jpg', 'jpeg'][doc_id % 3 + 1]"
    return f"""SELECT doc_id, {names} AS file_type,
        CASE WHEN doc_id % 11 <> 0 THEN 'Image dimensions: (' || CAST(doc_id % 640 + 1 AS VARCHAR) ||
             ', ' || CAST(strlen(text) % 480 + 1 AS VARCHAR) || '), format: ' ||
             CASE WHEN doc_id % 2 = 0 THEN 'PNG' ELSE 'JPEG' END END AS text,
        CASE WHEN doc_id % 11 = 0 THEN 'Error processing ' || {names} || CASE WHEN doc_id % 3 = 0
             THEN ': not a PNG file' ELSE ': ValueError: not a JPEG file' END END AS error
        FROM documents"""


# --- E11 / E12 ---------------------------------------------------------------------------

def form_feed_pages(data: bytes) -> list[str]:
    """Page splitter for the registered PDF-like files: pages separated by form feeds."""
    return data.decode("utf-8").split("\f")


@query("e11_extract_with")
def e11(spark, sf):
    d = _docs(spark, sf)
    files = d.select("doc_id", F.lit("pdf").alias("file_type"),
                     _enc(F.replace("text", F.lit("\n"), F.lit("\f"))).alias("content"))
    out = X.extract_text(files, extractors={"pdf": X.pages_decoder(form_feed_pages)})
    return out.select("doc_id", "text", "error")


def _pages_joined_sql(x: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), "
            f"lambda p_: {D.py_strip('p_')}), lambda s_: s_ <> ''), chr(10) || chr(10))")


@oracle("e11_extract_with")
def e11_sql():
    return (f"SELECT doc_id, {_pages_joined_sql('text')} AS text, CAST(NULL AS VARCHAR) AS error "
            f"FROM documents")


@query("e12_assemble_text")
def e12(spark, sf):
    d = _docs(spark, sf)
    pages = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")
                     ).withColumn("page", F.col("page") + 1)
    digits = F.regexp_extract("text", "[0-9]+", 0)
    images = pages.filter(digits != "").select(
        "doc_id", "page", F.lit(1).alias("image"),
        F.concat(F.lit("number "), digits).alias("description"))
    return X.assemble_text(pages, images)


@oracle("e12_assemble_text")
def e12_sql():
    return with_(f"""pg AS (SELECT doc_id, generate_subscripts(a_, 1) AS page, unnest(a_) AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS a_ FROM documents))""",
                 """im AS (SELECT doc_id, string_agg('[Page ' || CAST(page AS VARCHAR) || ', Image 1]: number '
                            || regexp_extract(text, '[0-9]+', 0), chr(10) ORDER BY page) AS imgs
        FROM pg WHERE regexp_extract(text, '[0-9]+', 0) <> '' GROUP BY doc_id)""",
                 f"""bd AS (SELECT doc_id, coalesce(string_agg({D.py_strip('text')}, chr(10) || chr(10)
                            ORDER BY page) FILTER (WHERE {D.py_strip('text')} <> ''), '') AS body
        FROM pg GROUP BY doc_id)""") + """
    SELECT bd.doc_id, CASE WHEN im.imgs IS NOT NULL
                           THEN bd.body || chr(10) || chr(10) || 'Image Descriptions:' || chr(10) || im.imgs
                           ELSE bd.body END AS text
    FROM bd LEFT JOIN im USING (doc_id)"""


# --- E0 ---------------------------------------------------------------------------------

@query("e0_extract_text")
def e0(spark, sf):
    from quarry.sources import derived
    f = derived.files(spark, sf).select("doc_id", "filename", "file_type",
                                        _enc("text").alias("content"))
    split_lines = lambda data: data.decode("utf-8").split("\n")
    out = X.extract_text(f, extractors={"pdf": X.pages_decoder(split_lines)})
    return out.select("doc_id", "filename", "file_type", "text", "error")


@oracle("e0_extract_text")
def e0_sql():
    from quarry.registry.q_catalog import FILES_SQL
    return with_(FILES_SQL) + f"""
    SELECT doc_id, filename, file_type,
           CASE file_type WHEN 'txt' THEN text WHEN 'md' THEN {md_sql('text')}
                          WHEN 'html' THEN {D.html_text('text')}
                          WHEN 'pdf' THEN {_pages_joined_sql('text')} END AS text,
           CASE WHEN file_type IN ('txt', 'md', 'html', 'pdf') THEN NULL
                ELSE 'Unsupported file type: ' || file_type END AS error
    FROM files"""
