"""Builders that turn supplied rows into file contents for the registered extraction and
archive queries (docx and zip containers need a zip writer, so they run in Arrow batches)."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

W_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(paragraphs: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>'
                   for p in paragraphs)
    doc = (f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
           f'<w:document xmlns:w="{W_NS}"><w:body>{body}</w:body></w:document>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types/>')
        z.writestr("word/document.xml", doc)
    return buf.getvalue()


def _docx_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([docx_bytes(t.split("\n")) for t in texts])


def make_docx(col):
    """One paragraph per line of the text (the UDF is built on use, not at import, so the
    Python workers can import this module)."""
    return F.pandas_udf(_docx_batch, "binary")(F.col(col) if isinstance(col, str) else col)


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return buf.getvalue()
