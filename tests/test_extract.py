"""Extraction, archives and file-type goldens (FIXTURES §3: S1, S2, E*)."""

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from quarry.functions.validate import file_type_of
from quarry.operators import extract as X
from quarry.registry.builders import docx_bytes
from quarry.sources import files as FS


def _files(spark, items):
    return spark.createDataFrame(items, "filename string, file_type string, content binary")


def _one(spark, ftype, data, **kw):
    r = X.extract_text(_files(spark, [("f." + ftype, ftype, bytearray(data))]), **kw).first()
    return r.text, r.error


def test_s1_file_type(spark):
    df = spark.createDataFrame([("a.b.TXT",), ("README",)], "n string")
    assert [r[0] for r in df.select(file_type_of("n")).collect()] == ["txt", "readme"]


def test_s1_scan_and_s2_archives(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("d/", b"")
        z.writestr("d/x.md", b"# T")
        z.writestr("y.zip", b"PK")
    (tmp_path / "bundle.zip").write_bytes(buf.getvalue())
    (tmp_path / "a.TXT").write_bytes(b"hello")
    files = FS.scan_files(spark, str(tmp_path))
    members = FS.expand_archives(files)
    got = sorted((r.filename, r.file_type, r.archive_path is not None) for r in members.collect())
    assert got == [("a.TXT", "txt", False), ("x.md", "md", True), ("y.zip", "zip", True)]
    ex = {r.filename: (r.text, r.error) for r in X.extract_text(members.drop("error")).collect()}
    assert ex["x.md"] == ("T", None)
    assert ex["y.zip"] == (None, "Unsupported file type: zip")
    assert ex["a.TXT"] == ("hello", None)


def test_e1_invalid_utf8(spark):
    assert _one(spark, "txt", b"\xff\xfe") == (None, X.UTF8_ERROR)


def test_e2_markdown(spark):
    md = "# T\n\nHello **w** [l](u)\n\n- `c`"
    assert _one(spark, "md", md.encode()) == ("T\n\nHello w l\n\nc", None)


def test_e4_rtf(spark):
    assert _one(spark, "rtf", rb"{\rtf1\ansi{\b bold} plain\par end}") == (
        "rtf1ansib bold plainpar end", None)
    df = spark.createDataFrame([(r"{\rtf1\ansi{\b bold} plain\par end}",)], "t string")
    assert df.select(X.rtf_text("t", strip_control_words=True)).first()[0] == "bold plainend"


def test_e5_json_pretty(spark):
    text, err = _one(spark, "json", '{"b":[1],"a":"é"}'.encode())
    assert err is None
    assert text == json.dumps({"b": [1], "a": "é"}, indent=2)
    assert '"\\u00e9"' in text and text.index('"b"') < text.index('"a"')


def test_e6_e7_xml_csv(spark):
    text, _ = _one(spark, "xml", b"<?xml version='1.0'?><r a='1'><!-- c --><x>&amp;</x></r>")
    assert text == '<r a="1"><x>&amp;</x></r>'
    text, _ = _one(spark, "csv", b"a,b\n1,2\n")
    assert text == "   a  b\n0  1  2"
    _, err = _one(spark, "xml", b"<r>")
    assert err and err.startswith("Error processing xml")


def test_e9_docx_paragraphs_only(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = (f'<w:document xmlns:w="{w}"><w:body>'
           f'<w:p><w:r><w:t>first</w:t></w:r></w:p>'
           f'<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
           f'<w:p><w:r><w:t>second</w:t></w:r><w:r><w:tab/><w:t>x</w:t></w:r></w:p>'
           f'</w:body></w:document>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", doc)
    assert _one(spark, "docx", buf.getvalue()) == ("first\nsecond\tx", None)
    assert _one(spark, "docx", docx_bytes(["a", "b"])) == ("a\nb", None)


def test_e10_png_and_jpeg(spark):
    png = (bytes.fromhex(X.PNG_SIGNATURE) + struct.pack(">I", 13) + b"IHDR"
           + struct.pack(">II", 3, 2) + b"\x08\x02\x00\x00\x00" + b"\x00" * 4)
    assert _one(spark, "png", png) == ("Image dimensions: (3, 2), format: PNG", None)
    jpg = (b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 2, 3)
           + b"\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01\xff\xd9")
    assert _one(spark, "jpg", jpg) == ("Image dimensions: (3, 2), format: JPEG", None)
    text, err = _one(spark, "png", b"nope")
    assert text is None and err


def test_e11_hook_and_e12_assembly(spark):
    fn = X.pages_decoder(lambda b: b.decode().split("\f"),
                         lambda b: [(1, 1, "i")])
    assert _one(spark, "pdf", b"a\f  \fb", extractors={"pdf": fn}) == (
        "a\n\nb\n\nImage Descriptions:\n[Page 1, Image 1]: i", None)
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (1, 3, "b")],
                                  "doc_id int, page int, text string")
    images = spark.createDataFrame([(1, 1, 1, "i")],
                                   "doc_id int, page int, image int, description string")
    assert X.assemble_text(pages, images).first().text == (
        "a\n\nb\n\nImage Descriptions:\n[Page 1, Image 1]: i")
    assert X.assemble_text(pages).first().text == "a\n\nb"


def test_e0_unsupported(spark):
    assert _one(spark, "exe", b"x") == (None, "Unsupported file type: exe")


def test_e9_e10_with_describer(spark):
    import base64
    seen = []

    def client(request):
        msg = json.loads(request)
        seen.append(msg[1]["image_url"]["detail"])
        data = base64.b64decode(msg[1]["image_url"]["url"].split(",", 1)[1])
        if data.startswith(b"BAD"):
            raise ValueError("cannot read")
        return f"{len(data)} bytes"

    describe = X.image_describer(client)
    png = (bytes.fromhex(X.PNG_SIGNATURE) + struct.pack(">I", 13) + b"IHDR"
           + struct.pack(">II", 3, 2) + b"\x08\x02\x00\x00\x00" + b"\x00" * 4)
    assert _one(spark, "png", png, extractors={"png": describe}) == ("33 bytes", None)
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r>'
                   f'<w:t>p</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels",
                   '<Relationships><Relationship Target="media/image1.png"/>'
                   '<Relationship Target="media/image2.png"/></Relationships>')
        z.writestr("word/media/image1.png", b"12345")
        z.writestr("word/media/image2.png", b"BAD")
    got = _one(spark, "docx", buf.getvalue(), extractors={"docx": X.docx_extractor(describe)})
    assert got == ("p\n\nImage Descriptions:\n5 bytes", None)
