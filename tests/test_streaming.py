"""Streaming equals batch (S10, Q8); a restart adds nothing."""

import io
import zipfile

from pyspark.sql import functions as F

from quarry.operators.chunk import chunk_words
from quarry.operators.extract import extract_text
from quarry.sources import derived
from quarry.sources.files import scan_files
from quarry.streaming import ingest, status
from quarry.operators.catalog import current_status

from conftest import SF001


def test_s10_file_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(30).collect()
    for r in docs:
        (src / f"doc_{r.doc_id}.txt").write_text(r.text, encoding="utf-8")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ingest.stream_ingest(ingest.file_stream(spark, str(src), max_files_per_trigger=7), out, ck)
    got = spark.read.parquet(out).select("filename", "pos", "page_content")
    batch = chunk_words(extract_text(scan_files(spark, str(src)).drop("modificationTime"))
                        .filter(F.col("error").isNull()).drop("error"), "text")
    want = batch.select("filename", "pos", "page_content")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    n = got.count()
    ingest.stream_ingest(ingest.file_stream(spark, str(src)), out, ck)  # restart: nothing new
    assert spark.read.parquet(out).count() == n


def test_q8_stream_equals_batch(spark, tmp_path):
    ev = derived.status_events(spark, SF001)
    src = str(tmp_path / "events")
    ev.repartition(3).write.parquet(src)
    s = spark.readStream.schema(status.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    cat = derived.catalog(spark, SF001)
    want = sorted(map(tuple, current_status(cat, ev).collect()))
    # files arrive in random time order: the watermark must exceed the data's time span,
    # otherwise older events are (correctly) dropped as late
    for wm in (None, "3650 days"):
        sink, ck = str(tmp_path / f"sink{wm}"), str(tmp_path / f"ck{wm}")
        status.stream_status(s, sink, ck, watermark=wm)
        got = status.status_view(spark, cat, sink)
        assert sorted(map(tuple, got.collect())) == want


def test_s10_files_archives_and_errors(spark, tmp_path):
    """Refused, corrupt and archived files: rows in one of two sinks, none twice on a replay."""
    src, zipped = tmp_path / "in", io.BytesIO()
    src.mkdir()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("d/", "")
        z.writestr("d/inner.txt", "text inside an archive")
        z.writestr("d/bad.txt", b"\xff\xfe")
    for name, data in (("a.txt", b"plain text of a file"), ("bad.txt", b"\xff\xfe\xfa"),
                       ("tool.exe", b"MZ"), ("good.zip", zipped.getvalue()),
                       ("torn.zip", zipped.getvalue()[:40])):
        (src / name).write_bytes(data)
    out, errors, ck = (str(tmp_path / n) for n in ("out", "errors", "ck"))

    def run(checkpoint):
        ingest.stream_files(ingest.file_stream(spark, f"file://{src}", 100), out, errors, checkpoint,
                            now="2024-06-01 00:00:00")
        rows = sorted((r.filename, r.page_content) for r in spark.read.parquet(out).collect())
        failed = sorted((r.filename, r.error is not None)
                        for r in spark.read.parquet(errors).collect())
        return rows, failed
    rows, failed = run(ck)
    assert [t for _, t in rows] == ["plain text of a file", "text inside an archive"]
    assert len(failed) == 4 and all(e for _, e in failed)
    assert {f.split("/")[-1] for f, _ in failed} == {"bad.txt", "tool.exe", "torn.zip"}
    assert run(ck) == (rows, failed)                        # a restart adds nothing
    assert run(str(tmp_path / "again")) == (rows, failed)   # nor does a replay of the batch
