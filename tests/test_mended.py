"""Inputs that the supplied tables lack: one test per mended fault."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions.urls import resolve_urls
from quarry.operators.analyses import trend
from quarry.session import scratch_path
from quarry.sources.files import expand_archives
from quarry.sources.index import all_documents, read_index, write_index


@pytest.mark.parametrize("href, want", [
    (" /x", "http://h/x"), ("\n/x", "http://h/x"), ("y", "http://h/a/y"), ("../z", "http://h/z"),
    ("http://h/q?a=1", "http://h/q?a=1"), ("//other/p", "http://other/p")])
def test_links_are_cleaned_before_they_are_joined(spark, href, want):
    df = spark.createDataFrame([("http://h/a/b", href)], "base string, href string")
    assert resolve_urls(df, "base", "href", "out").first()["out"] == want


def test_link_resolution_reads_its_input_once(spark):
    df = spark.range(5).selectExpr("'http://h/a/' as base", "concat('../', id) as href")
    plan = resolve_urls(df, "base", "href", "out")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Union" not in plan


def test_periods_shorter_than_a_day(spark):
    rows = [(dt.datetime(2024, 1, 1, h),) for h in (1, 1, 5)]
    df = spark.createDataFrame(rows, "ts timestamp")
    got = trend(df, F.lit(True), period="hour").orderBy("period").collect()
    assert [(r.period.hour, r.n) for r in got] == [(1, 2), (5, 1)]
    assert trend(df, F.lit(True)).first().period == dt.date(2024, 1, 1)


def test_corrupt_archives_are_rows(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello " * 500)
    good = buf.getvalue()
    bad = bytearray(good)
    bad[45:60] = b"\xff" * 15                       # deflate data
    files = spark.createDataFrame(
        [("d/g.zip", "g.zip", "zip", len(good), bytearray(good)),
         ("d/b.zip", "b.zip", "zip", len(bad), bad),
         ("d/n.zip", "n.zip", "zip", 3, bytearray(b"abc"))],
        "path string, filename string, file_type string, length long, content binary")
    got = {r.archive_path: r for r in expand_archives(files).collect()}
    assert got["d/g.zip"].error is None and got["d/g.zip"].length == 3000
    assert got["d/b.zip"].error and got["d/n.zip"].error


def test_one_index_for_files_and_web_pages(spark):
    path = scratch_path(spark, "mixed-index")
    write_index(spark.createDataFrame([("text a", "txt", "a.txt")],
                                      "page_content string, file_type string, filename string"),
                path)
    write_index(spark.createDataFrame([("text b", "web", "T")],
                                      "page_content string, file_type string, title string"), path)
    rows = {r.page_content: r.asDict() for r in read_index(spark, path).collect()}
    assert rows["text a"]["title"] is None and rows["text a"]["filename"] == "a.txt"
    assert rows["text b"]["title"] == "T" and rows["text b"]["filename"] is None
    assert all_documents(spark, path).count() == 2
