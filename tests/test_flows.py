"""End-to-end flows: upload, crawl-and-index, ask."""

from pyspark.sql import functions as F

from quarry.operators.chunk import chunk_words
from quarry.operators.embed import embed, fit_embedder
from quarry.operators.generate import ExtractiveClient
from quarry.plans.ask import ask
from quarry.plans.ingest import ingest_files, ingest_site
from quarry.registry.q_web import host_starts
from quarry.sources import derived
from quarry.sources.files import scan_files
from quarry.sources.index import read_index

from conftest import SF001


def test_upload_flow(spark, tmp_path):
    src = tmp_path / "up"
    src.mkdir()
    (src / "a.txt").write_text("alpha beta gamma delta " * 10)
    (src / "b.md").write_text("# Title\n\nsome **bold** words here")
    (src / "c.exe").write_bytes(b"MZ")
    idx = str(tmp_path / "idx")
    rows, rejected = ingest_files(scan_files(spark, str(src)), now="2024-01-01 00:00:00",
                                  index_path=idx)
    assert sorted(r.filename for r in read_index(spark, idx).select("filename").distinct()
                  .collect()) == ["a.txt", "b.md"]
    assert [(r.filename, r.error) for r in rejected.collect()] == [("c.exe", "Invalid file type")]


def test_site_flow(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    rows = ingest_site(pages, derived.links(spark, SF001), host_starts(spark, SF001),
                       now="2024-01-01 00:00:00")
    assert rows.filter(F.col("file_type") != "web").count() == 0
    assert rows.count() > 0


def test_ask_flow(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    chunks = chunk_words(docs)
    model = fit_embedder(chunks, "page_content", 64)
    index = embed(chunks, model, text="page_content").withColumn("filename", F.lit("f"))
    q = spark.createDataFrame([(1, "what is this"), (2, "  ")], "qid int, question string")
    out = {r.qid: r for r in ask(q, index, model, ExtractiveClient()).collect()}
    assert out[2].error == "Query cannot be empty" and out[2].answer is None
    assert out[1].context and (out[1].answer or out[1].error)


def test_ask_asks_once_and_keeps_rewording_errors(spark, tmp_path):
    log = tmp_path / "calls"
    log.write_text("")

    def client(prompt):
        with open(log, "a") as f:
            f.write("x\n")
        if len(open(log).readlines()) <= 3:     # the rewording and its retries
            raise ValueError("no rewording")
        return "an answer"

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    chunks = chunk_words(docs)
    model = fit_embedder(chunks, "page_content", 64)
    index = embed(chunks, model, text="page_content").withColumn("filename", F.lit("f"))
    q = spark.createDataFrame([(1, "what is this")], "qid int, question string")
    row, = ask(q, index, model, client).collect()
    assert row.answer == "an answer" and "no rewording" in row.error
    assert len(log.read_text().split()) == 4
