"""Unique index appends, hot terms in pieces, filters, image types, uploads, rewordings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import analyses as A
from quarry.operators import catalog as C
from quarry.operators.extract import extract_text
from quarry.operators.search import multi_query_search, search
from quarry.plans.ask import expand_query
from quarry.sources import index as IX

from conftest import rows

CHUNKS = "page_content string, filename string, file_type string, created_at timestamp_ntz, n int"
T0 = dt.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unique_index_appends_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ix")
    first = [("a", "f", "txt", T0, 2), ("a", "f", "txt", T0, 1), ("b", "f", "md", T0, 3),
             ("a", "f1", None, T0, 4), ("a", None, "txt", None, 5), (None, "f", "txt", T0, 6)]
    IX.write_unique(spark.createDataFrame(first, CHUNKS), path)
    more = [("b", "f", "md", T0, 9), ("c", "f", "txt", T0, 7), ("a", "", "txt", None, 8)]
    for _ in range(2):      # the second append is a retry
        IX.write_unique(spark.createDataFrame(more, CHUNKS), path)
    got = IX.read_index(spark, path)
    assert sorted(r.n for r in got.collect()) == [1, 3, 4, 5, 6, 7]
    assert got.select(IX.KEY).distinct().count() == 6
    unique = IX.all_documents(spark, path)
    assert "Exchange" not in _plan(unique) and "Aggregate" not in _plan(unique)
    assert unique.count() == 6 and IX.KEY not in unique.columns
    with pytest.raises(ValueError, match="without keys"):
        IX.write_unique(spark.createDataFrame(more, CHUNKS), path, metadata=["filename"])
    IX.write_index(spark.createDataFrame(more, CHUNKS), path)       # not unique from here on
    assert IX.all_documents(spark, path).count() == 6
    with pytest.raises(ValueError, match="without keys"):
        IX.write_unique(spark.createDataFrame(more, CHUNKS), path)
    IX.clear_index(spark, path)
    IX.write_unique(spark.createDataFrame(more, CHUNKS), path)
    assert IX.all_documents(spark, path).count() == 3
    assert IX.all_documents(spark, path, metadata=["file_type"]).count() == 3


def test_keys_keep_column_bounds(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a", None), ("a", ""), ("1:a", "c")],
                               "x string, y string")
    keys = [bytes(r[0]) for r in df.select(IX.content_key(df, ["x", "y"])).collect()]
    assert len(set(keys)) == 4 and keys[2] == keys[3] and all(len(k) == 16 for k in keys)


def test_empty_append(spark, tmp_path):
    path = str(tmp_path / "ix")
    IX.write_unique(spark.createDataFrame([], CHUNKS), path)
    assert IX.all_documents(spark, path).count() == 0
    IX.write_unique(spark.createDataFrame([("a", "f", "txt", T0, 2)], CHUNKS), path)
    assert IX.all_documents(spark, path).count() == 1


def test_hot_terms_in_pieces_weigh_the_same(spark):
    docs = spark.createDataFrame([(i, "hot warm" if i % 3 else f"hot rare{i}") for i in range(300)],
                                 "doc_id long, text string")
    plain = A.tfidf(docs)
    cut = A.tfidf(docs, hot_share=6, hot_rows=7)     # hot: over 100 of 600 rows
    assert sorted(rows(plain, "doc_id", "term", "tf", "df", "tfidf")) == sorted(
        rows(cut, "doc_id", "term", "tf", "df", "tfidf"))
    tf = A.doc_terms(docs).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    p = _plan(A.weighted(tf, 300, hot_share=6, hot_rows=7))
    assert "_salt" in p and "BroadcastHashJoin" in p and "Cartesian" not in p


def test_summary_counts_terms_once_and_keeps_sentences(spark):
    docs = spark.createDataFrame(
        [(1, "Common words here. Zebra quagga!  Common again? "), (2, "Common words. Common words."),
         (3, None), (4, "")], "doc_id long, text string")
    got = rows(A.summarise(docs, n=1).orderBy("doc_id"), "doc_id", "pos", "sentence")
    assert got == [(1, 1, "Zebra quagga!"), (2, 0, "Common words.")]


def test_filters_choose_documents(spark):
    docs = spark.createDataFrame(
        [(1, "alpha v1.2 beta", "md", T0), (2, "alpha alpha", "pdf", T0 + dt.timedelta(days=9)),
         (3, "gamma v2.0", "pdf", None), (4, "alpha v3.1", None, T0)],
        "doc_id long, text string, file_type string, created_at timestamp_ntz")
    days = {"date_range": {"start": "2024-01-01", "end": "2024-01-02"}}
    assert rows(A.technical_mentions(docs, filters={"file_type": ["md"]}), "doc_id", "mention") == [
        (1, "v1.2")]
    got = {r.file_type: r.n_aspect for r in A.compare(docs, "alpha", "file_type",
                                                      filters=days).collect()}
    assert got == {"md": 1, None: 1}
    lex = spark.createDataFrame([("alpha", 1)], "word string, polarity int")
    got = {r.file_type: r.n_docs for r in A.sentiment(docs, lex, "file_type", topic="Alpha").collect()}
    assert got == {"md": 1, "pdf": 1, None: 1}
    assert {r.doc_id for r in A.key_terms(docs, filters={"file_type": ["pdf"], **days}).collect()
            } == set()


def test_search_filters(spark):
    chunks = spark.createDataFrame(
        [(1, 0, [1.0, 0.0], "md"), (2, 0, [0.9, 0.0], "pdf"), (3, 0, [0.0, 1.0], "pdf")],
        "doc_id long, pos long, embedding array<double>, file_type string")
    q = spark.createDataFrame([(7, 1, [1.0, 0.0])], "qid long, variant long, embedding array<double>")
    assert rows(search(q, chunks, k=2, payload=[], filters={"file_type": ["pdf"]}), "doc_id", "rank"
                ) == [(2, 1), (3, 2)]
    assert {r.doc_id for r in multi_query_search(q, chunks, 5, filters={"file_type": []}).collect()
            } == set()


def test_image_type_of_the_bytes(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000020000000308020000000000")
    jpg = bytes.fromhex("FFD8FFC000110800050004030122000211010311")
    files = spark.createDataFrame(
        [(1, "jpg", png), (2, "PNG", jpg), (3, "jpeg", png), (4, "png", b"text"), (5, "jpg", b""),
         (6, "txt", png[:8]), (7, "png", None)], "id long, file_type string, content binary")
    got = {r.id: r for r in extract_text(files).collect()}
    assert got[1].text == got[3].text == "Image dimensions: (2, 3), format: PNG"
    assert (got[2].text, got[2].file_type) == ("Image dimensions: (4, 5), format: JPEG", "png")
    assert all(got[i].text is None and got[i].error for i in (4, 5, 6, 7))
    own = {r.id: r.text for r in extract_text(files, {"png": lambda b: "own"}).collect()}
    assert own[4] == "own" and own[1] is None       # types by name beside a caller's image decoder


def test_uploads_are_documents_of_their_own(spark):
    df = spark.createDataFrame([("a", "pdf", "1"), ("a", "pdf", "2"), ("a", None, "1")],
                               "filename string, file_type string, up string")
    by_row = [r.id for r in C.save_documents(df, upload=F.col("up")).collect()]
    assert len(set(by_row)) == 3
    assert by_row == [r.id for r in C.save_documents(df, upload=F.col("up")).collect()]
    assert len({r.id for r in C.save_documents(df).collect()}) == 1


def test_expand_query(spark):
    def client(prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return "other words"
    q = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "qid long, question string")
    got = {r.qid: r for r in expand_query(q, client).collect()}
    assert got[1].expanded == "good\nother words" and got[1].reword_error is None
    assert got[2].expanded == "bad" and "no" in got[2].reword_error
    assert got[3].expanded is None
