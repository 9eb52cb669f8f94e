"""Catalog state, filters, search union, prompts and generation goldens (FIXTURES §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions.validate import validate_query
from quarry.operators import catalog as C
from quarry.operators import prompts as P
from quarry.operators.generate import generate
from quarry.operators.search import unique_union
from quarry.sources.records import from_vector_json, to_vector_json

T0 = dt.datetime(2024, 1, 1)


def _catalog(spark):
    rows = [(i, f"f{i}.txt", "txt", None, "{}", "processing", 3, 0, T0, T0) for i in (1, 2, 3)]
    return spark.createDataFrame(rows, C.CATALOG_SCHEMA)


def test_q4_status_rules(spark):
    ev = spark.createDataFrame([
        (1, 1, 1, T0 + dt.timedelta(minutes=1), 3, None),      # 3 of 3 → completed
        (2, 1, 2, T0 + dt.timedelta(minutes=2), 2, None),      # then 2 of 3 → processing
        (3, 99, 1, T0 + dt.timedelta(minutes=1), 3, None),     # unknown id → no change
        (4, 3, 1, T0 + dt.timedelta(minutes=1), 1, "failed"),  # explicit status
    ], "event_id long, doc_id long, seq long, event_ts timestamp_ntz, processed_chunks long, status string")
    got = {r.id: (r.processing_status, r.processed_chunks, r.updated_at)
           for r in C.current_status(_catalog(spark), ev).collect()}
    assert got[1] == ("processing", 2, T0 + dt.timedelta(minutes=2))
    assert got[2] == ("processing", 0, T0)
    assert got[3] == ("failed", 1, T0 + dt.timedelta(minutes=1))


def test_q4_event_order_independent(spark):
    base = [(i, 1, i, T0 + dt.timedelta(minutes=i), i, None) for i in range(1, 4)]
    schema = "event_id long, doc_id long, seq long, event_ts timestamp_ntz, processed_chunks long, status string"
    a = C.current_status(_catalog(spark), spark.createDataFrame(base, schema)).collect()
    b = C.current_status(_catalog(spark), spark.createDataFrame(base[::-1] + base, schema)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_v4_v6_filters(spark):
    cat = _catalog(spark)
    assert C.filter_types(cat, []).count() == 0
    assert C.apply_filters(cat, {}).count() == 3
    assert C.apply_filters(cat, None).count() == 3
    assert C.apply_filters(cat, {"file_type": ["txt"], "date_range": {
        "start": "2024-01-01 00:00:00", "end": "2024-01-01 00:00:00"}}).count() == 3


def test_s8_insert_rule(spark):
    rows = spark.createDataFrame([("a", "txt", 1), ("b", "txt", 2)],
                                 "filename string, file_type string, total_chunks long")
    got = {r.filename: (r.processing_status, r.processed_chunks)
           for r in C.save_documents(rows, now="2024-01-01 00:00:00").collect()}
    assert got == {"a": ("completed", 0), "b": ("processing", 0)}


def test_r5_unique_union(spark):
    df = spark.createDataFrame([("t", "f", T0, 2), ("t", "f", T0, 1), ("t", "f", T0 + dt.timedelta(1), 3)],
                               "page_content string, filename string, created_at timestamp_ntz, rank int")
    got = sorted((r.created_at, r["rank"]) for r in
                 unique_union(df, ["page_content", "filename", "created_at"]).collect())
    assert got == [(T0, 1), (T0 + dt.timedelta(1), 3)]


def test_v3_query_validation(spark):
    df = spark.createDataFrame([(" \t",), ("a" * 1000,), ("a" * 1001,)], "q string")
    got = [tuple(r[0]) for r in df.select(validate_query("q")).collect()]
    assert got == [(False, "Query cannot be empty"), (True, ""), (False, "Query too long")]


def test_l2_query_types(spark):
    df = spark.createDataFrame([("TVs for sale",), ("Compare when",), ("Whenever",), ("hello",)],
                               "q string")
    assert [r[0] for r in df.select(P.classify_query("q")).collect()] == [
        "comparative", "comparative", "temporal", "semantic"]


def test_l10_extract(spark):
    df = spark.createDataFrame([("a" * 500, None), ("b" * 501, "f")], "c string, f string")
    name, ex = P.display_extract("c", "f")
    got = df.select(name, ex).collect()
    assert (got[0][0], got[0][1]) == ("Unknown", "a" * 500)
    assert (got[1][0], got[1][1]) == ("f", "b" * 500 + "...")


def test_l11_template(spark):
    df = spark.createDataFrame([("x {topic} y",)], "t string")
    out = P.format_query(df, "summary", topic="t").first().query
    assert out == "Provide a comprehensive summary of x {topic} y from the documents"
    with pytest.raises(KeyError):
        P.format_query(df, "comparison", aspect="t")
    assert P.templates(spark).count() == 8


def test_l1_l5_l6_prompts(spark):
    df = spark.createDataFrame([("q", "ctx", "x" * 5000)], "q string, c string, t string")
    r = df.select(P.summary_prompt("t", limit=4000).alias("s"), P.answer_prompt("c", "q").alias("a"),
                  P.reword_prompt("q").alias("w")).first()
    assert r.s == P.SUMMARY_PROMPT.format(text="x" * 4000)
    assert r.a == P.ANSWER_PROMPT.format(context="ctx", query="q")
    assert r.w == P.REWORD_PROMPT.format(query="q", num_queries=4)


def test_l4_context_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")],
                               "qid int, rank int, page_content string")
    got = {r.qid: r.context for r in P.build_context(df).collect()}
    assert got == {1: "a, b", 2: "c"}


def test_l7_generate_error_capture(spark):
    def client(p):
        if "bad" in p:
            raise RuntimeError("boom")
        return p.upper()
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "i int, prompt string")
    got = {r.i: (r.result, r.error) for r in generate(df, client).collect()}
    assert got[1] == ("OK", None) and got[3] == ("FINE", None)
    assert got[2][0] is None and "boom" in got[2][1]


def test_l8_base64(spark):
    df = spark.createDataFrame([(bytearray(b"hi there"), "aGk=", "not base64!")],
                               "b binary, good string, bad string")
    r = df.select(P.encode_b64("b").alias("e"), P.decode_b64("good").alias("g"),
                  P.decode_b64("bad").alias("x")).first()
    assert r.e == "aGkgdGhlcmU=" and bytes(r.g.data) == b"hi" and r.x.error == P.B64_ERROR


def test_s9_round_trip_and_missing_key(spark):
    df = spark.createDataFrame([("1", [0.5, 1.0], '{"k": "é"}')], "id string, vector array<float>, metadata string")
    back = from_vector_json(to_vector_json(df)).first()
    assert (back.id, list(back.vector), back.metadata) == ("1", [0.5, 1.0], '{"k":"é"}')
    bad = spark.createDataFrame([('{"id": "1", "vector": [1.0]}',)], "json string")
    with pytest.raises(Exception):
        from_vector_json(bad).collect()


def test_l7_last_duplicate_wins(spark):
    df = spark.createDataFrame([("a.png", 1, "x"), ("b.png", 2, "y"), ("a.png", 3, "z")],
                               "path string, i int, prompt string")
    got = {r.path: r.result for r in generate(df, str.upper, key="path", order="i").collect()}
    assert got == {"a.png": "Z", "b.png": "Y"}
