"""Search, chunking and ordering operators."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import chunk as CH
from quarry.operators.search import search
from quarry.plans.ordered import lag_column, neighbours, with_sequence


def test_search_exact_vs_bruteforce(spark):
    rnd = random.Random(3)
    chunks = [(i, 0, [rnd.random() for _ in range(8)]) for i in range(300)]
    chunks += [(1000, 0, chunks[0][2])]  # an exact duplicate vector: tie broken by id
    queries = [(q, [rnd.random() for _ in range(8)]) for q in range(7)] + [(99, chunks[0][2])]
    cdf = spark.createDataFrame(chunks, "doc_id long, pos long, embedding array<double>")
    qdf = spark.createDataFrame(queries, "qid long, embedding array<double>")
    got = {}
    for r in search(qdf, cdf.repartition(5), k=3, payload=[]).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc_id))
    for q, v in queries:
        d = sorted((round(sum((a - b) ** 2 for a, b in zip(v, c)), 6), i) for i, _, c in chunks)
        assert [i for _, i in d[:3]] == [i for _, i in sorted(got[q])]


def test_search_query_blocks(spark):
    rnd = random.Random(5)
    cdf = spark.createDataFrame([(i, 0, [rnd.random() for _ in range(4)]) for i in range(50)],
                                "doc_id long, pos long, embedding array<double>")
    qdf = spark.createDataFrame([(q, [rnd.random() for _ in range(4)]) for q in range(20)],
                                "qid long, embedding array<double>")
    one = sorted(map(tuple, search(qdf, cdf, k=2, payload=[]).collect()))
    many = sorted(map(tuple, search(qdf, cdf, k=2, payload=[], max_broadcast_bytes=64).collect()))
    assert one == many


def test_c3_windows(spark):
    text = " ".join(f"w{i}" for i in range(700))
    df = spark.createDataFrame([(1, text), (2, "   "), (3, "a b")], "doc_id int, text string")
    got = CH.chunk_words(df, size=300, overlap=50).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos) for r in got] == [(1, 0), (1, 1), (1, 2), (3, 0)]
    assert got[1].page_content.split()[0] == "w250" and got[2].page_content.split()[-1] == "w699"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=120), min_size=1, max_size=20))
def test_c2_recursive_properties(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    out = CH.chunk_recursive(df, size=20, overlap=5, length=len).collect()
    for r in out:
        src = texts[r.doc_id]
        assert r.page_content.strip() and r.page_content in src and len(r.page_content) <= 20
    for i, t in enumerate(texts):  # every non-blank character is covered by some chunk
        covered = "".join(r.page_content for r in out if r.doc_id == i)
        assert sum(not c.isspace() for c in covered) >= sum(not c.isspace() for c in t)


def test_c1_no_space_text(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, ""), (3, "a\n\nb")], "doc_id int, text string")
    out = CH.chunk_recursive(df, size=20, overlap=5, length=len).orderBy("doc_id", "pos").collect()
    assert "".join(r.page_content for r in out if r.doc_id == 1).startswith("x" * 20)
    assert [r.page_content for r in out if r.doc_id == 3] == ["a\n\nb"]
    assert not [r for r in out if r.doc_id == 2]


def test_sequence_lag_and_lead(spark):
    rows = [(k, i) for k in ("a", "b") for i in range(5)] + [("hot", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int")
    seq = with_sequence(df, [F.col("k"), F.col("i")], num_partitions=6)
    assert sorted(r._seq for r in seq.collect()) == list(range(len(rows)))
    nb = {(r.k, r.i, r.nb_k): r.nb_i for r in neighbours(seq, [1, 2], ["i"], same=["k"]).collect()}
    assert nb[("hot", 0, 1)] == 1 and nb[("hot", 38, 1)] == 39 and ("a", 4, 1) not in nb
    lag = {(r.k, r.i): r.p for r in lag_column(seq, "i", "p", same=["k"]).collect()}
    assert lag[("hot", 10)] == 9 and lag[("b", 0)] is None


def test_r9_recall_against_exact(spark):
    from quarry.operators.approx import approx_search, build_ivf, recall_at_k
    rnd = random.Random(11)
    centers = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    pts = [(i, 0, [c + rnd.gauss(0, 0.05) for c in centers[i % 6]]) for i in range(600)]
    cdf = spark.createDataFrame(pts, "doc_id long, pos long, embedding array<double>")
    qdf = spark.createDataFrame([(q, pts[q * 7][2]) for q in range(30)],
                                "qid long, embedding array<double>")
    cents, indexed = build_ivf(cdf, n_cells=12)
    approx = approx_search(qdf, indexed, cents, k=5, n_probe=3)
    exact = search(qdf, cdf, k=5, payload=[])
    rec = [r.recall for r in recall_at_k(approx, exact).collect()]
    assert len(rec) == 30 and sum(rec) / len(rec) >= 0.9
    # every approximate hit carries its true distance
    got = {(r.qid, r.doc_id): r.distance for r in approx.collect()}
    ex = {(r.qid, r.doc_id): r.distance for r in exact.collect()}
    assert all(abs(got[k] - ex[k]) < 1e-6 for k in got.keys() & ex.keys())


def test_r9_recall_with_the_registered_parameters(spark):
    from quarry.operators.approx import approx_search, build_ivf, recall_at_k
    rnd = random.Random(12)
    point = lambda: [rnd.gauss(0, 1) for _ in range(16)]
    cdf = spark.createDataFrame([(i, 0, point()) for i in range(2500)],
                                "doc_id long, pos long, embedding array<double>")
    qdf = spark.createDataFrame([(q, point()) for q in range(300)],
                                "qid long, embedding array<double>")
    cents, indexed = build_ivf(cdf)
    approx = approx_search(qdf, indexed, cents, k=5, n_probe=4)
    rec = [r.recall for r in recall_at_k(approx, search(qdf, cdf, k=5, payload=[])).collect()]
    assert len(rec) == 300 and sum(rec) / len(rec) >= 0.9


def test_r9_goes_on_until_it_holds_k_rows(spark):
    from quarry.operators.approx import approx_search, build_ivf
    rnd = random.Random(13)
    cdf = spark.createDataFrame([(i, 0, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)],
                                "doc_id long, pos long, embedding array<double>")
    qdf = cdf.select(F.col("doc_id").alias("qid"), "embedding").limit(10)
    cents, indexed = build_ivf(cdf, n_cells=30)
    for k, recall in ((25, 0.9), (25, None), (80, None)):
        got = approx_search(qdf, indexed, cents, k=k, n_probe=4, recall=recall)
        assert {r["count"] for r in got.groupBy("qid").count().collect()} == {min(k, 60)}
