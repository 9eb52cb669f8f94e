"""Search over an index written by cell: exact by triangle bounds, approximate by measured recall."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import cells as C
from quarry.operators.approx import recall_at_k
from quarry.operators.search import search

SCHEMA = "doc_id long, pos long, embedding array<double>"


def _clustered(rnd, n, dims=8, centres=6, spread=0.05):
    mids = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, 0, [c + rnd.gauss(0, spread) for c in mids[i % centres]]) for i in range(n)]


def _brute(queries, chunks, k):
    out = {}
    for q, v in queries:
        d = sorted((round(sum((a - b) ** 2 for a, b in zip(v, c)), 6), i) for i, _, c in chunks)
        out[q] = [i for _, i in d[:k]]
    return out


def _got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r["rank"], r.doc_id))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


def test_exact_over_cells_and_blocks(spark, tmp_path, monkeypatch):
    rnd = random.Random(21)
    pts = _clustered(rnd, 400)
    pts += [(1000 + i, 0, pts[0][2]) for i in range(30)]        # copies: ties go to smaller ids
    queries = [(q, pts[q * 9][2]) for q in range(20)] + [
        (100 + q, [rnd.gauss(0, 2) for _ in range(8)]) for q in range(10)]
    cdf, qdf = spark.createDataFrame(pts, SCHEMA), spark.createDataFrame(
        queries, "qid long, embedding array<double>")
    # small blocks of both sides: a cell is read by several tasks
    monkeypatch.setattr(C, "QUERY_BLOCK", 4)
    index = C.write_cells(cdf, str(tmp_path / "ix"), n_cells=12, block_rows=16)
    assert index.rows(spark).count() == len(pts)
    assert index.cells(spark).agg(F.max("n_blocks")).first()[0] > 1
    got = C.search_cells(qdf, index, k=5)
    assert _got(got) == _brute(queries, pts, 5)
    want = search(qdf, cdf, k=5, payload=[])
    key = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.distance)
                            for r in df.collect())
    assert key(got) == key(want)
    # tight clusters: a query near one reads a part of the cells only
    n = C.probes(qdf.filter("qid < 100"), index, 5, ["qid"], "embedding").agg(
        F.avg(F.size("_cells"))).first()[0]
    assert n < 8
    # the result doesn't depend on the number of tasks
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert key(C.search_cells(qdf, index, k=5)) == key(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_more_rows_wanted_than_there_are(spark, tmp_path):
    pts = _clustered(random.Random(22), 30)
    cdf = spark.createDataFrame(pts, SCHEMA)
    index = C.write_cells(cdf, str(tmp_path / "ix"), n_cells=5)
    qdf = cdf.select(F.col("doc_id").alias("qid"), "embedding")
    for n_probe in (None, 1):
        got = C.search_cells(qdf, index, k=50, n_probe=n_probe)
        assert {r["count"] for r in got.groupBy("qid").count().collect()} == {30}


def test_awkward_rows(spark, tmp_path):
    """Null, empty and non-finite vectors take no part; empty tables give no rows."""
    nan, inf = float("nan"), float("inf")
    pts = [(1, 0, [0.0, 0.0]), (2, 0, None), (3, 0, []), (4, 0, [nan, 1.0]), (5, 0, [inf, 0.0]),
           (6, 0, [1.0, None]), (7, 0, [3.0, 4.0])]
    cdf = spark.createDataFrame(pts, SCHEMA)
    qdf = cdf.select(F.col("doc_id").alias("qid"), "embedding")
    index = C.write_cells(cdf, str(tmp_path / "a"))
    assert _got(C.search_cells(qdf, index, k=3)) == {1: [1, 7], 7: [7, 1]}
    assert C.search_cells(qdf.limit(0), index, k=3).count() == 0
    empty = C.write_cells(cdf.limit(0), str(tmp_path / "b"))
    assert C.search_cells(qdf, empty, k=3).count() == 0
    with pytest.raises(ValueError):
        C.write_cells(cdf.withColumn("cell", F.lit(1)), str(tmp_path / "c"))


def test_filters_payload_and_pruned_read(spark, tmp_path):
    pts = _clustered(random.Random(23), 200)
    cdf = spark.createDataFrame(pts, SCHEMA).withColumn(
        "file_type", F.when(F.col("doc_id") % 7 == 0, "pdf").otherwise("md"))
    qdf = spark.createDataFrame([(q, pts[q][2]) for q in range(8)],
                                "qid long, embedding array<double>")
    index = C.write_cells(cdf, str(tmp_path / "ix"), n_cells=10)
    got = C.search_cells(qdf, index, k=4, payload=["file_type"], filters={"file_type": ["pdf"]})
    assert {r.file_type for r in got.collect()} == {"pdf"}
    assert _got(got) == _brute([(q, pts[q][2]) for q in range(8)],
                               [p for p in pts if p[0] % 7 == 0], 4)
    plan = C.search_cells(qdf, index, k=4)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "WindowGroupLimit" in plan


def test_measured_recall(spark, tmp_path):
    rnd = random.Random(24)
    point = lambda: [rnd.gauss(0, 1) for _ in range(16)]
    cdf = spark.createDataFrame([(i, 0, point()) for i in range(2000)], SCHEMA)
    qdf = spark.createDataFrame([(q, point()) for q in range(300)],
                                "qid long, embedding array<double>")
    index = C.write_cells(cdf, str(tmp_path / "ix"))
    n = C.measured_probes(qdf, index, 5)
    assert 1 <= n < index.cells(spark).count()
    rec = [r.recall for r in recall_at_k(C.search_cells(qdf, index, k=5, n_probe=n),
                                         search(qdf, cdf, k=5, payload=[])).collect()]
    assert len(rec) == 300 and sum(rec) / len(rec) >= 0.9
