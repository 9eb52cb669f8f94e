"""Plan checks: pushdown, no Python in native operators, no cartesian products."""

from pyspark.sql import functions as F

from quarry.operators import catalog as C
from quarry.operators.chunk import chunk_words
from quarry.operators.search import search
from quarry.sources.tables import table

from conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "cat")
    spark.read.parquet(f"{SF001}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.lit("pdf").alias("file_type"),
        F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("created_at")).write.parquet(path)
    df = C.apply_filters(spark.read.parquet(path), {"file_type": ["pdf"], "date_range": {
        "start": "2024-01-01 00:00:00", "end": "2024-01-03 00:00:00"}}).select("id")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(file_type), In(file_type" in p or "EqualTo(file_type" in p
    assert "ReadSchema: struct<id:bigint,file_type:string,created_at:timestamp_ntz>" in p


def test_chunking_is_native(spark):
    df = chunk_words(table(spark, SF001, "documents").select("doc_id", "text"))
    assert "Python" not in plan(df) and "ArrowEval" not in plan(df)


def test_search_has_no_cartesian_product(spark):
    emb = table(spark, SF001, "embeddings")
    q = emb.select(F.col("vec_id").alias("qid"), "embedding")
    c = emb.select(F.col("vec_id").alias("doc_id"), F.lit(0).cast("long").alias("pos"), "embedding")
    p = plan(search(q, c, k=5, payload=[]))
    assert "Cartesian" not in p and "NestedLoop" not in p


def test_no_local_checkpoint_in_library():
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[1] / "quarry"
    for f in root.rglob("*.py"):
        assert "localCheckpoint" not in f.read_text(), f
