"""The pipeline end to end, and the registered queries against their SQL."""

import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF001
from quarry.llm.queries import ORACLE, QUERIES
from tools.compare import TABLES, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = QUERIES[name](spark, SF001)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_stages_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "near_dedup", "decontaminate", "mix", "token_files"]
    assert "quarry.llm" in sys.modules


def test_pipeline_decisions(spark, tmp_path):
    r = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    text = lambda: " ".join(r.choice(words, 40))
    rows = [(i, text(), "en", "s%d" % (i % 2), 0, "e") for i in range(40)]
    item = "this very benchmark question has exactly twelve words in it right now"
    rows += [(100, "123 456", "en", "s0", 0, "e"), (101, rows[0][1], "en", "s0", 0, "e"),
             (102, rows[1][1] + " " + item, "en", "s0", 0, "e"), (103, None, None, None, 0, None),
             rows[5]]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted(x.doc_id for x in docs.select("doc_id").collect()))
    lang, dedup, clean, mixed = seen
    assert lang == sorted([*range(40), 5, 101, 102])
    assert dedup == [*range(40), 102] and clean == [*range(40)]
    assert set(mixed) <= set(clean) and max(map(mixed.count, set(mixed))) <= 2
    got = corpus_pipeline.token_files(spark, docs, sf).orderBy("start").collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = {x[0]: x[1] for x in rows}
    assert [x.doc_id for x in got] == mixed
    for x in got:
        ids = tok.encode(by[x.doc_id], add_special_tokens=False).ids + [2]
        assert x.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_runs_on_the_tables(spark):
    df = corpus_pipeline.run(spark, SF001)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    total = df.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert total[0] == total[1] > 0
