"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet
and reread as the next stage's ``docs``. All but the last return the columns of their input,
whatever these are. Nulls, empty tables, repeated rows and extra columns are handled as the
operators' docstrings say."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, langid, minhash, mixing, tokenfile
from quarry.llm.queries import table
from quarry.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without a letter, and those that the model
    gives less than even odds, go."""
    return langid.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one
    with the smallest id."""
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a document taken twice is two rows, one not taken is none."""
    return mixing.mix(docs).select("doc.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files in document order; returns their index, read back from them:
    doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(spark, "pipeline-tokens")
    tokenfile.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.token_index(spark, path)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix", mix), ("token_files", token_files)]

#: A learned language model and a hashed permutation have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; intermediates are Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
