"""Reading the supplied tables (S3 and friends): plain Parquet scans, so Catalyst prunes
columns and pushes filters into the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def rebalance(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than the session has cores (e.g. one file
    with one row group) over all of them with a round-robin repartition. Large inputs
    already have many more splits than cores and are returned unchanged, so no shuffle is
    added at scale; filters and column pruning still reach the scan below the repartition."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rebalance(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """S3: already fetched pages (page_id, url, html)."""
    return spark.read.parquet(path)
