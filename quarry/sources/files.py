"""File sources (S1, S2): directory scans and zip archive expansion."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.validate import file_type_of

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def with_file_columns(df: DataFrame, path: str = "path") -> DataFrame:
    """filename (last path segment) and file_type (S1 rule) from a path column."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return df.withColumn("filename", name).withColumn("file_type", file_type_of(name))


def scan_files(spark: SparkSession, directory: str, pattern: str | None = None) -> DataFrame:
    """Every file below ``directory`` as (path, filename, file_type, length,
    modificationTime, content). Projections that drop ``content`` do not read the bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return with_file_columns(reader.load(directory))


ARCHIVE_SCHEMA = T.StructType([
    T.StructField("archive_path", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("error", T.StringType()),
])


BATCH_BYTES = 16 * 1024 * 1024      # members of one output batch


def _expand(batches: Iterator[pd.DataFrame], batch_bytes: int = BATCH_BYTES
            ) -> Iterator[pd.DataFrame]:
    """Members in batches of bounded bytes, whatever the archives' sizes: one member is expanded
    at a time, and small archives share a batch."""
    names, rows, held = [f.name for f in ARCHIVE_SCHEMA.fields], [], 0
    for pdf in batches:
        for archive, data in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for info in z.infolist():
                        if info.filename.endswith("/"):
                            continue  # directory entry
                        member = z.read(info)
                        rows.append((archive, info.filename, len(member), member, None))
                        held += len(member)
                        if held >= batch_bytes:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
            except Exception as e:  # corrupt, encrypted or unsupported: a row, not a failed job
                rows.append((archive, None, None, None, f"Error reading archive: {e}"))
    if rows:
        yield pd.DataFrame(rows, columns=names)


def expand_archives(files: DataFrame) -> DataFrame:
    """Zip files become one row per member (directories skipped, no size check on
    members, nested zips stay members of type zip and are not supported downstream);
    other files pass through with ``archive_path`` NULL. One archive per task input row,
    so an archive's members never leave the task that read it."""
    is_zip = F.lower(F.col("filename")).endswith(".zip")
    zips = files.filter(is_zip).select("path", "content").mapInPandas(_expand, ARCHIVE_SCHEMA)
    zips = with_file_columns(zips)
    plain = files.filter(~is_zip | F.col("filename").isNull()).select(
        F.lit(None).cast("string").alias("archive_path"), "path", "filename", "file_type",
        "length", "content", F.lit(None).cast("string").alias("error"))
    return plain.unionByName(zips.select("archive_path", "path", "filename", "file_type",
                                         "length", "content", "error"))
