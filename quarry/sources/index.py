"""The chunk index on Parquet (S4-S6): append, append what is new, read back as unique documents,
clear.

Rows are partitioned by ``file_type`` so metadata filters prune whole folders; the embedding
column is written last so scans that do not need it skip its pages. The index schema is
kept in a ``_schema.json`` side file (ignored by Parquet readers), so a cleared or empty
index still reads as an empty, typed DataFrame.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.search import unique_union

METADATA = ["filename", "file_type", "created_at"]
KEY = "doc_key"     # 128-bit hash of a row's content and metadata
SCHEMA_FILE = "_schema.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm


def _write_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    fs, hpath, jvm = _fs(spark, path)
    fs.mkdirs(hpath)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(hpath, SCHEMA_FILE), True)
    out.write(bytearray(schema.json().encode("utf-8")))
    out.close()


def _read_schema(spark: SparkSession, path: str) -> T.StructType | None:
    fs, hpath, jvm = _fs(spark, path)
    f = jvm.org.apache.hadoop.fs.Path(hpath, SCHEMA_FILE)
    if not fs.exists(f):
        return None
    stream = fs.open(f)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    text = reader.readLine()
    reader.close()
    return T.StructType.fromJson(json.loads(text))


def _has_data(spark: SparkSession, path: str) -> bool:
    fs, hpath, _ = _fs(spark, path)
    if not fs.exists(hpath):
        return False
    return any(not st.getPath().getName().startswith(("_", "."))
               for st in fs.listStatus(hpath))


def write_index(chunks: DataFrame, path: str, mode: str = "append") -> str:
    """Append chunk rows (content, metadata, embedding) to the index at ``path``."""
    cols = [c for c in chunks.columns if c != "embedding"] + (
        ["embedding"] if "embedding" in chunks.columns else [])
    data = chunks.select(*cols)
    spark = data.sparkSession
    before = _read_schema(spark, path) if mode == "append" else None
    data.write.mode(mode).partitionBy("file_type").parquet(path)
    # File and web rows share one index: columns that some rows lack are null in those. No field
    # says that rows are unique from here on (see write_unique).
    known = set(data.schema.names)
    more = [f for f in (before.fields if before is not None else []) if f.name not in known]
    _write_schema(spark, path, T.StructType([
        T.StructField(f.name, f.dataType, True) for f in [*data.schema.fields, *more]]))
    return path


def _filled(idx: DataFrame, names: list[str]) -> list[Column]:
    return [F.coalesce(F.col(m), F.lit("")).alias(m)
            if isinstance(idx.schema[m].dataType, T.StringType) else F.col(m) for m in names]


def content_key(rows: DataFrame, names: list[str]) -> Column:
    """128-bit hash of the columns ``names`` (binary). Every value goes in with its length, so that
    no two different rows make the same bytes; a null string counts as the empty one, as
    ``all_documents`` reads it."""
    parts = []
    for c in _filled(rows, names):
        v = c.cast("string")
        parts += [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v),
                             F.lit("-"))]
    return F.unhex(F.md5(F.concat(*parts)))


def write_unique(chunks: DataFrame, path: str, content: str = "page_content",
                 metadata: list[str] | None = None) -> str:
    """S4 and S5 together: append the rows whose (content, metadata) the index doesn't hold yet, one
    row of each, so that reading it back needs no ``distinct`` over texts.

    Every row carries its ``doc_key``. Of equal rows in ``chunks`` the one that sorts first stays (a
    partial aggregate, so a key of a third of all rows is combined before the shuffle). The keys
    met already are found by reading the index's key column alone, against the keys of this
    batch, which are broadcast by adaptive execution when their measured size allows.
    A batch written again after a failure adds nothing. One writer at a time; an index with rows
    that ``write_index`` appended has no keys for these and raises."""
    spark = chunks.sparkSession
    meta = metadata or [c for c in METADATA if c in chunks.columns]
    names = [content, *meta]
    if KEY in chunks.columns:
        raise ValueError(f"chunks have a column {KEY} of their own")
    before = _read_schema(spark, path)
    held = _has_data(spark, path)
    if held and _unique_over(before) != names:
        raise ValueError(f"{path} holds rows without keys over {names}; write it anew")
    keyed = chunks.withColumn(KEY, content_key(chunks, names))
    one = keyed.groupBy(KEY).agg(F.min(F.struct(*chunks.columns)).alias("_row")).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in chunks.columns], KEY)
    if held:
        met = read_index(spark, path).select(KEY).join(keyed.select(KEY), KEY, "left_semi")
        one = one.join(met, KEY, "left_anti")
    cols = [c for c in one.columns if c != "embedding"] + (
        ["embedding"] if "embedding" in one.columns else [])
    one = one.select(*cols)
    known = set(one.columns)
    more = [f for f in (before.fields if before is not None else []) if f.name not in known]
    fields = [T.StructField(f.name, f.dataType, True, {"unique_over": names} if f.name == KEY else {})
              for f in [*one.schema.fields, *more]]
    # The schema first: rows without one would count as rows without keys.
    _write_schema(spark, path, T.StructType(fields))
    one.write.mode("append").partitionBy("file_type").parquet(path)
    return path


def _unique_over(schema: T.StructType | None) -> list[str] | None:
    """The columns over which the rows of an index are unique, if they are."""
    fields = [f for f in (schema.fields if schema is not None else []) if f.name == KEY]
    return (fields[0].metadata or {}).get("unique_over") if fields else None


def read_index(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The index rows; an absent, empty or cleared index gives an empty typed DataFrame."""
    schema = schema or _read_schema(spark, path)
    if not _has_data(spark, path):
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def all_documents(spark: SparkSession, path: str, content: str = "page_content",
                  metadata: list[str] | None = None, schema: T.StructType | None = None
                  ) -> DataFrame:
    """Every unique (content, metadata) in the index; an absent or empty index gives
    no rows; NULL string metadata reads as '' (an absent dict entry). An index that only
    ``write_unique`` appended to, over these columns, is read as it is, without a shuffle."""
    idx = read_index(spark, path, schema)
    meta = metadata or [c for c in METADATA if c in idx.columns]
    filled = idx.select(content, *_filled(idx, meta))
    if _unique_over(_read_schema(spark, path)) == [content, *meta]:
        return filled
    return unique_union(filled, [content, *meta], rank=None)


def clear_index(spark: SparkSession, path: str) -> None:
    """Delete every row, keep the schema."""
    fs, hpath, _ = _fs(spark, path)
    if not fs.exists(hpath):
        return
    schema = _read_schema(spark, path) or spark.read.parquet(path).schema
    fs.delete(hpath, True)
    _write_schema(spark, path, schema)
