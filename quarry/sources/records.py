"""Record formats (S9): the vector-document JSON round trip.

``{"id": ..., "vector": [...], "metadata": {...}}``: ``to_json`` of a struct and ``from_json``
with a fixed schema in FAILFAST mode, so a record that misses a key is an error as it is in
the reference. Metadata stays an open JSON object (kept as a JSON string column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR_DOC_SCHEMA = "id STRING, vector ARRAY<FLOAT>, metadata STRING"


def to_vector_json(df: DataFrame, out: str = "json") -> DataFrame:
    """(id, vector, metadata JSON string) → one JSON text per record."""
    meta = F.coalesce(F.parse_json(F.col("metadata")), F.parse_json(F.lit("{}")))
    return df.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"),
                                        F.col("vector").alias("vector"),
                                        meta.alias("metadata"))).alias(out))


def from_vector_json(df: DataFrame, col: str = "json") -> DataFrame:
    """JSON text → (id, vector, metadata). A record lacking a key raises (FAILFAST)."""
    parsed = F.from_json(F.col(col), "id STRING, vector ARRAY<FLOAT>, metadata VARIANT",
                         {"mode": "FAILFAST"})
    missing = (parsed["id"].isNull() | parsed["vector"].isNull() | parsed["metadata"].isNull())
    checked = F.when(missing, F.raise_error(F.concat(F.lit("VectorDocument key missing: "),
                                                     F.col(col)))).otherwise(parsed)
    return df.select(checked.alias("_r")).select(
        F.col("_r.id").alias("id"), F.col("_r.vector").alias("vector"),
        F.to_json(F.col("_r.metadata")).alias("metadata"))
