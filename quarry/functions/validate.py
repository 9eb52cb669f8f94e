"""Validation and file-type columns (S1, V1-V3). Results are struct(ok, error) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import PY_WS, col_

# Accepted upload extensions, size cap and messages.
ALLOWED_EXTENSIONS = ["pdf", "docx", "jpg", "jpeg", "png", "json", "xml", "csv", "zip", "md",
                      "txt", "html", "htm", "rtf"]
MAX_FILE_SIZE = 10 * 1024 * 1024
FILE_BAD_TYPE = "Invalid file type"
FILE_TOO_LARGE = "File too large"
QUERY_EMPTY = "Query cannot be empty"
QUERY_TOO_LONG = "Query too long"
QUERY_MAX_LEN = 1000


def file_type_of(name) -> Column:
    """Text after the last '.', lower-cased; the whole name when there is no dot."""
    return F.lower(F.element_at(F.split(col_(name), r"\."), -1))


def _result(err: Column) -> Column:
    return F.struct(err.isNull().alias("ok"), F.coalesce(err, F.lit("")).alias("error"))


def extension_error(name) -> Column:
    return F.when(~file_type_of(name).isin(*ALLOWED_EXTENSIONS), F.lit(FILE_BAD_TYPE))


def validate_extension(name) -> Column:
    """V1."""
    return _result(extension_error(name))


def validate_file(name, length, max_bytes: int = MAX_FILE_SIZE) -> Column:
    """V2: extension first, then size (exactly ``max_bytes`` passes)."""
    err = F.coalesce(extension_error(name),
                     F.when(col_(length) > max_bytes, F.lit(FILE_TOO_LARGE)))
    return _result(err)


def validate_query(q) -> Column:
    """V3: blank (Unicode whitespace only) → empty; more than 1000 characters → too long."""
    q = col_(q)
    err = (F.when(q.isNull() | F.regexp_replace(q, rf"{PY_WS}+", "").eqNullSafe(""),
                  F.lit(QUERY_EMPTY))
           .when(F.length(q) > QUERY_MAX_LEN, F.lit(QUERY_TOO_LONG)))
    return _result(err)
