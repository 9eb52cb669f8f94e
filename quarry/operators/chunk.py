"""Chunking (C1-C4).

C3 (fixed word windows) is native: split → sequence of window starts → slice → array_join,
then posexplode. C1/C2 (the recursive splitter) run the splitter kernel in Arrow batches of bounded
bytes and return one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.text import words
from quarry.llm.common import bounded

# Index splitter size/overlap and the LLM-side character splitter.
TOKEN_CHUNK_SIZE, TOKEN_CHUNK_OVERLAP = 300, 50
CHAR_CHUNK_SIZE, CHAR_CHUNK_OVERLAP = 1000, 100
OUT_CHARS = 4_000_000     # characters of chunks that leave a task in one batch
SEPARATORS = ["\n\n", "\n", " ", ""]


def window_count(n_words: Column, size: int = 300, overlap: int = 50) -> Column:
    """Number of C3 windows for a text of ``n_words`` words (0 for a blank text)."""
    stride = size - overlap
    return (F.when(n_words == 0, F.lit(0))
            .otherwise(1 + F.ceil(F.greatest(n_words - size, F.lit(0)) / F.lit(stride)))
            .cast("bigint"))


def word_windows(w: Column, size: int = 300, overlap: int = 50) -> Column:
    """array<string>: windows of ``size`` words over the word array ``w`` (a column that
    is already materialised: it is referenced inside the lambda), consecutive windows
    sharing ``overlap`` words."""
    stride = size - overlap
    n = F.size(w)
    last = (window_count(n, size, overlap) - 1) * stride
    starts = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.sequence(F.lit(0).cast("bigint"), last, F.lit(stride).cast("bigint")))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, (s + 1).cast("int"), size), " "))


def chunk_words(docs: DataFrame, text: str = "text", size: int = 300, overlap: int = 50,
                out: str = "page_content") -> DataFrame:
    """One row per window with ``pos``; the other columns are copied to every chunk.
    The word array is computed in its own projection: referenced from the window lambda it
    would otherwise be re-split once per window."""
    keep = [c for c in docs.columns if c != text]
    with_words = docs.select(*keep, words(text).alias("_w"))
    return with_words.select(
        *keep, F.posexplode(word_windows(F.col("_w"), size, overlap)).alias("pos", out)
    ).withColumn("pos", F.col("pos").cast("bigint"))


def chunk_counts(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """C4: chunks per document (partial aggregation before the shuffle)."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total_chunks"),
                                   F.max("pos").alias("last_pos"))


# --- C1 / C2: recursive splitter --------------------------------------------------------

def _split_keep(text: str, sep: str) -> list[str]:
    if sep == "":
        return list(text)
    parts = text.split(sep)
    out = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in out if p != ""]


def recursive_split(text: str, size: int, overlap: int, length: Callable[[str], int],
                    separators: list[str] | None = None) -> list[str]:
    """Recursive splitter: the first separator present splits the text (kept at the start of
    the following piece); short pieces are merged into windows of at most ``size`` (by
    ``length``) that share up to ``overlap``; long pieces are split again with the
    remaining separators."""
    seps = SEPARATORS if separators is None else separators
    sep, rest = seps[-1], []
    for i, s in enumerate(seps):
        if s == "" or s in text:
            sep, rest = s, seps[i + 1:]
            break
    pieces = _split_keep(text, sep)
    chunks: list[str] = []
    good: list[str] = []
    for p in pieces:
        if length(p) < size:
            good.append(p)
            continue
        if good:
            chunks.extend(_merge(good, size, overlap, length))
            good = []
        if not rest:
            chunks.append(p)
        else:
            chunks.extend(recursive_split(p, size, overlap, length, rest))
    if good:
        chunks.extend(_merge(good, size, overlap, length))
    return chunks


def _merge(pieces: list[str], size: int, overlap: int, length: Callable[[str], int]
           ) -> list[str]:
    docs: list[str] = []
    window: list[str] = []
    total = 0
    for d in pieces:
        n = length(d)
        if total + n > size and window:
            doc = "".join(window).strip()
            if doc:
                docs.append(doc)
            while total > overlap or (total + n > size and total > 0):
                total -= length(window[0])
                window.pop(0)
        window.append(d)
        total += n
    doc = "".join(window).strip()
    if doc:
        docs.append(doc)
    return docs


def word_length(s: str) -> int:
    return len(s.split())


def _split_kernel(text: str, schema: pa.Schema, size: int, overlap: int,
                  length: Callable[[str], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, out, held = [], [], [], 0
            for i, t in enumerate(batch.column(text)):
                t = t.as_py()
                for j, piece in enumerate([] if t is None else
                                          recursive_split(t, size, overlap, length)):
                    at.append(i)
                    pos.append(j)
                    out.append(piece)
                    held += len(piece)
                    if held > OUT_CHARS:
                        yield _chunk_rows(batch, schema, at, pos, out)
                        at, pos, out, held = [], [], [], 0
            if at:
                yield _chunk_rows(batch, schema, at, pos, out)
    return run


def _chunk_rows(batch: pa.RecordBatch, schema: pa.Schema, at: list, pos: list, out: list
                ) -> pa.RecordBatch:
    keep = [batch.column(n).take(pa.array(at, pa.int64())) for n in schema.names[:-2]]
    return pa.RecordBatch.from_arrays([*keep, pa.array(pos, pa.int64()), pa.array(out, pa.string())],
                                      names=schema.names)


def chunk_recursive(docs: DataFrame, text: str = "text", size: int = TOKEN_CHUNK_SIZE,
                    overlap: int = TOKEN_CHUNK_OVERLAP,
                    length: Callable[[str], int] = word_length,
                    out: str = "page_content") -> DataFrame:
    """C1 (token length; default: whitespace words) and C2 (``length=len``). A task holds a few MB of
    texts and of chunks at a time, and gives its memory back at its end."""
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("pos", T.LongType()),
                           T.StructField(out, T.StringType())])
    kernel = _split_kernel(text, to_arrow_schema(schema), size, overlap, length)
    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(
        bounded(kernel), schema)


def chunk_tokens(docs: DataFrame, text: str = "text", size: int = TOKEN_CHUNK_SIZE,
                 overlap: int = TOKEN_CHUNK_OVERLAP,
                 length: Callable[[str], int] = word_length) -> DataFrame:
    return chunk_recursive(docs, text, size, overlap, length)


def chunk_chars(docs: DataFrame, text: str = "text", size: int = CHAR_CHUNK_SIZE,
                overlap: int = CHAR_CHUNK_OVERLAP) -> DataFrame:
    return chunk_recursive(docs, text, size, overlap, len)
