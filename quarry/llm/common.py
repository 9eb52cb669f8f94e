"""Helpers shared by the training-data operators: written intermediate tables, vectorised word
hashing over UTF-8 bytes, connected components and tree sums of large count vectors.

Nothing here reads or writes outside Spark's own readers and writers: intermediates are Parquet
tables in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path

# ------------------------------------------------------------------ intermediate tables


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and return a scan of it: lineage is
    cut, a lost executor costs a re-read, and later passes read only the columns they need."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_quarry_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


TASK_BYTES = 32 << 20   # what one task sorts and writes, if the cores have enough tasks


def few(df: DataFrame, size: int) -> DataFrame:
    """``df`` in tasks of TASK_BYTES of its ``size`` (at most so many bytes), no fewer than cores:
    each task takes sort buffers and starts processes for its file, however few its rows are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-size // TASK_BYTES)))


BATCH_BYTES = 4 << 20


def release() -> None:
    """Give the memory that a worker no longer uses back to the system: Python workers are used
    again by later stages, and what they keep would add up in an executor."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function over batches of about BATCH_BYTES (a longer row is a batch of its
    own), so that what it makes of a batch stays small; afterwards unused memory is released."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut():
            for batch in batches:
                rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows)
        try:
            yield from run(cut())
        finally:
            release()
    return wrapped


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as a list of UTF-8 byte strings (None for null)."""
    return column.cast(pa.binary()).to_pylist()


def fold_remainder(doc_id: Column | str, mod: int = 4) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; the fold of a null id is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod, F.lit(0))


# ------------------------------------------------------------------ words of a text as hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32                                  # A-Z only
SPACED = np.ones(256, bool)                         # [^\x20\x09-\x0D]+
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)                         # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEGMENT = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (all bits of the result depend on all bits of ``x``)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_words(raw: bytes, table: np.ndarray, fold: bool):
    b = np.frombuffer(raw, np.uint8)
    if fold:
        b = LOWER[b]
    m = np.zeros(len(b) + 2, np.int8)
    m[1:-1] = table[b]
    d = np.diff(m)
    s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    p, inv = _pow(len(b) + 1)
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[:-1], out=c[1:])
    h = (c[e] - c[s]) * inv[s]
    return mix(h + (e - s).astype(np.uint64)), s, e


def words(raw: bytes | None, table: np.ndarray, fold: bool = True
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``raw`` (maximal runs of bytes that ``table`` marks, after
    lower-casing A-Z if ``fold``) with their byte starts and ends. Texts are cut between words
    into segments of about 1 MiB, so the working memory doesn't follow the text."""
    if not raw:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    if len(raw) <= 2 * _SEGMENT:
        return _segment_words(raw, table, fold)
    parts, at, n = [], 0, len(raw)
    while at < n:
        end = min(at + _SEGMENT, n)
        while end < n and table[LOWER[raw[end]] if fold else raw[end]]:
            end += 1
        h, s, e = _segment_words(raw[at:end], table, fold)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes, in order; one hash of the whole
    sequence if it is shorter, none if it is empty."""
    n = len(h)
    if n == 0:
        return h
    w = min(k, n)
    acc = h[: n - w + 1] * _COEF[0]
    for j in range(1, w):
        acc = acc + h[j: n - w + 1 + j] * _COEF[j]
    return mix(acc + np.uint64(w))


# ------------------------------------------------------------------ connected components


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of ``edges`` (any orderable
    type; self-links and repeats are allowed).

    Alternating large-star and small-star steps: each is a grouped minimum (partial
    aggregation) joined back to the links, so a node with a third of all links is a skewed join
    that adaptive execution splits, never a group gathered in one task. The links of every round
    are a written table; stops when a round changes none."""
    def oriented(df, u, v):
        return (df.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                .filter(F.col("u") != F.col("v")).distinct())

    def state(df):
        return df.agg(F.count(F.lit(1)),
                      F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    cur = stored(oriented(edges, F.col(a), F.col(b)), "cc")
    seen = state(cur)
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select(
            "u", F.least("m0", "u").alias("m"))
        large = oriented(both.filter("v > u").join(least, "u").select("v", "m"),
                         F.col("v"), F.col("m"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = oriented(large.join(down, "u").select("v", "m").unionByName(
            down.select(F.col("u").alias("v"), "m")), F.col("v"), F.col("m"))
        new = stored(small, "cc")
        now = state(new)
        drop_stored(cur)
        cur = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge; raise max_rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


# ------------------------------------------------------------------ tree sums


def sum_vectors(df: DataFrame, key: str, value: str, fan_in: int = 64) -> DataFrame:
    """Element-wise sums of int64 vectors (binary columns of one length per key): rows
    ``(key, value)``, one per task and key, are added in levels of ``fan_in``, so that no task
    ever reads more than ``fan_in`` vectors of a key, whatever the number of tasks."""
    spark = df.sparkSession
    cur = stored(df.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("r"),
                           F.col(value).alias("v")), "sums")
    while True:
        most = cur.groupBy("k").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return cur.select(F.col("k").alias(key), F.col("v").alias(value))
        groups = -(-most // fan_in)
        n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), groups * 64))
        salted = (cur.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
                  .repartition(n, "k", "g").sortWithinPartitions("k", "g"))
        schema = cur.select("k", F.col("r").cast("long"), "v").schema
        new = stored(salted.select("k", "g", "v").mapInArrow(_add_sorted, schema), "sums")
        drop_stored(cur)
        cur = new


def _add_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, total, out_schema = None, None, None

    def row(k, g, v):
        return pa.RecordBatch.from_arrays(
            [pa.array([k], out_schema), pa.array([g], pa.int64()),
             pa.array([v.tobytes()], pa.binary())], names=["k", "r", "v"])

    for batch in batches:
        out_schema = batch.column(0).type
        ks, gs, vs = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            at = (ks[i].as_py(), gs[i].as_py())
            v = np.frombuffer(vs[i].as_buffer(), np.int64)
            if at == now:
                total += v
            else:
                if now is not None:
                    yield row(*now, total)
                now, total = at, v.copy()
    if now is not None:
        yield row(*now, total)
