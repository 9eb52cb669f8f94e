"""Operator 2: near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) come from a bounded sample; a vector is described by its ``PREFIX``
nearest pivots in order of distance. An inverted list holds the vectors of one label that have
the pivot among them. Two vectors that meet in a list are candidates if they share ``SHARED``
pivots, and if their distances from the list's pivot differ by no more than linked vectors' can
(the triangle bound, exact); candidates are verified by cosine in double precision.

Equal vectors of a label are one class first, so a common vector costs one row. Long lists are
cut into blocks and each pair of blocks is one bounded group; a pair is verified only in the list
of its smallest shared pivot, so no link is counted twice. What leaves a group is one row per
linked vector: how many rows it links, and one vector of its linked part (a spanning star), so a
cluster of any size costs rows in proportion to its vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, drop_stored, stored

PIVOTS = 128
PREFIX = 12         # with SHARED: 0.98 of the links at 0.93 in vectors with a common direction
SHARED = 4
SAMPLE = 4096       # vectors from which the pivots are chosen
BLOCK = 512
COSINE = 0.93


def choose_pivots(sample: np.ndarray, count: int, dims: int, seed: int = 11) -> np.ndarray:
    """Spread-out reference points: each is the sampled vector farthest from those before it;
    random directions if the sample runs out."""
    rng = np.random.default_rng(seed)
    chosen = []
    if len(sample):
        near = np.full(len(sample), -np.inf)
        at = 0
        for _ in range(min(count, len(sample))):
            chosen.append(sample[at])
            near = np.maximum(near, sample @ sample[at])
            at = int(near.argmin())
    extra = rng.normal(size=(count - len(chosen), dims))
    extra /= np.linalg.norm(extra, axis=1, keepdims=True)
    return np.concatenate((np.array(chosen).reshape(-1, dims), extra))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows must be finite and not zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True) + 0.0
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _clean(values, width: type) -> np.ndarray | None:
    """The vector, or None if it can't link."""
    if values is None or any(v is None for v in values):
        return None
    v = np.array(values, width) + width(0)
    return v if len(v) and np.isfinite(v).all() and v.any() else None


def _describe(pivots: dict[int, np.ndarray], count: int, prefix: int, width: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors, nearest = [], [], []
            for emb, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v = _clean(emb, width) if label is not None else None
                if v is None:
                    nodes.append(None), vectors.append(None), nearest.append(None)
                    continue
                d = len(v)
                if d not in pivots:
                    pivots[d] = choose_pivots(np.zeros((0, d)), count, d)
                u = units(v[None].astype(np.float64))[0]
                near = np.argsort(-(pivots[d] @ u), kind="stable")[:prefix]
                raw = v.astype(np.float64).tobytes()
                nodes.append(hashlib.blake2b(raw + str(label).encode(), digest_size=16).digest())
                vectors.append(v.tobytes()), nearest.append(near.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()),
                 pa.array(vectors, pa.binary()), pa.array(nearest, pa.list_(pa.int32()))],
                names=["vec_id", "label", "node", "vector", "nearest"])
    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from every row over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _linker(pivots: dict[int, np.ndarray], count: int, shared: int, cosine: float, width: type):
    """Rows sorted by (label, dims, pivot, bi, bj)."""
    # Vectors of length one and this cosine are so far apart at most.
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9

    def links(key, rows):
        pivot = key[2]
        nodes, vectors, near, weight, blk = zip(*rows)
        x = units(np.frombuffer(b"".join(vectors), width).reshape(len(rows), -1).astype(np.float64))
        d = x.shape[1]
        if d not in pivots:
            pivots[d] = choose_pivots(np.zeros((0, d)), count, d)
        away = np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots[d][pivot])))
        hot = np.zeros((len(rows), count), np.float32)
        hot[np.arange(len(rows))[:, None], np.array(near)] = 1
        open_ = (hot @ hot.T >= shared) & (np.abs(away[:, None] - away) <= reach)
        if key[3] != key[4]:
            b = np.array(blk)
            open_ &= b[:, None] != b
        i, j = np.nonzero(np.triu(open_, 1))
        us, vs = [], []
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            mine = (hot[a] * hot[b]).argmax(axis=1) == pivot
            a, b = a[mine], b[mine]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            us.append(a[ok]), vs.append(b[ok])
        if not us:
            return [], [], []
        i, j = np.concatenate(us), np.concatenate(vs)
        m, others = np.array(weight, np.int64), np.zeros(len(rows), np.int64)
        np.add.at(others, i, m[j])
        np.add.at(others, j, m[i])
        root, linked = _roots(len(rows), i, j), np.flatnonzero(others)
        return ([nodes[r] for r in linked], [nodes[root[r]] for r in linked],
                others[linked].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key, rows):
            us, vs, ns = links(key, rows) if len(rows) > 1 else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(us, pa.binary()), pa.array(vs, pa.binary()), pa.array(ns, pa.int64())],
                names=["u", "v", "others"])
        now, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(10)]
            for label, dims, pivot, bi, bj, *row in zip(*cols):
                key = (label, dims, pivot, bi, bj)
                if key != now:
                    if len(rows) > 1:
                        yield emit(now, rows)
                    now, rows = key, []
                rows.append(row)
        yield emit(now, rows)
    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS,
                 prefix: int = PREFIX, shared: int = SHARED, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``, ``label``): vec_id, n_links
    (other rows linked directly), component_id (smallest vec_id reachable, itself included), kept
    (vec_id = component_id).

    Only rows with equal, non-null labels and equal dimensions are compared. A vector that is
    null, empty, zero or holds a null or non-finite component links with nothing and is its own
    component. Rows that repeat vector and label are links of cosine 1. A null vec_id keeps its
    row and counts as a link; it is no component's name. Other columns aren't read."""
    spark = vectors.sparkSession
    src = vectors.select("vec_id", "embedding", F.col("label"))
    width = np.float32 if src.schema["embedding"].dataType.elementType.simpleString() == "float" \
        else np.float64
    # About ``sample`` rows by a hash of the vector, equal vectors once.
    share = min(1.0, sample / max(src.count(), 1))
    some = src.select("embedding").filter(F.pmod(F.xxhash64(F.lit(3), "embedding"), F.lit(
        1 << 30)) < share * (1 << 30)).distinct().limit(2 * sample).collect()
    clean = [v for v in (_clean(r["embedding"], width) for r in some) if v is not None]
    by_dims: dict[int, np.ndarray] = {}
    for d in {len(v) for v in clean}:
        x = units(np.array([v for v in clean if len(v) == d], np.float64))
        by_dims[d] = choose_pivots(x[np.lexsort(x.T)], pivots, d)
    kinds = [src.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    told = stored(src.mapInArrow(_describe(by_dims, pivots, prefix, width), (
        f"vec_id {kinds[0]}, label {kinds[1]}, node binary, vector binary, nearest array<int>")),
        "embeds-index")
    nodes = stored(told.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"),
        F.first("nearest").alias("nearest"), F.count(F.lit(1)).alias("m")), "embeds-nodes")
    lists = nodes.withColumn("dims", F.length("vector")).select(
        "label", "dims", F.explode("nearest").alias("pivot"), "node", "vector", "nearest", "m")
    lengths = lists.groupBy("label", "dims", "pivot").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").drop("n")
    blocked = (lists.join(lengths, ["label", "dims", "pivot"])
               .withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
               .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
               .select("label", "dims", "pivot", F.least("blk", "o").alias("bi"),
                       F.greatest("blk", "o").alias("bj"), "node", "vector", "nearest", "m",
                       "blk"))
    key = ["label", "dims", "pivot", "bi", "bj"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = stored(blocked.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(
        _linker(by_dims, pivots, shared, cosine, width), "u binary, v binary, others long"),
        "embeds-links")
    comps = stored(connected_components(links, "u", "v"), "embeds-comps")
    others = links.groupBy("u").agg(F.sum("others").alias("others"))
    per_node = stored(
        nodes.select("node", "m").join(others.withColumnRenamed("u", "node"), "node", "left")
        .join(comps.withColumnRenamed("comp", "root"), "node", "left")
        .select("node", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                F.coalesce("root", "node").alias("root")), "embeds-result")
    drop_stored(nodes, links, comps)
    rows = told.select("vec_id", "node").join(per_node, "node", "left")
    low = rows.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("vec_id").alias("low"))
    return rows.join(low, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("low"))
        .alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
