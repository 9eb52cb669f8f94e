"""Approximate nearest neighbours with an inverted-file (IVF) index.

Cells come from Spark ML k-means on the chunk vectors (distributed training). Each query is
scored against its nearest cells only. Its list of cells is one number, the distance of the farthest one,
which tasks over the queries find; the query block (size-checked, broadcast) carries it, and the chunk
kernel scores a batch's rows against the queries that reach their cell, by the kernel of the exact search.
So no list grows with the cells that are probed. The chunks are written in the order of their cells. Of
several blocks one is worked on at a time, its ranked rows written.
How many cells are probed follows from the index: an exact search of a sample of the queries
shows how far down their lists of cells the true neighbours lie, and the least number of cells
that holds the wanted share of them is taken (``n_probe`` at least). A query whose cells hold
fewer than ``k`` chunks goes on to further ones. The result is approximate by design (the
feature); ``recall_at_k`` measures it against the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators.cells import (FIT_PER_CELL, FIT_ROWS, SEED_CELLS, _cell_udf, usable)
from quarry.operators.search import (DEFAULT_MAX_BROADCAST_BYTES, Nearest, _batch_rows,
                                     _query_blocks, matrix, search)
from quarry.session import scratch_path

RECALL = 0.9
_SAMPLE = 256             # queries searched exactly to choose the number of cells


def build_ivf(chunks: DataFrame, vec: str = "embedding", n_cells: int | None = None,
              seed: int = 7, max_iter: int = 20):
    """Fit cells on a bounded share of the rows; returns (centroids as numpy array, all usable chunks
    with a ``cell`` column, written in the order of the cells)."""
    # Read several times: written to the shared folder, so that the chunks are derived once.
    spark = chunks.sparkSession
    path, fine = scratch_path(spark, "ivf"), chunks.filter(usable(vec))
    fine.write.parquet(path + "-0")
    data = spark.read.schema(fine.schema).parquet(path + "-0")
    n = data.count()
    k = n_cells or max(1, int(math.sqrt(n)))
    share = min(1.0, min(FIT_ROWS, FIT_PER_CELL * k) / max(1, n))
    fit = data if share == 1.0 or n <= FIT_PER_CELL * SEED_CELLS else data.sample(share, seed)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="cell",
                   initMode="k-means||" if k <= SEED_CELLS else "random").fit(
        fit.select(array_to_vector(vec).alias("_v")))
    cents = np.array([c for c in model.clusterCenters()], dtype=np.float64)
    placed = data.withColumn("cell", _cell_udf(spark.sparkContext.broadcast(cents))(F.col(vec)))
    # By range of cell and content: a cell of any size is as many tasks as it needs.
    order = ["cell", F.xxhash64(*chunks.columns)]
    placed.repartitionByRange(*order).sortWithinPartitions("cell").write.parquet(path)
    return cents, spark.read.schema(placed.schema).parquet(path)


def _cell_distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((q ** 2).sum(1)[:, None] + (centroids ** 2).sum(1) - 2.0 * (q @ centroids.T), 0.0)


def _reach(q: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, n_probe: int, k: int) -> np.ndarray:
    """The squared distance of the farthest cell that each query probes: of its ``n_probe`` nearest ones,
    and of further ones until they hold ``k`` rows. 4 million distances are held at once."""
    out, n = np.empty(len(q)), min(max(1, n_probe), len(centroids))
    step = max(1, 4_000_000 // len(centroids))
    for lo in range(0, len(q), step):
        d = _cell_distances(q[lo:lo + step].astype(np.float64), centroids)
        far = np.partition(d, n - 1, axis=1)[:, n - 1]
        few = np.flatnonzero((d <= far[:, None]) @ sizes.astype(np.float64) < k)
        if len(few):
            near = np.argsort(d[few], axis=1, kind="stable")
            last = np.minimum((np.cumsum(sizes[near], axis=1) < k).sum(1), len(centroids) - 1)
            far[few] = np.maximum(far[few], d[few, near[np.arange(len(few)), last]])
        out[lo:lo + step] = far
    return out


def _reach_kernel(bc, vec: str, n_probe: int, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                far = _reach(matrix(batch.column(vec)), *bc.value, n_probe, k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far)], schema=schema)
    return run


def _probing(queries: np.ndarray, reach: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The places of the queries that reach the cell around ``centre``."""
    found = []
    for lo in range(0, len(queries), 65536):
        q = queries[lo:lo + 65536].astype(np.float64)
        d = _cell_distances(q, centre[None, :])[:, 0]
        slack = 1e-12 * ((q ** 2).sum(1) + (centre ** 2).sum())     # of sums in another order
        found.append(lo + np.flatnonzero(d <= reach[lo:lo + 65536] + slack))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ivf_kernel(bc, qkeys: list[str], ids: list[str], vec: str, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries, reach, centroids = bc.value
        best = Nearest(queries, np.full(len(queries), np.inf), k, len(ids))
        last, at = None, np.zeros(0, np.int64)      # rows come in the order of their cells
        for batch in batches:
            x, names, use = _batch_rows(batch, ids, vec, k)
            if not len(x):
                continue
            cells, rows = batch.column("cell").to_numpy()[use], best.rows(x, names)
            for cell in np.unique(cells):
                if cell != last:
                    last, at = cell, _probing(queries, reach, centroids[cell])
                best.score(at, rows, np.flatnonzero(cells == cell))
        q, d, *found = best.cut()
        for lo in range(0, len(q), 65536):
            part = slice(lo, lo + 65536)
            cols = [*[keys[c].to_numpy()[q[part]] for c in qkeys], *[i[part] for i in found], d[part]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type, from_pandas=True) for c, f in zip(cols, schema)], schema=schema)
    return run


def _cell_order(qmat: np.ndarray, centroids: np.ndarray) -> Iterator[np.ndarray]:
    """All cells from near to far, a row per query; 4 million distances are held at once."""
    cn, step = (centroids ** 2).sum(1), max(1, 4_000_000 // len(centroids))
    for i in range(0, len(qmat), step):
        yield np.argsort(cn - 2.0 * (qmat[i:i + step] @ centroids.T), axis=1, kind="stable")


def measured_probes(queries: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int,
                    recall: float, qkeys: list[str], ids: list[str], vec: str) -> int:
    """The least number of nearest cells that holds a share ``recall`` of the true neighbours of a
    sample of the queries, two standard errors added where there are more queries."""
    some = queries.orderBy(F.xxhash64(*qkeys)).select(vec).limit(_SAMPLE + 1).toArrow()
    every, some = len(some) <= _SAMPLE, some[:_SAMPLE]
    if not len(some):
        return 1
    qmat = matrix(some[vec]).astype(np.float64)
    sample = indexed.sparkSession.createDataFrame(
        list(enumerate(qmat.tolist())), T.StructType([
            T.StructField("_q", T.LongType()), T.StructField(vec, T.ArrayType(T.DoubleType()))]))
    exact = search(sample, indexed, k, "_q", ids, vec, payload=["cell"])
    cells: dict[int, list[int]] = {}
    for r in exact.select("_q", "cell").collect():      # _SAMPLE x k rows
        cells.setdefault(r["_q"], []).append(r["cell"])
    places, q = [], 0
    for order in _cell_order(qmat, centroids):
        for row in order:
            places.extend(np.argsort(row)[cells.get(q, [])].tolist())
            q += 1
    if not places:
        return 1
    want = recall if every else min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / len(qmat)))
    return sorted(places)[max(0, math.ceil(want * len(places) - 1e-9) - 1)] + 1


def approx_search(queries: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int = 5,
                  n_probe: int = 4, qkeys: list[str] | str = "qid",
                  ids: list[str] | None = None, vec: str = "embedding",
                  recall: float | None = RECALL,
                  max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Top-``k`` by squared L2 among the chunks of each query's nearest cells: ``n_probe`` at least,
    as many as ``recall`` needs by measure (not measured if it is None), and as many as hold ``k``
    chunks. Queries are broadcast in size-checked blocks, as in the exact search."""
    qkeys = [qkeys] if isinstance(qkeys, str) else list(qkeys)
    ids = ids or ["doc_id", "pos"]
    spark = indexed.sparkSession
    qsel = queries.select(*qkeys, vec).filter(usable(vec))
    csel = indexed.select(*ids, vec, "cell").filter(F.col(vec).isNotNull())
    qt = {f.name: f.dataType for f in qsel.schema.fields}
    ct = {f.name: f.dataType for f in csel.schema.fields}
    schema = T.StructType([T.StructField(c, qt[c]) for c in qkeys]
                          + [T.StructField(c, ct[c]) for c in ids]
                          + [T.StructField("distance", T.DoubleType())])
    sizes = np.zeros(len(centroids), np.int64)
    for r in csel.groupBy("cell").count().collect():     # one row per cell
        sizes[r["cell"]] = r["count"]
    if recall is not None:
        n_probe = max(n_probe, measured_probes(qsel, csel, centroids, k, recall, qkeys, ids, vec))
    # Each query's reach is found in tasks; then the queries are read block by block.
    bc = spark.sparkContext.broadcast((centroids, sizes))
    reaching = T.StructType([*qsel.schema.fields, T.StructField("_reach", T.DoubleType())])
    path = scratch_path(spark, "reach")
    qsel.mapInArrow(_reach_kernel(bc, vec, n_probe, k, to_arrow_schema(reaching)), reaching
                    ).write.parquet(path)
    bc.destroy()
    qsel = spark.read.schema(reaching).parquet(path)
    blocks, n = _query_blocks(qsel, qkeys, vec, max_broadcast_bytes)
    if not n:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(None).cast("bigint")).select(
            *qkeys, "rank", *ids, "distance")
    w = Window.partitionBy(*qkeys).orderBy(F.floor(F.col("distance") * 1e6 + 0.5), *ids)
    parts = []
    for block in blocks:    # each block is within the broadcast bound
        held = block.toArrow()
        bc = spark.sparkContext.broadcast((held.select(qkeys).to_pandas(), matrix(held[vec]),
                                           held["_reach"].to_numpy(), centroids))
        del held
        near = csel.mapInArrow(_ivf_kernel(bc, qkeys, ids, vec, k, to_arrow_schema(schema)), schema)
        top = near.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
        if len(blocks) > 1:     # a block's rows are final: written, so that one block is held at a time
            path = scratch_path(spark, "probed")
            top.write.parquet(path)
            top = spark.read.schema(top.schema).parquet(path)
            bc.destroy()
        parts.append(top)
    top = parts[0]
    for p in parts[1:]:
        top = top.unionByName(p)
    return (top.withColumn("distance", F.round("distance", 6))
            .select(*qkeys, "rank", *ids, "distance"))


def recall_at_k(approx: DataFrame, exact: DataFrame, qkeys: list[str] | str = "qid",
                ids: list[str] | None = None) -> DataFrame:
    """Share of the exact top-k found by the approximate search, per query."""
    qkeys = [qkeys] if isinstance(qkeys, str) else list(qkeys)
    ids = ids or ["doc_id", "pos"]
    hit = exact.select(*qkeys, *ids).join(approx.select(*qkeys, *ids).withColumn("_h", F.lit(1)),
                                          [*qkeys, *ids], "left")
    return hit.groupBy(*qkeys).agg(F.round(F.avg(F.coalesce("_h", F.lit(0))), 6).alias("recall"))
