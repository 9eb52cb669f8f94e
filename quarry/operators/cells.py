"""R2, R8, R9 over a stored index: vectors written by reference point, searched cell by cell.

``write_cells`` writes the rows partitioned by the nearest of up to ``MAX_CELLS`` k-means centres and,
inside a cell, by blocks of about ``BLOCK_ROWS`` rows (a hash of the ids), plus a table with one row
per cell: centre, radius (largest distance to the centre), rows, blocks. ``search_cells`` then

1. lists the cells of each query in tasks over the queries: no query passes through the driver.
   Exact search first searches the nearest cells that hold ``k`` rows; the distance of the k-th one is
   ``tau``. Then it takes every cell that may hold a nearer row: one whose ball, and whose side of the
   plane between its centre and the query's own, come within ``tau``. Approximate search takes the
   ``n_probe`` nearest ones, and further ones until they hold ``k`` rows;
2. joins queries and rows on (unit, block, query block). Small neighbouring cells are one unit of up to
   ``UNIT_ROWS`` rows, so a query that probes many cells is sent to few units. The rows are read from
   the probed cells only (dynamic partition pruning); a large cell is many blocks, so many tasks, and a
   unit has as many query blocks as its own queries fill. A task holds one block of each side;
3. keeps the best ``k`` rows per query and block, then per query: Spark's group limit cuts each
   task's rows before the shuffle.

The rows that leave step 2 depend on the blocks and not on how many tasks run. Distances of the kept
rows are summed from the differences, so they don't depend on the blocks either.

Rows and queries with a vector that is null, empty, or holds null or non-finite components take no
part. All vectors of an index have one length. Ties go to the smaller ids. Queries with equal keys
are one query. An empty index or no query gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.catalog import apply_filters
from quarry.operators.search import (MAX_BROADCAST_WINNERS, Nearest, _find_centres, _rows_of, matrix,
                                     nearest_centre)
from quarry.session import scratch_path

MAX_CELLS = 16_384        # folders of an index; larger tables get more blocks a cell
BLOCK_ROWS = 4_096        # rows of a cell that one task holds
UNIT_ROWS = 16_384        # rows of neighbouring cells that one task holds
QUERY_BLOCK = 16_384      # queries that one task holds
FIT_ROWS = 1_000_000      # rows (by hash share) from which the centres are found, at most
FIT_PER_CELL = 64         # and so many a cell
SEED_CELLS = 256          # up to so many centres start as k-means||, more from random rows
MAX_CENTRE_BYTES = 256 * 1024 * 1024
SAMPLE = 256              # queries searched exactly to choose the number of probed cells
RESERVED = ("cell", "block", "unit", "_qb", "_d", "_limit")


@dataclass(frozen=True)
class CellIndex:
    """A written index: its folder, the columns that identify a row, and the vector column."""

    path: str
    ids: tuple[str, ...]
    vec: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def usable(vec: str) -> Column:
    """True for a vector with entries, all of them finite."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & (F.size(v) > 0) & fine


def _gap_kernel(bc, vec: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf[vec]).astype(np.float64)
                own = nearest_centre(x, bc.value)
                gap = np.sqrt(((x - bc.value[own]) ** 2).sum(1))
                yield pd.DataFrame({"cell": own, "gap": gap})
    return run


def _cell_udf(bc):
    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        return pd.Series(nearest_centre(matrix(vectors).astype(np.float64), bc.value))
    return cell


def write_cells(chunks: DataFrame, path: str, ids: list[str] | None = None,
                vec: str = "embedding", n_cells: int | None = None, seed: int = 7,
                max_iter: int = 20, block_rows: int = BLOCK_ROWS) -> CellIndex:
    """Write ``chunks`` as an index below ``path`` (replaced if it exists). Every usable row is
    written; only the centres come from a bounded share of them."""
    ids = ids or ["doc_id", "pos"]
    clash = [c for c in RESERVED if c in chunks.columns]
    if clash:
        raise ValueError(f"rename the columns {clash}: an index has its own")
    index = CellIndex(path.rstrip("/"), tuple(ids), vec)
    # Centres, statistics and rows read the same rows: write them once to the shared folder.
    stored = scratch_path(chunks.sparkSession, "cell-rows")
    fine = chunks.filter(usable(vec))
    fine.write.parquet(stored)
    data = chunks.sparkSession.read.schema(fine.schema).parquet(stored)
    n = data.count()
    if n == 0:
        (data.withColumn("block", F.lit(0).cast("bigint")).withColumn("cell", F.lit(0))
         .write.mode("overwrite").parquet(f"{index.path}/rows"))
        data.sparkSession.createDataFrame([], _CELLS).write.mode("overwrite").parquet(
            f"{index.path}/cells")
        return index
    # Centres are fitted on a share that the ids' hash chooses, the same on every run.
    k = max(2, n_cells or min(MAX_CELLS, int(math.sqrt(n))))     # two centres at least
    share = min(1.0, min(FIT_ROWS, FIT_PER_CELL * k) / n)
    fit = data if share == 1.0 or n <= FIT_PER_CELL * SEED_CELLS else data.filter(
        F.pmod(F.xxhash64(*ids), F.lit(1_000_000)) < int(share * 1_000_000))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="cell",
                   initMode="k-means||" if k <= SEED_CELLS else "random").fit(
        fit.select(array_to_vector(F.col(vec)).alias("_v")))
    spark = data.sparkSession
    found = np.array(model.clusterCenters(), dtype=np.float64)
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)],
                                    "cell int, centre array<double>")
    bc = spark.sparkContext.broadcast(found)
    stats = data.select(vec).mapInPandas(_gap_kernel(bc, vec), "cell int, gap double").groupBy(
        "cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
    placed = data.withColumn("cell", _cell_udf(bc)(F.col(vec)))
    (centres.join(stats, "cell")
     .withColumn("n_blocks", F.ceil(F.col("n") / F.lit(block_rows)).cast("bigint"))
     .select(*[f.name for f in _CELLS.fields])
     .write.mode("overwrite").parquet(f"{index.path}/cells"))
    blocks = F.broadcast(index.cells(spark).select("cell", "n_blocks"))  # MAX_CELLS rows at most
    (placed.join(blocks, "cell")
     .withColumn("block", F.pmod(F.xxhash64(*ids), F.col("n_blocks"))).drop("n_blocks")
     .repartition("cell", "block")
     .write.mode("overwrite").partitionBy("cell").parquet(f"{index.path}/rows"))
    return index


_CELLS = T.StructType([T.StructField("cell", T.IntegerType()),
                       T.StructField("centre", T.ArrayType(T.DoubleType())),
                       T.StructField("radius", T.DoubleType()),
                       T.StructField("n", T.LongType()), T.StructField("n_blocks", T.LongType())])


def _centres(spark: SparkSession, index: CellIndex, rows: DataFrame | None = None):
    """The cells' table as arrays, one row per cell: its size is checked before it is collected.
    With ``rows`` (filtered ones), each cell's count is theirs and cells without any are left out."""
    size = index.cells(spark).agg(F.count(F.lit(1)).alias("n"),
                                  F.max(F.size("centre")).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 > MAX_CENTRE_BYTES:
        raise ValueError("the centres exceed MAX_CENTRE_BYTES: write the index with fewer cells")
    cells = index.cells(spark)
    if rows is not None:
        cells = cells.drop("n").join(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell")
    pdf = cells.orderBy("cell").toPandas()
    mat = np.stack(pdf["centre"].to_numpy()) if len(pdf) else np.zeros((0, 1))
    return (pdf["cell"].to_numpy(), mat, pdf["radius"].to_numpy(), pdf["n"].to_numpy(),
            pdf["n_blocks"].to_numpy())


def _units(centres: np.ndarray, counts: np.ndarray, n_blocks: np.ndarray) -> np.ndarray:
    """The unit of each cell: neighbouring cells of one block share one, up to ``UNIT_ROWS`` rows."""
    m = len(centres)
    if not m:
        return np.zeros(0, np.int64)
    near = nearest_centre(centres, _find_centres(centres, max(1, math.isqrt(m))))
    unit, out, held = 0, np.zeros(m, np.int64), 0
    for i in np.lexsort([near, n_blocks > 1]):
        if held and (n_blocks[i] > 1 or held + counts[i] > UNIT_ROWS):
            unit, held = unit + 1, 0
        out[i] = unit
        held += counts[i]
    return out


def _distances(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (q ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :] - 2.0 * (q @ centres.T)
    return np.sqrt(np.maximum(d, 0.0))


def _reachable(q, centres, radius, counts, k, limit) -> np.ndarray:
    """Cells (a row of booleans per query) that may hold one of the ``k`` nearest rows, the k-th of
    which is within the squared distance ``limit`` (infinite if it isn't known)."""
    d = _distances(q, centres)
    slack = 1e-6 * (1.0 + np.sqrt((q ** 2).sum(1))[:, None] + radius[None, :] + d)
    far = d + radius[None, :] + slack
    order = np.argsort(far, axis=1, kind="stable")
    full = np.cumsum(counts[order], axis=1) >= k
    at = np.where(full.any(1), full.argmax(1), len(centres) - 1)
    tau = np.minimum(far[np.arange(len(q)), order[np.arange(len(q)), at]] ** 2, limit)
    near = np.maximum(d - radius[None, :] - slack, 0.0)
    # A cell's rows lie on its side of the plane between its centre and the query's nearest one.
    own = d.argmin(1)
    gap = _distances(centres[own], centres)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d ** 2 - d[np.arange(len(q)), own][:, None] ** 2) / (2.0 * gap) - slack
    near = np.maximum(near, np.where(gap > 1e-3 * (1.0 + d), plane, 0.0))
    # Ranks are by squares rounded to 6 digits: rows that tie after rounding stay reachable.
    return near ** 2 <= tau[:, None] + 2e-6


def _nearest(q, centres, counts, k, n_probe) -> np.ndarray:
    """The ``n_probe`` nearest cells and further ones until they hold ``k`` rows."""
    order = np.argsort(_distances(q, centres), axis=1, kind="stable")
    enough = (np.cumsum(counts[order], axis=1) < k).sum(1) + 1
    take = np.arange(len(centres))[None, :] < np.maximum(enough, n_probe)[:, None]
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, take, axis=1)
    return out


def _probe_kernel(bc, vec: str, k: int, n_probe: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, centres, radius, counts, units = bc.value
        step = max(1, 1_000_000 // max(1, len(cells)))
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                if not len(cells):
                    continue
                q = np.stack(part[vec].to_numpy()).astype(np.float64)
                take = (_reachable(q, centres, radius, counts, k, part["_limit"].to_numpy())
                        if n_probe is None else _nearest(q, centres, counts, k, n_probe))
                yield part.assign(_cells=[cells[row].tolist() for row in take],
                                  _units=[np.unique(units[row]).tolist() for row in take])
    return run


def probes(queries: DataFrame, index: CellIndex, k: int, qkeys: list[str], vec: str,
           n_probe: int | None = None, rows: DataFrame | None = None,
           limits: DataFrame | None = None, table: tuple | None = None) -> DataFrame:
    """(*qkeys, vec, _limit, _cells, _units): the cells that each query reads, and their units; all
    reachable cells by default. ``rows``: the index's filtered rows, if it is searched under a filter.
    ``limits`` (*qkeys, _limit): squared distances within which the k-th row lies."""
    spark = queries.sparkSession
    q = queries.select(*qkeys, vec).filter(usable(vec)).dropDuplicates(qkeys)
    q = (q.withColumn("_limit", F.lit(float("inf"))) if limits is None else
         q.join(limits, qkeys, "left").withColumn("_limit", F.coalesce("_limit", F.lit(float("inf")))))
    cells, centres, radius, counts, n_blocks = table or _centres(spark, index, rows)
    bc = spark.sparkContext.broadcast((cells, centres, radius, counts,
                                       _units(centres, counts, n_blocks)))
    schema = T.StructType(list(q.schema.fields)
                          + [T.StructField("_cells", T.ArrayType(T.IntegerType())),
                             T.StructField("_units", T.ArrayType(T.LongType()))])
    return q.mapInPandas(_probe_kernel(bc, vec, k, n_probe), schema)


def _block_kernel(qkeys: list[str], ids: list[str], qvec: str, vec: str, k: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        cols = [*qkeys, *ids, "cell", "_d"]
        if q.empty or c.empty:
            return pd.DataFrame({name: [] for name in cols})
        c, x = _rows_of(c, ids, vec, k)
        best = Nearest(matrix(q[qvec]).astype(np.float64), q["_limit"].to_numpy(dtype=np.float64), k,
                       len(ids) + 1)
        best.score(np.arange(len(q)), best.rows(x, [c[name].to_numpy() for name in [*ids, "cell"]]))
        qi, d, *found = best.cut()
        out = {name: q[name].to_numpy()[qi] for name in qkeys}
        return pd.DataFrame({**out, **dict(zip([*ids, "cell"], found)), "_d": d})
    return run


def _top(probed: DataFrame, rows: DataFrame, index: CellIndex, k: int, qkeys: list[str], vec: str,
         table: tuple) -> tuple[DataFrame, int]:
    """The ``k`` nearest rows of each query among its cells: (*qkeys, *ids, cell, _d, rank), and
    the number of queries."""
    spark, ids = probed.sparkSession, list(index.ids)
    path = scratch_path(spark, "probed")        # read for both sides of the join
    probed.write.parquet(path)
    probed = spark.read.schema(probed.schema).parquet(path)
    n = probed.count()
    cells, centres, _, counts, n_blocks = table
    unit = spark.createDataFrame(
        [(int(c), int(u), int(b)) for c, u, b in zip(cells, _units(centres, counts, n_blocks), n_blocks)],
        "cell int, unit long, n_blocks long")
    busy = probed.select(F.explode("_units").alias("unit")).groupBy("unit").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("bigint").alias("n_qb"))
    # A row per unit, MAX_CELLS at most.
    busy = F.broadcast(busy.join(F.broadcast(unit.groupBy("unit").agg(
        F.max("n_blocks").alias("n_blocks"))), "unit").checkpoint())
    qvec, zero = "_qvec", F.lit(0).cast("bigint")
    keys = [f"_k{i}" for i in range(len(qkeys))]
    left = (probed.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(qkeys)],
                          F.col(vec).alias(qvec), "_limit", F.explode("_units").alias("unit"))
            .join(busy, "unit")
            .select(*keys, qvec, "_limit", "unit",
                    F.pmod(F.xxhash64(*keys), F.col("n_qb")).alias("_qb"),
                    F.explode(F.sequence(zero, F.col("n_blocks") - 1)).alias("block")))
    wanted = probed.select(F.explode("_cells").alias("cell")).distinct().checkpoint()
    # The filter makes the read of the rows prune its folders by the broadcast cells.
    right = (rows.select(*ids, index.vec, "cell", "block")
             .join(F.broadcast(wanted.filter(F.col("cell") >= 0)), "cell")
             .join(F.broadcast(unit.drop("n_blocks")), "cell").join(busy, "unit")
             .select(*ids, index.vec, "cell", "unit", "block",
                     F.explode(F.sequence(zero, F.col("n_qb") - 1)).alias("_qb")))
    types = {f.name: f.dataType for f in [*left.schema.fields, *right.schema.fields]}
    schema = T.StructType([T.StructField(c, types[c]) for c in [*keys, *ids, "cell"]]
                          + [T.StructField("_d", T.DoubleType())])
    part = (left.groupBy("unit", "block", "_qb").cogroup(right.groupBy("unit", "block", "_qb"))
            .applyInPandas(_block_kernel(keys, ids, qvec, index.vec, k), schema))
    w = Window.partitionBy(*keys).orderBy(F.floor(F.col("_d") * 1e6 + 0.5), *ids)
    top = part.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    return top, n


def _exact(queries: DataFrame, rows: DataFrame, index: CellIndex, k: int, qkeys: list[str], vec: str,
           table: tuple) -> tuple[DataFrame, int]:
    """``_top`` among all cells that may hold one of the ``k`` nearest rows."""
    near, _ = _top(probes(queries, index, k, qkeys, vec, 1, table=table), rows, index, k, qkeys, vec,
                   table)
    limits = near.filter(F.col("rank") == k).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(qkeys)], F.col("_d").alias("_limit"))
    return _top(probes(queries, index, k, qkeys, vec, limits=limits, table=table), rows, index, k,
                qkeys, vec, table)


def measured_probes(queries: DataFrame, index: CellIndex, k: int, qkeys: list[str] | str = "qid",
                    vec: str | None = None, recall: float = 0.9) -> int:
    """The least number of nearest cells that holds a share ``recall`` of the true neighbours of
    ``SAMPLE`` queries (those first by hash), two standard errors added where there are more."""
    qkeys, vec = [qkeys] if isinstance(qkeys, str) else list(qkeys), vec or index.vec
    spark = queries.sparkSession
    some = (queries.select(*qkeys, vec).filter(usable(vec)).dropDuplicates(qkeys)
            .orderBy(F.xxhash64(*qkeys)).limit(SAMPLE + 1).checkpoint())
    n = some.count()
    table = _centres(spark, index)
    top, _ = _exact(some, index.rows(spark), index, k, qkeys, vec, table)
    hits = top.groupBy(*[f"_k{i}" for i in range(len(qkeys))]).agg(
        F.collect_list("cell").alias("_hits"))                       # k cells
    for i, c in enumerate(qkeys):
        hits = hits.withColumnRenamed(f"_k{i}", c)
    pdf = some.join(hits, qkeys).select(vec, "_hits").toPandas()     # SAMPLE queries
    if pdf.empty:
        return 1
    cells, centres = table[:2]
    at, places = {c: i for i, c in enumerate(cells)}, []
    for v, found in zip(pdf[vec], pdf["_hits"]):
        order = np.argsort(_distances(np.asarray(v, np.float64)[None, :], centres)[0], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        places.extend(place[[at[c] for c in found]].tolist())
    want = recall if n <= SAMPLE else min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / n))
    return sorted(places)[max(0, math.ceil(want * len(places) - 1e-9) - 1)] + 1


def search_cells(queries: DataFrame, index: CellIndex, k: int = 5, qkeys: list[str] | str = "qid",
                 payload: list[str] | None = None, vec: str | None = None,
                 n_probe: int | None = None, with_score: bool = False,
                 filters: dict | None = None) -> DataFrame:
    """The ``k`` rows of the index nearest to each query by squared Euclidean distance: exact (R2,
    R8), or among the ``n_probe`` nearest cells at least (R9; see ``measured_probes``). ``filters``
    (as in ``apply_filters``) choose rows first; the cells are then counted anew, which reads the
    filtered columns only. Returns (*qkeys, rank, *ids, *payload, distance[, score])."""
    qkeys, vec = [qkeys] if isinstance(qkeys, str) else list(qkeys), vec or index.vec
    spark, ids = queries.sparkSession, list(index.ids)
    rows = index.rows(spark)
    payload = [c for c in payload or [] if c not in ids]
    if filters:
        rows = apply_filters(rows, filters)
    table = _centres(spark, index, rows if filters else None)
    top, n = (_exact(queries, rows, index, k, qkeys, vec, table) if n_probe is None else
              _top(probes(queries, index, k, qkeys, vec, n_probe, table=table), rows, index, k, qkeys,
                   vec, table))
    if payload:
        winners = F.broadcast(top) if n * k <= MAX_BROADCAST_WINNERS else top
        top = rows.select("cell", *ids, *payload).join(winners, ["cell", *ids])
    out = [F.col(f"_k{i}").alias(c) for i, c in enumerate(qkeys)] + [F.col("rank")] + [
        F.col(c) for c in [*ids, *payload]] + [F.round("_d", 6).alias("distance")]
    if with_score:
        out.append(F.round(1 - F.col("_d") / 2, 6).alias("score"))
    return top.select(*out)
