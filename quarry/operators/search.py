"""Similarity search (R2-R5, R7-R9) over chunk embeddings.

Exact top-k (R2) never materialises query × chunk pairs as rows and never cross-joins:

1. the query vectors are counted and sized; blocks of at most ``max_broadcast_bytes`` are
   broadcast (more queries → more blocks, each one more pass over the chunks). A block is grouped by
   the nearest of up to ``MAX_CENTRES`` centres, found from at most ``CENTRE_SAMPLE`` queries;
2. beyond ``FEW_QUERIES`` queries, the chunks' ids and vectors are written in the order of their own
   nearest centres, range-partitioned, so that a popular centre is many tasks;
3. a first pass scores each group of queries against the chunks of the nearest centres that hold
   ``FIRST_SHARE`` of all chunks (``k`` at least). The distance of a query's k-th chunk there bounds its
   true k-th one;
4. the second pass leaves out the groups of queries that lie beyond their bounds for certain: by the
   balls around the centres and the planes between them, or by boxes around groups of queries in the
   leading principal directions, whichever rules out more. What remains is scored in tiles by a product of
   single-precision matrices that errs on the near side; the distance of what it lets through is
   summed in double precision. A task keeps the best ``k`` chunks per query only (ties broken by the
   chunk id columns);
5. the partial results are ranked by a window per query (Spark pushes a partial group limit below
   the shuffle). Of several blocks one is worked on at a time, its ranked rows written;
6. payload columns are joined back to the ≤ queries × k winners (a bounded broadcast).

The result is exact on any input. How much is left out depends on how near the k-th chunk is against
the distances between centres; vectors without any near ones are all compared, in bounded memory.
Distances are rounded to 6 digits before ranking so float noise cannot reorder results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators.catalog import apply_filters
from quarry.session import scratch_path

DEFAULT_MAX_BROADCAST_BYTES = 96 * 1024 * 1024
MAX_BROADCAST_WINNERS = 2_000_000
FEW_QUERIES = 2_048       # up to so many are compared with every chunk in one pass
MAX_CENTRES = 4_096
CENTRE_SAMPLE = 65_536    # queries (by hash share) from which the centres are found
FIRST_SHARE = 1 / 32      # of the chunks, that the first pass scores
BOX_DIMS = 3              # principal directions of the boxes
BOX_QUERIES = 256         # queries of a box
_PAIR_BUDGET = 4_000_000  # query × chunk distances held at once by one kernel call
_TILE = (512, 1_024)      # queries and chunks of one product, which stays in the cache
_KEPT = 500_000           # candidates held before they are cut to k a query
_TIE = 2e-6               # squared distances this near may tie after rounding


def _round6(d: np.ndarray) -> np.ndarray:
    return np.floor(d * 1e6 + 0.5) / 1e6


def matrix(vectors) -> np.ndarray:
    """The vectors of a pandas or Arrow column as rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, 1))
    if not isinstance(vectors, pa.Array):
        return np.stack(vectors.to_numpy())
    flat = vectors.flatten()
    dims = len(flat) // len(vectors)
    if dims and not vectors.null_count and pc.all(
            pc.equal(pc.list_value_length(vectors), dims)).as_py():
        return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.stack(vectors.to_numpy(zero_copy_only=False))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, cn = np.zeros(len(x), np.int32), (centres ** 2).sum(1)
    step = max(1, _PAIR_BUDGET // max(1, len(centres)))
    for lo in range(0, len(x), step):
        out[lo:lo + step] = np.argmin(cn - 2.0 * (x[lo:lo + step] @ centres.T), axis=1)
    return out


@dataclass
class _Rows:
    """Rows to be compared with queries: the vectors (double), their ids, the matrix of the product, the
    largest squared norm, and the product's error as a share of the norms."""

    x: np.ndarray
    ids: list[np.ndarray]
    right: np.ndarray
    top: float
    rel: float


class Nearest:
    """The ``k`` rows nearest to each of a task's queries, so far: ``limit`` is the squared distance
    that a row must not exceed."""

    def __init__(self, queries: np.ndarray, limit: np.ndarray, k: int, n_ids: int):
        self.q, self.limit, self.k, self.n_ids = queries, limit.copy(), k, n_ids
        self.qn = np.einsum("ij,ij->i", queries, queries, dtype=np.float64)
        self.held: list[tuple] = []
        self.n = 0
        self.space: np.ndarray | None = None

    def rows(self, x: np.ndarray, ids: list[np.ndarray]) -> _Rows:
        """Rows ``x`` (finite, double) made ready to be compared with queries."""
        n, dims = x.shape
        xn = np.einsum("ij,ij->i", x, x)
        top = float(xn.max()) if n else 0.0
        kind = np.float32 if max(self.qn.max(initial=0.0), top) < 1e30 else np.float64
        # More than the error of the product in single precision, as a share of the norms.
        rel = (dims + 8) * 1.2e-7
        right = np.empty((n, dims + 2), kind)
        right[:, :dims], right[:, dims], right[:, dims + 1] = x, 1.0, xn * (0.5 - rel)
        return _Rows(x, ids, right, top, rel)

    def score(self, at: np.ndarray, rows: _Rows, some: np.ndarray | None = None) -> None:
        """Compare the queries at the places ``at`` with the rows at the places ``some`` (all)."""
        right = rows.right if some is None else rows.right[some]
        if not len(at) or not len(right):
            return
        if self.space is None or self.space.dtype != right.dtype:
            self.space = np.empty(_TILE[0] * _TILE[1], right.dtype)
        dims = right.shape[1] - 2
        for q0 in range(0, len(at), _TILE[0]):
            part = at[q0:q0 + _TILE[0]]
            left = np.empty((len(part), dims + 2), right.dtype)
            left[:, :dims], left[:, dims + 1] = self.q[part], -1.0
            limit, least = self._least(part, rows)
            left[:, dims] = -least
            for lo in range(0, len(right), _TILE[1]):
                there = right[lo:lo + _TILE[1]]
                s = self.space[:len(part) * len(there)].reshape(len(part), len(there))
                np.matmul(left, there.T, out=s)  # 0 at least where the distance may be within the limit
                hit = np.flatnonzero(s.max(1) >= 0)
                if not len(hit):
                    continue
                s = s if len(hit) == len(part) else s[hit]
                near = s >= 0
                if len(there) >= self.k and np.count_nonzero(near) > 4 * self.k * len(hit) + 64:
                    # The k-th of this tile bounds it too.
                    cut = np.partition(s, len(there) - self.k, axis=1)[:, len(there) - self.k]
                    slack = 4 * rows.rel * (self.qn[part[hit]] + rows.top + limit[hit]) + _TIE
                    near = s >= np.maximum(cut - slack, 0.0)[:, None]
                    kth = self.qn[part[hit]] - 2.0 * (cut + least[hit]) + 3.0 * slack
                    self.limit[part[hit]] = np.minimum(self.limit[part[hit]], kth)
                    limit, least = self._least(part, rows)
                    left[:, dims] = -least
                qi, ci = np.nonzero(near)
                self._hold(part[hit[qi]], lo + ci if some is None else some[lo + ci], rows)

    def _least(self, at: np.ndarray, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
        """Limits that are finite, and what the product must come to at least."""
        qn = self.qn[at]
        limit = np.minimum(self.limit[at] + _TIE, 2.1 * (qn + rows.top) + 1.0)
        return limit, (qn - limit) / 2 - rows.rel * (qn + limit)

    def _hold(self, at: np.ndarray, ci: np.ndarray, rows: _Rows) -> None:
        d = [((self.q[at[i:i + 65536]].astype(np.float64) - rows.x[ci[i:i + 65536]]) ** 2).sum(1)
             for i in range(0, len(at), 65536)]
        d = np.concatenate(d) if d else np.zeros(0)
        keep = d <= self.limit[at] + _TIE
        at, ci, d = at[keep], ci[keep], d[keep]
        if not len(at):
            return
        self.held.append((at, d, *[i[ci] for i in rows.ids]))
        self.n += len(at)
        if self.n > _KEPT + self.k * len(self.q):
            self.cut()

    def cut(self) -> tuple:
        """(query place, squared distance, *ids) of the rows held, nearest first."""
        if not self.held:
            return (np.zeros(0, np.int64), np.zeros(0), *[np.zeros(0)] * self.n_ids)
        q, d, *ids = [np.concatenate(c) for c in zip(*self.held)]
        d6 = _round6(d)
        order = np.lexsort([pd.factorize(i, sort=True)[0] if i.dtype == object else i
                            for i in reversed(ids)] + [d6, q])
        q, d, d6, ids = q[order], d[order], d6[order], [i[order] for i in ids]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last, keep = place == self.k - 1, place < self.k
        self.limit[q[last]] = np.minimum(self.limit[q[last]], d6[last])
        out = (q[keep], d[keep], *[i[keep] for i in ids])
        self.held, self.n = [out], int(keep.sum())
        return out


@dataclass
class _Block:
    """A broadcast block of queries in the order of their centres."""

    keys: pd.DataFrame
    vectors: np.ndarray
    starts: np.ndarray              # first query of each centre, and their number
    centres: np.ndarray
    radius: np.ndarray
    limit: np.ndarray
    home: dict[int, list[int]] | None = None    # a row's centre → centres whose queries it meets
    between: np.ndarray | None = None   # distances of the centres from those with queries, once needed
    box: tuple[np.ndarray, np.ndarray] | None = None    # least and largest place of each group's queries
    basis: tuple[np.ndarray, np.ndarray] | None = None  # mean and leading directions of the places

    def span(self, c: int) -> np.ndarray:
        return np.arange(self.starts[c], self.starts[c + 1])


def _block_of(keys: pd.DataFrame, vectors: np.ndarray, centres: np.ndarray) -> _Block:
    fine = np.isfinite(vectors).all(1) if len(vectors) else np.zeros(0, bool)
    keys, vectors = keys[fine], vectors[fine]
    if not len(vectors):
        return _Block(keys, vectors, np.zeros(2, np.int64), np.zeros((1, 1)), np.zeros(1), np.zeros(0))
    own = nearest_centre(vectors, centres)
    order = np.argsort(own, kind="stable")
    own, vectors = own[order], vectors[order]
    radius = np.zeros(len(centres))
    for lo in range(0, len(own), 65536):
        part = own[lo:lo + 65536]
        np.maximum.at(radius, part, np.sqrt(((vectors[lo:lo + 65536] - centres[part]) ** 2).sum(1)))
    return _Block(keys.iloc[order].reset_index(drop=True), vectors,
                  np.searchsorted(own, np.arange(len(centres) + 1)), centres, radius,
                  np.full(len(own), np.inf))


def _find_centres(sample: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` centres of the sample by a few rounds of k-means."""
    x = sample[np.isfinite(sample).all(1)].astype(np.float64)
    if len(x) == 0:
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(7)
    centres = np.unique(x[rng.permutation(len(x))[:m]], axis=0)
    for _ in range(5):
        own = nearest_centre(x, centres)
        order = np.argsort(own, kind="stable")
        found, first = np.unique(own[order], return_index=True)
        centres = np.add.reduceat(x[order], first) / np.bincount(own)[found][:, None]
    return centres


def _place_kernel(bc, vec: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = nearest_centre(matrix(batch.column(vec)).astype(np.float64), bc.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], schema=schema)
    return run


def _first_of_equal(x: np.ndarray, ids: list[np.ndarray], k: int) -> np.ndarray:
    """True but for rows beyond the first ``k``, by ids, of equal vectors: no query can take more."""
    x, out = np.ascontiguousarray(x), np.ones(len(x), bool)
    if not x.size:
        return out
    odd = np.random.default_rng(7).integers(1, 2 ** 62, x.shape[1], dtype=np.uint64) * np.uint64(2) + (
        np.uint64(1))
    mixed = (x.view(np.uint64) * odd).sum(1, dtype=np.uint64)
    _, inverse, n = np.unique(mixed, return_inverse=True, return_counts=True)
    if n.max() <= k:
        return out
    many = np.flatnonzero(n[inverse] > k)       # rows that share their hash with more than k
    many = many[np.lexsort([pd.factorize(i[many], sort=True)[0] if i.dtype == object else i[many]
                            for i in reversed(ids)])]
    same = np.unique(x[many].view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(),
                     return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    place = np.empty(len(many), np.int64)
    place[order] = np.arange(len(many)) - np.searchsorted(same[order], same[order])
    out[many[place >= k]] = False
    return out


def _rows_of(pdf: pd.DataFrame, ids: list[str], vec: str, k: int):
    """Usable rows of a batch. Of equal vectors only the first ``k`` by ids: no query can take more."""
    pdf = pdf[pdf[vec].notna()]
    if pdf.empty:
        return pdf, np.zeros((0, 1))
    x = np.ascontiguousarray(matrix(pdf[vec]).astype(np.float64))
    use = np.isfinite(x).all(1) & _first_of_equal(x, [pdf[c].to_numpy() for c in ids], k)
    return pdf[use], x[use]


def _batch_rows(batch: pa.RecordBatch, ids: list[str], vec: str, k: int):
    """As ``_rows_of``, of an Arrow batch without null vectors: (vectors, ids, places in the batch)."""
    x = matrix(batch.column(vec)).astype(np.float64)
    names = [batch.column(c).to_pandas().to_numpy() for c in ids]
    use = np.flatnonzero(np.isfinite(x).all(1) & _first_of_equal(x, names, k))
    return x[use], [i[use] for i in names], use


def _basis(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions of the sample."""
    x = sample[np.isfinite(sample).all(1)].astype(np.float64)
    if not len(x):
        return np.zeros(sample.shape[1]), np.zeros((sample.shape[1], 0))
    mean = x.mean(0)
    x = x - mean
    spread = x.T @ x
    if not np.isfinite(spread).all():
        return mean, np.zeros((sample.shape[1], 0))
    return mean, np.linalg.eigh(spread)[1][:, ::-1][:, :BOX_DIMS]


def _places(x: np.ndarray, basis: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The vectors' parts in the leading directions, and the length of what is left: two places are as
    far apart as their vectors at most."""
    out = np.empty((len(x), basis[1].shape[1] + 1))
    for lo in range(0, len(x), 65536):
        part = x[lo:lo + 65536].astype(np.float64) - basis[0]
        lead = part @ basis[1]
        out[lo:lo + 65536, :-1] = lead
        out[lo:lo + 65536, -1] = np.sqrt(np.maximum((part ** 2).sum(1) - (lead ** 2).sum(1), 0.0))
    return out


def _boxed(block: _Block, basis: tuple[np.ndarray, np.ndarray]) -> _Block:
    """The block's queries in groups of up to ``BOX_QUERIES``, cut at the middle of the widest
    direction of their places."""
    places = _places(block.vectors, basis)
    done, todo = [], [np.arange(len(places))]
    while todo:
        some = todo.pop()
        if len(some) <= BOX_QUERIES:
            done.append(some)
            continue
        half = len(some) // 2
        some = some[np.argpartition(places[some, places[some].std(0).argmax()], half)]
        todo += [some[half:], some[:half]]
    order = np.concatenate(done)
    starts = np.concatenate([[0], np.cumsum([len(g) for g in done])])
    box = (np.stack([places[g].min(0) for g in done]), np.stack([places[g].max(0) for g in done]))
    return _Block(block.keys.iloc[order].reset_index(drop=True), block.vectors[order], starts,
                  block.centres, block.radius, block.limit[order], box=box, basis=basis)


def _box_groups(block: _Block, x: np.ndarray, limit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """As ``_groups``, for a block of boxes."""
    low, high = block.box
    worst = np.maximum.reduceat(limit, block.starts[:-1]) + _TIE
    size = 1.0 + np.sqrt((block.basis[0] ** 2).sum()) + np.sqrt(
        (np.maximum(np.abs(low), np.abs(high)) ** 2).sum(1).max())
    step = max(1, _PAIR_BUDGET // 4 // len(low))
    for lo in range(0, len(x), step):
        p = _places(x[lo:lo + step], block.basis)
        # More than the error of a place, the last part of which is the root of a difference.
        slack = 1e-6 * (size + np.sqrt((p ** 2).sum(1)))[:, None]
        far = np.zeros((len(p), len(low)))
        for j in range(p.shape[1]):
            at = p[:, j][:, None]
            gap = np.maximum(np.maximum(low[:, j] - at, at - high[:, j]) - slack, 0.0)
            far += gap * gap
        near = ~(far > worst)
        for g in np.flatnonzero(near.any(0)):
            yield int(g), lo + np.flatnonzero(near[:, g])


def _groups(block: _Block, x: np.ndarray, limit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(centre, rows) where a row may be within the limit of one of the centre's queries."""
    live = np.flatnonzero(np.diff(block.starts))
    if not len(live):
        return
    if block.box is not None:
        yield from _box_groups(block, x, limit)
        return
    c = block.centres
    worst = np.sqrt(np.maximum.reduceat(limit, block.starts[live]) + _TIE)
    if block.between is None:
        block.between = np.sqrt(np.maximum((c ** 2).sum(1)[:, None] + (c[live] ** 2).sum(1)[None, :]
                                           - 2.0 * (c @ c[live].T), 0.0))
    between = block.between
    step = max(1, _PAIR_BUDGET // 2 // len(c))
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        xn = (part ** 2).sum(1)
        sq = np.maximum(xn[:, None] + (c ** 2).sum(1)[None, :] - 2.0 * (part @ c.T), 0.0)
        own, to = sq.argmin(1), sq[:, live]
        slack = 1e-6 * (1.0 + np.sqrt(xn)[:, None] + np.sqrt((c[live] ** 2).sum(1))[None, :]
                        + block.radius[live][None, :])
        # Nearer to another centre than the queries are: they lie beyond the plane between the two.
        gap = between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (to - sq[np.arange(len(part)), own][:, None]) / (2.0 * gap)
        plane = np.where(gap > 1e-3 * (1.0 + np.sqrt(xn))[:, None], plane - slack, 0.0)
        far = (np.sqrt(to) - block.radius[live][None, :] - slack > worst[None, :]) | (
            plane > worst[None, :])
        for j in np.flatnonzero(~far.all(0)):
            yield int(live[j]), lo + np.flatnonzero(~far[:, j])


def _near_kernel(bc, qkeys: list[str], ids: list[str], vec: str, k: int, schema: pa.Schema):
    """Rows of the second pass (keys, ids, distance), or of the first one (``home`` is given):
    (_q, distance)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = bc.value
        first = block.home is not None
        best = Nearest(block.vectors, block.limit, k, len(ids))
        for batch in batches:
            if not len(block.vectors):
                continue
            x, names, use = _batch_rows(batch, ids, vec, k)
            if not len(x):
                continue
            rows = best.rows(x, names)
            if first:
                cells = batch.column("_cell").to_numpy()[use]
                pairs = ((c, some) for a in np.unique(cells) for some in [np.flatnonzero(cells == a)]
                         for c in block.home.get(int(a), []))
            else:
                pairs = _groups(block, x, best.limit)
            for c, some in pairs:
                best.score(block.span(c), rows, None if len(some) == len(x) else some)
        q, d, *found = best.cut()
        for lo in range(0, len(q), 65536):
            part = slice(lo, lo + 65536)
            cols = [q[part]] if first else [
                *[block.keys[c].to_numpy()[q[part]] for c in qkeys], *[i[part] for i in found]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type, from_pandas=True) for c, f in zip([*cols, d[part]], schema)],
                schema=schema)
    return run


_FIRST = T.StructType([T.StructField("_q", T.LongType()), T.StructField("distance", T.DoubleType())])


def _limits(placed: DataFrame, block: _Block, sizes: np.ndarray, ids: list[str], vec: str, k: int
            ) -> np.ndarray:
    """The squared distance of each query's k-th row among those of the nearest centres that hold
    ``FIRST_SHARE`` of the rows and ``k`` of them: its true k-th row is as near at least."""
    home: dict[int, list[int]] = {}
    c, wanted = block.centres, max(k, sizes.sum() * FIRST_SHARE)
    for i in np.flatnonzero(np.diff(block.starts)):
        order = np.argsort(((c - c[i]) ** 2).sum(1), kind="stable")
        enough = int((np.cumsum(sizes[order]) < wanted).sum()) + 1
        for a in order[:enough]:
            home.setdefault(int(a), []).append(int(i))
    block.home = home
    bc = placed.sparkSession.sparkContext.broadcast(block)
    found = placed.mapInArrow(_near_kernel(bc, [], ids, vec, k, to_arrow_schema(_FIRST)), _FIRST)
    w = Window.partitionBy("_q").orderBy("distance")
    kth = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k).select(
        "_q", "distance").toArrow()         # a number per query of the block
    bc.destroy()
    block.home = None
    limit = np.full(len(block.vectors), np.inf)
    limit[kth["_q"].to_numpy()] = _round6(kth["distance"].to_numpy())
    return limit


def _pairs(block: _Block, sample: np.ndarray, weights: np.ndarray) -> float:
    """Pairs that the block's groups leave, of those with the sample's rows."""
    return sum(len(block.span(g)) * float(weights[rows].sum())
               for g, rows in _groups(block, sample, block.limit))


def _query_blocks(queries: DataFrame, qkeys: list[str], vec: str, max_bytes: int
                  ) -> tuple[list[DataFrame], int]:
    stats = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dims")).first()
    n, dims = stats["n"], stats["dims"] or 0
    nblocks = max(1, math.ceil(n * max(dims, 1) * 8 / max_bytes))
    return _dealt(queries, qkeys, nblocks), n


def _dealt(queries: DataFrame, qkeys: list[str], nblocks: int) -> list[DataFrame]:
    if nblocks == 1:
        return [queries]
    b = F.pmod(F.xxhash64(*qkeys), F.lit(nblocks))
    return [queries.filter(b == i) for i in range(nblocks)]


def _collected(part: DataFrame, qkeys: list[str], vec: str, centres: np.ndarray | None) -> _Block:
    table = part.toArrow()      # bounded by the size check of the blocks
    mat = matrix(table[vec])
    return _block_of(table.select(qkeys).to_pandas(), mat,
                     np.zeros((1, mat.shape[1])) if centres is None else centres)


@dataclass
class _Placed:
    """Rows written by the nearest centre, the centres, their rows' number, a row of each (of its number's
    weight) and the leading directions of the queries."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    sample: np.ndarray
    weights: np.ndarray
    basis: tuple[np.ndarray, np.ndarray]


def _placed(rows: DataFrame, queries: DataFrame, n: int, qkeys: list[str], ids: list[str], vec: str
            ) -> _Placed:
    """The rows written by the nearest centre of the queries."""
    spark = rows.sparkSession
    share = min(1.0, CENTRE_SAMPLE / n)
    sample = queries if share == 1.0 else queries.filter(
        F.pmod(F.xxhash64(*qkeys), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = matrix(sample.select(vec).toArrow()[vec])
    centres = _find_centres(sample, min(MAX_CENTRES, max(1, math.isqrt(n))))
    # Neighbouring centres get neighbouring numbers, so that a query's nearest ones lie in few tasks.
    centres = centres[np.argsort(nearest_centre(
        centres, _find_centres(centres, math.isqrt(len(centres)))), kind="stable")]
    bc = spark.sparkContext.broadcast(centres)
    rows = rows.filter(F.col(vec).isNotNull())
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType())])
    path = scratch_path(spark, "placed")
    rows.mapInArrow(_place_kernel(bc, vec, to_arrow_schema(schema)), schema).write.parquet(path + "-0")
    stored = spark.read.schema(schema).parquet(path + "-0")
    stored.repartitionByRange("_cell", *ids).sortWithinPartitions("_cell", *ids).write.parquet(path)
    placed = spark.read.schema(schema).parquet(path)
    sizes, found = np.zeros(len(centres), np.int64), []
    for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.any_value(vec).alias("v")
                                         ).collect():     # a row per centre
        sizes[r["_cell"]] = r["n"]
        found.append((r["n"], r["v"]))
    some = np.array([v for _, v in found], np.float64) if found else np.zeros((0, centres.shape[1]))
    fine = np.isfinite(some).all(1)
    return _Placed(placed, centres, sizes, some[fine], np.array([w for w, _ in found])[fine],
                   _basis(sample))


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, qkeys: list[str] | str = "qid",
           ids: list[str] | None = None, vec: str = "embedding", payload: list[str] | None = None,
           with_score: bool = False,
           max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
           filters: dict | None = None) -> DataFrame:
    """R2 (+R4 with ``with_score``, R8 for many queries, R3 with ``filters`` as in
    ``apply_filters``): exact top-``k`` chunks per query by squared Euclidean distance. Returns (*qkeys, rank, *ids, *payload, distance[, score])."""
    qkeys = [qkeys] if isinstance(qkeys, str) else list(qkeys)
    ids = ids or ["doc_id", "pos"]
    payload = [c for c in (payload if payload is not None else chunks.columns)
               if c not in ids and c != vec]
    spark = chunks.sparkSession
    chunks = apply_filters(chunks, filters)
    qsel = queries.select(*qkeys, vec).filter(F.col(vec).isNotNull())
    rows = chunks.select(*ids, vec)
    qtypes = {f.name: f.dataType for f in qsel.schema.fields}
    ctypes = {f.name: f.dataType for f in rows.schema.fields}
    out_schema = T.StructType([T.StructField(c, qtypes[c]) for c in qkeys]
                              + [T.StructField(c, ctypes[c]) for c in ids]
                              + [T.StructField("distance", T.DoubleType())])
    partials = []
    blocks, n_queries = _query_blocks(qsel, qkeys, vec, max_broadcast_bytes)
    placed = None
    if n_queries > FEW_QUERIES:
        path = scratch_path(spark, "queries")       # read for the centres and for each block
        qsel.write.parquet(path)
        qsel = spark.read.schema(qsel.schema).parquet(path)
        blocks = _dealt(qsel, qkeys, len(blocks))
        placed = _placed(rows, qsel, n_queries, qkeys, ids, vec)
        rows = placed.rows
    rows = rows.filter(F.col(vec).isNotNull())
    # Ranked by the kernel's own rounding, so that both keep the same rows at a tie.
    w = Window.partitionBy(*qkeys).orderBy(F.floor(F.col("distance") * 1e6 + 0.5), *ids)
    for part in blocks:
        block = _collected(part, qkeys, vec, None if placed is None else placed.centres)
        if placed is not None and len(block.vectors):
            block.limit = _limits(rows, block, placed.sizes, ids, vec, k)
            boxed = _boxed(block, placed.basis)
            if _pairs(boxed, placed.sample, placed.weights) < _pairs(
                    block, placed.sample, placed.weights):
                block = boxed
            del boxed
            block.between = None
        bc = spark.sparkContext.broadcast(block)
        del block
        near = rows.mapInArrow(
            _near_kernel(bc, qkeys, ids, vec, k, to_arrow_schema(out_schema)), out_schema)
        top = near.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
        if len(blocks) > 1:     # a block's rows are final: written, so that one block is held at a time
            path = scratch_path(spark, "nearest")
            top.write.parquet(path)
            top = spark.read.schema(top.schema).parquet(path)
            bc.destroy()
        partials.append(top)
    top = partials[0]
    for p in partials[1:]:
        top = top.unionByName(p)
    top = top.withColumn("_raw", F.col("distance")).withColumn("distance", F.round("distance", 6))
    if payload:
        # The winners are at most queries × k rows (counted above): broadcast them when that is
        # within the bound, otherwise join by shuffling.
        winners = F.broadcast(top) if n_queries * k <= MAX_BROADCAST_WINNERS else top
        top = chunks.select(*ids, *payload).join(winners, ids)
    cols = [*qkeys, "rank", *ids, *payload, "distance"]
    if with_score:
        top = top.withColumn("score", F.round(1 - F.col("_raw") / 2, 6))
        cols.append("score")
    return top.select(*cols)


def unique_union(results: DataFrame, keys: list[str], rank: str | None = "rank") -> DataFrame:
    """One row per distinct ``keys`` (content + metadata); keeps the minimum rank."""
    if rank is None or rank not in results.columns:
        return results.select(*keys).distinct()
    other = [c for c in results.columns if c not in keys and c != rank]
    # One struct, so that tied ranks never mix the columns of two rows.
    best = results.groupBy(*keys).agg(F.min(F.struct(rank, *other)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in [rank, *other]])


def multi_query_search(variants: DataFrame, chunks: DataFrame, k: int = 5, qkey: str = "qid",
                       variant: str = "variant", ids: list[str] | None = None,
                       vec: str = "embedding", content_keys: list[str] | None = None,
                       filters: dict | None = None) -> DataFrame:
    """Search every rewording of a question, union the results, keep each distinct
    (content, metadata) once per question at its best rank."""
    ids = ids or ["doc_id", "pos"]
    res = search(variants, chunks, k, [qkey, variant], ids, vec, filters=filters)
    keys = [qkey] + (content_keys or [c for c in res.columns
                                      if c not in (qkey, variant, "rank", "distance")])
    return unique_union(res.drop(variant, "distance"), keys, "rank")


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding"
                    ) -> DataFrame:
    """Mean vector per label (for R8 batch queries): posexplode + avg per (label, dim)."""
    e = vectors.select(label, F.posexplode(vec).alias("i", "x"))
    per_dim = e.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per_dim.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]
                    ).alias(vec))
