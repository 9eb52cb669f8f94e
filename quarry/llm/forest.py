"""Operator 11: nearest neighbours by inner product in a forest of random-projection trees.

Vectors get one more entry that makes their lengths equal, so that the largest inner product is
the smallest angle. The trees are grown over a bounded sample: a node splits its part at the
median of a random projection. Every vector of the table is then dealt to one leaf of each tree;
the table of vectors with their leaves, in shards, is the index.

A query walks all trees through one priority queue: the branch that is least far on the wrong
side of a hyperplane is next, whichever tree it belongs to, until the leaves met hold ``budget``
rows. Its candidates are the rows of these leaves; they are scored by their inner products in
double precision. The budget is measured: the exact neighbours of sampled queries are found over
the whole table, and the budget is what reaches ``recall`` of them.

Equal vectors are one class with the smallest ids of its rows, as many as a result can hold, so a
common vector costs one row. A shard holds neighbouring leaves of the first tree, or a share of a
large one, and a query goes only to shards that hold a leaf it has met. A group of the search
reads one shard (bounded) and streams the queries of one block; what leaves it are the nearest of
the shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import TASK_BYTES, drop_stored, stored  # noqa: F401
from quarry.llm.common import few as _few

TREES = 8
LEAF = 64               # sampled vectors of a leaf at most
SAMPLE = 16_384         # vectors over which the trees are grown
SAMPLE_BYTES = 32 << 20     # and fewer, if they are longer than 256 entries
PROBES = 256            # sampled queries whose exact neighbours set the budget
RECALL = 0.95           # share of these neighbours that the budget reaches
SHARD_BYTES = 4 << 20   # vectors of a shard, as doubles
QUERY_BLOCK = 16_384    # queries that stream past a shard in one group
MAX_LENGTHS = 16        # different vector lengths in a table; more raise

# ------------------------------------------------------------------ trees


@dataclass
class Forest:
    """Trees as arrays. Inner node i: ``planes[i]``, ``cuts[i]`` and ``kids[i]``, a node, or
    ``-1 - leaf`` for a leaf; leaves are numbered over all trees."""
    planes: np.ndarray
    cuts: np.ndarray
    kids: np.ndarray
    roots: list[int]
    leaves: int
    norm: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the entry that makes all of them ``norm`` long."""
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(axis=1), 0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree (rows x trees)."""
        x = self.lifted(x)
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if node < 0:
                    out[rows, t] = -1 - node
                elif len(rows):
                    up = x[rows] @ self.planes[node] >= self.cuts[node]
                    todo.append((int(self.kids[node, 0]), rows[~up]))
                    todo.append((int(self.kids[node, 1]), rows[up]))
        return out

    def margins(self, q: np.ndarray) -> np.ndarray:
        """Signed distances of queries (their further entry is zero) from all hyperplanes, as if
        every query were ``norm`` long."""
        length = np.sqrt((q * q).sum(axis=1))
        return q @ self.planes[:, :-1].T * (self.norm / length)[:, None] - self.cuts

    def walk(self, margins: np.ndarray) -> Iterator[int]:
        """Leaves for one query: always the branch, of any tree, that is least far on the wrong
        side of a hyperplane above it."""
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        kids = self.kids
        while queue:
            far, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            m = margins[node]
            heapq.heappush(queue, (max(far, m), int(kids[node, 0])))
            heapq.heappush(queue, (max(far, -m), int(kids[node, 1])))


def grow(sample: np.ndarray, norm: float, trees: int = TREES, leaf: int = LEAF, seed: int = 17
         ) -> Forest:
    """Random-projection trees over a sample: of a few random directions the one along which a
    node's vectors spread most, cut at their median. A part that no direction splits is a leaf."""
    rng = np.random.default_rng(seed)
    forest = Forest(np.zeros((0, 0)), np.zeros(0), np.zeros((0, 2)), [], 0, norm)
    x = forest.lifted(sample)
    planes, cuts, kids = [], [], []

    def split(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            w = rng.normal(size=(4, x.shape[1]))
            w /= np.sqrt((w * w).sum(axis=1))[:, None]
            p = x[rows] @ w.T
            best = int(p.var(axis=0).argmax())
            p, half = p[:, best], len(rows) // 2
            # Between two vectors, so that a rounding error moves none of them.
            cut = float(np.partition(p, (half - 1, half))[half - 1:half + 1].mean())
            up = p >= cut
            if up.any() and not up.all():
                me = len(planes)
                planes.append(w[best]), cuts.append(cut), kids.append([0, 0])
                kids[me] = [split(rows[~up]), split(rows[up])]
                return me
        forest.leaves += 1
        return -forest.leaves
    forest.roots = [split(np.arange(len(x))) for _ in range(trees)]
    forest.planes = np.array(planes).reshape(-1, x.shape[1])
    forest.cuts, forest.kids = np.array(cuts), np.array(kids, np.int64).reshape(-1, 2)
    return forest


# ------------------------------------------------------------------ index


def _valid(c: Column) -> Column:
    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, finite) & F.exists(c, lambda v: v != 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _share(c: str, wanted: int, have: int) -> Column:
    """About ``wanted`` of ``have`` rows, the same ones in every run, by a hash of ``c``."""
    return F.pmod(F.xxhash64(F.lit(5), c), F.lit(1 << 30)) < min(1.0, wanted / max(have, 1)) * (
        1 << 30)


def _classes(vectors: DataFrame, ids: int) -> DataFrame:
    """vec, members: distinct vectors with the ``ids`` smallest ids of their rows, null last. The
    members are read off the same sorted rows, not gathered and sorted again. Vectors are sorted
    by a hash first: Spark normalises both sides' entries anew in every comparison of vectors."""
    first = Window.partitionBy("h", "vec").orderBy(F.col("vec_id").asc_nulls_last())
    members = F.collect_list(F.struct("vec_id")).over(first.rowsBetween(0, ids - 1))
    return (vectors.distinct().withColumn("h", F.xxhash64("vec"))
            .withColumn("r", F.row_number().over(first))
            .filter(F.col("r") <= ids).withColumn("m", members).filter("r = 1")
            .select("vec", F.col("m.vec_id").alias("members")))


@dataclass
class Index:
    """``rows``: shard, vec, members, leaves. ``first`` and ``shares`` tell the shards of every
    leaf of the first tree (a region), ``met`` which leaves have rows in which region."""
    forest: Forest
    rows: DataFrame
    dims: int
    sizes: np.ndarray
    met: np.ndarray
    first: np.ndarray
    shares: np.ndarray


def build(vectors: DataFrame, dims: int, ids: int, trees: int = TREES, leaf: int = LEAF,
          sample: int = SAMPLE, shard_bytes: int = SHARD_BYTES) -> Index:
    """Index all of ``vectors`` (vec_id, vec; ``dims`` entries each). To the driver come the
    sample and, per pair of leaves of the first tree and any tree, a count: both bounded."""
    # A row is its vector and one place in a list of members, each with some bytes around it.
    classes = stored(_few(_classes(vectors, ids), vectors.count() * (8 * dims + 128)),
                     "forest-classes")
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    count, norm = classes.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    if norm is not None and not norm < float("inf"):
        raise ValueError("the lengths of the vectors don't fit double precision")
    wanted = min(sample, SAMPLE_BYTES // (8 * dims))
    some = classes.filter(_share("vec", wanted, count)).select("vec").toArrow()
    points = _matrix(some.column(0).combine_chunks(), dims)
    # In one order, whatever the tasks that wrote the classes.
    forest = grow(points[np.lexsort(points.T)], norm or 1.0, trees, leaf)
    given = classes.sparkSession.sparkContext.broadcast(forest)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = given.value.leaf_of(_matrix(batch.column(0), dims))
            cut = np.arange(len(at) + 1, dtype=np.int32) * at.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(cut, at.reshape(-1))],
                names=["vec", "members", "leaves"])

    kinds = [f"{c} {classes.schema[c].dataType.simpleString()}" for c in classes.columns]
    dealt = stored(classes.mapInArrow(deal, ", ".join([*kinds, "leaves array<int>"])),
                   "forest-leaves")
    pairs = dealt.select(F.col("leaves")[0].alias("r"), F.explode("leaves").alias("leaf")).groupBy(
        "r", "leaf").count().toArrow()
    r, at, n = (c.to_numpy() for c in pairs.columns)
    met = np.zeros((forest.leaves, forest.leaves), bool)
    met[r, at] = True
    sizes = np.bincount(at, n, forest.leaves).astype(np.int64)
    region = np.where(met.any(axis=1), sizes, 0)
    bound = max(1, shard_bytes // (8 * dims))
    shares = np.maximum(1, -(-region // bound))
    first, shard, held = np.zeros(forest.leaves, np.int64), 0, 0
    for i, (rows, parts) in enumerate(zip(region.tolist(), shares.tolist())):
        if held and held + rows > bound:
            shard, held = shard + 1, 0
        first[i] = shard
        if parts > 1:
            shard, held = shard + parts, 0
        else:
            held += rows
    spark = classes.sparkSession
    places = spark.createDataFrame(
        [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, shares)) if region[i]] or [],
        "r int, first long, shares long")
    rows = dealt.withColumn("r", F.col("leaves")[0]).join(F.broadcast(places), "r").select(
        (F.col("first") + F.pmod(F.xxhash64("vec"), F.col("shares"))).alias("shard"),
        "vec", "members", "leaves")
    drop_stored(classes)
    return Index(forest, rows, dims, sizes, met, first, shares)


# ------------------------------------------------------------------ search


def _visits(index: Index, budget: int | None):
    """Adds to queries (q, query_id, vec) the leaves that they meet, as bits, and the shards that
    hold rows of them; without a budget, all."""
    forest, sizes, met = index.forest, index.sizes, index.met.astype(np.float32)
    spans = [np.arange(a, a + b) for a, b in zip(index.first, index.shares)]
    dims = index.dims
    given = index.rows.sparkSession.sparkContext.broadcast((forest, sizes, met, spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sizes, met, spans = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = _matrix(part.column(2), dims)
                seen = np.full((len(q), forest.leaves), budget is None)
                if budget is not None:
                    for i, margins in enumerate(forest.margins(q)):
                        held = 0
                        for leaf in forest.walk(margins):
                            seen[i, leaf] = True
                            held += sizes[leaf]
                            if held >= budget:
                                break
                near = seen.astype(np.float32) @ met.T > 0
                shards = [np.unique(np.concatenate([spans[r] for r in np.flatnonzero(row)]))
                          if row.any() else np.zeros(0, np.int64) for row in near]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x.tobytes() for x in np.packbits(seen, axis=1)],
                                             pa.binary()), pa.array(shards, pa.list_(pa.int64()))],
                    names=["q", "query_id", "vec", "seen", "shards"])
    return run


def _dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order wherever its row stands."""
    return np.multiply(x, q).cumsum(axis=1)[:, -1]


class _Shard:
    """The rows of a shard, and the nearest of them for queries."""

    def __init__(self, parts: list[pa.RecordBatch], dims: int, k: int, leaves: int):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.x = _matrix(whole.column("vec"), dims)
        self.members = whole.column("members")
        self.at = whole.column("leaves").flatten().to_numpy().reshape(len(self.x), -1)
        self.k, self.leaves = k, leaves

    def nearest(self, ids: list, q: np.ndarray, seen: np.ndarray
                ) -> Iterator[tuple[int, object, float, int]]:
        """(query, vec_id, score, row) of the k nearest candidates of each query."""
        some = np.flatnonzero(seen.any(axis=0)[self.at].any(axis=1))
        if not len(some):
            return
        x, at = self.x[some], self.at[some]
        scores = q @ x.T
        open_ = np.zeros(scores.shape, bool)
        for t in range(at.shape[1]):
            open_ |= seen[:, at[:, t]]
        scores[~open_] = -np.inf
        # The class of the query itself may hold no other row, so one more than k is kept; and
        # an exact score may lie a rounding error beside that of the matrix product.
        k = min(self.k + 1, len(some))
        low = np.partition(scores, len(some) - k, axis=1)[:, len(some) - k]
        low = np.where(low > -np.inf, low - 1e-14 * x.shape[1] * np.sqrt(
            (x * x).sum(axis=1).max() * (q * q).sum(axis=1)), low)
        for i in range(len(q)):
            rows = np.flatnonzero((scores[i] >= low[i]) & open_[i])
            found = []
            for r, s in zip(rows.tolist(), _dots(x[rows], q[i]).tolist()):
                row = int(some[r])
                found += [(-s, m is None, 0 if m is None else m, row)
                          for m in self.members[row].as_py() if m != ids[i]]
            for s, missing, m, row in heapq.nsmallest(self.k, found):
                yield i, None if missing else m, -s, row


def _searcher(dims: int, k: int, leaves: int, with_leaves: bool):
    """Rows sorted by (g, kind): a shard's rows, then queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard = None, [], None
        for batch in batches:
            g, kind = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            cuts = [0, *edges.tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if g[a] != now:
                    now, parts, shard = g[a], [], None
                if kind[a] == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if parts:
                    shard, parts = _Shard(parts, dims, k, leaves), []
                if shard is None:
                    continue
                for at in range(a, b, 128):
                    yield answer(shard, batch.slice(at, min(128, b - at)))

    def answer(shard: _Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column("query_id")
        bits = np.frombuffer(b"".join(part.column("seen").to_pylist()), np.uint8)
        seen = np.unpackbits(bits.reshape(part.num_rows, -1), axis=1, count=leaves).astype(bool)
        found = list(shard.nearest(ids.to_pylist(), _matrix(part.column("vec"), dims), seen))
        i, m, s, rows = zip(*found) if found else ((), (), (), ())
        at = pa.array(i, pa.int64())
        out = [part.column("q").take(at), ids.take(at),
               pa.array(m, shard.members.type.value_type), pa.array(s, pa.float64())]
        if with_leaves:
            out.append(pa.array([shard.at[r] for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(out, names=[
            "q", "query_id", "vec_id", "score", "leaves"][:len(out)])
    return run


def search(index: Index, queries: DataFrame, many: int, k: int, budget: int | None,
           with_leaves: bool = False) -> DataFrame:
    """q, query_id, vec_id, score, rank: the k nearest candidates of the ``many`` queries (q,
    query_id, vec), among the leaves that each meets within ``budget``; without one, all rows."""
    kinds = {c: queries.schema[c].dataType.simpleString() for c in queries.columns}
    member = index.rows.schema["members"].dataType.simpleString()
    visiting = queries.mapInArrow(_visits(index, budget), (
        f"q long, query_id {kinds['query_id']}, vec {kinds['vec']}, seen binary, "
        "shards array<long>"))
    blocks = -(-max(many, 1) // QUERY_BLOCK)

    def group(block: Column) -> Column:
        return (F.col("shard") * blocks + block).alias("g")

    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)
    asked = visiting.withColumn("shard", F.explode("shards")).select(
        group(F.pmod(F.xxhash64("q"), F.lit(blocks))), F.lit(1).alias("kind"), "vec", "q",
        "query_id", "seen", none(member).alias("members"), none("array<int>").alias("leaves"))
    held = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        group(F.col("block")), F.lit(0).alias("kind"), F.col("vec").cast(kinds["vec"]).alias("vec"),
        none("long").alias("q"), none(kinds["query_id"]).alias("query_id"),
        none("binary").alias("seen"), "members", "leaves")
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = held.unionByName(asked).repartition(n, "g").sortWithinPartitions("g", "kind").mapInArrow(
        _searcher(index.dims, k, index.forest.leaves, with_leaves),
        f"q long, query_id {kinds['query_id']}, vec_id {member[6:-1]}, score double"
        + (", leaves array<int>" if with_leaves else ""))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    # From each shard a query gets k rows at most.
    size = many * k * int((index.first + index.shares).max()) * (
        64 + 4 * len(index.forest.roots) * with_leaves)
    return _few(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), size)


def measured_budget(index: Index, queries: DataFrame, many: int, k: int, recall: float,
                    probes: int) -> int:
    """Rows that the leaves of a walk must hold so that ``recall`` of the exact neighbours of
    about ``probes`` queries, chosen by a hash, are met. The driver reads probes x k rows."""
    some = queries.filter(_share("q", probes, many)).orderBy("q").limit(2 * probes)
    if some.isEmpty():
        some = queries.orderBy("q").limit(1)
    some = stored(some, "forest-probes")
    truth = search(index, some, probes, k, None, with_leaves=True).select("q", "leaves").toArrow()
    near: dict[int, list] = {}
    for q, leaves in zip(*(c.to_pylist() for c in truth.columns)):
        near.setdefault(q, []).append(leaves)
    before = []
    for row in some.toArrow().to_pylist():
        margins = index.forest.margins(np.array([row["vec"]], np.float64))[0]
        held, reached = 0, np.zeros(index.forest.leaves, np.int64)
        for leaf in index.forest.walk(margins):
            reached[leaf] = held
            held += index.sizes[leaf]
        before += [int(reached[x].min()) for x in near.get(row["q"], [])]
    drop_stored(some)
    before.sort()
    # A leaf is met if the leaves before it hold less than the budget.
    return before[max(0, -(-int(recall * 1e6) * len(before) // 10 ** 6) - 1)] + 1 if before else 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL,
            trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, probes: int = PROBES,
            shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every query (``query_id``, ``embedding``) the
    k rows of ``vectors`` (``vec_id``, ``embedding``) found with the largest inner products in
    double precision, nearest first, ties to the smaller vec_id (null last); all, if fewer.

    A row whose vec_id is the query's id is no candidate of it. Vectors that are null, empty,
    zero, or hold a null or non-finite entry take no part, as queries neither; vectors of
    different lengths aren't compared. Repeated rows (id and vector) count once; an id with
    several vectors is a candidate, or a query, with each, a query's ranks then starting anew for
    each. A null query_id excludes no row but those without an id. Other columns aren't read. An empty table gives no
    row. Each query meets at least k other rows, or all."""
    spark = vectors.sparkSession
    rows = stored(vectors.filter(_valid(F.col("embedding"))).select(
        "vec_id", F.col("embedding").alias("vec")), "forest-vectors")
    wanted = queries.filter(_valid(F.col("embedding"))).select(
        "query_id", F.col("embedding").alias("vec"))
    entries = wanted.agg(F.count(F.lit(1)), F.sum(F.size("vec"))).first()
    asked = stored(_few(wanted.distinct(), 64 * entries[0] + 8 * (entries[1] or 0)).select(
        F.monotonically_increasing_id().alias("q"), "query_id", "vec"), "forest-queries")
    lengths = [r.n for r in asked.select(F.size("vec").alias("n")).distinct()
               .limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"more than {MAX_LENGTHS} different vector lengths")
    out = spark.createDataFrame([], (
        f"query_id {asked.schema['query_id'].dataType.simpleString()}, rank int, "
        f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double"))
    for dims in sorted(lengths):
        same = rows.filter(F.size("vec") == dims)
        index = build(same, dims, k + 1, trees, leaf, sample, shard_bytes)
        index.rows = stored(index.rows, "forest-index")
        mine = asked.filter(F.size("vec") == dims)
        many = mine.count()
        budget = measured_budget(index, mine, many, k, recall, probes)
        # Leaves of all trees hold a row trees times: this many hold k rows and the query's own.
        budget = max(budget, trees * (k + 1))
        out = out.unionByName(search(index, mine, many, k, budget).select(
            "query_id", "rank", "vec_id", "score"))
    return out
