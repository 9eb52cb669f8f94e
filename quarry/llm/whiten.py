"""Operator 12: whitening of vectors by an incremental eigendecomposition.

Vectors are held as whole numbers, so counts, sums and deviations are exact. Each task keeps the
eigenvalues and eigenvectors of the scatter of the rows it has read: one more row is a centred
rank-one update, whose new eigenvalues are the roots of the secular equation, after deflation of
the directions that it leaves as they are. Spectra of tasks are combined in a tree: one is added
to another by a rank-one update per eigenpair and one for the difference of the means. A last
pass over all rows refines the result (Rayleigh-Ritz): the covariance is taken in the basis
found, centred by the exact means, and the small matrix is solved.

What passes through the driver is one spectrum (dims x dims numbers, dims at most MAX_DIMS).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_stored, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MAX_DIMS = 2048         # longer vectors raise: a task holds a few matrices of dims x dims
MAX_LENGTHS = 16        # different vector lengths in a table; more raise
FAN_IN = 16
_EPS = np.finfo(float).eps
_SAFE = 2.0 ** 62

# ------------------------------------------------------------------ rank-one updates


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z_j^2 / (d_j - x))`` for ascending ``d``, ``rho`` > 0 and no zero
    in ``z``: one right of every d_j. Returns the roots and the differences ``d_j - root_i``, which
    are exact to the last bits because each root is found as its distance from the nearer pole.

    Both sides of a root are interpolated by one pole each; a step that leaves the bracket is
    replaced by a bisection."""
    k = len(d)
    z2 = z * z
    right = np.append(d[1:], d[-1] + rho * z2.sum())
    gap = right - d
    rows = np.arange(k)
    mid = d[None, :] - (d + gap / 2)[:, None]
    below = 1 + rho * (z2 / mid).sum(axis=1) >= 0       # the root lies left of the middle
    below[-1] |= k == 1
    near = np.where(below, rows, np.minimum(rows + 1, k - 1))
    origin = np.where(below, d, right)
    delta = d[None, :] - origin[:, None]
    left = np.where(below, 0.0, -gap)                   # d_i and d_(i+1) from the origin
    far = np.where(below, gap, 0.0)
    lo = np.where(below, 0.0, -gap / 2)
    hi = np.where(below, gap / 2, 0.0)
    if k == 1:
        return d + rho * z2, np.array([[-rho * z2[0]]])
    tau = np.where(below, hi, lo)
    lower, ones, weight = np.tri(k), np.ones(k), rho * z2
    for _ in range(80):
        inverse = 1 / (delta - tau[:, None])
        t = weight * inverse
        every, under = t @ ones, np.einsum("ij,ij->i", t, lower)
        f = 1 + every
        done = np.abs(f) <= 4 * _EPS * (1 + every - 2 * under)
        if done.all():
            break
        lo, hi = np.where(f < 0, tau, lo), np.where(f > 0, tau, hi)
        t *= inverse
        slope, psi = t @ ones, np.einsum("ij,ij->i", t, lower)
        x, y = left - tau, far - tau
        a = (x + y) * f - x * y * slope
        b = x * y * f
        c = f - x * psi - y * (slope - psi)
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = tau + step
        out = ~((new > lo) & (new < hi))
        new = np.where(out, (lo + hi) / 2, new)
        new = np.where(done, tau, new)
        if (new == tau).all():
            break
        tau = new
    return origin + tau, delta - tau[:, None]


def _deflate(d: np.ndarray, u: np.ndarray, z: np.ndarray, rho: float, tol: float) -> np.ndarray:
    """Marks the directions that the update changes. Of two (nearly) equal eigenvalues one is
    rotated out of the update; ``d``, ``u`` and ``z`` are changed in place."""
    active = rho * np.abs(z) > tol
    last = -1
    for j in np.flatnonzero(active).tolist():
        if last >= 0:
            r = np.hypot(z[last], z[j])
            c, s = z[j] / r, z[last] / r
            if abs((d[j] - d[last]) * c * s) <= tol:
                z[last], z[j] = 0.0, r
                p, q = u[:, last].copy(), u[:, j].copy()
                u[:, last], u[:, j] = c * p - s * q, s * p + c * q
                dp, dq = d[last], d[j]
                d[last], d[j] = c * c * dp + s * s * dq, s * s * dp + c * c * dq
                active[last] = False
        last = j
    return active


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float
             ) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``u diag(d) u^T + rho v v^T``, rho >= 0."""
    z = u.T @ v
    norm = np.sqrt(z @ z)
    rho = rho * norm * norm
    if not rho > 0:
        return d, u
    z = z / norm
    tol = 8 * _EPS * max(np.abs(d).max(), rho)
    pairs = z[1:] ** 2 + z[:-1] ** 2
    apart = (rho * np.abs(z) > tol).all() and (
        np.diff(d) * np.abs(z[1:] * z[:-1]) > tol * pairs).all()
    if apart:
        active = slice(None)
    else:
        d, u = d.copy(), u.copy()
        active = _deflate(d, u, z, rho, tol)
        if not active.any():
            return d, u
    poles, basis = d[active], u[:, active]
    roots, diff = secular_roots(poles, z[active], rho)
    # The vector whose update has exactly these roots (Loewner's formula): eigenvectors from it
    # are orthogonal to the last bits even if roots are close.
    between = poles[:, None] - poles[None, :]
    np.fill_diagonal(between, 1.0)
    w = np.sqrt(np.abs(diff / between).prod(axis=0)) * np.sign(z[active])
    vectors = w / diff
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    if apart:
        return roots, basis @ vectors.T
    d = np.concatenate((d[~active], roots))
    u = np.concatenate((u[:, ~active], basis @ vectors.T), axis=1)
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


class Spectrum:
    """Count, exact sums, mean, and eigenpairs of the scatter of some rows."""

    def __init__(self, dims: int):
        self.n, self.sums, self.mean = 0, np.zeros(dims, np.int64), np.zeros(dims)
        self.d, self.u = np.zeros(dims), np.eye(dims)

    def add(self, y: np.ndarray) -> None:
        """One more row, of whole numbers."""
        gap = y - self.mean
        if self.n:
            self.d, self.u = rank_one(self.d, self.u, gap, self.n / (self.n + 1))
        self.n += 1
        self.sums += y
        self.mean = self.sums / self.n

    def merge(self, other: Spectrum) -> None:
        """The rows of both: the other's eigenpairs and the gap of the means, one by one."""
        if not other.n:
            return
        gap, both = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.d, other.u.T):
            self.d, self.u = rank_one(self.d, self.u, vector, max(value, 0.0))
        self.d, self.u = rank_one(self.d, self.u, gap, self.n * other.n / both)
        self.n, self.sums = both, self.sums + other.sums
        self.mean = self.sums / both

    def pack(self) -> bytes:
        return (np.int64(self.n).tobytes() + self.sums.tobytes() + self.d.tobytes()
                + np.ascontiguousarray(self.u).tobytes())

    @classmethod
    def unpack(cls, raw: bytes, dims: int) -> Spectrum:
        got = cls(dims)
        whole = np.frombuffer(raw, np.int64, dims + 1)
        got.n, got.sums = int(whole[0]), whole[1:].copy()
        got.mean = got.sums / max(got.n, 1)
        reals = np.frombuffer(raw, np.float64, dims + dims * dims, 8 * (dims + 1))
        got.d, got.u = reals[:dims].copy(), reals[dims:].reshape(dims, dims).copy()
        return got


# ------------------------------------------------------------------ passes over the rows


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and ``y``: floor(64 * c) of every entry c, without the rows whose vector is null,
    empty, or holds a null or non-finite entry."""
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    e = F.col("embedding")
    return vectors.filter(e.isNotNull() & (F.size(e) > 0) & F.forall(e, finite)).select(
        "vec_id", F.transform(e, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
        .alias("y"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _fold(df: DataFrame, make: Callable[[Iterator[np.ndarray]], bytes],
          merge: Callable[[bytes, bytes], bytes], dims: int) -> bytes | None:
    """One value per task, made from its rows, and these merged in levels of FAN_IN in the order
    of the tasks, so that no task reads more than FAN_IN of them; None if there are no rows."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = []

        def blocks():
            for b in batches:
                if b.num_rows:
                    met.append(1)
                    yield _matrix(b.column(0), dims)
        value = make(blocks())
        if met:
            yield _value(TaskContext.get().partitionId(), value)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = value = None
        for batch in batches:
            for g, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != now and value is not None:
                    yield _value(now, value)
                    value = None
                now, value = g, v if value is None else merge(value, v)
        if value is not None:
            yield _value(now, value)

    cur = stored(df.mapInArrow(first, "g long, value binary"), "whiten-fold")
    while (left := cur.count()) > 1:
        n = min(-(-left // FAN_IN), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = cur.withColumn("h", F.expr(f"g div {FAN_IN}")).repartition(n, "h")
        new = stored(dealt.sortWithinPartitions("h", "g").select("h", "value").mapInArrow(
            more, "g long, value binary"), "whiten-fold")
        drop_stored(cur)
        cur = new
    row = cur.select("value").first()
    drop_stored(cur)
    return bytes(row[0]) if row else None


def _value(g: int, value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([value], pa.binary())],
                                      names=["g", "value"])


def _spectra(dims: int):
    def make(blocks: Iterator[np.ndarray]) -> bytes:
        s = Spectrum(dims)
        for y in blocks:
            for row in y:
                s.add(row)
        return s.pack()

    def merge(a: bytes, b: bytes) -> bytes:
        s = Spectrum.unpack(a, dims)
        s.merge(Spectrum.unpack(b, dims))
        return s.pack()
    return make, merge


def centred(y: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """``y - sums / n`` from the exact ``n * y - sums``; and that, or None where it doesn't fit 64
    bits."""
    if len(y) and n * max(float(np.abs(y).max()), 1.0) < _SAFE:
        exact = n * y - sums
        return exact / n, exact
    return (y.astype(np.longdouble) - sums / np.longdouble(n)).astype(float), None


def _products(model_n: int, sums: np.ndarray, basis: np.ndarray):
    """Sums of the rows projected on ``basis`` and of their products, as doubles."""
    k = basis.shape[1]

    def make(blocks: Iterator[np.ndarray]) -> bytes:
        total, cross = np.zeros(k), np.zeros((k, k))
        for y in blocks:
            p = centred(y, model_n, sums)[0] @ basis
            total += p.sum(axis=0)
            cross += p.T @ p
        return total.tobytes() + cross.tobytes()

    def merge(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a) + np.frombuffer(b)).tobytes()
    return make, merge


def _covariance(raw: bytes, n: int, k: int) -> np.ndarray:
    total, cross = np.frombuffer(raw)[:k], np.frombuffer(raw)[k:].reshape(k, k)
    return cross / n - np.outer(total / n, total / n)


@dataclass
class Whitening:
    """A fitted whitening of vectors of one length: rows fitted, exact sums of floor(64 * c),
    falling eigenvalues with their unit eigenvectors (columns), the covariance's trace, and the
    largest entry by which the whitened rows' covariance differs from the identity."""
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit the distinct rows ``y`` of ``rows``, all of ``dims`` entries; None if there are none.
    Eigenvalues that are zero to double precision have no component."""
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS} are whitened")
    raw = _fold(rows, *_spectra(dims), dims)
    if raw is None:
        return None
    s = Spectrum.unpack(raw, dims)
    basis = np.linalg.qr(s.u[:, ::-1])[0]
    small = _covariance(_fold(rows, *_products(s.n, s.sums, basis), dims), s.n, dims)
    values, turn = np.linalg.eigh(small)
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    kept = min(components, int((values > dims * _EPS * max(values[0], 0)).sum()))
    vectors = vectors[:, :kept]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[top, np.arange(kept)])
    model = Whitening(s.n, s.sums, values[:kept], vectors, float(np.trace(small)))
    if kept:
        white = vectors / np.sqrt(model.values)
        cov = _covariance(_fold(rows, *_products(s.n, s.sums, white), dims), s.n, kept)
        model.identity_error = float(np.abs(cov - np.eye(kept)).max())
    return model


def transform(rows: DataFrame, model: Whitening, dims: int) -> DataFrame:
    """One row per row of ``rows`` (``vec_id``, ``y``) and component."""
    k, n, sums = len(model.values), model.n, model.sums
    white, explained = model.vectors / np.sqrt(model.values), model.explained
    error = model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            y = _matrix(batch.column(1), dims)
            real, exact = centred(y, n, sums)
            p = real @ white
            if exact is not None and len(exact) and dims * float(np.abs(exact).max()) ** 2 < _SAFE:
                deviation = (exact * exact).sum(axis=1).tolist()
            else:
                deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums))
                             for row in y]
                deviation = [x if x < 2 ** 63 else None for x in deviation]
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()),
                pa.array(deviation, pa.int64()).take(at), pa.array(p.reshape(-1)),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "y").mapInArrow(run, (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``vectors`` (``vec_id``, ``embedding``) and component up to
    ``components``: vec_id, component (from 1, by falling eigenvalue), n (distinct vectors
    fitted), deviation (exact sum over the dimensions of ``(n * x - S)^2``), whitened, explained
    (share of the trace), identity_error (the same value everywhere).

    Rows whose vector is null, empty, or holds a null or non-finite entry are dropped. Equal
    vectors are fitted once, and each of their rows is returned; so are rows with a null or
    repeated vec_id. Vectors of different lengths are fitted apart, each length by itself.
    Components whose eigenvalue is zero to double precision aren't returned (no scale makes their
    variance one), so a table with fewer than two different vectors gives no row. A deviation
    beyond 64 bits is null. Other columns aren't read."""
    rows = stored(quantised(vectors), "whiten-rows")
    distinct = stored(rows.select("y").distinct(), "whiten-distinct")
    lengths = [r.n for r in distinct.select(F.size("y").alias("n")).distinct()
               .limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"more than {MAX_LENGTHS} different vector lengths")
    out = None
    for dims in sorted(lengths):
        model = fit(distinct.filter(F.size("y") == dims), dims, components)
        part = transform(rows.filter(F.size("y") == dims), model, dims)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = transform(rows, Whitening(0, np.zeros(1, np.int64), np.ones(0), np.ones((1, 0)), 1.0),
                        1)
    drop_stored(distinct)
    return out
