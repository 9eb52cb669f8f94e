"""Operator 5: quality classification from random-indexing word vectors and a small network.

Random indexing: every token has a fixed sparse index vector (``NONZERO`` entries of +1 or -1,
from its hash) and a context vector, the sum of the index vectors of its neighbours within
``REACH`` places over the whole corpus. Context vectors live in ``TOKENS`` hash buckets, so the
table has a fixed size; entries are integers and are added by a tree of sums, so every run gives
the same table. Tokens are case-sensitive runs of word characters or of punctuation.

A document is pooled as the mean of its tokens' unit context vectors, once plainly and once with
weights falling with a token's corpus frequency, with the lengths of both means. A two-layer network (numpy, Adam, fixed seed) is
trained on a bounded sample of ``SAMPLE`` labelled documents (chosen by id hash);
a fifth of it is held back to choose the temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold_remainder, stored, sum_vectors, utf8, words

TOKENS = 1 << 14
DIMS = 64
NONZERO = 4
REACH = 2
SAMPLE = 20_000     # labelled documents that train the network
HIDDEN = 32
THRESHOLD = 0.7
POOLED = 2 * DIMS + 2
_PARTS = 16         # the table travels in slices

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PUNCT = ~_WORD
_PUNCT[[0x20, *range(0x09, 0x0E)]] = False

_rng = np.random.default_rng(4711)
#: Index vectors: the dimensions of every bucket's entries and their signs.
_DIM = np.argsort(_rng.random((TOKENS, DIMS)), axis=1)[:, :NONZERO].astype(np.int64)
_SIGN = _rng.integers(0, 2, (TOKENS, NONZERO)).astype(np.int64) * 2 - 1


def tokens(raw: bytes | None) -> np.ndarray:
    """Bucket of every token, in order."""
    a, s, _ = words(raw, _WORD, fold=False)
    b, t, _ = words(raw, _PUNCT, fold=False)
    order = np.argsort(np.concatenate((s, t)), kind="stable")
    return (np.concatenate((a, b))[order] % np.uint64(TOKENS)).astype(np.int64)


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(TOKENS * DIMS, np.int64)
    seen = np.zeros(TOKENS, np.int64)

    def add(lists: list[np.ndarray]) -> None:
        t = np.concatenate(lists)
        doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        seen[:] += np.bincount(t, minlength=TOKENS)
        for r in range(1, REACH + 1):
            same = doc[r:] == doc[:-r]
            left, right = t[:-r][same], t[r:][same]
            for x, y in ((left, right), (right, left)):
                for k in range(NONZERO):
                    at, sign = x * DIMS + _DIM[y, k], _SIGN[y, k]
                    table[:] += np.bincount(at[sign > 0], minlength=TOKENS * DIMS)
                    table[:] -= np.bincount(at[sign < 0], minlength=TOKENS * DIMS)

    held, size = [], 0
    for batch in batches:
        for raw in utf8(batch.column(0)):
            x = tokens(raw)
            if len(x):
                held.append(x)
                size += len(x)
            if size >= 1 << 20:
                add(held)
                held, size = [], 0
    if held:
        add(held)
    slices = [*np.split(table, _PARTS), seen]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(slices)), pa.int32()),
         pa.array([x.tobytes() for x in slices], pa.binary())], names=["part", "v"])


class Vectors:
    """Unit context vectors and frequency weights of the token buckets."""

    def __init__(self, table: np.ndarray, seen: np.ndarray):
        t = table.reshape(TOKENS, DIMS).astype(np.float32)
        t -= t.sum(axis=0) / max(1, seen.sum()) * seen[:, None]     # without the common part
        self.unit = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)
        self.weight = (1e-3 / (1e-3 + seen / max(1, seen.sum()))).astype(np.float32)

    def pool(self, raw: bytes | None) -> np.ndarray:
        t = tokens(raw)
        if not len(t):
            return np.zeros(POOLED, np.float32)
        ids, n = np.unique(t, return_counts=True)
        u, w = self.unit[ids], n * self.weight[ids]
        plain, rare = n @ u / n.sum(), w @ u / w.sum()
        # The lengths tell how alike the tokens are: 1 for a single one repeated.
        return np.concatenate((plain, rare, [np.linalg.norm(plain), np.linalg.norm(rare)])
                              ).astype(np.float32)


def word_vectors(docs: DataFrame) -> Vectors:
    """Context vectors from all of ``docs`` (``text``)."""
    sums = sum_vectors(docs.select("text").mapInArrow(_context, "part int, v binary"), "part", "v")
    got = {r["part"]: np.frombuffer(r["v"], np.int64) for r in sums.collect()}  # TOKENS x DIMS
    empty = np.zeros(TOKENS * DIMS // _PARTS, np.int64)
    return Vectors(np.concatenate([got.get(i, empty) for i in range(_PARTS)]),
                   got.get(_PARTS, np.zeros(TOKENS, np.int64)))


def pooled(docs: DataFrame, vectors: Vectors) -> DataFrame:
    """doc_id, x (array of POOLED floats) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.pool(raw) for raw in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<float>")


class Network:
    """x -> tanh layer -> logit; probabilities are sigmoid(logit / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 7):
        rng = np.random.default_rng(seed)
        x, y = x.astype(np.float64), y.astype(np.float64)
        self.mean, self.temperature, self.constant = x.mean(axis=0), 1.0, None
        self.scale = x.std(axis=0) + 1e-6
        if y.min() == y.max():
            self.constant = float(y[0])
            return
        order = rng.permutation(len(y))
        held = order[: len(y) // 5]
        fit = order[len(y) // 5:]
        z = (x - self.mean) / self.scale
        d = x.shape[1]
        self.p = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m = [np.zeros_like(q) for q in self.p]
        v = [np.zeros_like(q) for q in self.p]
        # Both labels weigh the same in training; the prior comes back with the calibration.
        weight = np.where(y > 0, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean())) \
            if 0 < y[fit].mean() < 1 else np.ones(len(y))
        step = 0
        for _ in range(epochs):
            rng.shuffle(fit)
            for at in range(0, len(fit), 128):
                i = fit[at:at + 128]
                h = np.tanh(z[i] @ self.p[0] + self.p[1])
                out = 1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -40, 40)))
                g = (out - y[i]) * weight[i] / len(i)
                gh = g[:, None] * self.p[2] * (1 - h * h)
                grads = [z[i].T @ gh + 1e-4 * self.p[0], gh.sum(axis=0), h.T @ g,
                         g.sum(keepdims=True)]
                step += 1
                for k, q in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    self.p[k] -= 0.005 * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        logit = self.logits(x[held] if len(held) else x)
        truth = y[held] if len(held) else y

        def loss(t: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(logit / t, -40, 40))), 1e-9, 1 - 1e-9)
            return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(x):
            return np.full(len(x), self.constant if self.constant is not None else 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(vectors_of: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on about ``sample`` rows of ``vectors_of`` (doc_id, x) that ``labels`` (doc_id,
    quality) marks 0 or 1: those whose id hash lies in that share of all hashes. An id with several labels counts
    once, with the smallest."""
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").alias("y"))
    n = marked.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    some = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # About ``sample`` rows, in an order of their own.
    rows = sorted(vectors_of.join(some, "doc_id").select(
        F.xxhash64("doc_id").alias("o"), "x", "y").collect(), key=lambda r: (r["o"], r["x"]))
    if not rows:
        return Network(np.zeros((1, POOLED)), np.ones(1))
    return Network(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (``doc_id``, ``text``). Labels are
    learned only from ids whose crc32 modulo 4 is not 2.

    Null and empty texts are pooled as zero vectors and scored like any other. Without a label of
    either kind the score is that of the only kind (1 without any). Equal texts get equal scores.
    Other columns aren't read."""
    fold = fold_remainder("doc_id")
    x = stored(pooled(docs, word_vectors(docs)), "quality-pooled")
    net = docs.sparkSession.sparkContext.broadcast(
        train(x.filter(fold != 2), labels.filter(fold != 2), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            score = net.value.predict(flat.reshape(batch.num_rows, -1).astype(np.float64)
                                      if batch.num_rows else np.zeros((0, POOLED)))
            score = np.round(score, 9)      # the same whatever batch a row came in
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()),
                 pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(run, f"doc_id {kind}, score double, predicted int").select(
        "doc_id", (fold == 2).alias("held_out"), "score", "predicted")
