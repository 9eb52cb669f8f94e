"""Operator 4: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the 1- to 3-grams of every labelled text (lower-cased letters, other characters
as one space) into ``BUCKETS`` hash buckets per language: one vector per task and language, added
by a tree of sums. The log-probability matrix (languages x buckets doubles, a fixed size per
language) is broadcast; texts are scored in numpy by blocks: the grams of many texts are the
entries of sparse rows, and a block of rows times that matrix is one gather and one sum per row.

Awkward rows, in all functions here: a null or empty text, or one without a letter, is ``und`` with
score 0, and counts for its language's prior only; a null ``lang`` trains nothing; repeated rows
are rows of their own; very long texts are hashed in segments that overlap by the longest order
less one; an empty table gives an empty result; other columns are kept (``identified``) or not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded, fold_remainder, mix, sum_vectors

BUCKETS = 1 << 14     # a power of two
ORDERS = (1, 2, 3)
MAX_LANGS = 1000    # distinct labels; bounds the matrix (8 * BUCKETS bytes each)
ALPHA = 0.5
UND = "und"

_GAP = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SEGMENT = 1 << 20
_BLOCK = 1 << 15    # code points of the texts that are hashed and scored at once


def _normalised(text: str) -> str:
    return " " + _GAP.sub(" ", text.lower()) + " "


def _codes(part: str) -> np.ndarray:
    return np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashed(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order - 1, bucket of the gram that starts at each code point), order by order."""
    acc = np.zeros(len(c), np.uint64)
    for j in range(max(ORDERS)):
        n = len(c) - j
        if n <= 0:
            return
        acc = acc[:n] + (c[j:] + np.uint64(1)) * _K[j]
        if j + 1 in ORDERS:
            yield j, (mix(acc + np.uint64(j)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def gram_counts(text: str) -> np.ndarray:
    """Counts of the text's n-grams per bucket; long texts in segments. A segment reads the longest
    order less one code points before it, and counts the grams that end in itself."""
    total = np.zeros(BUCKETS, np.int64)
    norm = _normalised(text)
    for at in range(0, len(norm), _SEGMENT):
        lead = max(0, at - max(ORDERS) + 1)
        for j, h in _hashed(_codes(norm[lead: at + _SEGMENT])):
            total += np.bincount(h[max(0, at - lead - j):], minlength=BUCKETS)
    return total


def _rows(numbers: list[int], parts: list[str]):
    lens = np.array([len(p) for p in parts])
    ends = np.cumsum(lens)
    c = _codes("".join(parts))
    left = np.repeat(ends, lens) - np.arange(len(c))    # code points up to the text's end
    for j, h in _hashed(c):
        n = np.maximum(lens - j, 0)
        held = n > 0
        yield (np.array(numbers)[held], (np.cumsum(n) - n)[held], h[left[:len(h)] > j], None)


def sparse_rows(texts: list[str], block: int = _BLOCK):
    """The texts' gram counts as sparse rows, in blocks (text numbers, start of each one's entries,
    buckets, counts): the grams of many texts, one order at a time and each a count of 1 (None),
    or the summed counts of one text longer than ``block``. Empty texts have no entries. A text's
    entries and their order don't depend on the texts beside it."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > block:
            counts = gram_counts(text)
            ids = np.flatnonzero(counts)
            yield np.array([i]), np.array([0]), ids, counts[ids]
            continue
        if size + len(text) > block:
            yield from _rows(numbers, parts)
            numbers, parts, size = [], [], 0
        numbers.append(i)
        parts.append(_normalised(text))
        size += len(text)
    if numbers:
        yield from _rows(numbers, parts)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # One slot past the buckets counts the documents.
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for lang in labels:
            sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[-1] += 1
        for numbers, starts, ids, counts in sparse_rows(batch.column(1).to_pylist()):
            of = [labels[i] for i in numbers]
            at = np.repeat(np.arange(len(of)), np.diff(np.append(starts, len(ids))))
            for lang in dict.fromkeys(of):
                its = np.array([x == lang for x in of])[at]
                sums[lang][:-1] += np.bincount(
                    ids[its], None if counts is None else counts[its], BUCKETS).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()),
         pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "v"])


class Model:
    """Languages in order with log priors and log probabilities (languages x buckets)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, docs = counts[:, :-1].astype(float), counts[:, -1].astype(float)
        self.prior = np.log((docs + 1) / (docs + 1).sum()) if langs else np.zeros(0)
        total = grams.sum(axis=1, keepdims=True) + ALPHA * BUCKETS
        self.logp = np.log((grams + ALPHA) / total) if langs else np.zeros((0, BUCKETS))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = len(self.langs)
        asked = [t if t and n and _LETTER.search(t) else None for t in texts]
        ll = np.zeros((n, len(texts)))
        # At most 4 million gathered values at once, unless one text alone has more.
        for numbers, starts, ids, counts in sparse_rows(asked, min(_BLOCK, (4 << 20) // max(1, n))):
            at = self.logp[:, ids]
            ll[:, numbers] += np.add.reduceat(at if counts is None else at * counts, starts, axis=1)
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        for i, text in enumerate(asked):
            if text:
                p = ll[:, i] + self.prior
                p = np.exp(p - p.max())
                best = int(p.argmax())
                langs[i], scores[i] = self.langs[best], float(p[best] / p.sum())
        return langs, scores


def train(docs: DataFrame, keep: Column | None = None, max_langs: int = MAX_LANGS) -> Model:
    """Fit on every row of ``docs`` (``text``, ``lang``) with a non-null lang that ``keep``
    selects. A null text counts for the prior only. Raises if there are more than ``max_langs``
    labels, whose matrix would no longer be a small broadcast."""
    rows = docs.filter(F.col("lang").isNotNull())
    rows = rows.filter(keep) if keep is not None else rows
    per_task = rows.select("lang", "text").mapInArrow(bounded(_counter), "lang string, v binary")
    sums = sum_vectors(per_task, "lang", "v")
    n = sums.count()
    if n > max_langs:
        raise ValueError(f"{n} languages; the model is bounded to {max_langs}")
    got = sorted(((r["lang"], np.frombuffer(r["v"], np.int64)) for r in sums.collect()),
                 key=lambda x: x[0])
    return Model([x[0] for x in got], np.array([x[1] for x in got]).reshape(len(got), BUCKETS + 1))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) as doc_id, lang_pred, score, one row per row. ``und`` with
    score 0 if the text is null, has no letter, or the model knows no language; ties go to the
    first language by code point. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        bounded(run), f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with all its columns, without the rows whose language isn't identified: ``und``,
    or a probability under ``least``. Trained as ``language_id`` is; rows pass unshuffled."""
    model = train(docs, fold_remainder("doc_id") != 2)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UND and s >= least
                                         for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(bounded(run), docs.schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the documents whose id's crc32 modulo 4 is not 2, then predict all of them:
    doc_id, held_out, lang_pred, score."""
    fold = fold_remainder("doc_id")
    model = train(docs, fold != 2)
    return identify(docs, model).select(
        "doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
