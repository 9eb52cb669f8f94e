"""Operator 7: substring dedup by sliding sentence spans.

A text's sentences end at a newline or at ``.``, ``!`` or ``?`` before white space. A run is any
number of consecutive sentences of at least ``min_sentences`` sentences and ``min_words`` words, or
a single sentence of ``long_words`` words. Two runs per sentence stand for all of them: the shortest
one that starts at it and the shortest one that ends with it. A sentence of a longer run is in the
first kind, or too little follows it in the run; then the second kind at the run's end holds it. A
run is known by a 96-bit hash of its words, A-Z lower-cased, so layout and punctuation don't matter.
Equal passages (the same words in the same sentences) hold equal runs wherever they stand, and every
run of a passage lies inside it.

Plan: one narrow pass writes the runs; a grouped minimum (partial aggregation, so a run that a
third of all documents share is one row per task) finds each repeated run's first place; the runs
joined back (a skewed join that adaptive execution splits) give the covered sentences of all
non-first occurrences; one join by document removes them. Workers take texts in batches of a few MB
and give unused memory back; what is grouped or joined is written in files by its size, not by the
number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ALNUM, bounded, drop_stored, few, mix, stored, utf8, words

MIN_SENTENCES = 2
MIN_WORDS = 24
LONG_WORDS = 50
RUN_BYTES = 128         # of a run in a sort, about

_END = regex.compile(rb"\n|[.!?]+(?=\s)")
_Q = np.uint64(0xD1342543DE82EF95)
_Q_INV = np.uint64(pow(int(_Q), -1, 2**64))


def sentences(raw: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each sentence and a last entry with the number of words, byte
    starts of the sentences). A sentence has a word; what precedes the first word of the next one
    belongs to the sentence before."""
    h, s, _ = words(raw, ALNUM)
    if not len(h):
        z = np.zeros(0, np.int64)
        return h, np.zeros(1, np.int64), z
    ends = np.fromiter((m.end() for m in _END.finditer(raw)), np.int64)
    number = np.searchsorted(ends, s, side="right")
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    starts = np.where(number[first] > 0, ends[np.maximum(number[first] - 1, 0)]
                      if len(ends) else 0, 0)
    starts[0] = 0
    return h, np.append(first, len(h)), starts


def runs(h: np.ndarray, first: np.ndarray, min_sentences: int = MIN_SENTENCES,
         min_words: int = MIN_WORDS, long_words: int = LONG_WORDS):
    """(start sentence, end sentence exclusive, 64-bit and 32-bit hash) of the shortest run from
    every start and the shortest one to every end."""
    n = len(first) - 1
    i = np.arange(n)
    j = np.maximum(np.searchsorted(first, first[:-1] + min_words), i + min_sentences)
    j = np.where(np.diff(first) >= long_words, i + 1, j)
    ok = j <= n
    i, j = i[ok], j[ok]
    end = np.arange(1, n + 1)
    back = np.minimum(np.searchsorted(first, first[1:] - min_words, side="right") - 1,
                      end - min_sentences)
    # The same run only once: a start has one end of the first kind.
    ahead = np.full(n + 1, -1)
    ahead[i] = j
    ok = (back >= 0) & (ahead[back] != end)
    i, j = np.concatenate((i, back[ok])), np.concatenate((j, end[ok]))
    q = np.full(len(h) + 1, _Q, np.uint64)
    q[0] = 1
    q = np.multiply.accumulate(q)
    inv = np.full(n and len(h) + 1 or 1, _Q_INV, np.uint64)
    inv[0] = 1
    inv = np.multiply.accumulate(inv)
    a, b = first[i], first[j]
    out = []
    for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ salt) * q[:-1], out=c[1:])
        out.append(mix((c[b] - c[a]) * inv[a] + (b - a).astype(np.uint64)))
    return i, j, out[0].view(np.int64), (out[1] >> np.uint64(33)).astype(np.int32)


def _run_rows(options: tuple):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cols = [], [[], [], [], []]
            for r, raw in enumerate(utf8(batch.column(2))):
                h, first, _ = sentences(raw)
                i, j, h64, h32 = runs(h, first, *options)
                keep.append(np.full(len(i), r))
                for c, x in zip(cols, (h64, h32, i, j)):
                    c.append(x)
            at = pa.array(np.concatenate(keep or [np.zeros(0)]).astype(np.int64))
            h64, h32, i, j = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h64, pa.int64()), pa.array(h32.astype(np.int32)),
                 batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))],
                names=["h", "g", "doc_id", "t", "i", "j"])
    return make


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ns, nr, kept, removed = [], [], [], []
        held = batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(held)))
        i, j = (x.to_numpy(zero_copy_only=False) for x in batch.column(2).flatten().flatten())
        for k, raw in enumerate(utf8(batch.column(1))):
            _, first, starts = sentences(raw)
            n = len(starts)
            ends = np.zeros(n + 1, np.int64)
            np.add.at(ends, i[at[k]:at[k + 1]], 1)
            np.add.at(ends, j[at[k]:at[k + 1]], -1)
            gone = np.cumsum(ends[:n]) > 0
            ns.append(n), nr.append(int(gone.sum())), removed.append(np.flatnonzero(gone))
            if not gone.any():
                kept.append(raw)
                continue
            cut = np.append(starts, len(raw))
            kept.append(b"".join(raw[cut[k]:cut[k + 1]] for k in np.flatnonzero(~gone)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ns, pa.int64()), pa.array(nr, pa.int64()),
             pa.array(removed, pa.list_(pa.int64())),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_sentences", "n_removed", "removed", "text"])


def dedup_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
                long_words: int = LONG_WORDS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): doc_id, n_sentences, n_removed,
    removed (sentence numbers), text (without them).

    The first occurrence of a run is the one of the smallest doc_id (null ids come last), then
    text hash, then sentence; only it stays. Null or empty texts have no sentences; a null text
    stays null. Rows with equal id and text are the same document and get equal results, so a
    repeated row doesn't make its own passages repeated. Other columns aren't read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = stored(src.mapInArrow(
        bounded(_run_rows((min_sentences, min_words, long_words))),
        f"h long, g int, doc_id {kind}, t long, i int, j int"), "spans-runs")
    size = RUN_BYTES * found.count()        # the texts of these runs take less
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "i")
    firsts = (found.select("h", "g", place.alias("p")).groupBy("h", "g")
              .agg(F.min("p").alias("lo"), F.max("p").alias("hi")).filter("lo <> hi")
              .select("h", "g", "lo"))
    # Written, so that both sides of the next join are plain shuffles, which can be split.
    firsts = stored(few(firsts, size), "spans-firsts")
    later = (found.join(firsts, ["h", "g"]).filter(place != F.col("lo"))
             .select("doc_id", "t", "i", "j"))
    # At most two entries per sentence of the document.
    covers = later.groupBy("doc_id", "t").agg(
        F.collect_set(F.struct("i", "j")).alias("cover")).withColumnsRenamed(
        {"doc_id": "c_id", "t": "c_t"})
    covers = stored(few(covers, size), "spans-cover")
    drop_stored(found, firsts)
    joined = src.join(covers, src["doc_id"].eqNullSafe(covers["c_id"])
                      & (src["t"] == covers["c_t"]), "left")
    return few(joined.select("doc_id", "text", "cover"), size).mapInArrow(
        bounded(_remover), f"doc_id {kind}, n_sentences long, n_removed long, removed array<long>, "
        "text string")
