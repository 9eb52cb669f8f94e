"""Operator 3: license scans by an exact set-similarity join of text blocks with templates.

A block is a line or, in longer lines, a sentence; a sentence that goes over several lines (up to
a blank line) is a block besides its lines, for templates of which it holds more than each of them.
A block meets a template if it holds at least ``THRESHOLD`` of the template's distinct tokens.
Candidates come from the usual filters:

* order: template tokens by their document frequency over the whole corpus (first pass), rarest
  first;
* prefix: a block that holds ``need = ceil(threshold * n)`` of ``n`` tokens holds one of the
  ``n - need + 1`` rarest ones, so blocks without a prefix token are never looked at;
* length: the block must have ``need`` tokens of the template vocabulary;
* position: the overlap is at most what the two ordered token lists still hold from the first
  common prefix token on;

then the overlap is counted exactly. The templates and phrases are small fixed lists (parameters),
so the join runs inside each task against an inverted prefix index; the documents are not
shuffled. Base phrases are found on the same word hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ALNUM, utf8, words

#: Phrases and the labels that they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice templates and the labels that they stand for.
TEMPLATES = {
    "licensed under the apache license version 2.0": "apache-2.0",
    "licensed under the bsd 3 clause license": "bsd-3-clause",
    "licensed under cc by 4.0": "cc-by-4.0",
    "licensed under cc by nc 4.0": "cc-by-nc-4.0",
    "licensed under cc by sa 4.0": "cc-by-sa-4.0",
    "this work is licensed under the gnu general public license": "gpl-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "redistribution and use in source and binary forms with or without modification "
    "are permitted": "bsd-grant",
    "all rights reserved": "reserved",
}
THRESHOLD = 0.8
_END = regex.compile(rb"\n|[.!?]+(?=\s)")
_END_WIDE = regex.compile(rb"\n[^\S\n]*(?=\n)|[.!?]+(?=\s)")


def _hashes(text: str) -> np.ndarray:
    return words(text.encode(), ALNUM)[0]


class Scanner:
    """Phrases and templates as word hashes; ``order`` sets the prefix index."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], threshold: float):
        self.phrases = [(_hashes(p), label) for p, label in phrases.items() if len(_hashes(p))]
        self.sets = [(np.unique(_hashes(t)), label) for t, label in templates.items()
                     if len(_hashes(t))]
        self.vocab = np.unique(np.concatenate([x for x, _ in self.sets])) if self.sets \
            else np.zeros(0, np.uint64)
        self.threshold = threshold
        self.order(np.zeros(len(self.vocab), np.int64))

    def order(self, df: np.ndarray) -> None:
        """Number the tokens from rare to common and index the templates' prefixes."""
        n = len(self.vocab)
        self.rank = np.empty(n, np.int64)
        self.rank[np.lexsort((np.arange(n), df))] = np.arange(n)
        self.templates, self.index = [], {}
        for t, (tokens, label) in enumerate(self.sets):
            ids = np.sort(self.rank[np.searchsorted(self.vocab, tokens)])
            need = max(1, math.ceil(self.threshold * len(ids) - 1e-9))
            self.templates.append((ids, set(ids.tolist()), need, label))
            for place, token in enumerate(ids[: len(ids) - need + 1].tolist()):
                self.index.setdefault(token, []).append((t, place))
        self.is_prefix = np.zeros(n + 1, bool)
        self.is_prefix[list(self.index)] = True

    def token_ids(self, h: np.ndarray) -> np.ndarray:
        """Rank of every word among the template tokens; the vocabulary's size if it is none."""
        if not len(self.vocab):
            return np.zeros(len(h), np.int64)
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        return np.where(self.vocab[at] == h, self.rank[at], len(self.vocab))

    def places(self, h: np.ndarray) -> list[tuple[int, str]]:
        found = []
        for p, label in self.phrases:
            m = len(h) - len(p) + 1
            if m <= 0:
                continue
            at = np.flatnonzero(h[:m] == p[0])
            for j in range(1, len(p)):
                at = at[h[at + j] == p[j]]
            found.extend((int(i), label) for i in at)
        return found

    def blocks(self, raw: bytes, starts: np.ndarray, ids: np.ndarray):
        """(template number, its tokens in the block, first word, end word, first and end word of
        the sentence over all its lines) of every match."""
        prefix = self.is_prefix[ids]
        if not prefix.any():
            return
        line, wide = (np.searchsorted(np.fromiter((m.end() for m in end.finditer(raw)), np.int64),
                                      starts, side="right") for end in (_END, _END_WIDE))
        for w in np.unique(wide[prefix]):
            first, last = np.searchsorted(wide, w), np.searchsorted(wide, w, side="right")
            inside, most = line[first:last], {}
            for b in np.unique(inside[prefix[first:last]]):
                lo = first + np.searchsorted(inside, b)
                hi = first + np.searchsorted(inside, b, side="right")
                for t, both in self.met(ids[lo:hi]):
                    most[t] = max(most.get(t, 0), len(both))
                    yield t, both, int(lo), int(hi), int(first), int(last)
            if inside[0] != inside[-1]:
                for t, both in self.met(ids[first:last]):
                    if len(both) > most.get(t, 0):
                        yield t, both, int(first), int(last), int(first), int(last)

    def met(self, ids: np.ndarray):
        """(template number, its tokens in the block and how often they stand there) of every
        template that the block meets."""
        have, times = np.unique(ids[ids < len(self.vocab)], return_counts=True)
        count, have, tried = dict(zip(have.tolist(), times.tolist())), have.tolist(), set()
        for i, token in enumerate(have):
            for t, place in self.index.get(token, ()):
                if t in tried:
                    continue
                tried.add(t)
                tokens, as_set, need, _ = self.templates[t]
                # Length, then position: this is the first common token of both lists.
                if len(have) < need or 1 + min(len(have) - i - 1,
                                               len(tokens) - place - 1) < need:
                    continue
                both = {x: count[x] for x in have if x in as_set}
                if len(both) >= need:
                    yield t, both


def _labels(found: list[tuple]) -> list[str]:
    """Labels of the matches (share, template size, label, tokens, need, span, span over all lines)
    but those that better ones of the block explain, or, for a part of a template, better ones of
    the sentence over all its lines or of these lines. They explain a match that isn't met by the
    words that they leave (each takes each of its tokens once), unless the match is a whole
    template with a token that none of them has."""
    kept: dict[tuple, list[tuple]] = {}
    inner: dict[tuple, list[tuple]] = {}        # of all lines of a sentence

    def explained(m: tuple, others: list[tuple]) -> bool:
        better = [o[3] for o in others if o[:3] > m[:3]]
        return bool(better) and (m[0] < 1 or any(m[3].keys() <= o.keys() for o in better)) and sum(
            n > sum(x in o for o in better) for x, n in m[3].items()) < m[4]

    for m in sorted(found, key=lambda m: m[:3], reverse=True):
        span, wide = m[5:]
        if explained(m, kept.get(span, [])):
            continue
        if m[0] < 1 and explained(m, (inner if span == wide else kept).get(wide, [])):
            continue
        kept.setdefault(span, []).append(m)
        if span != wide:
            inner.setdefault(wide, []).append(m)
    return [m[2] for ms in kept.values() for m in ms]


def _frequency(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(scanner.vocab)
        sums = np.zeros(n + 1, np.int64)
        for batch in batches:
            for raw in utf8(batch.column(0)):
                sums[np.unique(scanner.token_ids(words(raw, ALNUM)[0]))] += 1
        inverse = np.argsort(scanner.rank)
        i = np.flatnonzero(sums[:n])
        yield pa.RecordBatch.from_arrays(
            [pa.array(inverse[i].astype(np.int64)), pa.array(sums[i])], names=["token", "n"])
    return run


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(8)]
            for raw in utf8(batch.column(1)):
                h, s, _ = words(raw, ALNUM)
                base = scanner.places(h)
                labels, spans, best = {x for _, x in base}, [], 1.0 if base else 0.0
                found = []
                if len(h):
                    for t, both, lo, hi, first, last in scanner.blocks(raw, s,
                                                                       scanner.token_ids(h)):
                        tokens, _, need, label = scanner.templates[t]
                        share = len(both) / len(tokens)
                        found.append((share, len(tokens), label, both, need, (lo, hi),
                                      (first, last)))
                        best = max(best, share)
                        spans.append({"label": label, "start": lo, "end": hi, "share": share})
                labels.update(_labels(found))
                at = [i for i, _ in base]
                row = (len(h), len(at), min(at, default=None), max(at, default=None),
                       ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best,
                       spans)
                for o, v in zip(out, row):
                    o.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                 ("share", pa.float64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(o, k) for o, k in zip(out, kinds)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                       "labels", "score", "blocks"])
    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES,
                  templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD
                  ) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): doc_id, n_words, n_base (places of
    base phrases), first_word, last_word (smallest and largest start; null without one),
    base_labels, labels (base labels and each block's templates but those that a better one, of
    larger containment, then longer, explains by the same words; sorted), score (1 with a base
    phrase, else the best template containment, 0 without a match), blocks (the matching blocks: label, word span,
    containment).

    Null and empty texts have no words and no labels. Equal rows get equal results. Other columns
    aren't read."""
    scanner = Scanner(phrases, templates, threshold)
    df = np.zeros(len(scanner.vocab), np.int64)
    counts = docs.select("text").mapInArrow(_frequency(scanner), "token long, n long")
    for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect():   # template tokens
        df[r["token"]] = r["n"]
    scanner.order(df)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(scanner), (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, "
        "blocks array<struct<label:string,start:bigint,end:bigint,share:double>>"))
