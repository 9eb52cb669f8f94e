"""Operator 10: edit-aware token counts.

A document's pre-tokens (the pieces that the tokenizer's merges never cross) are grouped into
leaves of at most ``LEAF`` pre-tokens; a segment tree over the leaves holds subtree sums of
characters and tokens. An edit finds its leaves by descending the character sums, re-encodes the
text of those leaves only, and updates the sums on the path to the root.

Context at the edges: a pre-token depends on the text before its start not at all and on the text
after its end by the look-ahead of white space. The region therefore starts with the leaf that
holds the last visible character before the edit, and it grows to the right, leaf by leaf, until
a pre-token ends on an old leaf's end; from there on every match is as before.

The work is narrow: text, tree and edits of a document travel in one row; the query and
``apply_edits`` shuffle nothing. Token counts of pre-tokens are cached per worker, bounded by
``MAX_PIECES``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 32
MAX_PIECES = 400_000
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Number of tokens of pre-tokens, each distinct one encoded once."""

    def __init__(self, path: str):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.known: dict[str, int] = {}
        self.split = regex.compile(PATTERN)
        self.encoded = 0

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece."""
        self.encoded += len(pieces)
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            for p, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)):
                self.known[p] = len(e.ids)
        out = [self.known[p] for p in pieces]
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker process and file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class Tree:
    """Segment tree of one document: ``chars`` and ``toks`` are sums over heap-ordered nodes."""

    def __init__(self, count: Counter, text: str, state: tuple | None = None):
        self.count = count
        if state is None:
            pieces = count.split.findall(text)
            n = np.array(count.counts(pieces), np.int64)
            size = np.array([len(p) for p in pieces], np.int64)
            at = np.arange(0, len(pieces), LEAF)
            chars = np.add.reduceat(size, at) if len(pieces) else np.zeros(0, np.int64)
            toks = np.add.reduceat(n, at) if len(pieces) else np.zeros(0, np.int64)
        else:
            chars, toks = (np.array(x, np.int64) for x in state)
        self.n = len(chars)
        self.width = 1 << max(0, (max(1, self.n) - 1).bit_length())
        self.chars, self.toks = self._sums(chars), self._sums(toks)
        ends = np.cumsum(chars)
        self.texts = [text[e - c:e] for e, c in zip(ends.tolist(), chars.tolist())]
        if not self.texts:
            self.n, self.texts = 1, [""]

    def _sums(self, leaves: np.ndarray) -> np.ndarray:
        t = np.zeros(2 * self.width, np.int64)
        t[self.width:self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            half = level // 2
            t[half:level] = t[level:2 * level:2] + t[level + 1:2 * level:2]
            level = half
        return t

    def _set(self, leaf: int, text: str, toks: int) -> None:
        self.texts[leaf] = text
        i = self.width + leaf
        dc, dt = len(text) - int(self.chars[i]), toks - int(self.toks[i])
        while i:
            self.chars[i] += dc
            self.toks[i] += dt
            i //= 2

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf that holds character ``place``, its first character)."""
        i, first = 1, 0
        while i < self.width:
            i *= 2
            if place >= first + self.chars[i]:
                first += int(self.chars[i])
                i += 1
        return i - self.width, first

    @property
    def tokens(self) -> int:
        return int(self.toks[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.texts)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end``."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        a, first = self._find(start) if start < self.length else (self.n - 1, self.length - len(
            self.texts[self.n - 1]))
        b, b_first = self._find(end - 1) if end > start else (a, first)
        # Left context: back to the leaf of the last visible character before the edit.
        while a > 0 and not (self.texts[a][:start - first] if start > first else "").strip():
            a -= 1
            first -= len(self.texts[a])
        old = "".join(self.texts[a:b + 1])
        region = old[:start - first] + new + old[end - first:]
        # Right context: until a pre-token ends where an old leaf ended.
        done, at, pieces = False, 0, []
        while not done:
            follow = next((t for t in self.texts[b + 1:] if t), "")
            stop, pieces, ends = len(region), [], 0
            for m in self.count.split.finditer(region + follow):
                if m.start() >= stop:
                    break
                pieces.append(m.group())
                ends = m.end()
            if ends == stop or not follow:
                done = True
            else:
                b += 1
                while not self.texts[b]:
                    b += 1
                region += self.texts[b]
        self._set(a, region, sum(self.count.counts(pieces)))
        for leaf in range(a + 1, b + 1):
            if self.texts[leaf]:
                self._set(leaf, "", 0)

    def state(self) -> tuple[list[int], list[int]]:
        """Leaf sums of characters and tokens: what a later edit needs besides the text."""
        w = self.width
        c, t = self.chars[w:w + self.n], self.toks[w:w + self.n]
        return c[c > 0].tolist(), t[c > 0].tolist()


def _ordered(edits: list[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """Edits from the last to the first, clamped to the text; an edit that reaches into a later
    one ends at its start. Those without a start are none."""
    out, limit = [], length
    for e in sorted((e for e in edits or [] if e is not None and e["start"] is not None),
                    key=lambda e: e["start"], reverse=True):
        start = min(max(e["start"], 0), limit)
        stop = e["start"] if e["end"] is None else e["end"]
        out.append((start, min(max(stop, start), limit), e["new"] or ""))
        limit = start
    return out


STATE = "leaf_chars array<int>, leaf_tokens array<int>"
EDITS = "array<struct<start:int,end:int,new:string>>"


def _runner(tokenizer: str, has_state: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            out = [[] for _ in range(7)]
            texts, edits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            states = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()) \
                if has_state else [None] * len(texts)
            for text, todo, state in zip(texts, edits, states):
                if state is not None and state[0] is None:
                    state = None
                tree = Tree(count, text or "", state)
                before, was = tree.tokens, count.encoded
                todo = _ordered(todo, tree.length)
                for e in todo:
                    tree.edit(*e)
                chars, toks = tree.state()
                row = (before, tree.tokens, len(todo), count.encoded - was,
                       tree.text() if todo else text, chars, toks)
                for o, v in zip(out, row):
                    o.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(o, k) for o, k in zip(out, kinds)],
                names=["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_reencoded", "text",
                       "leaf_chars", "leaf_tokens"])
    return run


def apply_edits(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Count and edit ``docs``: doc_id, text, edits (array of struct<start, end, new> in
    characters of the text) and, if an earlier result is carried on, leaf_chars and leaf_tokens
    (the trees; without them they are built by encoding the whole text).

    One row per row: doc_id, n_tokens, n_tokens_after, n_edits, n_reencoded (pre-tokens encoded
    for the edits), text (edited), leaf_chars, leaf_tokens (the updated trees). Null texts count
    as empty, null edits as none; edits are clamped to the text, and one that reaches into a later
    one ends at its start. Equal rows get equal results. Other columns aren't read."""
    has = {"leaf_chars", "leaf_tokens"} <= set(docs.columns)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "text", F.col("edits").cast(EDITS).alias("edits")] + (
        ["leaf_chars", "leaf_tokens"] if has else [])
    return docs.select(*cols).mapInArrow(_runner(tokenizer, has), (
        f"doc_id {kind}, n_tokens long, n_tokens_after long, n_edits long, n_reencoded long, "
        f"text string, {STATE}"))


def with_cleaning_edits(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the edits of a usual cleaning round: the first line goes, the
    middle character's place gets a paragraph break, and the text gets a closing newline."""
    n = F.coalesce(F.length("text"), F.lit(0))
    line = F.coalesce(F.locate("\n", F.col("text")), F.lit(0))
    edit = lambda start, end, new: F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("new"))
    edits = F.filter(F.array(
        F.when(line > 0, edit(F.lit(0), line, "")),
        F.when(n > 1, edit(F.floor(n / 2), F.floor(n / 2), "\n\n")),
        F.when(n > 0, edit(n, n, "\n"))), lambda e: e.isNotNull())
    return docs.select("doc_id", "text", edits.alias("edits"))
