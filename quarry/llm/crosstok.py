"""Operator 13: tokens of two tokenizers aligned by interval coalescing.

Each text is encoded twice: by a byte-level tokenizer of the tokenizers library (A, over a space
and the text) and by a sentencepiece model (B, which adds that space). Tokens are byte intervals
of the same bytes. All intervals of both, sorted by start, are cut where a start reaches the
running maximum of the ends before it: no token crosses that place, so the pieces are the finest
groups in which both tokenizers cover the same bytes. Within a group every A token is linked with
every B token.

Plan: one narrow pass encodes, coalesces and writes one row per document with its distinct id
pairs and how often each is linked. Pairs are then counted by document (partial aggregation), the
highest count of each A id found, and the counts joined back: as a broadcast while there are few
distinct pairs, by a shuffle join (split by adaptive execution where a pair is hot) beyond that.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_stored, stored

SLICE_BYTES = 1 << 20               # texts that are encoded and coalesced at a time
WIDE = 256                          # links of a group from which its equal ids are joined first
MAX_BROADCAST_PAIRS = 1_000_000     # counted id pairs broadcast at most; about 50 MB


#: Fixed value: the pre-token pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# A text that the rank encoder isn't given: with a character above the Latin blocks, whose class
# may differ between the libraries' Unicode tables, or with a very long piece.
_OTHER = re.compile("[^\x00-\u024f]|[^ ]{2000}| {2000}")


class Pair:
    """Both tokenizers with the bytes of each of their tokens. With ``ranked`` (as ``is_ranked``
    found) A's texts are encoded by ranks, three times as fast, with the same ids."""

    def __init__(self, a_path: str, b_path: str, ranked: bool = False):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, vocab = byte_alphabet(), self.a.get_vocab(True)
        self.a_bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for entry, i in vocab.items():
            known = all(c in alphabet for c in entry)
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if known else entry.encode()
        self.ranks = None
        if ranked:
            import tiktoken
            self.ranks = tiktoken.Encoding(
                "a", pat_str=PATTERN, special_tokens={},
                mergeable_ranks={self.a_bytes[i]: i for i in self._merged()})
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        names = [str(i).encode() for n in (len(self.a_bytes), len(self.b_bytes)) for i in range(n)]
        self.digits = np.array([len(x) for x in names], np.int64)
        width = int(self.digits.max(initial=0)) + 1     # one more for the separator
        self.names = np.frombuffer(b"".join(x.ljust(width) for x in names), np.uint8).reshape(
            -1, width)

    def _merged(self) -> list[int]:
        """The ids that merges make or start from: all but those of added tokens."""
        return sorted(set(self.a.get_vocab(False).values())
                      - set(self.a.get_added_tokens_decoder()))

    def is_ranked(self) -> bool:
        """Whether merging the pair whose joined bytes have the smallest id gives A's own ids.

        It does if the ids follow the merges and every token's entry is merged to that token: the
        merges inside a token's bytes then always end in its own last pair, so no other pair of
        parts that spells it is ever left."""
        told = json.loads(self.a.to_str())
        model, pre = told["model"], told["pre_tokenizer"] or {}
        if not (told["normalizer"] is None and pre.get("type") == "ByteLevel"
                and not pre["add_prefix_space"] and pre.get("use_regex", True)
                and all(t["special"] for t in told["added_tokens"]) and model["type"] == "BPE"
                and not any(model.get(k) for k in (
                    "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                    "ignore_merges"))):
            return False
        vocab, merged = model["vocab"], self._merged()
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)]
                for m in model["merges"]]
        base = set(merged) - set(made)
        entry = {i: e for e, i in vocab.items()}
        return (made == sorted(set(made)) and len(base) == 256
                and {self.a_bytes[i] for i in base} == {bytes([i]) for i in range(256)}
                and max(base) < min(made)
                and all([t.id for t in self.a.model.tokenize(entry[i])] == [i] for i in merged))

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        """The ids of a space and each text."""
        other = [self.ranks is None or _OTHER.search(t) is not None for t in texts]
        rest = iter(self.a.encode_batch_fast(
            [" " + t for t, o in zip(texts, other) if o], add_special_tokens=False))
        return [next(rest).ids if o else self.ranks.encode_ordinary(" " + t)
                for t, o in zip(texts, other)]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(
            "▁", " ").encode()

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """The ids of each text by A and B; two empty lists for a null or empty text and where
        the bytes of the tokens of either aren't a space and the text."""
        full = [t for t in texts if t]
        a = self._encode_a(full)
        b = self.b.encode(full, num_threads=1) if full else []
        found = []
        for t, x, y in zip(full, a, b):
            raw = b" " + t.encode()
            same = raw == b"".join(map(self.a_bytes.__getitem__, x)) and raw == b"".join(
                map(self.b_bytes.__getitem__, y))
            found.append((x, y) if same else ([], []))
        rest = iter(found)
        return [next(rest) if t else ([], []) for t in texts]


class Coalesced:
    """The groups of some documents: ``a`` and ``b`` hold the ids of all of them one after the
    other, ``a_doc``, ``b_doc`` their documents and ``a_group``, ``b_group`` their groups,
    numbered over all documents."""

    def __init__(self, pair: Pair, ids: list[tuple[list[int], list[int]]]):
        self.pair, self.docs = pair, len(ids)
        self.n_a = np.array([len(x) for x, _ in ids], np.int64)
        self.n_b = np.array([len(y) for _, y in ids], np.int64)
        self.a = np.fromiter(chain.from_iterable(x for x, _ in ids), np.int64, self.n_a.sum())
        self.b = np.fromiter(chain.from_iterable(y for _, y in ids), np.int64, self.n_b.sum())
        self.a_doc = np.repeat(np.arange(self.docs), self.n_a)
        self.b_doc = np.repeat(np.arange(self.docs), self.n_b)
        # Both cover the same bytes of every document, so offsets run on over the documents.
        a_len, b_len = pair.a_len[self.a], pair.b_len[self.b]
        a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
        start = np.concatenate((a_end - a_len, b_end - b_len))
        end = np.concatenate((a_end, b_end))
        side = np.repeat(np.array([0, 1], np.int8), [len(self.a), len(self.b)])
        order = np.lexsort((start,))        # stable: A's tokens come before B's of one start
        start, end, side = start[order], end[order], side[order]
        breaks = np.zeros(len(order), np.int64)
        breaks[1:] = start[1:] >= np.maximum.accumulate(end)[:-1]
        group = np.cumsum(breaks)
        self.a_group, self.b_group = group[side == 0], group[side == 1]
        self.groups = int(group[-1]) + 1 if len(group) else 0
        self.start = start[np.concatenate(([True], breaks[1:] > 0))] if len(group) else start
        self.in_a = np.bincount(self.a_group, minlength=self.groups)
        self.in_b = np.bincount(self.b_group, minlength=self.groups)
        first = np.cumsum(self.in_a) - self.in_a
        self.group_doc = self.a_doc[first]

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums over the documents of one number per group."""
        return np.bincount(self.group_doc, values, self.docs).astype(np.int64)

    def digests(self) -> list[str]:
        """SHA-256 of every document's groups, written ``a1,a2|b1;a3|b2,b3``; '' without any."""
        total = len(self.a) + len(self.b)
        at_a = np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.a_group]
        at_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[self.b_group]
        token, side, group = (np.zeros(total, np.int64) for _ in range(3))
        token[at_a], token[at_b] = self.a, self.b + len(self.pair.a_bytes)
        group[at_a], group[at_b] = self.a_group, self.b_group
        side[at_b] = 1
        mark = np.full(total, ord(","), np.uint8)
        mark[:-1][side[1:] != side[:-1]] = ord("|")
        mark[:-1][group[1:] != group[:-1]] = ord(";")
        ends = np.cumsum(self.n_a + self.n_b)
        n = self.pair.digits[token]
        chars = self.pair.names[token]
        chars[np.arange(total), n] = mark
        n += 1
        n[ends[(self.n_a > 0)] - 1] -= 1        # no separator after a document's last id
        raw = chars[np.arange(chars.shape[1]) < n[:, None]].tobytes()
        upto = np.concatenate(([0], np.cumsum(n)))
        cut = [0, *upto[ends].tolist()]
        return [hashlib.sha256(raw[x:y]).hexdigest() if y > x else ""
                for x, y in zip(cut, cut[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of every document as ``a * size of B + b``, in document order, with
        the number of links of each: (places where documents begin, pairs, links)."""
        many = len(self.pair.b_bytes)
        size = len(self.pair.a_bytes) * many
        first_b = np.cumsum(self.in_b) - self.in_b
        wide = self.in_a * self.in_b > WIDE
        some = np.flatnonzero(~wide[self.a_group])
        g = self.a_group[some]
        n = self.in_b[g]
        upto = np.cumsum(n)
        which = np.repeat(first_b[g] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)
        keys = np.repeat(self.a_doc[some] * size + self.a[some] * many, n) + self.b[which]
        parts = [np.unique(keys, return_counts=True)]
        first_a = np.cumsum(self.in_a) - self.in_a
        for g in np.flatnonzero(wide).tolist():
            x, nx = np.unique(self.a[first_a[g]:first_a[g] + self.in_a[g]], return_counts=True)
            y, ny = np.unique(self.b[first_b[g]:first_b[g] + self.in_b[g]], return_counts=True)
            base = self.group_doc[g] * size
            parts.append(((base + x[:, None] * many + y).reshape(-1),
                          (nx[:, None] * ny).reshape(-1)))
        if len(parts) > 1:
            every, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            count = np.zeros(len(every), np.int64)
            np.add.at(count, at, np.concatenate([c for _, c in parts]))
        else:
            every, count = parts[0]
        cut = np.searchsorted(every, np.arange(self.docs + 1) * size)
        return cut, every % size, count


_pairs: dict[tuple, Pair] = {}


def _pair(*key) -> Pair:
    """One pair of tokenizers per worker process."""
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _lists(cut: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))


def _digester(*pair_key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*pair_key)
        for batch in batches:
            for x, y in _slices(batch.column(2)):
                part = batch.slice(x, y - x)
                c = Coalesced(pair, pair.encode(part.column(2).to_pylist()))
                cut, pairs, links = c.links()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(c.n_a), pa.array(c.n_b),
                     pa.array(c.per_doc(np.ones(c.groups))), pa.array(c.per_doc(c.in_a * c.in_b)),
                     pa.array(c.digests(), pa.string()), _lists(cut, pairs, pa.int64()),
                     _lists(cut, links, pa.int64())],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links",
                           "groups_sha256", "pairs", "links"])
    return run


def _aligner(*pair_key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*pair_key)
        for batch in batches:
            for x, y in _slices(batch.column(1)):
                part = batch.slice(x, y - x)
                c = Coalesced(pair, pair.encode(part.column(1).to_pylist()))
                cut_a, cut_b = (np.concatenate(([0], np.cumsum(n))) for n in (c.n_a, c.n_b))
                n_groups = c.per_doc(np.ones(c.groups))
                cut_g = np.concatenate(([0], np.cumsum(n_groups)))
                bytes_before = np.concatenate(([0], np.cumsum(np.bincount(
                    c.a_doc, pair.a_len[c.a], c.docs).astype(np.int64))))
                ids = [_lists(cut_a, c.a, pa.int32()), _lists(cut_b, c.b, pa.int32()),
                       _lists(cut_a, c.a_group - cut_g[c.a_doc], pa.int32()),
                       _lists(cut_b, c.b_group - cut_g[c.b_doc], pa.int32()),
                       _lists(cut_g, c.start - bytes_before[c.group_doc], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *ids],
                    names=["doc_id", "a_ids", "b_ids", "a_group", "b_group", "group_start"])
    return run


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): doc_id; a_ids, b_ids (its tokens by A
    and B); a_group, b_group (the group of each token, from 0); group_start (the byte of a space
    and the text at which each group starts).

    Arrays are empty for a null or empty text, and for one whose tokens don't spell a space and
    the text (a tokenizer that normalises it). Repeated rows, null ids and other columns are
    kept apart: each row is aligned by itself, other columns aren't read. A text is encoded
    whole, so one text and its tokens must fit in a worker."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_aligner(a_path, b_path, _pair(a_path, b_path).is_ranked()), (
        f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_group array<int>, "
        "b_group array<int>, group_start array<long>"))


def pair_counts(rows: DataFrame, many: int) -> DataFrame:
    """(pair, count, best): documents that hold each id pair linked, and whether no other pair of
    its A id is held by more; ``pairs`` of ``rows`` are distinct, ``many`` is the size of B."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("count"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {many}")), "crosstok-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    best = stored(counts.join(most, "a").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")), "crosstok-best")
    drop_stored(counts)
    return best


def alignment_report(docs: DataFrame, a_path: str, b_path: str,
                     max_broadcast: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): doc_id, n_a, n_b (tokens), n_groups,
    n_links, n_best (links whose pair is held by the most documents of all pairs of its A id, ties
    included), count_sum (documents that hold the linked pair, summed over the links),
    groups_sha256.

    A text that is null, empty, or not spelled by its tokens has zeros and ''. Every row counts as
    a document of its own, rows with one id or equal text too. Other columns aren't read; an empty
    table gives no row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pair = _pair(a_path, b_path)
    many = pair.b.get_piece_size()
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
                  .mapInArrow(_digester(a_path, b_path, pair.is_ranked()), (
                      f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                      "groups_sha256 string, pairs array<long>, links array<long>")),
                  "crosstok-rows")
    counts = pair_counts(rows, many)
    if counts.count() <= max_broadcast:
        counts = F.broadcast(counts)
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    sums = linked.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
