"""Operator 9: token ids in a bit-packed binary format.

Format: a Parquet table of blocks (so that Spark's committer makes the files whole on any store),
ordered by document id over numbered parts. A block holds whole documents, about ``block_ids``
ids, each packed in the smallest number of bits that holds the vocabulary, least significant bit
first. Columns:

    part int            files in ascending document order
    block_start long    ids of the part before this block
    first_doc, last_doc document ids bounding the block (Parquet statistics prune by them)
    doc_ids, doc_starts the block's documents and the places of their first ids in the block
    n_ids long, bits int, payload binary

Any document is reached through the block statistics and its start: bit ``doc_starts[i] * bits``
of the payload. Unpacking is vectorised.

Plan: one range shuffle of the texts by id (sampled bounds, no single task), then tokenising,
packing and writing in one narrow pass. Offsets between parts are sums of one row per part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import BATCH_BYTES, bounded

BLOCK_IDS = 1 << 16
MAX_WORDS = 400_000         # entries of a worker's word cache, about 90 MB
_MARK = "\x01"
MAX_LETTERS = 256           # bytes; longer runs of letters are left to the whole tokenizer
BATCH_TEXTS = 256           # texts whose distinct words are found together
# Latin letters (composed ones; a combining mark could join its neighbour, and the lower case of
# U+0130 ends in one) and ASCII punctuation.
_LETTERS = "".join(chr(c) for a, b in (
    (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x2AF))
    for c in range(a, b + 1))
_TAIL = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


# ------------------------------------------------------------------ packing


def bits_for(vocabulary: int) -> int:
    """The smallest width that holds the ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a little-endian bit stream of ``bits`` bits each, padded to a whole byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start``; reads only the bytes that hold them."""
    if count <= 0:
        return np.zeros(0, "<u4")
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(payload, f"<u{width}", count, start * width).astype("<u4")
    lo, hi = start * bits, (start + count) * bits
    raw = np.frombuffer(payload, np.uint8, (hi + 7) // 8 - lo // 8, lo // 8)
    flat = np.unpackbits(raw, bitorder="little")[lo % 8: lo % 8 + count * bits]
    planes = np.zeros((count, 32), np.uint8)
    planes[:, :bits] = flat.reshape(count, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").reshape(-1)


# ------------------------------------------------------------------ encoding


def _taken(flat: np.ndarray, lens: np.ndarray, starts: np.ndarray, which: np.ndarray
           ) -> np.ndarray:
    """``lens`` entries of ``flat`` from ``starts`` on for each of ``which``, in order."""
    n = lens[which]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.uint32)
    return flat[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1])]


class _Words(dict):
    """word -> number; collects the words that it meets for the first time."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """The tokenizers library with each distinct word encoded once per worker.

    Only for a tokenizer that drops white space, as checked when it is loaded: the ids of a text
    are then those of its space-separated pieces, one after the other. Any other tokenizer
    encodes whole texts. The distinct pieces of a batch are found by Arrow. If the tokenizer also
    parts letters from the punctuation after them, ignores the case of A-Z and spells Latin
    letters one by one (``_spelling``), a piece is put together from its letters in lower case
    and its tail, which are mostly known; new letters go straight to the tokenizer's model, as
    normalising and splitting them cost far more than their merges."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.vocabulary = max([-1, *self.tok.get_vocab(True).values()]) + 1
        self.max_words = max_words
        one = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        self.by_word = (one("ab cd") == one("ab") + one("cd") and one(" ab\n") == one("ab")
                        and one("á ́b") == one("á") + one("́b"))
        self.spelling = self._spelling(one) if self.by_word else None
        mark = one(_MARK)
        self.mark = mark[0] if len(mark) == 1 and one(f"ab {_MARK} cd") == one("ab") + mark + one(
            "cd") else None
        self._reset()

    def _spelling(self, one) -> dict[int, str] | None:
        """What the tokenizer's model gets for each Latin letter, if a run of letters is spelt
        letter by letter and its tail and the case of A-Z don't matter to it, else None."""
        marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if one("") or any(not t.lstrip(_LETTERS).rstrip(_TAIL) for t in marks) or any(
                one(w + t) != one(w) + one(t)
                for w in ("ab", "né") for t in (",", ".'", "'", ",%%")):
            return None
        norm, pre = self.tok.normalizer, self.tok.pre_tokenizer
        spelling = {}
        for c in _LETTERS:
            got = pre.pre_tokenize_str(norm.normalize_str(c) if norm else c) if pre else []
            if len(got) != 1:
                return None
            spelling[ord(c)] = got[0][0]
        small = _LETTERS[26:52]
        if any(spelling[ord(c.upper())] != spelling[ord(c)] for c in small):
            return None
        probes = [x for c in _LETTERS for x in (c, f"ab{c}é", f"É{c}{c}Ba")]
        probes += [a + b for a in small for b in small]
        probes += [_LETTERS[i:i + 90] for i in range(0, len(_LETTERS), 15)]
        spelt = [[t.id for t in self.tok.model.tokenize(x.translate(spelling))] for x in probes]
        return spelling if spelt == self._encode_all(probes) else None

    def _reset(self) -> None:
        self.words = _Words()
        self.lens = np.zeros(1 << 12, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0
        self.again = np.zeros(1 << 12, bool)

    def _shrink(self) -> None:
        """Forget the words that were not met again since the last time (most are met once), so
        that the common ones aren't encoded anew; three quarters of the bound stay at most."""
        keep = np.flatnonzero(self.again[:len(self.words)])[:self.max_words * 3 // 4]
        names = list(self.words)
        lens, starts, flat = self.lens[keep], self.starts[keep], self.flat
        self._reset()
        for i in keep.tolist():
            self.words[names[i]] = len(self.words)
        n, ends = len(keep), np.cumsum(lens)
        total = int(ends[-1]) if n else 0
        for name, need in (("lens", n), ("starts", n), ("again", n), ("flat", total)):
            if len(getattr(self, name)) < need:
                setattr(self, name, np.zeros(need, getattr(self, name).dtype))
        self.lens[:n], self.starts[:n] = lens, ends - lens
        self.flat[:total] = flat[np.repeat(starts - ends + lens, lens) + np.arange(total)]
        self.used = total

    def _encode_all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _room(self, n: int, total: int) -> None:
        for name, need in (("lens", n), ("starts", n), ("again", n), ("flat", total)):
            a = getattr(self, name)
            if len(a) < need:
                setattr(self, name, np.concatenate((a, np.zeros(max(len(a), need - len(a)),
                                                                a.dtype))))

    def _store(self, numbers: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """Set the ids of the words with these numbers; ``ids`` holds them one after the other."""
        self._room(len(self.words), self.used + len(ids))
        self.lens[numbers] = lens
        self.starts[numbers] = self.used + np.cumsum(lens) - lens
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these words, one after the other."""
        return _taken(self.flat, self.lens, self.starts, numbers)

    def _numbers(self, words: pa.Array, encoded) -> np.ndarray:
        """The numbers of these distinct words; ``encoded`` gives the ids of the new ones."""
        known = len(self.words)
        # Much faster than to_pylist, which makes a scalar of each.
        names = words.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))
        self.again[numbers[numbers < known]] = True
        new, self.words.new = self.words.new, []
        if new:
            self._store(np.arange(known, known + len(new)), *encoded(new))
        return numbers

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each of these distinct words, and the ids of all."""
        if self.spelling is None:
            numbers = self._numbers(words, self._encoded)
            return self.lens[numbers], self._gather(numbers)
        stem, tail = pc.utf8_rtrim(words, _TAIL), pc.utf8_ltrim(words, _LETTERS)
        n, m, both = (pc.binary_length(a).to_numpy().astype(np.int64) for a in (stem, tail, words))
        # Whatever stands between letters and tail is in both, and then they are longer.
        apart = (n > 0) & (n <= MAX_LETTERS) & (n + m == both)
        parts = np.zeros((len(words), 2), np.int64)
        cut, whole = pa.array(apart), pa.array(~apart)
        # Numbers last until the next batch: only ``encode`` forgets words.
        stems = pc.ascii_lower(stem.filter(cut)).dictionary_encode()
        tails = tail.filter(cut).dictionary_encode()
        parts[apart, 0] = self._numbers(stems.dictionary, self._spelt)[stems.indices.to_numpy()]
        parts[apart, 1] = self._numbers(tails.dictionary, self._encoded)[tails.indices.to_numpy()]
        parts[~apart, 0] = self._numbers(words.filter(whole), self._encoded)
        parts[~apart, 1] = self._numbers(pa.array([""], words.type), self._encoded)[0]
        return self.lens[parts].sum(axis=1), self._gather(parts.reshape(-1))

    def _spelt(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``, of words that are Latin letters throughout."""
        lens, ids, model, spelling = [], [], self.tok.model, self.spelling
        for w in new:
            got = model.tokenize(w.translate(spelling))
            lens.append(len(got))
            ids += [t.id for t in got]
        return np.array(lens, np.int64), np.array(ids, np.uint32)

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids of all."""
        ids: list = [None] * len(new)
        plain = [i for i, w in enumerate(new) if self.mark is not None and _MARK not in w]
        for at in range(0, len(plain), 2000):
            some = plain[at:at + 2000]
            got = np.array(self._encode_all([f" {_MARK} ".join([new[i] for i in some])])[0],
                           np.uint32)
            cut = np.flatnonzero(got == self.mark)
            if len(cut) != len(some) - 1:       # a word holds the mark's id: one by one
                for i, x in zip(some, self._encode_all([new[i] for i in some])):
                    ids[i] = np.array(x, np.uint32)
                continue
            a = np.concatenate(([0], cut + 1))
            b = np.concatenate((cut, [len(got)]))
            for i, x, y in zip(some, a.tolist(), b.tolist()):
                ids[i] = got[x:y]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self._encode_all([new[i] for i in rest]) if rest else []):
            ids[i] = np.array(x, np.uint32)
        return (np.array([len(x) for x in ids], np.int64),
                np.concatenate(ids) if ids else np.zeros(0, np.uint32))

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        if not self.by_word:
            for t in texts:
                yield np.array(self._encode_all([t.as_py() or ""])[0], np.uint32)
            return
        at = 0
        while at < len(texts):
            some = texts.slice(at, BATCH_TEXTS)
            some = some.slice(0, max(1, len(some) * BATCH_BYTES // max(1, some.nbytes)))
            at += len(some)
            if len(self.words) > self.max_words:
                self._shrink()
            split = pc.split_pattern(
                pc.replace_substring(pc.fill_null(some, ""), "\n", " "), " ")
            ends = np.cumsum(pc.list_value_length(split).to_numpy()).tolist()
            coded = split.flatten().dictionary_encode()
            lens, ids = self._pieces(coded.dictionary)
            starts, which = np.cumsum(lens) - lens, coded.indices.to_numpy()
            for a, b in zip([0, *ends], ends):
                yield _taken(ids, lens, starts, which[a:b])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ writing and reading


def _packer(tokenizer: str, end_id: int | None, block_ids: int, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits = bits_for(max(enc.vocabulary, (end_id or 0) + 1))
        docs, starts, ids, n, before = [], [], [], 0, 0

        def block():
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([before], pa.int64()),
                pa.array([docs[0]], doc_type), pa.array([docs[-1]], doc_type),
                pa.array([docs], pa.list_(doc_type)), pa.array([starts], pa.list_(pa.int64())),
                pa.array([n], pa.int64()), pa.array([bits], pa.int32()),
                pa.array([pack(np.concatenate(ids), bits)], pa.binary())],
                names=["part", "block_start", "first_doc", "last_doc", "doc_ids", "doc_starts",
                       "n_ids", "bits", "payload"])

        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                docs.append(doc), starts.append(n), ids.extend((x, end))
                n += len(x) + len(end)
                if n >= block_ids:
                    yield block()
                    before += n
                    docs, starts, ids, n = [], [], [], 0
        if docs:
            yield block()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2,
                 block_ids: int = BLOCK_IDS, parts: int | None = None) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) without special tokens, append ``end_id`` to each
    document, and write them at ``path`` in ascending doc_id order.

    A null text is an empty one; a null doc_id sorts first; rows that share an id follow each
    other in order of a hash of their texts. An empty table writes no block. ``tokenizer`` is a
    file of the tokenizers library that every executor can read."""
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    field = docs.schema["doc_id"].dataType
    kind = field.simpleString()
    arrow = to_arrow_type(field)
    ranged = docs.select("doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(
        *order)
    ranged.mapInArrow(bounded(_packer(tokenizer, end_id, block_ids, arrow)), (
        f"part int, block_start long, first_doc {kind}, last_doc {kind}, doc_ids array<{kind}>, "
        "doc_starts array<long>, n_ids long, bits int, payload binary")).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: ids of all blocks before (one row per part is summed)."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per part that write_tokens was told to make: 12 bytes each.
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n"))
                           .alias("offset"))
    return blocks.join(F.broadcast(offsets), "part").withColumn(
        "start", F.col("offset") + F.col("block_start")).drop("offset")


def _unpacker(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4)]
            payloads = batch.column(5)
            for r, (ids, starts, n, bits, start) in enumerate(zip(*cols)):
                every = unpack(payloads[r].as_buffer(), bits, 0, n)
                for d, a, b in zip(ids, starts, [*starts[1:], n]):
                    x = every[a:b]
                    out[0].append(d), out[1].append(start + a), out[2].append(b - a)
                    out[3].append(x if with_ids else zlib.crc32(x.tobytes()))
            kind = batch.column(0).type.value_type
            last = pa.list_(pa.int64()) if with_ids else pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], kind), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], last)],
                names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])
    return run


def _unpacked(blocks: DataFrame, with_ids: bool) -> DataFrame:
    kind = blocks.schema["first_doc"].dataType.simpleString()
    last = "ids array<long>" if with_ids else "ids_crc32 long"
    return blocks.select("doc_ids", "doc_starts", "n_ids", "bits", "start", "payload").mapInArrow(
        _unpacker(with_ids), f"doc_id {kind}, start long, n_tokens long, {last}")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 from the files."""
    return _unpacked(read_blocks(spark, path), False)


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; with ``doc_ids`` only the blocks that can hold them are
    read."""
    blocks = read_blocks(spark, path)
    if doc_ids is None:
        return _unpacked(blocks, True)
    near = F.lit(False)
    for d in doc_ids:
        near = near | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
    return _unpacked(blocks.filter(near), True).filter(F.col("doc_id").isin(doc_ids))
