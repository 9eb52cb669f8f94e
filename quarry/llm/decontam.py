"""Operator 6: benchmark decontamination by a prefix-filtered set join.

Windows are runs of ``window`` consecutive item words (a shorter item is one window). A window's
shingles (runs of 3 words, fewer in shorter windows) are ordered by rarity: their document
frequency over the whole corpus, counted in a first pass. Containment must be full, so the
necessary prefix of a window is its single rarest shingle; any occurrence of the window contains
it at a known offset.

The second pass probes the documents' shingles against the prefix shingles only, applies the
positional bound (the shingle's place less its offset must leave room for the whole window, which
is the length bound too) and verifies the words of the window one by one.

The windows are a bounded broadcast: they are cut into blocks of ``block_words`` words by hash,
and a larger benchmark means more blocks over the same documents, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ALNUM, bounded, shingles, stored, utf8, words

WINDOW = 10
SHINGLE = 3
MAX_BROADCAST_IDS = 1_000_000   # documents to remove, 16 bytes each
BLOCK_WORDS = 2_000_000     # 16 MB of word hashes in a broadcast block


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, hashes, texts = [], [], []
            for item, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                h, s, e = words(raw, ALNUM)
                if not len(h):
                    continue
                low = raw.translate(_FOLD)
                w = min(window, len(h))
                for i in range(len(h) - w + 1):
                    items.append(item)
                    hashes.append(h[i:i + w].tobytes())
                    texts.append(b" ".join(low[s[j]:e[j]] for j in range(i, i + w)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(texts, pa.binary()),
                 pa.array(hashes, pa.binary())], names=["item", "win", "hashes"])
    return run


_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Block:
    """Distinct windows of one block: keys, texts, word hashes and the set of their shingles."""

    def __init__(self, keys: list[bytes], texts: list[bytes], hashes: list[bytes]):
        self.keys, self.texts = keys, texts
        self.hashes = [np.frombuffer(h, np.uint64) for h in hashes]
        self.by_size: dict[int, np.ndarray] = {}
        for k in range(1, SHINGLE + 1):
            x = [shingles(h, k) for h in self.hashes if min(SHINGLE, len(h)) == k]
            if x:
                self.by_size[k] = np.unique(np.concatenate(x))
        self.index: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}

    def rank(self, df: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle (ties: the larger hash, then the first place)."""
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for w, h in enumerate(self.hashes):
            k = min(SHINGLE, len(h))
            x = shingles(h, k)
            o = min(range(len(x)), key=lambda i: (df.get((k, int(x[i])), 0), -int(x[i]), i))
            found.setdefault(k, {}).setdefault(int(x[o]), []).append((w, o))
        for k, by in found.items():
            keys = np.array(sorted(by), np.uint64)
            self.index[k] = (keys, [by[int(x)] for x in keys])

    def hits(self, raw: bytes | None) -> tuple[int, np.ndarray, list[int]]:
        """(number of words, mask of the words hit, windows found)."""
        h, s, e = words(raw, ALNUM)
        mask, seen = np.zeros(len(h) + 1, np.int32), set()
        low = None
        for k, (keys, places) in self.index.items():
            if len(h) < k:
                continue
            x = shingles(h, k)
            at = np.searchsorted(keys, x)
            at[at == len(keys)] = 0
            for p in np.flatnonzero(keys[at] == x):
                for w, o in places[at[p]]:
                    want = self.hashes[w]
                    i = int(p) - o
                    if i < 0 or i + len(want) > len(h) or (h[i:i + len(want)] != want).any():
                        continue
                    low = raw.translate(_FOLD) if low is None else low
                    if b" ".join(low[s[j]:e[j]] for j in range(i, i + len(want))) \
                            != self.texts[w]:
                        continue
                    mask[i] += 1
                    mask[i + len(want)] -= 1
                    seen.add(w)
        return len(h), np.cumsum(mask[:-1]) > 0, sorted(seen)


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        sums = {k: np.zeros(len(x), np.int64) for k, x in block.by_size.items()}
        for batch in batches:
            for raw in utf8(batch.column(0)):
                h = words(raw, ALNUM)[0]
                for k, keys in block.by_size.items():
                    if len(h) < k:
                        continue
                    x = shingles(h, k)
                    at = np.searchsorted(keys, x)
                    at[at == len(keys)] = 0
                    sums[k][np.unique(at[keys[at] == x])] += 1
        for k, v in sums.items():
            i = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), k), pa.int32()),
                 pa.array(block.by_size[k][i].view(np.int64), pa.int64()),
                 pa.array(v[i], pa.int64())], names=["k", "x", "n"])
    return run


def _prober(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            n, spans, found = [], [], []
            for raw in utf8(batch.column(3)):
                total, mask, seen = block.hits(raw)
                n.append(total)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                spans.append([{"start": a, "end": b}
                              for a, b in edge.reshape(-1, 2).tolist()])
                found.append([block.keys[w] for w in seen])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()),
                                                     ("end", pa.int64())]))),
                 pa.array(found, pa.list_(pa.binary()))],
                names=["doc_id", "t", "row", "n_words", "spans", "windows"])
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``) against ``benchmark`` (``item_id``,
    ``text``): doc_id, t (xxhash64 of the text), n_words, n_hit (words inside any occurrence of a window), spans (array of
    struct<start, end>: the hit words, 0-based, end exclusive), items (sorted array of the ids of
    items with an occurring window, as text), n_items (their number, an item without an id included).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null or empty
    texts have no words and no hits; items without words give no window. Items that repeat an id are
    one item; those without an id are one item too, which is hit and counted like any other and
    only has no place in ``items``. An empty benchmark hits nothing. Equal rows get equal results. Other columns aren't read."""
    spark = docs.sparkSession
    wins = stored(benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
                  .mapInArrow(bounded(_window_rows(window)), "item string, win binary, hashes binary")
                  .distinct().withColumn("key", F.unhex(F.md5("win"))), "decontam-windows")
    total = wins.select("win", "hashes").distinct().agg(
        F.sum(F.length("hashes") / 8)).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_words))
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    if n_blocks > 1:        # rows of several blocks meet again by a row number
        src = stored(src.withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
    else:
        src = src.withColumn("row", F.lit(0).cast("long"))
    outs = []
    for b in range(n_blocks):
        part = wins.select("key", "win", "hashes").distinct().filter(
            F.pmod(F.xxhash64("win"), F.lit(n_blocks)) == b)
        rows = sorted(part.collect(), key=lambda r: bytes(r["win"]))     # block_words at most
        block = Block(*([bytes(r[c]) for r in rows] for c in ("key", "win", "hashes")))
        counting = spark.sparkContext.broadcast(block)
        freq = (src.select("text").mapInArrow(bounded(_frequencies(counting)), "k int, x long, n long")
                .groupBy("k", "x").agg(F.sum("n").alias("n")).collect())  # block's shingles
        block.rank({(r["k"], r["x"] & (2**64 - 1)): r["n"] for r in freq})
        shared = spark.sparkContext.broadcast(block)
        outs.append(src.select("doc_id", "t", "row", "text").mapInArrow(
            bounded(_prober(shared)), f"doc_id {kind}, t long, row long, n_words long, "
            "spans array<struct<start:bigint,end:bigint>>, windows array<binary>"))
    if n_blocks == 1:
        hits = stored(outs[0].select("doc_id", "t", F.monotonically_increasing_id().alias("row"),
                                     "n_words", "spans", "windows"), "decontam-hits")
    else:
        every = outs[0]
        for o in outs[1:]:
            every = every.unionByName(o)
        # At most n_blocks rows of a document.
        hits = stored(every.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("t").alias("t"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("windows")).alias("windows")), "decontam-hits")
    found = (hits.filter(F.size("windows") > 0).select("row", F.explode("windows").alias("key"))
             .join(wins.select("key", "item"), "key").select("row", "item").distinct()
             .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"),
                                 F.count(F.lit(1)).alias("n_items")))
    # Spans of several blocks may overlap: sweep them in order.
    merged = F.aggregate(
        F.array_sort("spans"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x)))) if n_blocks > 1 else F.col("spans")
    spans = hits.select("row", "doc_id", "t", "n_words", merged.alias("spans"))
    return (spans.join(found, "row", "left").select(
        "doc_id", "t", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
        .alias("n_hit"), "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items")))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns, without the rows that hold a window of an item."""
    gone = stored(find_contamination(docs, benchmark, window).filter("n_hit > 0").select(
        F.col("doc_id").alias("__gone_id"), F.col("t").alias("__gone_t")).distinct(),
        "decontam-gone")
    if gone.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)    # else the documents are shuffled once
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone_id"])
                     & (F.xxhash64(docs["text"]) == gone["__gone_t"]), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digest columns of ``find_contamination``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated."""
    return find_contamination(docs, benchmark, window).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))

