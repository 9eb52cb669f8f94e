"""Operator 1: near-duplicate documents by min-max hashing.

A document's set is its distinct ``shingle_words``-word shingles (64-bit hashes of whole texts,
A-Z lower-cased). Every permutation is evaluated once and yields two signature values, the
smallest and the largest hash of the set; each agrees between two sets with probability equal to
their similarity, so half the hash evaluations give an unbiased signature of lower variance.
Bands are runs of minima and runs of maxima of different permutations. With the default 16 + 16
bands of 5 values a pair at similarity 0.8 shares no band with probability 3e-6.

Plan (every intermediate is a written table):

1. one narrow pass: set digest (128 bits), size, band keys, one-byte signature;
2. equal sets become one node by digest (partial aggregation), so copies cost one row each;
3. a bucket is the nodes of one band key. Its hub is its member that meets most others over all
   buckets; every member is compared with the hub only: rows = nodes x bands at most;
4. the links found are joined into components. Members of one bucket that are then still in
   different components are compared block by block, each pair in the first band that it shares:
   first on signatures (hopeless if 0.2 below the threshold), then on consistent samples of the
   sets, which are the whole sets up to ``SAMPLE`` shingles and decide there. What remains goes to
   the exact check as well, so no link between components is lost to the star, and a large group
   of texts that are nearly but not quite near copies yields links, not pairs;
5. pairs are confirmed on full shingle sets: the hub's set streams ahead of its partners' sets
   through sorted partitions, one hub in memory at a time, a hot hub dealt over many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import (SPACED, bounded, connected_components, drop_stored, mix, shingles,
                               stored, utf8, words)

BANDS = 32          # half of them of minima, half of maxima
ROWS = 5
SLACK = 0.2         # of the estimate from 160 values: over 6 standard deviations at 0.8
SAMPLE = 512        # shingles of a set that are compared whole; of larger sets every 2nd, 4th, ...
SAMPLE_SLACK = 0.12     # of the estimate from 256 to 512 sampled shingles: over 5 of them
BLOCK = 1024        # nodes of a bucket compared in one group
MAX_BROADCAST_IDS = 2_000_000   # 16 bytes each
PARTNERS = 512      # partners of a hub checked in one group

_SIGN = "doc_id {id}, t long, n_shingles long, node binary, keys array<long>, sig binary"


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(1, 2**63, n, dtype=np.uint64)[:, None]


def min_max(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation ``a * x + b`` (mod 2**64)."""
    lo = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    hi = np.zeros(len(a), np.uint64)
    for i in range(0, len(x), 1024):
        h = x[None, i:i + 1024] * a + b
        np.minimum(lo, h.min(axis=1), out=lo)
        np.maximum(hi, h.max(axis=1), out=hi)
    return lo, hi


def digest(x: np.ndarray) -> bytes:
    """128 bits of a set of hashes, whatever its order."""
    d = np.array([mix(x).sum(), mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()])
    return (d + np.uint64(len(x))).tobytes()


def _signer(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = bands // 2 * rows
        a, b = _multipliers(perms)
        coef = _multipliers(rows)[0][:, 0]
        band_no = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            n_out, nodes, keys, sigs = [], [], [], []
            for raw in utf8(batch.column(2)):
                x = np.unique(shingles(words(raw, SPACED)[0], k))
                n_out.append(len(x))
                if not len(x):
                    nodes.append(None), keys.append(None), sigs.append(None)
                    continue
                nodes.append(digest(x))
                v = np.concatenate(min_max(x, a, b))
                keys.append(mix((mix(v).reshape(bands, rows) * coef).sum(axis=1) + band_no)
                            .view(np.int64))
                sigs.append((mix(v) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_out, pa.int64()),
                 pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(sigs, pa.binary())],
                names=["doc_id", "t", "n_shingles", "node", "keys", "sig"])
    return run


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(words(r, SPACED)[0], k)) for r in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(x) for x in sets], pa.binary()),
                 pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "set"])
    return run


def _checker(threshold: int):
    """Rows sorted by (hub, block, role): the hub's set, then its partners'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            hubs, blks, roles, nodes, sets = (batch.column(i) for i in range(5))
            us, vs = [], []
            for i in range(batch.num_rows):
                x = np.frombuffer(sets[i].as_buffer(), np.uint64)
                key = (hubs[i].as_py(), blks[i].as_py())
                if roles[i].as_py() == 0:
                    at, hub = key, x.copy()
                    continue
                if key != at or not len(hub):
                    continue
                pos = np.minimum(np.searchsorted(hub, x), len(hub) - 1)
                both = int((hub[pos] == x).sum())
                if 100 * both >= threshold * (len(hub) + len(x) - both):
                    us.append(key[0]), vs.append(nodes[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])
    return run


def _level(n: int) -> int:
    """Of a set of ``n`` shingles one in 2**level is sampled."""
    return max(0, (max(n, 1) - 1).bit_length() - (SAMPLE - 1).bit_length())


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = np.frombuffer(v.as_buffer(), np.uint64)
            x = x[x & np.uint64((1 << _level(len(x))) - 1) == 0]
            out.append(x.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())],
                                         names=["node", "sample"])


def _hopeful(x: np.ndarray, y: np.ndarray, n: int, m: int, threshold: int) -> bool:
    """Whether sets of ``n`` and ``m`` shingles may be similar enough, by their samples."""
    level = max(_level(n), _level(m))
    if level:
        keep = np.uint32((1 << level) - 1)
        x, y = x[x & keep == 0], y[y & keep == 0]
    if not len(x) or not len(y):
        return level > 0
    pos = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[pos] == y).sum())
    union = len(x) + len(y) - both
    return 100 * both >= (threshold - (100 * SAMPLE_SLACK if level else 0)) * union


def _estimator(threshold: int, slack: float):
    """Rows sorted by (key, bi, bj): pairs of different components that may be links."""
    least = threshold / 100 - slack

    def pairs(rows):
        nodes, comps, blk, n, sig, band, keys, samples = zip(*rows)
        blk, n = np.array(blk), np.array(n, np.int64)
        number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([number[c] for c in comps])
        s = np.frombuffer(b"".join(sig), np.uint8).reshape(len(rows), -1)
        k = np.array(keys, np.int32)[:, :band[0] + 1]
        x = [np.sort(np.frombuffer(v, np.uint32)) for v in samples]
        for i in range(len(rows)):
            j = np.arange(i + 1, len(rows))
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i])
                                          >= threshold * np.maximum(n[j], n[i]))]
            if blk.min() != blk.max():
                j = j[blk[j] != blk[i]]
            j = j[(s[j] == s[i]).mean(axis=1) >= least]
            j = j[~(k[j, :-1] == k[i, :-1]).any(axis=1)]
            for t in j:
                if _hopeful(x[i], x[t], int(n[i]), int(n[t]), threshold):
                    yield (nodes[i], nodes[t]) if nodes[i] < nodes[t] else (nodes[t], nodes[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            found = sorted(set(pairs(rows))) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in found], pa.binary()),
                 pa.array([p[1] for p in found], pa.binary())], names=["u", "v"])
        now, rows = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(11)]
            for key, bi, bj, *row in zip(*cols):
                if (key, bi, bj) != now:
                    if len(rows) > 1:
                        yield emit(rows)
                    now, rows = (key, bi, bj), []
                rows.append(row)
        yield emit(rows)
    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) among candidate ``pairs`` (u, v), on full sets."""
    blocked = pairs.withColumn("blk", F.pmod(
        F.xxhash64("v"), F.greatest(F.lit(1), F.ceil(F.col("n_u") / PARTNERS)).cast("long")))
    hubs = (blocked.select(F.col("u").alias("hub"), "blk").distinct()
            .join(sets, F.col("hub") == sets["node"])
            .select("hub", "blk", F.lit(0).alias("role"), "node", "set"))
    partners = (blocked.join(sets, blocked["v"] == sets["node"])
                .select(F.col("u").alias("hub"), "blk", F.lit(1).alias("role"), "node", "set"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hubs.unionByName(partners).repartition(n, "hub", "blk").sortWithinPartitions(
        "hub", "blk", "role")
    return rows.mapInArrow(bounded(_checker(threshold)), "u binary, v binary")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): doc_id, n_shingles (set size),
    component_id (smallest doc_id reachable over links of similarity ``threshold`` percent or
    more, itself included), kept (doc_id = component_id), t (xxhash64 of the text) and cluster
    (digest naming the component; null for the empty set).

    A null, empty or blank text has the empty set, links with nothing and is its own component.
    A null doc_id keeps its row: component_id is the smallest non-null id of its component (null
    if there is none) and kept is null. Repeated rows get equal results. Other columns of
    ``docs`` are not read, whatever their names."""
    src = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    signed = stored(src.mapInArrow(
        bounded(_signer(shingle_words, bands, rows)),
        _SIGN.format(id=src.schema["doc_id"].dataType.simpleString())), "minhash-sign")
    # One row per distinct set.
    sets_of = signed.filter(F.col("node").isNotNull())
    nodes = stored(sets_of.groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("keys").alias("keys"),
        F.first("sig").alias("sig")), "minhash-nodes")

    # Buckets of two and more nodes.
    rows_of = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    sizes = rows_of.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = stored(rows_of.join(sizes, "key"), "minhash-buckets")
    degree = members.groupBy("node").agg(F.sum("m").alias("deg"))
    hubs = (members.join(degree, "node").groupBy("key")
            .agg(F.max(F.struct("deg", "node", "n")).alias("h"))
            .select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")))
    star = (members.join(hubs, "key").filter(
        (F.col("hub") != F.col("node"))
        & (100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")))
        .select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct())
    star = stored(star, "minhash-star")

    def with_load(pairs):
        return pairs.join(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n_u")), "u")

    # Full sets of the nodes that share a bucket with another one, from their texts.
    shared = members.select("node").distinct()
    one = stored(sets_of.join(shared, "node", "left_semi").groupBy("node")
                 .agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(),
                 "minhash-ids")
    one_table = one
    if one.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        one = F.broadcast(one)      # else the texts are shuffled once
    texts = (src.join(one, "doc_id", "left_semi").select("text")
             .unionByName(src.filter(F.col("doc_id").isNull()).select("text")))
    sets = stored(texts.mapInArrow(bounded(_setter(shingle_words)), "node binary, set binary")
                  .groupBy("node").agg(F.first("set").alias("set")), "minhash-sets")
    links = stored(_confirmed(with_load(star), sets, threshold), "minhash-links")
    comps = stored(connected_components(links, "u", "v"), "minhash-comps")

    # Bucket members that the stars left in different components.
    placed = members.join(comps, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")
                                      ).filter("c0 <> c1").select("key")
    nblk = F.ceil(F.col("m") / BLOCK).cast("int")
    blk = F.pmod(F.xxhash64("node", "key"), nblk).cast("int")
    rest = placed.filter("m > 2").join(mixed, "key", "left_semi")
    samples = sets.join(rest.select("node").distinct(), "node", "left_semi").mapInArrow(
        bounded(_sampler), "node binary, sample binary")
    short = F.transform("keys", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    known = stored(nodes.select("node", "sig", short.alias("keys")).join(samples, "node"),
                   "minhash-samples")
    rest = (rest.withColumn("nb", nblk).withColumn("blk", blk)
            .join(known, "node")
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("key", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"),
                    "node", "comp", "blk", "n", "sig", "band", "keys", "sample"))
    n_part = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = (rest.repartition(n_part, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
            .mapInArrow(bounded(_estimator(threshold, SLACK)), "u binary, v binary").distinct())
    more = stored(more.join(star, ["u", "v"], "left_anti"), "minhash-more")
    if more.limit(1).count():
        links2 = _confirmed(with_load(more), sets, threshold)
        # Links of the stars count through their components.
        old = comps.select(F.col("node").alias("u"), F.col("comp").alias("v"))
        new_comps = stored(connected_components(old.unionByName(links2), "u", "v"),
                           "minhash-comps")
        drop_stored(comps)
        comps = new_comps
    drop_stored(members, star, sets, links, more, nodes, known, one_table)

    # Components by the smallest document id.
    ids = signed.select("doc_id", "t", "n_shingles", "node").join(
        comps.withColumnRenamed("comp", "root"), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    first = ids.filter(F.col("root").isNotNull()).groupBy("root").agg(
        F.min("doc_id").alias("low"))
    return ids.join(first, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id"))
        .otherwise(F.col("low")).alias("component_id"), "t", F.col("root").alias("cluster")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns and one row per component of ``near_duplicates``: the
    smallest doc_id (null ids only where there is no other), then the smallest text hash, then the
    smallest hash of the row's columns. Rows with an empty set all stay."""
    found = near_duplicates(docs, **options).select("doc_id", "t", "cluster")
    grouped = stored(found.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("w")
    ).select("w.doc_id", "w.t"), "minhash-kept")
    alone = found.filter(F.col("cluster").isNull()).select("doc_id", "t")
    keep = grouped.unionByName(alone).distinct().withColumnsRenamed(
        {"doc_id": "__keep_id", "t": "__keep_t"})
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["__keep_id"])
                     & (F.xxhash64(docs["text"]) == keep["__keep_t"]), "left_semi")
    repeated = found.filter(F.col("cluster").isNotNull()).groupBy("doc_id", "t").count().filter(
        "count > 1").limit(1).count()
    if repeated:        # rows of one id and text: the one whose columns have the least hash stays
        has_set = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
        row = F.struct(*[kept[f"`{c}`"] for c in kept.columns]).alias("row")
        one = kept.filter(has_set).select("doc_id", F.xxhash64("text").alias("t"), row).groupBy(
            "doc_id", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = one.select("row.*").unionByName(kept.filter(~has_set))
    return kept
