"""Operator 8: mixing sources to target weights, with DataFrame functions only.

1. Sizes: words per document, summed per source by partial aggregation.
2. Targets: sources in code point order weigh 3, 1, 2, repeating; they share ``share`` times all
   words, and a target stops at ``max_epochs`` times its source. The shares that stay below are
   ``level * weight``; the level follows in closed form from the sources sorted by cap / weight.
3. Quotas: a source is taken whole ``floor(target / size)`` times and the rest is the documents
   that come first in its permutation (a 63-bit hash of id and text). Where the rest ends is found
   by radix: word sums per leading digit (4096 at most per source), then per second digit inside
   the digit that holds the end, then over the few documents left. No window sees more than 4096
   rows of a source until the last step, whose group is 2**-24 of a source.
4. Splitting tree: a source's share is ``BLOCKS`` blocks of its permutation per epoch. The block
   quotas are split between the two halves of the output shards by drawing half of a node's blocks
   without replacement (multivariate hypergeometric counts per source), and again down to single
   shards. A shard then draws its quota of each source's blocks in permuted order, so the
   draws are disjoint, and its rows are ordered by a local hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SHARDS = 16         # a power of two
BLOCKS = 64         # of a source and epoch
WORD = r"[^\x20\x09-\x0D]+"
_DIGIT, _TOP = 12, 51
MAX_BROADCAST_ROWS = 200_000


def size_of(text: Column | str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A document's place in its source's permutation: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), doc_id, text), 1)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a written table of at most MAX_BROADCAST_ROWS short rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS \
        else df


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from one row per source. Windows over all sources."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(
        Window.orderBy(F.asc_nulls_last("source")))).withColumn("w", w).withColumn(
        "cap", F.col("source_size") * float(max_epochs))
    everything = Window.partitionBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * float(share)
              - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    leveled = ranked.withColumn("level", level).withColumn(
        "free", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    # The level of the first source (by ratio) that stays below its cap holds for all after it.
    cut = F.first("free", ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return leveled.withColumn("cut", cut).select(
        "source", "source_size", F.when(F.col("cut").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cut") * F.col("w"), F.col("cap"))).alias("target"))


def _end_digit(rows: DataFrame, digit: Column) -> DataFrame:
    """Per source (``s``: its id) the digit in which ``need`` words end, with the rest."""
    sums = rows.groupBy("s", "need", digit.alias("d")).agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("d").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return (sums.withColumn("before", before)
            .filter((F.col("before") <= F.col("need"))
                    & (F.col("need") < F.col("before") + F.col("words")))
            .select("s", F.col("d").alias("end"), (F.col("need") - F.col("before")).alias("left")))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
         max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: s, source, source_size, target, epochs (whole passes) and cut: the
    documents with a place up to it (-1: none) are taken once more."""
    sized = stored(docs.select("source", size_of().alias("size"), place_of().alias("place")),
                   "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights,
                      share, max_epochs)
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = stored(sources.withColumn("epochs", epochs.cast("int")).withColumn(
        "need", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn(
        "s", F.xxhash64(F.col("source").isNull(), "source")), "mix-sources")
    rest = _small(sources.filter("need > 0").select("source", "s", "need"))
    rows = sized.join(rest, sized["source"].eqNullSafe(rest["source"])).select(
        "s", "need", "size", "place")
    d1 = F.shiftright("place", _TOP)
    e1 = stored(_end_digit(rows, d1), "mix-end1")
    inside = (rows.withColumn("d", d1).drop("need")
              .join(_small(e1), ["s"]).filter("d = `end`")
              .select("s", F.col("left").alias("need"), "size", "place"))
    d2 = F.shiftright("place", _TOP - _DIGIT).bitwiseAND(F.lit((1 << _DIGIT) - 1))
    e2 = stored(_end_digit(inside, d2).join(e1.select("s", F.col("end").alias("end1")), "s"),
                "mix-end2")
    last = (rows.drop("need").withColumn("d", F.shiftright("place", _TOP - _DIGIT))
            .join(_small(e2), ["s"])
            .filter(F.col("d") == F.shiftleft(F.col("end1"), _DIGIT) + F.col("end")))
    # Equal places are equal documents and are taken together.
    each = last.groupBy("s", "left", "place").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("s").orderBy("place"))
    taken = (each.withColumn("half", upto - F.col("size") / 2).filter("half <= left")
             .groupBy("s").agg(F.max("place").alias("taken")))
    lowest = F.shiftleft(F.shiftleft(F.col("end1"), _DIGIT) + F.col("end"), _TOP - _DIGIT) - 1
    cuts = e2.join(taken, "s", "left").select(
        "s", F.coalesce("taken", lowest).alias("cut"))
    return stored(sources.join(cuts, "s", "left").select(
        "s", "source", "source_size", "target", "epochs",
        F.coalesce("cut", F.lit(-1)).alias("cut")), "mix-plan")


def _block_of(place: Column | str) -> Column:
    return F.shiftright(place, 63 - (BLOCKS - 1).bit_length()).cast("int")


def shard_map(sources: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """s, block, shards (array: the shard of the block's 1st, 2nd, ... epoch). The tree halves the
    shards at each level, so ``shards`` is a power of two; others raise."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError(f"shards must be a power of two, not {shards}")
    last = F.when(F.col("cut") >= 0, _block_of(F.col("cut"))).otherwise(-1)
    per = sources.select("s", F.explode(F.sequence(F.lit(1), F.col("epochs") + 1))
                         .alias("epoch"), "epochs", last.alias("last"))
    top = F.when(F.col("epoch") <= F.col("epochs"), F.lit(BLOCKS - 1)).otherwise(F.col("last"))
    blocks = per.withColumn("top", top).filter("top >= 0").select(
        "s", "epoch", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("block"))
    # The tree: a quota unit goes left if it is drawn among the node's first half.
    permuted = blocks.withColumn("unit", F.row_number().over(Window.partitionBy("s").orderBy(
        F.xxhash64(F.lit(seed), "s", "epoch", "block"), "epoch", "block")))
    units = permuted.select("s", "unit").withColumn("node", F.lit(1))
    levels = (shards - 1).bit_length()
    for depth in range(levels):
        draw = F.row_number().over(Window.partitionBy("node").orderBy(
            F.xxhash64(F.lit(seed + 1), F.lit(depth), "s", "unit"), "s", "unit"))
        of = F.count(F.lit(1)).over(Window.partitionBy("node"))
        units = units.withColumn("draw", draw).withColumn("of", of).select(
            "s", "unit", (F.col("node") * 2 + F.when(
                F.col("draw") * 2 <= F.col("of") + F.pmod("node", F.lit(2)), 0).otherwise(1))
            .alias("node"))
    # Leaf quotas per source, filled with its blocks in permuted order.
    leaf = units.withColumn("unit", F.row_number().over(
        Window.partitionBy("s").orderBy("node", "unit"))).select(
        "s", "unit", (F.col("node") - (1 << levels)).alias("shard"))
    drawn = permuted.join(leaf, ["s", "unit"])
    return stored(drawn.groupBy("s", "block").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"])
        .alias("map")), "mix-shards")


def allocate(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
             max_epochs: int = MAX_EPOCHS, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` with its columns in a struct ``doc`` and size (words), source_size,
    target (of its source), place, shards (array: the output shard of each copy taken).

    Null texts have 0 words; documents without words are taken as often as their place says and
    add nothing. A null source is one source, the last. Rows that are equal are taken equally
    often. An empty table gives an empty result."""
    for column in ("doc_id", "text", "source"):
        docs[column]                      # fails early if a column is missing
    sources = plan(docs, weights, share, max_epochs)
    where = shard_map(sources, shards, seed)
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")).withColumns({
        "size": size_of("doc.text"), "place": place_of("doc.doc_id", "doc.text")})
    src = _small(sources)
    row = row.join(src, F.col("doc.source").eqNullSafe(src["source"]), "left").withColumns({
        "copies": F.col("epochs") + F.when(F.col("place") <= F.col("cut"), 1).otherwise(0),
        "block": _block_of(F.col("place"))})
    small = _small(where)
    return row.join(small, ["s", "block"], "left").select(
        "doc", "size", "source_size", "target", "place", F.when(
            F.col("copies") > 0, F.slice("map", 1, F.col("copies")))
        .otherwise(F.array().cast("array<int>")).alias("shards"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` in a struct ``doc``, one row per copy taken,
    with shard and order_key (the local shuffle: sort a shard by it)."""
    got = allocate(docs, **options)
    return got.select("doc", "place", F.posexplode("shards").alias("copy", "shard")).select(
        "doc", "shard", F.xxhash64(F.lit("order"), "place", "copy").alias("order_key"))


def write_shards(mixed: DataFrame, path: str, shards: int = SHARDS, slices: int = 8) -> None:
    """Write ``mix``'s rows as one folder per shard. A shard is dealt over ``slices`` tasks by
    the leading values of its order key, each sorted by it, so no task holds a whole shard."""
    part = F.pmod(F.shiftright("order_key", 40), F.lit(slices))
    (mixed.repartition(shards * slices, "shard", part)
     .sortWithinPartitions("shard", "order_key").select("doc.*", "shard")
     .write.partitionBy("shard").parquet(path))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), n_copies, shards."""
    return allocate(docs, **options).select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.size("shards")).alias("taken"), F.size("shards").alias("n_copies"),
        "shards")

