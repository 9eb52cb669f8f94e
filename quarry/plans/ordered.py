"""Order-dependent operators without a single-task window.

``lag``/``lead`` over an ORDER BY with no (or a skewed) PARTITION BY puts every row of a key
in one task. Here rows get a global sequence number instead:

1. ``repartitionByRange`` on the ordering (Spark samples the bounds, so a hot key spreads over
   consecutive partitions) and ``sortWithinPartitions``;
2. ``monotonically_increasing_id`` = (partition << 33) + position, made stable by a reliable
   checkpoint in the shared checkpoint folder;
3. per-partition counts (one row per partition) turned into offsets by a window over that
   tiny table, broadcast back.

Neighbours are then equi-joins on ``_seq + k``: unique keys, so no skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

SEQ = "_seq"
_LOW_BITS = (1 << 33) - 1


def with_sequence(df: DataFrame, order: list[Column | str], num_partitions: int | None = None
                  ) -> DataFrame:
    """Add ``_seq``: 0-based position of each row in the total order ``order``.

    ``order`` must be a total order (add a unique tie-breaker) for a deterministic result.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    pid = F.shiftright(F.col("_mid"), 33)
    counts = ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # One row per partition: a bounded broadcast.
    out = ranged.join(F.broadcast(offsets), pid == F.col("_pid"))
    return out.select(*[F.col(c) for c in df.columns],
                      (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))).alias(SEQ))


def neighbours(seq_df: DataFrame, offsets: list[int], cols: list[str],
               same: list[str] | None = None, prefix: str = "nb") -> DataFrame:
    """For each offset k, the row at ``_seq + k`` (its ``cols`` as ``{prefix}_{col}``), kept
    only when it agrees on the ``same`` key columns. One row per (row, k) pair found:
    ``k`` > 0 is lead, ``k`` < 0 is lag."""
    same = same or []
    left = seq_df.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in offsets])))
    right = seq_df.select(F.col(SEQ).alias("_rseq"), *[F.col(c).alias(f"_r_{c}") for c in
                                                       sorted(set(cols) | set(same))])
    cond = [left[SEQ] + left["_k"] == right["_rseq"]] + [
        left[c] == right[f"_r_{c}"] for c in same]
    joined = left.join(right, cond, "inner")
    return joined.select(*[F.col(c) for c in seq_df.columns], F.col("_k").alias(f"{prefix}_k"),
                         *[F.col(f"_r_{c}").alias(f"{prefix}_{c}") for c in cols])


def lag_column(seq_df: DataFrame, col: str, out: str, same: list[str] | None = None
               ) -> DataFrame:
    """``lag(col, 1)`` as a left join on the previous sequence number."""
    same = same or []
    prev = seq_df.select((F.col(SEQ) + 1).alias("_pseq"), F.col(col).alias(out),
                         *[F.col(c).alias(f"_p_{c}") for c in same])
    cond = [seq_df[SEQ] == prev["_pseq"]] + [seq_df[c] == prev[f"_p_{c}"] for c in same]
    return seq_df.join(prev, cond, "left").select(*seq_df.columns, out)
