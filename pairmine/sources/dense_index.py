"""W8 dense_index: a gap-free 0-based position under a total order, without a
single-partition window.

Plan: range-partition on the order keys and sort within partitions (one shuffle);
``monotonically_increasing_id`` then numbers the rows of each partition densely in
that order (its high bits are the partition id). Per-partition row counts are a
tiny aggregate (one row per partition, bounded by the partition count, not by the
data); their prefix sums are broadcast as a two-column table. The sorted table is
checkpointed to the shared checkpoint folder first, so the counting pass and the
numbering pass see the same rows even if executors are lost in between.

``rank_within``: the dense position inside each group of ``group_cols`` (exact
per-group quotas, e.g. stratified splits) = global position - the group's first
position; no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmine.session import stage_root


def dense_index(df: DataFrame, order_cols: list, out_col: str = "idx",
                num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ordered = (ordered.withColumn("_pid", F.spark_partition_id())
                      .withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        stage_root(spark)
        ordered = ordered.checkpoint(eager=True)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    # One row per partition: its number bounds the broadcast and the window.
    return (ordered.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, (F.col("_off") + local).cast("long")).drop("_pid", "_mid", "_off"))


def rank_within(indexed: DataFrame, group_cols: list, idx_col: str = "idx",
                out_col: str = "rank_in_group") -> DataFrame:
    """Dense 0-based rank inside each group, from a dense index whose order starts
    with ``group_cols``; adds the group size as ``group_size``."""
    starts = indexed.groupBy(*group_cols).agg(F.min(idx_col).alias("_start"),
                                             F.count(F.lit(1)).alias("group_size"))
    return (indexed.join(starts, group_cols)
                   .withColumn(out_col, F.col(idx_col) - F.col("_start")).drop("_start"))
