"""Run metrics: A5 run_summary, A6 margin_stats, A7 rank_distribution,
A8 weighted_rank_score (F7 rank_weight, F13 pct).

Rates divide by all sources (R13); rank percentages by successful sources.
Grouped by ``group_keys`` (``experiment_id`` in a sweep); one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmine.functions.scalar import pct, rank_weight

METRIC_COLS = ["total", "successful", "failed", "success_rate", "weighted_score",
               "total_weighted_score", "rank_1_count", "rank_2_count", "rank_3_count",
               "rank_1_percentage", "rank_2_percentage", "rank_3_percentage",
               "avg_selected_margin", "std_selected_margin"]


def pair_aggregates(final_pairs: DataFrame, group_keys=(), where: Column | None = None,
                    extra=()) -> DataFrame:
    """Sums over the chosen pairs: successes, weights, rank counts, margins.

    ``where`` restricts every aggregate to the chosen rows of a larger table (so the
    table is scanned once, together with any ``extra`` aggregates)."""
    r = F.col("pre_rank")
    ok = where if where is not None else F.lit(True)
    return final_pairs.groupBy(*group_keys).agg(
        F.count(F.when(ok, 1)).alias("successful"),
        F.sum(F.when(ok, rank_weight(r))).alias("total_weighted_score"),
        F.count(F.when(ok & (r == 1), 1)).alias("rank_1_count"),
        F.count(F.when(ok & (r == 2), 1)).alias("rank_2_count"),
        F.count(F.when(ok & (r == 3), 1)).alias("rank_3_count"),
        F.avg(F.when(ok, F.col("margin"))).alias("_avg_margin"),
        F.stddev_pop(F.when(ok, F.col("margin"))).alias("_std_margin"),
        *extra,
    )


def finish_metrics(agg: DataFrame, total: Column) -> DataFrame:
    """Close the formulas given the source count ``total`` (a column)."""
    succ = F.coalesce(F.col("successful"), F.lit(0)).cast("long")
    tw = F.coalesce(F.col("total_weighted_score"), F.lit(0.0))
    out = (agg.withColumn("total", total.cast("long"))
              .withColumn("successful", succ)
              .withColumn("failed", F.col("total") - F.col("successful"))
              .withColumn("success_rate", pct(F.col("successful"), F.col("total")))
              .withColumn("total_weighted_score", tw)
              .withColumn("weighted_score",
                          F.when(F.col("total") > 0, tw / F.col("total")).otherwise(F.lit(0.0))))
    for i in (1, 2, 3):
        c = F.coalesce(F.col(f"rank_{i}_count"), F.lit(0)).cast("long")
        out = (out.withColumn(f"rank_{i}_count", c)
                  .withColumn(f"rank_{i}_percentage", pct(F.col(f"rank_{i}_count"), F.col("successful"))))
    return (out.withColumn("avg_selected_margin", F.coalesce(F.col("_avg_margin"), F.lit(0.0)))
               .withColumn("std_selected_margin",
                           F.when(F.col("successful") > 1, F.col("_std_margin")).otherwise(F.lit(0.0)))
               .drop("_avg_margin", "_std_margin"))


def run_summary(final_pairs: DataFrame, n_sources: int) -> DataFrame:
    """A5-A8 for one run: one row."""
    agg = pair_aggregates(final_pairs)
    return finish_metrics(agg, F.lit(n_sources)).select(*METRIC_COLS)


def rank_distribution(final_pairs: DataFrame, group_keys=()) -> DataFrame:
    """Count and percentage of successful pairs per pre-rank."""
    from pyspark.sql import Window
    counts = final_pairs.groupBy(*group_keys, "pre_rank").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group_keys) if group_keys else Window.partitionBy(F.lit(1))
    return (counts.withColumn("_succ", F.sum("n").over(w))
                  .withColumn("percentage", pct(F.col("n"), F.col("_succ")))
                  .withColumn("weight", rank_weight(F.col("pre_rank")))
                  .drop("_succ"))
