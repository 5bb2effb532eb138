"""Choosing one pair per source: P9 quality_gate, W4 best_per_source, W5/J9
selected_margin, J8 missing_sources, A10 failure_reasons, U2/U3 covered and
uncovered sources, J6 attach_text, A3 group_by_source, T3 restore_order.

All per-source work is windows over ``(*group_keys, src_idx)`` on the top-N table,
so a table already hash-partitioned on ``src_idx`` is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_text(df: DataFrame, src_attrs: DataFrame, tgt_attrs: DataFrame) -> DataFrame:
    """Look up per-id attributes (texts, labels, text keys) of both sides.

    Run after top-N so that long texts are not shuffled with every candidate.
    ``src_attrs``/``tgt_attrs`` are keyed by ``idx``; their other columns get a
    ``src_``/``tgt_`` prefix unless already prefixed.
    """
    def prefixed(attrs: DataFrame, key: str, prefix: str) -> DataFrame:
        cols = [F.col("idx").alias(key)]
        cols += [F.col(c).alias(c if c.startswith(prefix) else prefix + c)
                 for c in attrs.columns if c != "idx"]
        return attrs.select(*cols)

    return (df.join(prefixed(src_attrs, "src_idx", "src_"), "src_idx", "left")
              .join(prefixed(tgt_attrs, "tgt_idx", "tgt_"), "tgt_idx", "left"))


def quality_gate(df: DataFrame, threshold) -> DataFrame:
    """Keep candidates with quality >= threshold; missing quality counts as 0."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.filter(F.coalesce(F.col("quality"), F.lit(0.0)) >= thr)


def choose_best(df: DataFrame, threshold, group_keys=(), text_key: str = "tgt_text_key") -> DataFrame:
    """W4 + W5 + J9 (R11, R12) on the scored top-N table.

    Adds ``passes``, ``is_chosen`` (best quality among those that pass; a tie goes to
    the lower pre-rank) and, on the chosen row, ``margin`` = chosen final score minus
    the best final score among candidates whose target text differs from the chosen
    one (0 when there is none).
    """
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    w = Window.partitionBy(*group_keys, "src_idx")
    passes = F.coalesce(F.col("quality"), F.lit(0.0)) >= thr
    order = w.orderBy(F.col("_passes").desc(), F.col("quality").desc_nulls_last(), F.asc("pre_rank"))
    df = (df.withColumn("_passes", passes)
            .withColumn("is_chosen", (F.row_number().over(order) == 1) & F.col("_passes")))
    df = (df.withColumn("_chosen_key", F.max(F.when(F.col("is_chosen"), F.col(text_key))).over(w))
            .withColumn("_chosen_final", F.max(F.when(F.col("is_chosen"), F.col("final_score"))).over(w)))
    other = F.max(F.when(F.col(text_key) != F.col("_chosen_key"), F.col("final_score"))).over(w)
    df = df.withColumn("_best_other", other)
    return (df.withColumn("margin", F.when(F.col("is_chosen"),
                                          F.col("final_score") - F.coalesce(F.col("_best_other"),
                                                                            F.col("final_score"))))
              .withColumnRenamed("_passes", "passes")
              .drop("_chosen_key", "_chosen_final", "_best_other"))


def best_per_source(df: DataFrame, threshold, group_keys=(), text_key: str = "tgt_text_key") -> DataFrame:
    """The chosen pair of each successful source, with its margin."""
    return choose_best(df, threshold, group_keys, text_key).filter("is_chosen").drop("is_chosen", "passes")


def missing_sources(sources: DataFrame, candidates: DataFrame, group_keys=()) -> DataFrame:
    """Sources (``idx``) with no row in ``candidates``."""
    keys = candidates.select(*group_keys, "src_idx").distinct()
    s = sources.select(F.col("idx").alias("src_idx"))
    if group_keys:
        raise ValueError("missing_sources works on a single run")
    return s.join(keys, "src_idx", "left_anti")


def covered_sources(*tables: DataFrame) -> DataFrame:
    """Set union of the sources present in any of the tables."""
    out = None
    for t in tables:
        s = t.select("src_idx")
        out = s if out is None else out.union(s)
    return out.distinct()


def failure_reasons(scored: DataFrame, chosen: DataFrame, group_keys=()) -> DataFrame:
    """A10: for sources with candidates but no chosen pair, the best quality seen
    (missing quality counts as -1)."""
    best = (scored.groupBy(*group_keys, "src_idx")
            .agg(F.max(F.coalesce(F.col("quality"), F.lit(-1.0))).alias("max_quality"),
                 F.count(F.lit(1)).alias("n_candidates")))
    return best.join(chosen.select(*group_keys, "src_idx"), [*group_keys, "src_idx"], "left_anti")


def group_by_source(df: DataFrame, group_keys=()) -> DataFrame:
    """A3: candidates grouped per source (count and best final score)."""
    return df.groupBy(*group_keys, "src_idx").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max("final_score").alias("best_final_score"))


def restore_order(df: DataFrame) -> DataFrame:
    """Sort by source id, at the sink only."""
    return df.orderBy("src_idx")
