"""Sweep queries on the driver's tables (unit 11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmine.plans import sweep as SW
from pairmine.plans.mining_queries import _quality_expr, rounded
from pairmine.sources.tables import corpora


def _sized(spark, sf_dir, grid: DataFrame) -> DataFrame:
    """A grid with the size of its runs over the given corpora: sources, targets, and the
    most candidate pairs that a config can score."""
    c = corpora(spark, sf_dir)
    n_src, n_tgt = c.src_vec.count(), c.tgt_vec.count()
    return (grid.withColumn("n_sources", F.lit(n_src).cast("long"))
            .withColumn("max_pairs", F.lit(n_src).cast("long") * F.least(2 * F.col("search_k"), F.lit(n_tgt))))


def q_grid_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir, SW.grid_minimal(spark))


def q_grid_focused(spark, sf_dir):
    return _sized(spark, sf_dir, SW.grid_focused(spark))


def q_grid_baseline(spark, sf_dir):
    return _sized(spark, sf_dir, SW.grid_baseline(spark))


# Two configs that must fail: no z-score exceeds its clip of 5, and one
# parameter is missing.
FAILING_ROWS = [
    dict(SW.BASELINE_COMMON, experiment_id=10004, base_weight=0.6, z_weight=0.4, sparse_bonus=0.1,
         crowded_penalty=0.15, z_threshold=5.0),
    dict(SW.BASELINE_COMMON, experiment_id=10005, base_weight=0.6, z_weight=0.4, sparse_bonus=0.1,
         crowded_penalty=0.15, z_threshold=None),
]


def failing_grid(spark) -> DataFrame:
    rows = [tuple(None if r[c] is None else float(r[c]) for c in SW.GRID_COLUMNS) for r in FAILING_ROWS]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in SW.GRID_COLUMNS))
    return df.select(*[SW._typed(c).alias(c) for c in SW.GRID_COLUMNS])


def sweep_grid(spark) -> DataFrame:
    """The minimal grid, the three ablations and two configs that fail: 329 configs."""
    return SW.grid_minimal(spark).unionByName(SW.grid_baseline(spark)).unionByName(failing_grid(spark))


def _sweep(spark, sf_dir, grid=None, staged: bool = False) -> SW.SweepResult:
    """``staged``: for a caller that reads results and pairs, each of which would search anew."""
    c = corpora(spark, sf_dir)
    return SW.run_sweep(grid if grid is not None else sweep_grid(spark), c.src_vec, c.tgt_vec,
                        c.src_attrs, c.tgt_attrs, quality_expr=_quality_expr, materialize=False,
                        searches=SW.Searches(c.src_vec, c.tgt_vec) if staged else None)


def q_run_sweep(spark, sf_dir):
    return rounded(_sweep(spark, sf_dir).results)


def q_sweep_best_pairs(spark, sf_dir):
    """K4: the pairs of the best run, taken from the sweep (no rerun)."""
    res = _sweep(spark, sf_dir, staged=True)
    cols = ["experiment_id", "src_idx", "tgt_idx", "pre_rank", "final_score", "quality", "margin"]
    return rounded(SW.best_pairs(res).select(*cols))


def q_best_experiment(spark, sf_dir):
    res = _sweep(spark, sf_dir).results
    return rounded(SW.best_experiment(res).select("experiment_id", "weighted_score"))


def q_leaderboard(spark, sf_dir):
    res = _sweep(spark, sf_dir).results
    return rounded(SW.leaderboard(res).select("position", "experiment_id", "weighted_score",
                                              "avg_selected_margin", "std_selected_margin"))


def q_best_by_margin(spark, sf_dir):
    res = _sweep(spark, sf_dir).results
    return rounded(SW.best_by_margin(res).select("experiment_id", "avg_selected_margin"))


def q_status_counts(spark, sf_dir):
    return SW.status_counts(_sweep(spark, sf_dir).results)


def q_running_best(spark, sf_dir):
    res = _sweep(spark, sf_dir).results
    return rounded(SW.running_best(res).select("experiment_id", "weighted_score", "is_new_best"))


def q_pending_experiments(spark, sf_dir):
    """Resume after the three ablation runs: the minimal grid is still pending."""
    done = _sweep(spark, sf_dir, SW.grid_baseline(spark)).results
    return SW.pending_experiments(sweep_grid(spark), done)


QUERIES = {
    "grid_minimal": q_grid_minimal,
    "grid_focused": q_grid_focused,
    "grid_baseline": q_grid_baseline,
    "run_sweep": q_run_sweep,
    "sweep_best_pairs": q_sweep_best_pairs,
    "best_experiment": q_best_experiment,
    "leaderboard": q_leaderboard,
    "best_by_margin": q_best_by_margin,
    "status_counts": q_status_counts,
    "running_best": q_running_best,
    "pending_experiments": q_pending_experiments,
}
