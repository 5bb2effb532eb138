"""Candidate scoring: J4 rescore_candidates (F1, F2), A1/A2/W1/F4/P10 local z-score,
J5/A4/W6/F5/P15 corpus density, F6 density_adjust, W3/T2 pre_rank.

Every stage takes its parameters as columns (``Params``): a single run folds them
to literals, a sweep carries them as grid columns next to ``experiment_id``. Windows
partition by ``(*group_keys, src_idx)``; a table hash-partitioned on ``src_idx``
already satisfies that distribution, so the chain of windows costs one shuffle.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmine.functions import scalar as S
from pairmine.operators.knn import self_neighbours

# ---------------------------------------------------------------------------
# The defaults of a mining run.
@dataclass(frozen=True)
class MiningConfig:
    search_k: int = 100
    top_after_filtering: int = 5
    quality_threshold: float = 0.75
    cosine_weight: float = 0.6
    l2_weight: float = 0.4
    base_weight: float = 0.6
    z_weight: float = 0.4
    z_threshold: float = -1.0
    sparse_bonus: float = 0.1
    crowded_penalty: float = 0.15
    sparse_threshold: float = 0.3
    crowded_threshold: float = 0.1
    k_neighbors: int = 20
# ---------------------------------------------------------------------------

PARAM_NAMES = ("top_after_filtering", "quality_threshold", "cosine_weight", "l2_weight",
               "base_weight", "z_weight", "z_threshold", "sparse_bonus", "crowded_penalty",
               "sparse_threshold", "crowded_threshold")


class Params(dict):
    """Parameter name -> Column."""

    @classmethod
    def literal(cls, cfg: MiningConfig) -> "Params":
        d = asdict(cfg)
        return cls({k: F.lit(d[k]) for k in PARAM_NAMES})

    @classmethod
    def columns(cls) -> "Params":
        return cls({k: F.col(k) for k in PARAM_NAMES})

    def adaptive_on(self) -> Column:
        """Off exactly when base_weight == 1.0 and z_weight == 0.0."""
        return ~((self["base_weight"] == 1.0) & (self["z_weight"] == 0.0))

    def density_on(self) -> Column:
        """Off exactly when bonus and penalty are both 0."""
        return ~((self["sparse_bonus"] == 0.0) & (self["crowded_penalty"] == 0.0))


def rescore_candidates(cands: DataFrame, p: Params) -> DataFrame:
    """J4 + F1 + F2: cosine from the inner product; L2 similarity from the squared
    distance when the pair is in the L2 list, from the un-squared distance otherwise."""
    l2 = F.when(F.col("l2_rank").isNotNull(), S.l2_similarity(F.col("sqd"))) \
          .otherwise(S.l2_similarity(F.sqrt("sqd")))
    return (cands
            .withColumn("cosine_score", F.col("dot"))
            .withColumn("l2_score", l2)
            .withColumn("score", S.combined_score(F.col("cosine_score"), F.col("l2_score"),
                                                  p["cosine_weight"], p["l2_weight"])))


def local_zscore(scored: DataFrame, p: Params, group_keys=()) -> DataFrame:
    """A1 + A2 + W1 + F4 + P10.

    Per source: mean and population std of ``score``. Groups of fewer than 3 rows or
    std < 1e-8 keep ``adaptive = score``, ``z = 0``, no ``base_score``, no gate.
    Otherwise z is clipped to [-5, 5], adaptive = clip(bw*s + zw*clip(z/3,-1,1), 0, 1),
    and only rows with z > z_threshold stay. With adaptive scoring off:
    adaptive = score, z = 0, base = score, no gate.
    """
    w = Window.partitionBy(*group_keys, "src_idx")
    on = p.adaptive_on()
    n = F.count(F.lit(1)).over(w)
    mean = F.avg("score").over(w)
    std = F.stddev_pop("score").over(w)
    df = (scored.withColumn("_n", n).withColumn("_mean", mean).withColumn("_std", std)
          .withColumn("_degenerate", (F.col("_n") < 3) | (F.col("_std") < S.Z_EPS)))
    active = on & ~F.col("_degenerate")
    z = S.zscore(F.col("score"), F.col("_mean"), F.col("_std"))
    df = (df.withColumn("z_score", F.when(active, z).otherwise(F.lit(0.0)))
            .withColumn("adaptive_score",
                        F.when(active, S.adaptive_score(F.col("score"), F.col("z_score"),
                                                        p["base_weight"], p["z_weight"]))
                        .otherwise(F.col("score")))
            .withColumn("base_score",
                        F.when(~on, F.col("score"))
                        .when(F.col("_degenerate"), F.lit(None).cast("double"))
                        .otherwise(F.col("score"))))
    keep = ~active | (F.col("z_score") > p["z_threshold"])
    return df.filter(keep).drop("_n", "_mean", "_std", "_degenerate")


def density_stats(targets: DataFrame, k_neighbors: int = 20, *, id_col: str = "idx",
                  vec: str = "vec", only: DataFrame | None = None, **knn_kw) -> DataFrame:
    """J5 + W6 + P15 + A4 + F5: density of each target in its own corpus.

    Neighbours = the ``min(k+1, n)`` most similar targets; the first by position is
    dropped; the finite ones are clipped to [-1, 1] and averaged. No finite neighbour
    -> avg 0, density 0.5; ``has_neighbors`` is false for a corpus of one only, where
    bonus and penalty are skipped too (R16). ``only`` (a table with ``idx``) restricts
    the left side to those targets, for instance the ones that are candidates at all;
    a target's density does not depend on it (R10).
    Returns ``tgt_idx, avg_neighbor_sim, density, has_neighbors``.
    """
    vecs = targets.select(F.col(id_col).alias("idx"), F.col(vec).alias("vec"))
    n = vecs.count()
    nbrs = self_neighbours(vecs, k_neighbors, only, n, **knn_kw)
    agg = (nbrs.filter(F.col("rank") >= 2).groupBy("idx")
           .agg(F.avg(S.clip(F.col("sim"), -1.0, 1.0)).alias("_avg")))
    ids = vecs.select("idx") if only is None else only.select("idx").distinct()
    out = ids.join(agg, "idx", "left")
    avg = S.clip(F.col("_avg"), -1.0, 1.0)
    return out.select(
        F.col("idx").alias("tgt_idx"),
        F.when(F.col("_avg").isNull(), F.lit(0.0)).otherwise(avg).alias("avg_neighbor_sim"),
        F.when(F.col("_avg").isNull(), F.lit(0.5)).otherwise(S.density_from_avg(avg)).alias("density"),
        F.lit(n > 1).alias("has_neighbors"))


def density_adjust(df: DataFrame, p: Params, density_col: str = "_density_raw") -> DataFrame:
    """bonus if density > sparse_thr; penalty if density < crowded_thr (both can
    apply, R8); final = clip(adaptive + bonus - penalty, 0, 1). With density off, or
    no neighbour at all (R16): density 0.5, no bonus or penalty, final = adaptive."""
    on = p.density_on() & F.col(density_col).isNotNull()
    dens = F.col(density_col)
    return (df
            .withColumn("density", F.when(on, dens).otherwise(F.lit(0.5)))
            .withColumn("density_bonus",
                        F.when(on, S.density_bonus(dens, p["sparse_threshold"], p["sparse_bonus"]))
                        .otherwise(F.lit(0.0)))
            .withColumn("density_penalty",
                        F.when(on, S.density_penalty(dens, p["crowded_threshold"], p["crowded_penalty"]))
                        .otherwise(F.lit(0.0)))
            .withColumn("final_score",
                        F.when(on, S.clip(F.col("adaptive_score") + F.col("density_bonus")
                                          - F.col("density_penalty"), 0.0, 1.0))
                        .otherwise(F.col("adaptive_score")))
            .drop(density_col))


def attach_density(df: DataFrame, density: DataFrame | None) -> DataFrame:
    """Look up each candidate's target density; NULL in a corpus of one, which
    density_adjust treats as R16. A plain equi-join: adaptive execution broadcasts the
    density table by its measured size, or splits a skewed partition (a hub target in
    many candidate lists)."""
    if density is None:
        return df.withColumn("_density_raw", F.lit(None).cast("double"))
    d = density.select("tgt_idx", F.when(F.col("has_neighbors"), F.col("density")).alias("_density_raw"))
    return df.join(d, "tgt_idx", "left")


def pre_rank(df: DataFrame, p: Params, group_keys=(), at_most: int | None = None) -> DataFrame:
    """W3 + T2 + W2 (R7): stable order final desc, adaptive desc (W2, only when adaptive scoring
    is on), target id asc; keep the first ``top_after_filtering``; rank 1..N. ``at_most`` is
    the largest N of a grid: a literal bound lets Spark plan a WindowGroupLimit."""
    adaptive_key = F.when(p.adaptive_on(), F.col("adaptive_score")).otherwise(F.lit(0.0))
    w = (Window.partitionBy(*group_keys, "src_idx")
         .orderBy(F.desc("final_score"), adaptive_key.desc(), F.asc("tgt_idx")))
    df = df.withColumn("pre_rank", F.row_number().over(w))
    if at_most is not None:
        df = df.filter(F.col("pre_rank") <= at_most)
    return df.filter(F.col("pre_rank") <= p["top_after_filtering"])


RANKED_COLS = ["src_idx", "tgt_idx", "cosine_score", "l2_score", "score", "base_score",
               "z_score", "adaptive_score", "density", "density_bonus", "density_penalty",
               "final_score", "pre_rank"]
