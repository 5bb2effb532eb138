"""Mining queries on the driver's tables (units 3-10). Each takes (spark, sf_dir).

Parameters follow FIXTURES.md: quality threshold 0.60 for the stand-in model,
N = 5, ``search_k`` 20 and 100, density thresholds (sparse, crowded) = (0.37, 0.36)
so that both bonus and penalty occur, and the overlapping pair (0.36, 0.37).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmine.functions import scalar as S
from pairmine.operators import quality as Q
from pairmine.operators import run_metrics as RM
from pairmine.operators import scoring as SC
from pairmine.operators import selection as SEL
from pairmine.operators.knn import knn_inner_product, knn_l2
from pairmine.plans import mining as M
from pairmine.session import stage_root
from pairmine.sources.tables import corpora

# Query parameters.
DEMO = SC.MiningConfig(search_k=20, top_after_filtering=5, quality_threshold=0.60,
                       sparse_threshold=0.37, crowded_threshold=0.36)
WIDE_K = 100


def rounded(df: DataFrame, decimals: int = 9) -> DataFrame:
    """Round every DOUBLE column (the oracle rounds the same way)."""
    cols = [F.round(F.col(f.name), decimals).alias(f.name) if f.dataType.simpleString() == "double"
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def _quality_expr(df: DataFrame):
    return Q.stub_quality(F.col("cosine_score"), F.col("src_label"), F.col("tgt_label"))


def _ranked(spark, sf_dir, cfg=DEMO, density=None) -> tuple:
    """``density``: of the same targets and ``k_neighbors``, for runs that share it."""
    c = corpora(spark, sf_dir)
    p = SC.Params.literal(cfg)
    adaptive_on = not (cfg.base_weight == 1.0 and cfg.z_weight == 0.0)
    density_on = not (cfg.sparse_bonus == 0.0 and cfg.crowded_penalty == 0.0)
    cands = M.candidate_table(c.src_vec, c.tgt_vec, cfg.search_k)
    if density_on and density is None:
        density = SC.density_stats(c.tgt_vec, cfg.k_neighbors)
    ranked = M.rank_candidates(cands, density, p, adaptive=adaptive_on, use_density=density_on)
    return c, ranked


def _shared_density(spark, sf_dir) -> DataFrame:
    """The targets' density, staged: a narrow and a wide run look up the same."""
    stage_root(spark)
    return SC.density_stats(corpora(spark, sf_dir).tgt_vec, DEMO.k_neighbors).checkpoint(eager=True)


def _scored(spark, sf_dir, cfg=DEMO, density=None):
    c, ranked = _ranked(spark, sf_dir, cfg, density)
    wt = M.attach_keys(ranked, c.src_attrs, c.tgt_attrs)
    return c, wt.withColumn("quality", _quality_expr(wt))


def _final(spark, sf_dir, cfg=DEMO, density=None, staged: bool = False):
    """``staged``: for a caller that reads the scored rows as well, which would be made twice."""
    c, scored = _scored(spark, sf_dir, cfg, density)
    if staged:
        stage_root(spark)
        scored = scored.checkpoint(eager=True)
    return c, scored, SEL.best_per_source(scored, cfg.quality_threshold)


# --- J1-J4, J5 -------------------------------------------------------------------
def q_knn_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpora(spark, sf_dir)
    return rounded(knn_inner_product(c.src_vec, c.tgt_vec, DEMO.search_k))


def q_knn_l2(spark, sf_dir):
    c = corpora(spark, sf_dir)
    return rounded(knn_l2(c.src_vec, c.tgt_vec, DEMO.search_k))


def q_candidate_union(spark, sf_dir):
    c = corpora(spark, sf_dir)
    return rounded(M.candidate_table(c.src_vec, c.tgt_vec, WIDE_K))


def q_rescore_candidates(spark, sf_dir):
    c = corpora(spark, sf_dir)
    cands = M.candidate_table(c.src_vec, c.tgt_vec, WIDE_K)
    out = SC.rescore_candidates(cands, SC.Params.literal(DEMO))
    return rounded(out.select("src_idx", "tgt_idx", "cosine_score", "l2_score", "score"))


def q_self_knn_density(spark, sf_dir):
    c = corpora(spark, sf_dir)
    return rounded(SC.density_stats(c.tgt_vec, DEMO.k_neighbors))


def _adaptive(spark, sf_dir, cfg, k):
    c = corpora(spark, sf_dir)
    p = SC.Params.literal(cfg)
    df = SC.local_zscore(SC.rescore_candidates(M.candidate_table(c.src_vec, c.tgt_vec, k), p), p)
    return rounded(df.select("src_idx", "tgt_idx", "score", "base_score", "z_score", "adaptive_score"))


def q_local_zscore(spark, sf_dir):
    return _adaptive(spark, sf_dir, DEMO, WIDE_K)


def q_adaptive_score(spark, sf_dir):
    cfg = replace(DEMO, base_weight=0.7, z_weight=0.3, z_threshold=-0.5)
    return _adaptive(spark, sf_dir, cfg, DEMO.search_k)


# --- W3 under the four on/off combinations and the overlapping thresholds ---------
PRE_RANK_CONFIGS = {
    "pre_rank": DEMO,
    "pre_rank_no_adaptive": replace(DEMO, base_weight=1.0, z_weight=0.0),
    "pre_rank_no_density": replace(DEMO, sparse_bonus=0.0, crowded_penalty=0.0),
    "pre_rank_plain": replace(DEMO, base_weight=1.0, z_weight=0.0, sparse_bonus=0.0, crowded_penalty=0.0),
    "pre_rank_overlap": replace(DEMO, sparse_threshold=0.36, crowded_threshold=0.37),
    "pre_rank_default_density": replace(DEMO, search_k=WIDE_K, sparse_threshold=0.3, crowded_threshold=0.1),
}


def _pre_rank_query(name):
    def q(spark, sf_dir):
        _, ranked = _ranked(spark, sf_dir, PRE_RANK_CONFIGS[name])
        return rounded(ranked)
    q.__name__ = f"q_{name}"
    return q


# --- P9, W4, W5, J8, J7, A10 -------------------------------------------------------
def q_quality_gate(spark, sf_dir):
    _, scored = _scored(spark, sf_dir)
    out = SEL.quality_gate(scored, DEMO.quality_threshold)
    return rounded(out.select("src_idx", "tgt_idx", "pre_rank", "final_score", "quality"))


def q_best_per_source(spark, sf_dir):
    _, _, fp = _final(spark, sf_dir)
    return rounded(fp.select("src_idx", "tgt_idx", "pre_rank", "final_score", "quality"))


def q_selected_margin(spark, sf_dir):
    _, _, fp = _final(spark, sf_dir)
    return rounded(fp.select("src_idx", "tgt_idx", "margin"))


def q_missing_sources(spark, sf_dir):
    """Sources left without a chosen pair (no candidate, or none passes the gate)."""
    c, _, fp = _final(spark, sf_dir)
    return SEL.missing_sources(c.src_vec, fp)


def q_failure_reasons(spark, sf_dir):
    _, scored, fp = _final(spark, sf_dir, staged=True)
    return rounded(SEL.failure_reasons(scored, fp))


def _scored_narrow_and_wide(spark, sf_dir):
    """Pairs scored by an earlier run with search_k 20 and the top-N of a run with 100."""
    density = _shared_density(spark, sf_dir)
    _, narrow = _ranked(spark, sf_dir, DEMO, density)
    _, wide = _ranked(spark, sf_dir, replace(DEMO, search_k=WIDE_K), density)
    return narrow, wide


def q_unscored_pairs(spark, sf_dir):
    narrow, wide = _scored_narrow_and_wide(spark, sf_dir)
    return Q.unscored_pairs(wide.select("src_idx", "tgt_idx", "pre_rank"), narrow)


def q_candidate_coverage(spark, sf_dir):
    c = corpora(spark, sf_dir)
    narrow, wide = _scored_narrow_and_wide(spark, sf_dir)
    n_src = c.src_vec.count()
    return rounded(Q.candidate_coverage(wide, narrow, n_src))


def q_covered_sources(spark, sf_dir):
    """Sources with a pair above the gate in the narrow run or in the wide one."""
    density = _shared_density(spark, sf_dir)
    _, _, a = _final(spark, sf_dir, density=density)
    _, _, b = _final(spark, sf_dir, replace(DEMO, search_k=WIDE_K), density)
    return SEL.covered_sources(a, b)


def q_append_scored(spark, sf_dir):
    """U4: the scored table of the narrow run, completed by the pairs that only the wide
    run has."""
    c, narrow = _scored(spark, sf_dir)
    _, wide = _scored(spark, sf_dir, replace(DEMO, search_k=WIDE_K))
    cols = ["src_idx", "tgt_idx", "quality"]
    new = Q.unscored_pairs(wide.select(*cols), narrow)
    return rounded(Q.append_scored(Q.usable_scores(narrow.select(*cols)), new))


# --- A5-A8 ------------------------------------------------------------------------
def q_run_summary(spark, sf_dir):
    c, _, fp = _final(spark, sf_dir)
    return rounded(RM.run_summary(fp, c.src_vec.count()))


def q_rank_distribution(spark, sf_dir):
    _, _, fp = _final(spark, sf_dir)
    return rounded(RM.rank_distribution(fp))


def q_weighted_rank_score(spark, sf_dir):
    return q_run_summary(spark, sf_dir).select("total", "total_weighted_score", "weighted_score")


def q_margin_stats(spark, sf_dir):
    return q_run_summary(spark, sf_dir).select("successful", "avg_selected_margin", "std_selected_margin")


def q_group_by_source(spark, sf_dir):
    """A3: candidates per source after top-N, with the best final score."""
    _, ranked = _ranked(spark, sf_dir)
    return rounded(SEL.group_by_source(ranked))


def q_vector_norms(spark, sf_dir):
    """F9 + F11: every embedding normalised to unit length (zero stays zero), its
    squared norm and its inner product with the raw vector."""
    emb = corpora(spark, sf_dir)
    vec = emb.src_vec.unionByName(emb.tgt_vec)
    unit = vec.withColumn("unit", S.l2_normalize(F.col("vec")))
    return rounded(unit.select("idx", S.dot(F.col("unit"), F.col("unit")).alias("unit_sq_norm"),
                               S.dot(F.col("unit"), F.col("vec")).alias("dot_raw")))


# --- X7 -----------------------------------------------------------------------------
def q_mine_pairs(spark, sf_dir, materialize: bool = False):
    c = corpora(spark, sf_dir)
    res = M.mine_pairs(c.src_vec, c.tgt_vec, c.src_attrs, c.tgt_attrs, DEMO,
                       quality_expr=_quality_expr, materialize=materialize)
    return rounded(res.final_pairs.select(*M.FINAL_PAIR_COLS))


QUERIES = {
    "knn_inner_product": q_knn_inner_product,
    "knn_l2": q_knn_l2,
    "candidate_union": q_candidate_union,
    "rescore_candidates": q_rescore_candidates,
    "self_knn_density": q_self_knn_density,
    "local_zscore": q_local_zscore,
    "adaptive_score": q_adaptive_score,
    **{name: _pre_rank_query(name) for name in PRE_RANK_CONFIGS},
    "quality_gate": q_quality_gate,
    "best_per_source": q_best_per_source,
    "selected_margin": q_selected_margin,
    "missing_sources": q_missing_sources,
    "failure_reasons": q_failure_reasons,
    "unscored_pairs": q_unscored_pairs,
    "candidate_coverage": q_candidate_coverage,
    "covered_sources": q_covered_sources,
    "append_scored": q_append_scored,
    "run_summary": q_run_summary,
    "rank_distribution": q_rank_distribution,
    "weighted_rank_score": q_weighted_rank_score,
    "margin_stats": q_margin_stats,
    "mine_pairs": q_mine_pairs,
    "group_by_source": q_group_by_source,
    "vector_norms": q_vector_norms,
}
