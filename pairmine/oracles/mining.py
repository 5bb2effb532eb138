"""DuckDB oracle SQL for the mining queries (brute force: every pair is scored;
fine at the test scale, never used by the engine).

Same rounding as the engine: similarities to 9 decimals before ranking, every
DOUBLE output to 6 decimals.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


# Fixed values, written out: the oracle shares no constant with the engine.
@dataclass(frozen=True)
class MiningConfig:
    search_k: int = 20
    top_after_filtering: int = 5
    quality_threshold: float = 0.60
    cosine_weight: float = 0.6
    l2_weight: float = 0.4
    base_weight: float = 0.6
    z_weight: float = 0.4
    z_threshold: float = -1.0
    sparse_bonus: float = 0.1
    crowded_penalty: float = 0.15
    sparse_threshold: float = 0.37
    crowded_threshold: float = 0.36
    k_neighbors: int = 20


SOURCE_EVERY = 5
WIDE_K = 100
DEMO = MiningConfig()
PRE_RANK_CONFIGS = {
    "pre_rank": DEMO,
    "pre_rank_no_adaptive": replace(DEMO, base_weight=1.0, z_weight=0.0),
    "pre_rank_no_density": replace(DEMO, sparse_bonus=0.0, crowded_penalty=0.0),
    "pre_rank_plain": replace(DEMO, base_weight=1.0, z_weight=0.0, sparse_bonus=0.0, crowded_penalty=0.0),
    "pre_rank_overlap": replace(DEMO, sparse_threshold=0.36, crowded_threshold=0.37),
    "pre_rank_default_density": replace(DEMO, search_k=100, sparse_threshold=0.3, crowded_threshold=0.1),
}


def d(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def vectors_cte() -> str:
    return f"""
src AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % {SOURCE_EVERY} = 0),
tgt AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % {SOURCE_EVERY} <> 0),
attrs AS (SELECT e.vec_id AS idx, e.label, coalesce(dc.text, 'vec ' || CAST(e.vec_id AS VARCHAR)) AS text
          FROM embeddings e LEFT JOIN documents dc ON dc.doc_id = e.vec_id)"""


def knn_cte(k: int, name: str = "cand") -> str:
    return f"""
pairs_{name} AS (
  SELECT s.idx AS src_idx, t.idx AS tgt_idx,
         round(list_inner_product(s.vec, t.vec), 9) AS dot,
         round(list_sum(list_transform(list_zip(s.vec, t.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS sqd
  FROM src s, tgt t),
knn_{name} AS (
  SELECT *, row_number() OVER (PARTITION BY src_idx ORDER BY dot DESC, tgt_idx) AS ipr,
            row_number() OVER (PARTITION BY src_idx ORDER BY sqd, tgt_idx) AS l2r
  FROM pairs_{name}),
{name} AS (
  SELECT src_idx, tgt_idx, dot, sqd,
         CAST(CASE WHEN ipr <= {k} THEN ipr END AS INTEGER) AS ip_rank,
         CAST(CASE WHEN l2r <= {k} THEN l2r END AS INTEGER) AS l2_rank
  FROM knn_{name} WHERE ipr <= {k} OR l2r <= {k})"""


def density_cte(k_neighbors: int) -> str:
    return f"""
dpairs AS (SELECT a.idx AS idx, b.idx AS nbr, round(list_inner_product(a.vec, b.vec), 9) AS sim
           FROM tgt a, tgt b),
drank AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, nbr) AS rk FROM dpairs),
dagg AS (SELECT idx, avg(least(greatest(sim, -1.0), 1.0)) AS avg_
         FROM drank WHERE rk >= 2 AND rk <= {k_neighbors + 1} AND isfinite(sim) GROUP BY idx),
dens AS (SELECT t.idx AS tgt_idx,
                coalesce(least(greatest(avg_, -1.0), 1.0), 0.0) AS avg_neighbor_sim,
                CASE WHEN avg_ IS NULL THEN 0.5
                     ELSE least(greatest(1.0 - (least(greatest(avg_, -1.0), 1.0) + 1.0) / 2.0, 0.0), 1.0) END AS density,
                (SELECT count(*) FROM tgt) > 1 AS has_neighbors
         FROM tgt t LEFT JOIN dagg USING (idx))"""


def ranked_cte(cfg: MiningConfig, cand: str = "cand", out: str = "ranked") -> str:
    aon = not (cfg.base_weight == 1.0 and cfg.z_weight == 0.0)
    don = not (cfg.sparse_bonus == 0.0 and cfg.crowded_penalty == 0.0)
    a_on = "TRUE" if aon else "FALSE"
    d_on = "TRUE" if don else "FALSE"
    dens_join = ("LEFT JOIN dens d USING (tgt_idx)" if don else
                 "LEFT JOIN (SELECT NULL::BIGINT AS tgt_idx, NULL::DOUBLE AS density, NULL::BOOLEAN AS has_neighbors) d USING (tgt_idx)")
    return f"""
sc_{out} AS (
  SELECT src_idx, tgt_idx, l2_rank, dot AS cosine_score,
         CASE WHEN l2_rank IS NOT NULL THEN 1.0 / (1.0 + sqd) ELSE 1.0 / (1.0 + sqrt(sqd)) END AS l2_score
  FROM {cand}),
sc2_{out} AS (SELECT *, {d(cfg.cosine_weight)} * cosine_score + {d(cfg.l2_weight)} * l2_score AS score FROM sc_{out}),
st_{out} AS (SELECT *, count(*) OVER w AS n_, avg(score) OVER w AS mean_, stddev_pop(score) OVER w AS std_
             FROM sc2_{out} WINDOW w AS (PARTITION BY src_idx)),
ad_{out} AS (SELECT *, {a_on} AND NOT (n_ < 3 OR std_ < 1e-8) AS active_,
                   (n_ < 3 OR std_ < 1e-8) AS degen_ FROM st_{out}),
ad2_{out} AS (SELECT *, CASE WHEN active_ THEN least(greatest((score - mean_) / (std_ + 1e-8), -5.0), 5.0)
                             ELSE 0.0 END AS z_score FROM ad_{out}),
ad3_{out} AS (
  SELECT *,
    CASE WHEN active_ THEN least(greatest({d(cfg.base_weight)} * score
                 + {d(cfg.z_weight)} * least(greatest(z_score / 3.0, -1.0), 1.0), 0.0), 1.0)
         ELSE score END AS adaptive_score,
    CASE WHEN NOT {a_on} THEN score WHEN degen_ THEN NULL ELSE score END AS base_score
  FROM ad2_{out} WHERE NOT active_ OR z_score > {d(cfg.z_threshold)}),
fi_{out} AS (SELECT a.*, CASE WHEN {d_on} AND d.has_neighbors THEN d.density END AS draw_
             FROM ad3_{out} a {dens_join}),
fi2_{out} AS (
  SELECT *,
    CASE WHEN draw_ IS NOT NULL THEN draw_ ELSE 0.5 END AS density,
    CASE WHEN draw_ IS NOT NULL AND draw_ > {d(cfg.sparse_threshold)} THEN {d(cfg.sparse_bonus)} ELSE 0.0 END AS density_bonus,
    CASE WHEN draw_ IS NOT NULL AND draw_ < {d(cfg.crowded_threshold)} THEN {d(cfg.crowded_penalty)} ELSE 0.0 END AS density_penalty
  FROM fi_{out}),
fi3_{out} AS (
  SELECT *, CASE WHEN draw_ IS NOT NULL
                 THEN least(greatest(adaptive_score + density_bonus - density_penalty, 0.0), 1.0)
                 ELSE adaptive_score END AS final_score
  FROM fi2_{out}),
rk_{out} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY src_idx ORDER BY final_score DESC,
           (CASE WHEN {a_on} THEN adaptive_score ELSE 0.0 END) DESC, tgt_idx) AS INTEGER) AS pre_rank
  FROM fi3_{out}),
{out} AS (
  SELECT src_idx, tgt_idx, cosine_score, l2_score, score, base_score, z_score, adaptive_score,
         density, density_bonus, density_penalty, final_score, pre_rank
  FROM rk_{out} WHERE pre_rank <= {cfg.top_after_filtering})"""


def scored_cte(cfg: MiningConfig, ranked: str = "ranked") -> str:
    thr = d(cfg.quality_threshold)
    return f"""
wt AS (SELECT r.*, sa.label AS src_label, sa.text AS src_text, ta.label AS tgt_label, ta.text AS tgt_text
       FROM {ranked} r JOIN attrs sa ON sa.idx = r.src_idx JOIN attrs ta ON ta.idx = r.tgt_idx),
scored AS (SELECT *, 0.5 * greatest(cosine_score, 0.0)
                   + 0.5 * (CASE WHEN src_label = tgt_label THEN 1.0 ELSE 0.0 END) AS quality FROM wt),
ch AS (SELECT *, coalesce(quality, 0.0) >= {thr} AS passes_ FROM scored),
ch2 AS (SELECT *, (row_number() OVER (PARTITION BY src_idx ORDER BY passes_ DESC, quality DESC NULLS LAST, pre_rank) = 1)
                  AND passes_ AS is_chosen FROM ch),
ch3 AS (SELECT *, max(CASE WHEN is_chosen THEN tgt_text END) OVER (PARTITION BY src_idx) AS chosen_text FROM ch2),
ch4 AS (SELECT *, max(CASE WHEN tgt_text <> chosen_text THEN final_score END) OVER (PARTITION BY src_idx) AS best_other
        FROM ch3),
fp AS (SELECT *, final_score - coalesce(best_other, final_score) AS margin FROM ch4 WHERE is_chosen)"""


def metrics_cte() -> str:
    w = ("CAST(CASE WHEN pre_rank IS NULL THEN 0.0 WHEN pre_rank = 1 THEN 1.0 WHEN pre_rank = 2 THEN 0.7 "
         "WHEN pre_rank = 3 THEN 0.5 WHEN pre_rank = 4 THEN 0.3 ELSE 0.1 END AS DOUBLE)")
    return f"""
agg AS (SELECT count(*) AS successful, coalesce(sum({w}), CAST(0.0 AS DOUBLE)) AS total_weighted_score,
               count(*) FILTER (WHERE pre_rank = 1) AS rank_1_count,
               count(*) FILTER (WHERE pre_rank = 2) AS rank_2_count,
               count(*) FILTER (WHERE pre_rank = 3) AS rank_3_count,
               coalesce(avg(margin), 0.0) AS avg_selected_margin,
               CASE WHEN count(*) > 1 THEN stddev_pop(margin) ELSE 0.0 END AS std_selected_margin
        FROM fp),
summary AS (
  SELECT (SELECT count(*) FROM src) AS total, successful,
         (SELECT count(*) FROM src) - successful AS failed,
         CASE WHEN (SELECT count(*) FROM src) > 0 THEN successful * 100.0 / (SELECT count(*) FROM src) ELSE 0.0 END AS success_rate,
         CASE WHEN (SELECT count(*) FROM src) > 0 THEN total_weighted_score / (SELECT count(*) FROM src) ELSE 0.0 END AS weighted_score,
         total_weighted_score, rank_1_count, rank_2_count, rank_3_count,
         CASE WHEN successful > 0 THEN rank_1_count * 100.0 / successful ELSE 0.0 END AS rank_1_percentage,
         CASE WHEN successful > 0 THEN rank_2_count * 100.0 / successful ELSE 0.0 END AS rank_2_percentage,
         CASE WHEN successful > 0 THEN rank_3_count * 100.0 / successful ELSE 0.0 END AS rank_3_percentage,
         avg_selected_margin, std_selected_margin
  FROM agg)"""


def r(col: str, alias: str | None = None) -> str:
    return f"round({col}, 9) AS {alias or col.split('.')[-1]}"


RANKED_SELECT = ", ".join([
    "src_idx", "tgt_idx", r("cosine_score"), r("l2_score"), r("score"), r("base_score"), r("z_score"),
    r("adaptive_score"), r("density"), r("density_bonus"), r("density_penalty"), r("final_score"), "pre_rank"])


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def sql_mining() -> dict[str, str]:
    k, K = DEMO.search_k, WIDE_K
    base = vectors_cte()
    out: dict[str, str] = {}
    out["knn_inner_product"] = _with(base, knn_cte(k)) + f"""
SELECT src_idx, tgt_idx, round(dot, 9) AS sim, ip_rank AS rank FROM cand WHERE ip_rank IS NOT NULL"""
    out["knn_l2"] = _with(base, knn_cte(k)) + f"""
SELECT src_idx, tgt_idx, round(sqd, 9) AS sq_dist, l2_rank AS rank FROM cand WHERE l2_rank IS NOT NULL"""
    out["candidate_union"] = _with(base, knn_cte(K)) + """
SELECT src_idx, tgt_idx, round(dot, 9) AS dot, round(sqd, 9) AS sqd, ip_rank, l2_rank FROM cand"""
    out["rescore_candidates"] = _with(base, knn_cte(K), ranked_cte(replace(DEMO, top_after_filtering=10**6))) + """
SELECT src_idx, tgt_idx, round(cosine_score, 9) AS cosine_score, round(l2_score, 9) AS l2_score,
       round(score, 9) AS score FROM sc2_ranked"""
    out["self_knn_density"] = _with(base, density_cte(DEMO.k_neighbors)) + """
SELECT tgt_idx, round(avg_neighbor_sim, 9) AS avg_neighbor_sim, round(density, 9) AS density, has_neighbors FROM dens"""
    for name, cfg, kk in (("local_zscore", DEMO, K),
                          ("adaptive_score", replace(DEMO, base_weight=0.7, z_weight=0.3, z_threshold=-0.5), k)):
        out[name] = _with(base, knn_cte(kk), ranked_cte(cfg)) + f"""
SELECT src_idx, tgt_idx, {r('score')}, {r('base_score')}, {r('z_score')}, {r('adaptive_score')} FROM ad3_ranked"""
    for name, cfg in PRE_RANK_CONFIGS.items():
        out[name] = _with(base, knn_cte(cfg.search_k), density_cte(cfg.k_neighbors), ranked_cte(cfg)) + f"""
SELECT {RANKED_SELECT} FROM ranked"""
    chain = (base, knn_cte(k), density_cte(DEMO.k_neighbors), ranked_cte(DEMO), scored_cte(DEMO))
    out["quality_gate"] = _with(*chain) + f"""
SELECT src_idx, tgt_idx, pre_rank, {r('final_score')}, {r('quality')} FROM scored
WHERE coalesce(quality, 0.0) >= {d(DEMO.quality_threshold)}"""
    out["best_per_source"] = _with(*chain) + f"""
SELECT src_idx, tgt_idx, pre_rank, {r('final_score')}, {r('quality')} FROM fp"""
    out["selected_margin"] = _with(*chain) + f"""
SELECT src_idx, tgt_idx, {r('margin')} FROM fp"""
    out["missing_sources"] = _with(*chain) + """
SELECT s.idx AS src_idx FROM src s WHERE s.idx NOT IN (SELECT src_idx FROM fp)"""
    out["failure_reasons"] = _with(*chain) + """
SELECT src_idx, round(max(coalesce(quality, -1.0)), 9) AS max_quality, count(*) AS n_candidates
FROM scored WHERE src_idx NOT IN (SELECT src_idx FROM fp) GROUP BY src_idx"""
    two = (base, knn_cte(k, "cand"), knn_cte(K, "cand_w"), density_cte(DEMO.k_neighbors),
           ranked_cte(DEMO, "cand", "narrow"), ranked_cte(replace(DEMO, search_k=K), "cand_w", "wide"))
    out["unscored_pairs"] = _with(*two) + """
SELECT w.src_idx, w.tgt_idx, w.pre_rank FROM wide w
WHERE NOT EXISTS (SELECT 1 FROM narrow n WHERE n.src_idx = w.src_idx AND n.tgt_idx = w.tgt_idx)"""
    out["candidate_coverage"] = _with(*two) + """
SELECT count(*) AS n_candidates, count(n.src_idx) AS n_scored, count(*) - count(n.src_idx) AS n_remaining,
       count(DISTINCT w.src_idx) AS n_sources_with_candidates,
       round(CASE WHEN (SELECT count(*) FROM src) > 0 THEN count(*) / (SELECT count(*) FROM src) ELSE 0.0 END, 9)
         AS avg_per_source
FROM wide w LEFT JOIN narrow n ON n.src_idx = w.src_idx AND n.tgt_idx = w.tgt_idx"""
    wide_cfg = replace(DEMO, search_k=K)
    wide = (base, knn_cte(K), density_cte(DEMO.k_neighbors), ranked_cte(wide_cfg), scored_cte(wide_cfg))
    one, other = _with(*chain), _with(*wide)
    out["covered_sources"] = f"""
SELECT src_idx FROM ({one} SELECT src_idx FROM fp) UNION SELECT src_idx FROM ({other} SELECT src_idx FROM fp)"""
    out["append_scored"] = f"""
WITH a AS ({one} SELECT src_idx, tgt_idx, quality FROM scored), b AS ({other} SELECT src_idx, tgt_idx, quality FROM scored)
SELECT src_idx, tgt_idx, round(quality, 9) AS quality FROM a
UNION ALL SELECT src_idx, tgt_idx, round(quality, 9) FROM b ANTI JOIN a USING (src_idx, tgt_idx)"""
    summary_cols = ["total", "successful", "failed", r("success_rate"), r("weighted_score"),
                    r("total_weighted_score"), "rank_1_count", "rank_2_count", "rank_3_count",
                    r("rank_1_percentage"), r("rank_2_percentage"), r("rank_3_percentage"),
                    r("avg_selected_margin"), r("std_selected_margin")]
    out["run_summary"] = _with(*chain, metrics_cte()) + f"""
SELECT {', '.join(summary_cols)} FROM summary"""
    out["weighted_rank_score"] = _with(*chain, metrics_cte()) + f"""
SELECT total, {r('total_weighted_score')}, {r('weighted_score')} FROM summary"""
    out["margin_stats"] = _with(*chain, metrics_cte()) + f"""
SELECT successful, {r('avg_selected_margin')}, {r('std_selected_margin')} FROM summary"""
    w = ("CAST(CASE WHEN pre_rank IS NULL THEN 0.0 WHEN pre_rank = 1 THEN 1.0 WHEN pre_rank = 2 THEN 0.7 "
         "WHEN pre_rank = 3 THEN 0.5 WHEN pre_rank = 4 THEN 0.3 ELSE 0.1 END AS DOUBLE)")
    out["rank_distribution"] = _with(*chain) + f"""
SELECT pre_rank, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS percentage,
       round(any_value({w}), 9) AS weight
FROM fp GROUP BY pre_rank"""
    cols = ["src_idx", "tgt_idx", "src_text", "tgt_text", r("cosine_score"), r("l2_score"), r("score"),
            r("base_score"), r("z_score"), r("adaptive_score"), r("density"), r("density_bonus"),
            r("density_penalty"), r("final_score"), "pre_rank", r("quality"), r("margin")]
    out["mine_pairs"] = _with(*chain) + f"""
SELECT {', '.join(cols)} FROM fp"""
    out["group_by_source"] = _with(base, knn_cte(k), density_cte(DEMO.k_neighbors), ranked_cte(DEMO)) + """
SELECT src_idx, count(*) AS n_candidates, round(max(final_score), 9) AS best_final_score FROM ranked GROUP BY src_idx"""
    out["vector_norms"] = """
WITH v AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
n AS (SELECT idx, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS nrm FROM v),
u AS (SELECT idx, vec, list_transform(vec, lambda x: CASE WHEN nrm > 0 THEN CAST(CAST(x / nrm AS FLOAT) AS DOUBLE)
                                                      ELSE 0.0 END) AS unit FROM n)
SELECT idx, round(list_inner_product(unit, unit), 9) AS unit_sq_norm, round(list_inner_product(unit, vec), 9) AS dot_raw
FROM u"""
    return out
