"""DuckDB oracle SQL for the sweep queries: every grid row applied to every candidate
(brute force), formulas as in the mining oracle with the parameters as columns."""

from __future__ import annotations

from pairmine.oracles.mining import density_cte, knn_cte, vectors_cte

# Fixed values, written out: the oracle shares no constant with the engine.
INT_PARAMS = {"search_k", "top_after_filtering"}
GRID_COLUMNS = ["experiment_id", "search_k", "top_after_filtering", "quality_threshold",
                "cosine_weight", "l2_weight", "base_weight", "z_weight", "z_threshold",
                "sparse_bonus", "crowded_penalty", "sparse_threshold", "crowded_threshold"]
MINIMAL_LISTS = [
    ("base_weight", [0.6, 0.7, 0.8]), ("sparse_bonus", [0.01, 0.10, 0.3]), ("crowded_penalty", [0.01, 0.15, 0.3]),
    ("z_threshold", [-1.0]), ("cosine_weight", [0.6, 0.7, 0.8]), ("sparse_threshold", [0.1, 0.3]),
    ("crowded_threshold", [0.1, 0.3]), ("search_k", [100]), ("top_after_filtering", [5]), ("quality_threshold", [0.70])]
FOCUSED_LISTS = [
    ("base_weight", [0.5, 0.6, 0.7, 0.8]), ("z_threshold", [-1.5, -1.0, -0.5]), ("cosine_weight", [0.5, 0.6, 0.7, 0.8]),
    ("sparse_bonus", [0.05, 0.10, 0.15]), ("crowded_penalty", [0.10, 0.15, 0.20]), ("sparse_threshold", [0.3]),
    ("crowded_threshold", [0.1]), ("search_k", [100]), ("top_after_filtering", [5]), ("quality_threshold", [0.50, 0.75])]
# In the order of GRID_COLUMNS: three ablations, then two configs that fail.
BASELINE = [(10001, 100, 5, 0.70, 0.6, 0.4, 1.0, 0.0, -1.0, 0.1, 0.15, 0.3, 0.1),
            (10002, 100, 5, 0.70, 0.6, 0.4, 0.6, 0.4, -1.0, 0.0, 0.0, 0.3, 0.1),
            (10003, 100, 5, 0.70, 0.6, 0.4, 1.0, 0.0, -1.0, 0.0, 0.0, 0.3, 0.1)]
FAILING = [(10004, 100, 5, 0.70, 0.6, 0.4, 0.6, 0.4, 5.0, 0.1, 0.15, 0.3, 0.1),
           (10005, 100, 5, 0.70, 0.6, 0.4, 0.6, 0.4, None, 0.1, 0.15, 0.3, 0.1)]


def _typed(c: str) -> str:
    if c == "experiment_id":
        return f"CAST({c} AS BIGINT) AS {c}"
    return f"CAST({c} AS INTEGER) AS {c}" if c in INT_PARAMS else f"CAST({c} AS DOUBLE) AS {c}"


def grid_sql(lists, name: str) -> str:
    parts, id_expr = [], "0"
    for i, (col, values) in enumerate(lists):
        vals = ", ".join(repr(float(v)) for v in values)
        parts.append(f"(SELECT unnest(CAST([{vals}] AS DOUBLE[])) AS {col}, "
                     f"unnest(range({len(values)})) AS p{i}) t{i}")
        id_expr = f"({id_expr}) * {len(values)} + p{i}"
    body = (f"SELECT *, {id_expr} + 1 AS experiment_id, round(1.0 - base_weight, 2) AS z_weight, "
            f"round(1.0 - cosine_weight, 2) AS l2_weight FROM " + ", ".join(parts))
    return f"{name} AS (SELECT {', '.join(_typed(c) for c in GRID_COLUMNS)} FROM ({body}))"


def rows_sql(rows, name: str) -> str:
    vals = ", ".join("(" + ", ".join("NULL" if v is None else repr(float(v)) for v in r) + ")" for r in rows)
    return (f"{name} AS (SELECT {', '.join(_typed(c) for c in GRID_COLUMNS)} FROM "
            f"(VALUES {vals}) v({', '.join(GRID_COLUMNS)}))")


COMPLETE = " AND ".join(f"g.{c} IS NOT NULL" for c in GRID_COLUMNS)


def sweep_cte(grid: str = "grid", k_max: int = 100) -> str:
    return ",".join([vectors_cte(), knn_cte(k_max), density_cte(20), f"""
x0 AS (
  SELECT g.*, c.src_idx, c.tgt_idx, c.dot AS cosine_score,
         CASE WHEN c.l2_rank <= g.search_k THEN 1.0 / (1.0 + c.sqd) ELSE 1.0 / (1.0 + sqrt(c.sqd)) END AS l2_score
  FROM cand c, {grid} g
  WHERE (c.ip_rank <= g.search_k OR c.l2_rank <= g.search_k) AND {COMPLETE}),
x1 AS (SELECT *, cosine_weight * cosine_score + l2_weight * l2_score AS score,
              NOT (base_weight = 1.0 AND z_weight = 0.0) AS aon_,
              NOT (sparse_bonus = 0.0 AND crowded_penalty = 0.0) AS don_ FROM x0),
x2 AS (SELECT *, count(*) OVER w AS n_, avg(score) OVER w AS mean_, stddev_pop(score) OVER w AS std_
       FROM x1 WINDOW w AS (PARTITION BY experiment_id, src_idx)),
x3 AS (SELECT *, aon_ AND NOT (n_ < 3 OR std_ < 1e-8) AS active_ FROM x2),
x4 AS (SELECT *, CASE WHEN active_ THEN least(greatest((score - mean_) / (std_ + 1e-8), -5.0), 5.0) ELSE 0.0 END AS z_score
       FROM x3),
x5 AS (SELECT *, CASE WHEN active_ THEN least(greatest(base_weight * score
                      + z_weight * least(greatest(z_score / 3.0, -1.0), 1.0), 0.0), 1.0) ELSE score END AS adaptive_score
       FROM x4 WHERE NOT active_ OR z_score > z_threshold),
x6 AS (SELECT x5.*, CASE WHEN don_ AND d.has_neighbors THEN d.density END AS draw_
       FROM x5 LEFT JOIN dens d USING (tgt_idx)),
x7 AS (SELECT *,
         CASE WHEN draw_ IS NOT NULL AND draw_ > sparse_threshold THEN sparse_bonus ELSE 0.0 END AS density_bonus,
         CASE WHEN draw_ IS NOT NULL AND draw_ < crowded_threshold THEN crowded_penalty ELSE 0.0 END AS density_penalty
       FROM x6),
x8 AS (SELECT *, CASE WHEN draw_ IS NOT NULL THEN least(greatest(adaptive_score + density_bonus - density_penalty, 0.0), 1.0)
                      ELSE adaptive_score END AS final_score FROM x7),
x9 AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, src_idx ORDER BY final_score DESC,
               (CASE WHEN aon_ THEN adaptive_score ELSE 0.0 END) DESC, tgt_idx) AS pre_rank FROM x8),
rk AS (SELECT * FROM x9 WHERE pre_rank <= top_after_filtering),
sq AS (SELECT rk.*, ta.text AS tgt_text,
              0.5 * greatest(cosine_score, 0.0) + 0.5 * (CASE WHEN sa.label = ta.label THEN 1.0 ELSE 0.0 END) AS quality
       FROM rk JOIN attrs sa ON sa.idx = rk.src_idx JOIN attrs ta ON ta.idx = rk.tgt_idx),
c1 AS (SELECT *, coalesce(quality, 0.0) >= quality_threshold AS passes_ FROM sq),
c2 AS (SELECT *, (row_number() OVER (PARTITION BY experiment_id, src_idx ORDER BY passes_ DESC, quality DESC NULLS LAST,
                  pre_rank) = 1) AND passes_ AS is_chosen FROM c1),
c3 AS (SELECT *, max(CASE WHEN is_chosen THEN tgt_text END) OVER (PARTITION BY experiment_id, src_idx) AS chosen_text FROM c2),
c4 AS (SELECT *, max(CASE WHEN tgt_text <> chosen_text THEN final_score END)
                   OVER (PARTITION BY experiment_id, src_idx) AS best_other FROM c3),
fp AS (SELECT *, final_score - coalesce(best_other, final_score) AS margin FROM c4 WHERE is_chosen),
agg AS (SELECT experiment_id, count(*) AS successful,
               sum(CAST(CASE WHEN pre_rank = 1 THEN 1.0 WHEN pre_rank = 2 THEN 0.7 WHEN pre_rank = 3 THEN 0.5
                        WHEN pre_rank = 4 THEN 0.3 ELSE 0.1 END AS DOUBLE)) AS total_weighted_score,
               count(*) FILTER (WHERE pre_rank = 1) AS rank_1_count,
               count(*) FILTER (WHERE pre_rank = 2) AS rank_2_count,
               count(*) FILTER (WHERE pre_rank = 3) AS rank_3_count,
               avg(margin) AS am_, stddev_pop(margin) AS sm_
        FROM fp GROUP BY experiment_id),
seen AS (SELECT experiment_id, count(*) AS n_ranked FROM rk GROUP BY experiment_id),
ns AS (SELECT count(*) AS total FROM src),
res AS (
  SELECT g.*, CASE WHEN coalesce(seen.n_ranked, 0) > 0 THEN 'completed' ELSE 'failed' END AS status,
         ns.total, coalesce(agg.successful, 0) AS successful,
         ns.total - coalesce(agg.successful, 0) AS failed,
         CASE WHEN ns.total > 0 THEN coalesce(agg.successful, 0) * 100.0 / ns.total ELSE 0.0 END AS success_rate,
         CASE WHEN ns.total > 0 THEN coalesce(agg.total_weighted_score, CAST(0.0 AS DOUBLE)) / ns.total ELSE 0.0 END AS weighted_score,
         coalesce(agg.total_weighted_score, CAST(0.0 AS DOUBLE)) AS total_weighted_score,
         coalesce(agg.rank_1_count, 0) AS rank_1_count, coalesce(agg.rank_2_count, 0) AS rank_2_count,
         coalesce(agg.rank_3_count, 0) AS rank_3_count,
         CASE WHEN coalesce(agg.successful, 0) > 0 THEN agg.rank_1_count * 100.0 / agg.successful ELSE 0.0 END AS rank_1_percentage,
         CASE WHEN coalesce(agg.successful, 0) > 0 THEN agg.rank_2_count * 100.0 / agg.successful ELSE 0.0 END AS rank_2_percentage,
         CASE WHEN coalesce(agg.successful, 0) > 0 THEN agg.rank_3_count * 100.0 / agg.successful ELSE 0.0 END AS rank_3_percentage,
         coalesce(agg.am_, 0.0) AS avg_selected_margin,
         CASE WHEN coalesce(agg.successful, 0) > 1 THEN agg.sm_ ELSE 0.0 END AS std_selected_margin,
         coalesce(agg.successful, 0) AS total_pairs,
         CASE WHEN NOT ({COMPLETE}) THEN 'missing parameter: z_threshold'
              WHEN coalesce(seen.n_ranked, 0) = 0 THEN 'no candidate left' END AS error
  FROM {grid} g CROSS JOIN ns LEFT JOIN agg USING (experiment_id) LEFT JOIN seen USING (experiment_id))"""])


def _r(c: str) -> str:
    return f"round({c}, 9) AS {c}"


RESULT_COLS = ["experiment_id", "status", "total", "successful", "failed", _r("success_rate"), _r("weighted_score"),
               _r("total_weighted_score"), "rank_1_count", "rank_2_count", "rank_3_count",
               _r("rank_1_percentage"), _r("rank_2_percentage"), _r("rank_3_percentage"),
               _r("avg_selected_margin"), _r("std_selected_margin"), "total_pairs"] + [
    c if c in INT_PARAMS else _r(c) for c in GRID_COLUMNS if c != "experiment_id"] + ["error"]


def sql() -> dict[str, str]:
    gm = grid_sql(MINIMAL_LISTS, "grid_min")
    gf = grid_sql(FOCUSED_LISTS, "grid_foc")
    gb = rows_sql(BASELINE, "grid_base") + "," + rows_sql(FAILING, "grid_fail")
    grid = ("grid AS (SELECT * FROM grid_min UNION ALL SELECT * FROM grid_base "
            "UNION ALL SELECT * FROM grid_fail)")
    sweep = "WITH " + ",".join([gm, gb, grid, sweep_cte("grid")])
    out = {
        **{name: f"""WITH {cte}, {vectors_cte()},
n AS (SELECT (SELECT count(*) FROM src) AS n_sources, (SELECT count(*) FROM tgt) AS n_targets)
SELECT g.*, n_sources, n_sources * least(2 * search_k, n_targets) AS max_pairs FROM {t} g, n"""
           for name, cte, t in (("grid_minimal", gm, "grid_min"), ("grid_focused", gf, "grid_foc"),
                                ("grid_baseline", gb, "grid_base"))},
        "run_sweep": sweep + f" SELECT {', '.join(RESULT_COLS)} FROM res",
        "sweep_best_pairs": sweep + """,
best AS (SELECT experiment_id FROM res WHERE status = 'completed' ORDER BY round(weighted_score, 9) DESC, experiment_id LIMIT 1)
SELECT experiment_id, src_idx, tgt_idx, CAST(pre_rank AS INTEGER) AS pre_rank, round(final_score, 9) AS final_score,
       round(quality, 9) AS quality, round(margin, 9) AS margin
FROM fp WHERE experiment_id IN (SELECT experiment_id FROM best)""",
        "best_experiment": sweep + """
SELECT experiment_id, round(weighted_score, 9) AS weighted_score FROM res WHERE status = 'completed'
ORDER BY round(weighted_score, 9) DESC, experiment_id LIMIT 1""",
        "leaderboard": sweep + """,
lb AS (SELECT *, CAST(row_number() OVER (ORDER BY round(weighted_score, 9) DESC, experiment_id) AS INTEGER) AS position
       FROM res WHERE status = 'completed')
SELECT position, experiment_id, round(weighted_score, 9) AS weighted_score,
       round(avg_selected_margin, 9) AS avg_selected_margin, round(std_selected_margin, 9) AS std_selected_margin
FROM lb WHERE position <= 10""",
        "best_by_margin": sweep + """
SELECT experiment_id, round(avg_selected_margin, 9) AS avg_selected_margin FROM res WHERE status = 'completed'
ORDER BY round(avg_selected_margin, 9) DESC, experiment_id LIMIT 1""",
        "status_counts": sweep + " SELECT status, count(*) AS n FROM res GROUP BY status",
        "running_best": sweep + """,
rb AS (SELECT *, max(CASE WHEN status = 'completed' THEN round(weighted_score, 9) END)
                   OVER (ORDER BY experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_
       FROM res)
SELECT experiment_id, round(weighted_score, 9) AS weighted_score,
       status = 'completed' AND (prev_ IS NULL OR round(weighted_score, 9) > prev_) AS is_new_best FROM rb""",
        "pending_experiments": "WITH " + ",".join([gm, gb, grid, sweep_cte("grid_base")]) + """
SELECT g.* FROM grid g WHERE g.experiment_id NOT IN (SELECT experiment_id FROM res WHERE status = 'completed')""",
    }
    return out
