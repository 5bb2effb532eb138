"""DuckDB oracle SQL for the model plug-in and file queries."""

from __future__ import annotations

from pairmine.oracles import mining as OM
from pairmine.oracles import sweep as OS
from pairmine.oracles.mt import bleu_ctes, ev_cte, meteor_ctes, split, strip
from pairmine.oracles.prep import PAIRS

# Fixed values, written out: the oracle shares no constant with the engine.
DIM, GRAM = 64, 3
NULL_MARKERS = ("('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', "
                "'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')")
CORPUS = OM.MiningConfig(quality_threshold=0.05)


def embed_cte(table: str, key: str, text: str, name: str) -> str:
    """Signed counts of MD5-hashed trigrams of ' text ', divided by their norm."""
    return f"""
{name}_t AS (SELECT {key} AS idx, ' ' || {text} || ' ' AS s FROM {table} WHERE {text} <> ''),
{name}_g AS (SELECT idx, md5(substring(s, CAST(p AS BIGINT), {GRAM})) AS h
             FROM (SELECT idx, s, unnest(range(1, greatest(length(s) - {GRAM} + 2, 2))) AS p FROM {name}_t)),
{name}_c AS (SELECT idx, CAST(('0x' || substr(h, 2, 4))::BIGINT % {DIM} AS INTEGER) AS cell,
                    sum(CASE WHEN ('0x' || substr(h, 1, 1))::BIGINT % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS n
             FROM {name}_g GROUP BY 1, 2),
{name} AS (SELECT idx, cell, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY idx)) AS FLOAT)::DOUBLE AS w FROM {name}_c)"""


def vector_cte(table: str, name: str) -> str:
    return f"""
{name} AS (SELECT t.idx, list(coalesce(e.w, 0.0) ORDER BY c.cell) AS vec
           FROM {table} t CROSS JOIN (SELECT unnest(range({DIM})) AS cell) c
           LEFT JOIN {name}_e e ON e.idx = t.idx AND e.cell = c.cell GROUP BY t.idx)"""


def overlap(a: str, b: str) -> str:
    x, y = f"list_distinct({split(a)})", f"list_distinct({split(b)})"
    return (f"(CASE WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / "
            f"len(list_distinct(list_concat({x}, {y}))) END)")


def mine_corpus_sql() -> str:
    flat = strip("regexp_replace(text, '[\\r\\n]', ' ', 'g')")
    cfg = CORPUS
    return "WITH " + ",".join([f"""
si AS (SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS idx, x AS text
       FROM (SELECT item_id, {flat} AS x FROM benchmark) WHERE x <> ''),
ti AS (SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS idx, x AS text
       FROM (SELECT conv_id, turn, {flat} AS x FROM conversations WHERE role = 'assistant') WHERE x <> '')""",
        embed_cte("si", "idx", "text", "src_e"), embed_cte("ti", "idx", "text", "tgt_e"),
        vector_cte("si", "src"), vector_cte("ti", "tgt"), OM.knn_cte(cfg.search_k), OM.density_cte(cfg.k_neighbors),
        OM.ranked_cte(cfg), f"""
wt AS (SELECT r.*, s.text AS src_text, t.text AS tgt_text, {overlap('s.text', 't.text')} AS quality
       FROM ranked r JOIN si s ON s.idx = r.src_idx JOIN ti t ON t.idx = r.tgt_idx),
ch AS (SELECT *, coalesce(quality, 0.0) >= {OM.d(cfg.quality_threshold)} AS passes_ FROM wt),
ch2 AS (SELECT *, (row_number() OVER (PARTITION BY src_idx ORDER BY passes_ DESC, quality DESC NULLS LAST, pre_rank) = 1)
                  AND passes_ AS is_chosen FROM ch),
ch3 AS (SELECT *, max(CASE WHEN is_chosen THEN tgt_text END) OVER (PARTITION BY src_idx) AS chosen_text FROM ch2),
ch4 AS (SELECT *, max(CASE WHEN tgt_text <> chosen_text THEN final_score END) OVER (PARTITION BY src_idx) AS best_other
        FROM ch3)"""]) + """
SELECT src_idx, tgt_idx, src_text, tgt_text, round(final_score, 6) AS final_score, pre_rank,
       round(quality, 6) AS quality, round(final_score - coalesce(best_other, final_score), 6) AS margin
FROM ch4 WHERE is_chosen"""


def sql() -> dict[str, str]:
    chain = (OM.vectors_cte(), OM.knn_cte(20), OM.density_cte(20), OM.ranked_cte(OM.DEMO), OM.scored_cte(OM.DEMO))
    lines = "'\\r\\n|\\r|\\n'"
    flat = lambda c: f"'> ' || regexp_replace({c}, '[\\r\\n]', ' ', 'g')"
    grid = OS.rows_sql(OS.BASELINE + OS.FAILING, "grid")
    return {
        "embed": "WITH " + embed_cte("documents", "doc_id", "text", "e") + """
SELECT idx, cell, round(w, 6) AS w FROM e WHERE w <> 0""",
        "translate": f"""WITH {PAIRS}
SELECT idx, src_text AS translation, CAST(NULL AS VARCHAR) AS error, 'user-assistant' AS direction FROM pairs
UNION ALL SELECT idx, tgt_text, NULL, 'assistant-user' FROM pairs""",
        "quality_score": f"""WITH {PAIRS}
SELECT idx AS src_idx, idx AS tgt_idx, round({overlap('src_text', 'tgt_text')}, 9) AS quality FROM pairs""",
        "model_metric": f"""SELECT a.doc_id AS row_id,
  CASE WHEN {strip('b.text')} <> '' THEN
    round(least(length(a.text), length(b.text))::DOUBLE / greatest(length(a.text), length(b.text), 1), 9) END AS length_ratio
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""",
        "read_sentences": f"""WITH l AS (
  SELECT doc_id, unnest(string_split_regex(text, {lines})) AS line,
         unnest(range(len(string_split_regex(text, {lines})))) AS line_no FROM documents),
s AS (SELECT doc_id, line_no, {strip('line')} AS text FROM l)
SELECT CAST(row_number() OVER (ORDER BY doc_id, line_no) - 1 AS BIGINT) AS idx, text FROM s WHERE text <> ''""",
        "read_pairs_csv": f"""WITH {PAIRS}
SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS idx, src_text, tgt_text FROM pairs
WHERE src_text NOT IN {NULL_MARKERS} AND tgt_text NOT IN {NULL_MARKERS}""",
        "read_eval_csv": f"""WITH {PAIRS}
SELECT idx AS row_id, src_text AS source, src_text AS prediction, tgt_text AS reference,
       src_text AS input, src_text AS translation FROM pairs""",
        "write_eval": f"""WITH {PAIRS},
ev AS (SELECT idx AS row_id, src_text AS hyp, tgt_text AS ref FROM pairs), {bleu_ctes()}
SELECT row_id, round(bleu, 9) AS bleu FROM bs_s""",
        "read_aligned_lines": f"""WITH {PAIRS}
SELECT idx, {flat('src_text')} AS source, {flat('tgt_text')} AS reference FROM pairs""",
        "stage_roundtrip": "WITH " + ",".join(chain) + """
SELECT src_idx, tgt_idx, pre_rank, round(quality, 9) AS quality FROM fp""",
        "sweep_results_kept": "WITH " + ",".join([grid, OS.sweep_cte("grid")]) + """
SELECT experiment_id, status, successful, round(weighted_score, 9) AS weighted_score, error FROM res""",
        "sweep_from_file": "WITH " + ",".join([OS.rows_sql(OS.BASELINE[:2], "grid"), OS.sweep_cte("grid")]) + f"""
SELECT {', '.join(OS.RESULT_COLS)} FROM res""",
        "aligned_first_n": f"""WITH {PAIRS}
SELECT idx, {flat('src_text')} AS source, {flat('tgt_text')} AS reference FROM pairs WHERE idx < 100""",
        "blank_references": "WITH " + ev_cte() + ", " + bleu_ctes() + ", " + meteor_ctes() + """
SELECT b.row_id, round(bleu, 9) AS bleu, round(meteor, 9) AS meteor FROM bs_s b JOIN mt_s m USING (row_id)
UNION ALL SELECT -1 - row_id, NULL, NULL FROM ev UNION ALL SELECT -1000000000 - row_id, NULL, NULL FROM ev""",
        "density_non_finite": "WITH " + OM.vectors_cte() + ", " + OM.density_cte(20) + """
SELECT tgt_idx, round(avg_neighbor_sim, 9) AS avg_neighbor_sim, round(density, 9) AS density, has_neighbors FROM dens
UNION ALL SELECT idx + 1000000000, 0.0, 0.5, TRUE FROM tgt UNION ALL SELECT idx + 2000000000, 0.0, 0.5, TRUE FROM tgt""",
        "sweep_best_so_far": "WITH " + ",".join([OS.rows_sql(OS.BASELINE, "grid"), OS.sweep_cte("grid")]) + """,
best AS (SELECT experiment_id FROM res WHERE status = 'completed' ORDER BY round(weighted_score, 9) DESC, experiment_id LIMIT 1)
SELECT experiment_id, src_idx, tgt_idx, CAST(pre_rank AS INTEGER) AS pre_rank, round(final_score, 9) AS final_score,
       round(quality, 9) AS quality, round(margin, 9) AS margin
FROM fp WHERE experiment_id IN (SELECT experiment_id FROM best)""",
        "sweep_isolated": "WITH " + ",".join([OS.rows_sql([(r[0], 20, *r[2:]) for r in OS.BASELINE], "grid"),
                                              OS.sweep_cte("grid")]) + """
SELECT experiment_id, status, successful, round(weighted_score, 9) AS weighted_score, error FROM res
UNION ALL SELECT 10006, 'failed', 0, 0.0, 'USER_RAISED_EXCEPTION: no quality beyond rank 20'""",
        "mine_corpus": mine_corpus_sql(),
        "mine_corpus_resumed": mine_corpus_sql(),
        "restore_order": "WITH " + ",".join(chain) + """
SELECT CAST(row_number() OVER (ORDER BY src_idx) - 1 AS BIGINT) AS idx, src_idx, tgt_idx FROM fp""",
        "incremental_scoring": f"""WITH {PAIRS}
SELECT idx AS src_idx, idx AS tgt_idx, round({overlap('src_text', 'tgt_text')}, 9) AS quality FROM pairs""",
    }
