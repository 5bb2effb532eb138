"""DuckDB oracle SQL for the MT evaluation queries (n-gram unnest SQL)."""

from __future__ import annotations

# Fixed values, written out: the oracle shares no constant with the engine.
PY_WHITESPACE = [chr(c) for c in (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200,
    8201, 8202, 8232, 8233, 8239, 8287, 12288)]
ENTITIES_13A = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
REGEX_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

WS = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in PY_WHITESPACE) + "]+"


WS_CHARS = "".join(f"\\x{{{ord(c):04x}}}" for c in PY_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {_ws_lit()})"


def _ws_lit() -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"


def split(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}'), lambda t: t <> '')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tok13a(x: str) -> str:
    t = f"rtrim({x}, {_ws_lit()})"
    t = f"replace({t}, '<skipped>', '')"
    t = f"replace({t}, '-' || chr(10), '')"
    t = f"replace({t}, chr(10), ' ')"
    for a, b in ENTITIES_13A:
        t = f"replace({t}, {_q(a)}, {_q(b)})"
    t = f"(' ' || {t} || ' ')"
    for pat, rep in REGEX_13A:
        t = f"regexp_replace({t}, {_q(pat)}, {_q(rep.replace('$', chr(92)))}, 'g')"
    return split(t)


def ev_cte(offset: int = 1, name: str = "ev") -> str:
    return (f"{name} AS (SELECT a.doc_id AS row_id, a.lang AS source, a.text AS hyp, b.text AS ref "
            f"FROM documents a JOIN documents b ON b.doc_id = a.doc_id + {offset})")


def _leads(max_n: int, sep: str) -> str:
    cols = ["u AS g1"]
    for n in range(2, max_n + 1):
        expr = " || ".join(["u"] + [f"{sep}lead(u, {k}) OVER w" if sep else f"lead(u, {k}) OVER w"
                                    for k in range(1, n)])
        cols.append(f"{expr} AS g{n}")
    return ", ".join(cols)


def stats_cte(src: str, hyp_expr: str, ref_expr: str, kind_grams, name: str) -> str:
    """kind_grams: list of (kind, max_n, 'words'|'chars', hyp_input, ref_input). Units
    (tokens or characters) are unnested with their position; n-grams are built with
    lead() over the position order."""
    units, grams = [], []
    for kind, max_n, unit, h, r in kind_grams:
        for side, col in ((0, h), (1, r)):
            if unit == "words":
                units.append(f"SELECT row_id, {side} AS side, '{kind}' AS kind, unnest({col}) AS u, "
                             f"unnest(range(len({col}))) AS pos FROM {name}_in")
            else:
                units.append(f"SELECT row_id, {side} AS side, '{kind}' AS kind, "
                             f"substring({col}, pos, 1) AS u, pos FROM "
                             f"(SELECT row_id, {col}, unnest(range(1, length({col}) + 1)) AS pos FROM {name}_in)")
        sep = "' ' || " if unit == "words" else ""
        grams.append((kind, max_n, sep))
    lead_sets = []
    for kind, max_n, sep in grams:
        lead_sets.append(f"""{name}_l_{kind} AS (SELECT row_id, side, {_leads(max_n, sep)} FROM {name}_u
            WHERE kind = '{kind}' WINDOW w AS (PARTITION BY row_id, side ORDER BY pos))""")
    unp = []
    for kind, max_n, _ in grams:
        for n in range(1, max_n + 1):
            unp.append(f"SELECT row_id, side, '{kind}' AS kind, {n} AS n, g{n} AS g FROM {name}_l_{kind} "
                       f"WHERE g{n} IS NOT NULL")
    return f"""
{name}_in AS MATERIALIZED (SELECT row_id, {hyp_expr}, {ref_expr} FROM {src}),
{name}_u AS ({' UNION ALL '.join(units)}),
{', '.join(lead_sets)},
{name}_g AS ({' UNION ALL '.join(unp)}),
{name}_c AS (SELECT row_id, kind, n, g, count(*) FILTER (WHERE side = 0) AS p, count(*) FILTER (WHERE side = 1) AS r
             FROM {name}_g GROUP BY row_id, kind, n, g),
{name} AS (SELECT row_id, kind, n, sum(least(p, r)) AS m, sum(p) AS h, sum(r) AS rr FROM {name}_c GROUP BY row_id, kind, n)"""


def pivot(stats: str, orders, group: str = "row_id") -> str:
    cols = []
    for kind, n in orders:
        for x, c in (("m", "m"), ("h", "h"), ("r", "rr")):
            cols.append(f"CAST(coalesce(sum({c}) FILTER (WHERE kind = '{kind}' AND n = {n}), 0) AS DOUBLE) AS {kind}{x}{n}")
    sel = f"{group}, " if group else ""
    grp = f" GROUP BY {group}" if group else ""
    return f"SELECT {sel}{', '.join(cols)} FROM {stats}{grp}"


def bleu_expr() -> str:
    logs, zeros = [], []
    for n in range(1, 5):
        zeros.append(f"(CASE WHEN wm{n} = 0 THEN 1 ELSE 0 END)")
        z = " + ".join(zeros)
        logs.append(f"ln(CASE WHEN wm{n} > 0 THEN 100.0 * wm{n} / wh{n} ELSE 100.0 / (pow(2.0, {z}) * wh{n}) END)")
    bp = "(CASE WHEN wh1 < wr1 THEN exp(1.0 - wr1 / wh1) ELSE 1.0 END)"
    return (f"(CASE WHEN wh4 > 0 AND wm1 + wm2 + wm3 + wm4 > 0 "
            f"THEN {bp} * exp(({' + '.join(logs)}) / 4.0) ELSE 0.0 END)")


def chrf_expr(orders) -> str:
    both = [f"(wh{n} > 0 AND wr{n} > 0)".replace("w", k, 1).replace("w", k, 1) for k, n in orders]
    eff = " + ".join(f"(CASE WHEN {k}h{n} > 0 AND {k}r{n} > 0 THEN 1 ELSE 0 END)" for k, n in orders)
    sp = " + ".join(f"(CASE WHEN {k}h{n} > 0 AND {k}r{n} > 0 THEN {k}m{n} / {k}h{n} ELSE 0.0 END)" for k, n in orders)
    sr = " + ".join(f"(CASE WHEN {k}h{n} > 0 AND {k}r{n} > 0 THEN {k}m{n} / {k}r{n} ELSE 0.0 END)" for k, n in orders)
    del both
    ap = f"(CASE WHEN ({eff}) > 0 THEN ({sp}) / ({eff}) ELSE 0.0 END)"
    ar = f"(CASE WHEN ({eff}) > 0 THEN ({sr}) / ({eff}) ELSE 0.0 END)"
    return (f"(CASE WHEN {ap} + {ar} > 0 THEN 100.0 * (1.0 + 4.0) * {ap} * {ar} / (4.0 * {ap} + {ar}) ELSE 0.0 END)")


def blank(alias: str = "ev") -> str:
    return f"({alias}.ref IS NULL OR {strip(alias + '.ref')} = '' OR {alias}.hyp IS NULL)"


BLEU_ORDERS = [("w", n) for n in range(1, 5)]
CHRF_ORDERS = [("c", n) for n in range(1, 7)]
CHRFPP_ORDERS = CHRF_ORDERS + [("w", 1), ("w", 2)]


def punct_split(toks: str) -> str:
    p = _q(PUNCTUATION)
    return (f"flatten(list_transform({toks}, lambda w: CASE WHEN length(w) = 1 THEN [w] "
            f"WHEN instr({p}, substring(w, length(w), 1)) > 0 THEN [substring(w, 1, length(w) - 1), substring(w, length(w), 1)] "
            f"WHEN instr({p}, substring(w, 1, 1)) > 0 THEN [substring(w, 1, 1), substring(w, 2, length(w) - 1)] "
            f"ELSE [w] END))")


def nows(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def bleu_ctes(src="ev", name="bs") -> str:
    return stats_cte(src, f"{tok13a('hyp')} AS ht", f"{tok13a('ref')} AS rt",
                     [("w", 4, "words", "ht", "rt")], name) + f""",
{name}_p AS ({pivot(name, BLEU_ORDERS)}),
{name}_s AS (SELECT ev.row_id, CASE WHEN {blank("ev")} THEN NULL ELSE coalesce({bleu_expr()}, 0.0) END AS bleu
             FROM {src} ev LEFT JOIN {name}_p USING (row_id))"""


def chrf_ctes(src="ev", name="cs", words=False) -> str:
    kg = [("c", 6, "chars", "hc", "rc")]
    hyp = f"{nows('hyp')} AS hc"
    ref = f"{nows('ref')} AS rc"
    if words:
        kg.append(("w", 2, "words", "hw", "rw"))
        hyp += f", {punct_split(split('hyp'))} AS hw"
        ref += f", {punct_split(split('ref'))} AS rw"
    orders = CHRFPP_ORDERS if words else CHRF_ORDERS
    col = "chrf_pp" if words else "chrf"
    return stats_cte(src, hyp, ref, kg, name) + f""",
{name}_p AS ({pivot(name, orders)}),
{name}_s AS (SELECT ev.row_id, CASE WHEN {blank("ev")} THEN NULL ELSE coalesce({chrf_expr(orders)}, 0.0) END AS {col}
             FROM {src} ev LEFT JOIN {name}_p USING (row_id))"""


def meteor_ctes(src="ev") -> str:
    return f"""
mt_t AS (SELECT row_id, 0 AS side, {split('lower(hyp)')} AS t FROM {src}
         UNION ALL SELECT row_id, 1 AS side, {split('lower(ref)')} AS t FROM {src}),
mt_p AS (SELECT row_id, side, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM mt_t),
mt_o AS (SELECT *, row_number() OVER (PARTITION BY row_id, side, tok ORDER BY pos DESC) AS occ FROM mt_p),
mt_m AS (SELECT h.row_id, h.pos AS hp, r.pos AS rp FROM mt_o h JOIN mt_o r
         ON h.row_id = r.row_id AND h.tok = r.tok AND h.occ = r.occ AND h.side = 0 AND r.side = 1),
mt_b AS (SELECT row_id, CASE WHEN lag(hp) OVER w + 1 = hp AND lag(rp) OVER w + 1 = rp THEN 0 ELSE 1 END AS brk
         FROM mt_m WINDOW w AS (PARTITION BY row_id ORDER BY hp)),
mt_c AS (SELECT row_id, count(*) AS matches, sum(brk) AS chunks FROM mt_b GROUP BY row_id),
mt_l AS (SELECT row_id, sum(CASE WHEN side = 0 THEN len(t) END) AS hl, sum(CASE WHEN side = 1 THEN len(t) END) AS rl
         FROM mt_t GROUP BY row_id),
mt_s AS (
  SELECT ev.row_id, CASE WHEN {blank("ev")} THEN NULL
    WHEN coalesce(c.matches, 0) = 0 THEN 0.0
    ELSE (1.0 - 0.5 * pow(CAST(c.chunks AS DOUBLE) / c.matches, 3.0))
         * ((CAST(c.matches AS DOUBLE) / l.hl) * (CAST(c.matches AS DOUBLE) / l.rl)
            / (CAST(0.9 AS DOUBLE) * (CAST(c.matches AS DOUBLE) / l.hl)
               + (CAST(1.0 AS DOUBLE) - CAST(0.9 AS DOUBLE)) * (CAST(c.matches AS DOUBLE) / l.rl))) END AS meteor
  FROM {src} ev LEFT JOIN mt_l l USING (row_id) LEFT JOIN mt_c c USING (row_id))"""


def _r(c):
    return f"round({c}, 9) AS {c}"


def sql() -> dict[str, str]:
    ev = ev_cte()
    good = "evg AS (SELECT * FROM ev WHERE NOT " + blank("ev") + ")"
    out = {
        "bleu_rows": f"WITH {ev}, {bleu_ctes()} SELECT row_id, {_r('bleu')} FROM bs_s",
        "chrf_rows": f"WITH {ev}, {chrf_ctes()} SELECT row_id, {_r('chrf')} FROM cs_s",
        "chrf_pp": f"WITH {ev}, {chrf_ctes(name='cp', words=True)} SELECT row_id, {_r('chrf_pp')} FROM cp_s",
        "meteor_rows": f"WITH {ev}, {meteor_ctes()} SELECT row_id, {_r('meteor')} FROM mt_s",
        "corpus_bleu": f"WITH {ev}, {good}, " + stats_cte("evg", f"{tok13a('hyp')} AS ht", f"{tok13a('ref')} AS rt",
                                                            [("w", 4, "words", "ht", "rt")], "cb")
        + f", cb_p AS ({pivot('cb', BLEU_ORDERS, group='')}) SELECT round({bleu_expr()}, 9) AS bleu FROM cb_p",
        "corpus_chrf": f"WITH {ev}, {good}, " + stats_cte("evg", f"{nows('hyp')} AS hc", f"{nows('ref')} AS rc",
                                                            [("c", 6, "chars", "hc", "rc")], "cc")
        + f", cc_p AS ({pivot('cc', CHRF_ORDERS, group='')}) SELECT round({chrf_expr(CHRF_ORDERS)}, 9) AS chrf FROM cc_p",
    }
    allm = f"WITH {ev}, {bleu_ctes()}, {chrf_ctes()}, {meteor_ctes()}"
    out["evaluate_table"] = allm + f""" SELECT ev.row_id, ev.source, round(bs_s.bleu, 9) AS bleu,
        round(cs_s.chrf, 9) AS chrf, round(mt_s.meteor, 9) AS meteor
        FROM ev JOIN bs_s USING (row_id) JOIN cs_s USING (row_id) JOIN mt_s USING (row_id)"""
    out["metric_means"] = allm + """ SELECT round(avg(bs_s.bleu), 9) AS mean_bleu, round(avg(cs_s.chrf), 9) AS mean_chrf,
        round(avg(mt_s.meteor), 9) AS mean_meteor
        FROM ev JOIN bs_s USING (row_id) JOIN cs_s USING (row_id) JOIN mt_s USING (row_id)"""
    ev2 = ("ev2 AS (SELECT ev.row_id, ev.source, d.text AS hyp, ev.ref FROM ev "
           "JOIN documents d ON d.doc_id + 1 = ev.row_id)")
    out["compare_runs"] = (f"WITH {ev}, {ev2}, {bleu_ctes('ev', 'ba')}, {chrf_ctes('ev', 'ca')}, "
                           f"{bleu_ctes('ev2', 'bb')}, {chrf_ctes('ev2', 'cb')}" + """
SELECT ba_s.row_id, round(ba_s.bleu, 9) AS bleu_a, round(ca_s.chrf, 9) AS chrf_a,
       round(bb_s.bleu, 9) AS bleu_b, round(cb_s.chrf, 9) AS chrf_b,
       round(bb_s.bleu - ba_s.bleu, 9) AS delta_bleu, round(cb_s.chrf - ca_s.chrf, 9) AS delta_chrf
FROM ba_s JOIN ca_s USING (row_id) JOIN bb_s USING (row_id) JOIN cb_s USING (row_id)""")
    return out
