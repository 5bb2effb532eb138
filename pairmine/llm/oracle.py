"""DuckDB SQL for the queries of the subpackage that SQL can express."""

from __future__ import annotations

OP7 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS key,
         row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS k,
         count(*) OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS m
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sized GROUP BY source),
lim AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS at FROM per),
lev AS (
  SELECT a.source, a.source_size, a.w, a.cap, row_number() OVER (ORDER BY a.at, a.source ASC NULLS LAST) AS pos
  FROM lim a),
run AS (
  SELECT l.*, ((SELECT sum(source_size) FROM lev) - coalesce((SELECT sum(cap) FROM lev p WHERE p.pos < l.pos), 0))::DOUBLE
              / ((SELECT sum(w) FROM lev) - coalesce((SELECT sum(w) FROM lev p WHERE p.pos < l.pos), 0))::DOUBLE AS level
  FROM lev l),
tgt AS (
  SELECT source, source_size,
         CASE WHEN level * w > cap THEN cap::DOUBLE
              ELSE (SELECT level FROM run WHERE NOT level * w > cap ORDER BY pos LIMIT 1) * w END AS target
  FROM run),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.source, s.k, s.m,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
         ('0x' || substr(md5(s.key || ':mix'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
dealt AS (SELECT *, least(floor(m * rate)::BIGINT + CASE WHEN u < m * rate - floor(m * rate) THEN 1 ELSE 0 END, 3 * m) AS total
          FROM rated)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM (
  SELECT *, (floor(total / m) + CASE WHEN k <= total % m THEN 1 ELSE 0 END)::INT AS copies FROM dealt)
"""

# Every 50-byte window as 100 hexadecimal digits.
OP10 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS hx, strlen(coalesce(text, ''))::BIGINT AS n
  FROM documents),
c AS (SELECT rid, doc_id, b, substr(hx, b * 256 + 1, 256 + 98) AS part
      FROM (SELECT *, unnest(range((n + 127) // 128)) AS b FROM d WHERE doc_id IS NOT NULL)),
w AS (SELECT rid, doc_id, b * 128 + i AS s, substr(part, 2 * i + 1, 100) AS g
      FROM (SELECT *, unnest(range(least(128, greatest(len(part) // 2 - 49, 0)))) AS i FROM c)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT w.rid, w.s, lag(w.s) OVER (PARTITION BY w.rid ORDER BY w.s) AS p FROM w JOIN f USING (g) WHERE w.doc_id > f.m),
q AS (SELECT rid, s, sum(CASE WHEN s - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS run FROM r),
sp AS (SELECT rid, run, min(s) AS a, max(s) + 50 AS z FROM q GROUP BY rid, run),
k AS (SELECT rid, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS aa, list(z ORDER BY a) AS zz
      FROM sp GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN aa IS NULL THEN hx ELSE array_to_string(list_transform(range(len(aa) + 1), lambda i:
         substr(hx, (2 * (CASE WHEN i = 0 THEN 0 ELSE zz[i] END) + 1)::BIGINT,
                (2 * ((CASE WHEN i = len(aa) THEN n ELSE aa[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE zz[i] END)))::BIGINT)),
         '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

# The contract's phrases and the notices that op2 looks for, written out: (label, words). An
# exact one counts at every place; of the others, every list of grams needs one that is found.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
CC = "licensed under a creative commons"
END = "4 0 international license"
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", [["version 2", "2 0"]]),
    ("apache-2.0", "you may not use this file except in compliance with the license "
                   "you may obtain a copy of the license at", []),
    ("bsd", "redistribution and use in source and binary forms with or without modification "
            "are permitted provided that the following conditions are met", []),
    ("cc-by-nc", "licensed under cc by nc 4 0", [["by nc"], ["nc 4"]]),
    ("cc-by-nc", f"{CC} attribution noncommercial {END}", [["attribution noncommercial"], ["noncommercial 4"]]),
    ("cc-by-sa", f"{CC} attribution sharealike {END}", [["attribution sharealike"]]),
    ("gpl", "this work is licensed under the gnu general public license", [["gnu general"]]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation", [["gnu general"]]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose "
            "with or without fee is hereby granted", []),
    ("mit", "released under the mit license", []),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files", []),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", [["v 2", "2 0"]]),
    ("agpl", "this work is licensed under the gnu affero general public license", [["affero general"]]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
     [["affero general"]]),
    ("cc-by", "licensed under cc by 4 0", [["by 4"]]),
    ("cc-by", f"{CC} attribution {END}", [["attribution 4"]]),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", [["by nc"], ["nc nd"]]),
    ("cc-by-nc-nd", f"{CC} attribution noncommercial noderivatives {END}",
     [["attribution noncommercial"], ["noncommercial noderivatives"]]),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", [["by nc"], ["nc sa"]]),
    ("cc-by-nc-sa", f"{CC} attribution noncommercial sharealike {END}",
     [["attribution noncommercial"], ["noncommercial sharealike"]]),
    ("cc-by-nd", "licensed under cc by nd 4 0", [["by nd"]]),
    ("cc-by-nd", f"{CC} attribution noderivatives {END}", [["attribution noderivatives"]]),
    ("cc-by-sa", "licensed under cc by sa 4 0", [["by sa"]]),
    ("cc0", "licensed under cc0 1 0", [["under cc0"]]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring "
            "rights to this work", []),
    ("lgpl", "this work is licensed under the gnu lesser general public license", [["lesser general"]]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     [["lesser general"]]),
]


def op2_sql() -> str:
    rows, needs = [], []
    for t, (exact, label, text, need) in enumerate([(True, *p, []) for p in PHRASES] + [(False, *p) for p in NOTICES]):
        w = text.split(" ")
        grams = [f"{x} {y}" for x, y in zip(w, w[1:])]
        rows += [f"({t}, '{label}', {exact}, {len(w)}, {len(grams)}, {i}, '{w[i]}', '{w[i + 1]}')" for i in range(len(grams))]
        needs += [f"({t}, {n}, {i})" for n, either in enumerate(need) for i, g in enumerate(grams) if g in either]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH g AS (SELECT * FROM (VALUES {", ".join(rows)}) v(t, label, exact, t_words, grams, tpos, a, b)),
nd AS (SELECT * FROM (VALUES {", ".join(needs)}) v(t, need, tpos)),
nc AS (SELECT t, count(DISTINCT need) AS n_needs FROM nd GROUP BY t),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
      FROM documents),
p AS (SELECT rid, w, unnest(range(greatest(len(w) - 1, 0))) AS pos FROM d),
h AS (SELECT p.rid, p.pos, g.* FROM p JOIN g ON p.w[p.pos + 1] = g.a AND p.w[p.pos + 2] = g.b),
v AS (SELECT rid, t, label, exact, t_words, grams, pos - tpos AS diag, list(tpos) AS found, min(pos) AS first_, max(pos) AS last_
      FROM h GROUP BY ALL HAVING count(*) >= grams * 0.2),
l AS (SELECT *, CASE WHEN exact OR coalesce(diag - lag(diag) OVER (PARTITION BY rid, t ORDER BY diag) > 3, TRUE)
                     THEN 1 ELSE 0 END AS apart FROM v),
c AS (SELECT *, sum(apart) OVER (PARTITION BY rid, t ORDER BY diag) AS cluster FROM l),
s AS (SELECT rid, t, label, exact, t_words, grams, cluster, list_distinct(flatten(list(found))) AS found,
             min(first_) AS first_, max(last_) + 2 AS end_, min(diag) AS diag
      FROM c GROUP BY ALL),
m AS (SELECT s.rid, s.t, s.cluster, count(DISTINCT nd.need) AS n_met
      FROM s JOIN nd ON s.t = nd.t AND list_contains(s.found, nd.tpos) GROUP BY ALL),
e AS (SELECT s.*, exact AND len(found) = grams AS base, end_ - first_ <= t_words * 2.0 AS straight,
             len(found)::DOUBLE / grams AS coverage, coalesce(n_met, 0) = coalesce(n_needs, 0) AS told_apart
      FROM s LEFT JOIN m USING (rid, t, cluster) LEFT JOIN nc USING (t)),
x AS (SELECT *, CASE WHEN exact THEN base ELSE coverage >= 0.7 AND straight AND told_apart END AS accepted,
             CASE WHEN exact AND NOT base THEN 0.0 WHEN straight THEN coverage END AS part FROM e),
o AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(diag) FILTER (WHERE base) AS first_word,
             max(diag) FILTER (WHERE base) AS last_word,
             array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ',') AS base_labels,
             array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE accepted))), ',') AS labels,
             max(part) AS score
      FROM x GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN o USING (rid)
"""


# Rules of op4: (name, ratio, cutoffs from the laxest on), the limit and the error probability.
OP4_RULES = [
    ("symbols", "n_symbols / greatest(n_words, 1)", [1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05]),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", [0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", [0.45, 0.42, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    ("capitals", "n_capitals / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
]


def op4_sql() -> str:
    limit = 0.04
    over = [" OR ".join(f"{ratio} > CAST({grid[j]} AS DOUBLE)" for _, ratio, grid in OP4_RULES) for j in range(8)]
    counts = ", ".join(f"count(*) FILTER (WHERE {x}) AS k{j}" for j, x in enumerate(over))
    long = " UNION ALL ".join(f"SELECT tested, n, {j} AS step, k{j} AS k FROM tst" for j in range(8))
    rejected = " OR ".join(f"(level = {j} AND ({x}))" for j, x in enumerate(over))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS x FROM documents),
t AS (SELECT *, list_filter(string_split_regex(x, '[ 	-
]+'), lambda w: w <> '') AS w,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS l FROM d),
g AS (SELECT rid, i, [w[i + 1], w[i + 2], w[i + 3]] AS gram
      FROM (SELECT rid, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM t)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
cv AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
b AS (SELECT t.rid, doc_id, stratum, len(w)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(x, '[A-Z]'))::BIGINT AS n_capitals,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM t LEFT JOIN cv USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
good AS (SELECT f.* FROM f WHERE NOT base_failed AND doc_id IN (
           SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1)),
per AS (SELECT stratum, count(*) AS n, {counts} FROM good GROUP BY stratum),
mem AS (SELECT *, CASE WHEN pow(1 - {limit}, n) <= 0.05 / (SELECT count(*) FROM per) THEN stratum END AS tested FROM per),
tst AS (SELECT tested, sum(n)::BIGINT AS n, {", ".join(f"sum(k{j})::BIGINT AS k{j}" for j in range(8))} FROM mem GROUP BY tested),
lng AS ({long}),
pv AS (SELECT *, CASE WHEN k < n * {limit} THEN list_sum(list_transform(range(k + 1), lambda i:
               exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limit}) + (n - i) * ln(1 - {limit})))) ELSE 1.0 END AS p
       FROM lng),
ok AS (SELECT *, min(CASE WHEN p <= 0.05 / (SELECT count(*) FROM tst) THEN 1 ELSE 0 END)
                   OVER (PARTITION BY tested ORDER BY step) AS passed FROM pv),
lev AS (SELECT tested, max(step) AS level FROM ok WHERE passed = 1 GROUP BY tested),
cut AS (SELECT mem.stratum, lev.level FROM mem JOIN lev ON mem.tested IS NOT DISTINCT FROM lev.tested)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce({rejected}, FALSE) AS kept
FROM f LEFT JOIN cut USING (stratum)
"""


OP11 = r"""
WITH tbl AS (SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                     lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
             FROM (SELECT unnest(range(256))::BIGINT AS n)),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
      FROM documents, tbl),
e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM d),
f AS (SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
               ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) ELSE w END AS w FROM e),
p AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i FROM f),
g AS (SELECT rid, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' '
                       || lead(x, 4) OVER o || ' ' || lead(x, 5) OVER o AS gram
      FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
m AS (SELECT l.rid, l.i, r.i - l.i AS q FROM g l JOIN g r ON l.rid = r.rid AND l.gram = r.gram AND l.i < r.i),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m),
st AS (SELECT rid, q, min(i) AS s, count(*) + 5 + q AS len FROM isl GROUP BY rid, q, island),
runs AS (SELECT rid, s, len, min(q) AS q FROM st WHERE len >= 12 AND len >= 2 * q GROUP BY rid, s, len),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len DESC, s, q) = 1),
agg AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM p ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * b.len // b.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM f LEFT JOIN agg USING (rid) LEFT JOIN best b USING (rid) LEFT JOIN kept USING (rid)
"""


def op12_sql() -> str:
    """64 dimensions: parts of four components a, b, c, d."""
    def assigned(name, book):
        far = " + ".join(f"(p.{x} - k.{x}) * (p.{x} - k.{x})" for x in "abcd")
        return f"{name} AS MATERIALIZED (SELECT rid, part, min(({far}) * 64 + e) AS m FROM p JOIN {book} k USING (part) GROUP BY ALL)"

    def updated(name, book, near):
        mean = ", ".join(f"CASE WHEN n IS NULL THEN k.{x} ELSE ((s{x} - ((s{x} % n) + n) % n) // n)::BIGINT END AS {x}" for x in "abcd")
        sums = ", ".join(f"sum({x}) AS s{x}" for x in "abcd")
        return (f"{name} AS MATERIALIZED (SELECT part, e, {mean} FROM {book} k LEFT JOIN (SELECT part, m % 64 AS e, count(*) AS n, "
                f"{sums} FROM p JOIN {near} USING (rid, part) GROUP BY ALL) USING (part, e))")
    steps = ",\n".join([assigned("a0", "b0"), updated("b1", "b0", "a0"), assigned("a1", "b1"), updated("b2", "b1", "a1"),
                        assigned("a2", "b2")])
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[4 * part + 1] AS a, v[4 * part + 2] AS b, v[4 * part + 3] AS c, v[4 * part + 4] AS d
                   FROM v, (SELECT unnest(range(16)) AS part)),
b0 AS MATERIALIZED (SELECT part, e, a, b, c, d FROM p JOIN
       (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM v QUALIFY e < 64) USING (rid)),
{steps},
r AS (SELECT rid, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY rid),
sha AS (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN r USING (rid), sha
"""


SQL = {"op2_license_scan": op2_sql(), "op4_quality_rules": op4_sql(), "op7_mix_sources": OP7,
       "op10_suffix_array_dedup": OP10, "op11_periodic_runs": OP11, "op12_vector_codes": op12_sql()}
