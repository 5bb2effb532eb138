"""DuckDB oracle SQL for the training-data queries."""

from __future__ import annotations

from pairmine.oracles.mt import split, strip

# Fixed values, written out: the oracle shares no constant with the engine.
SOS, EOS = 2, 3
L = 350
BATCH, VOCAB_SIZE = 8, 8000

PAIRS = """
u AS (SELECT conv_id, turn, text AS src_text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS tgt_text FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT CAST(row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS BIGINT) AS idx, u.conv_id, u.turn,
                 u.src_text, a.tgt_text
          FROM u JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn
          WHERE u.src_text IS NOT NULL AND a.tgt_text IS NOT NULL)"""


def vocab_cte(col: str, name: str) -> str:
    return f"""
{name}_c AS (SELECT unnest({split(col)}) AS token FROM pairs),
{name}_n AS (SELECT token, count(*) AS n FROM {name}_c
             WHERE token NOT IN ('[PAD]', '[UNK]', '[SOS]', '[EOS]') GROUP BY token),
{name} AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS BIGINT) AS token_id, n
           FROM {name}_n QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {VOCAB_SIZE - 4})"""


def enc_cte(col: str, vocab: str, name: str) -> str:
    return f"""
{name}_t AS (SELECT idx, unnest({split(col)}) AS token, unnest(range(len({split(col)}))) AS pos FROM pairs),
{name}_j AS (SELECT t.idx, t.pos, coalesce(v.token_id, 1) AS id FROM {name}_t t LEFT JOIN {vocab} v USING (token)),
{name}_l AS (SELECT idx, list(id ORDER BY pos) AS ids FROM {name}_j GROUP BY idx),
{name} AS (SELECT p.idx, coalesce(l.ids, CAST([] AS BIGINT[])) AS ids FROM pairs p LEFT JOIN {name}_l l USING (idx))"""


def pad(expr: str, n: int | str) -> str:
    return f"list_concat({expr}, list_transform(range(greatest({n} - len({expr}), 0)), lambda q: CAST(0 AS BIGINT)))"


def cut(expr: str, n: int) -> str:
    return f"{expr}[1:{n}]"


ENCODED = (PAIRS + "," + vocab_cte("src_text", "vs") + "," + vocab_cte("tgt_text", "vt") + ","
           + enc_cte("src_text", "vs", "es") + "," + enc_cte("tgt_text", "vt", "et") + """,
enc AS (SELECT es.idx, es.ids AS src_ids, et.ids AS tgt_ids FROM es JOIN et USING (idx))""")

PACKED = ENCODED + f""",
packed AS (SELECT idx,
  {pad(f"list_concat([CAST({SOS} AS BIGINT)], {cut('src_ids', L - 2)}, [CAST({EOS} AS BIGINT)])", L)} AS encoder_input,
  {pad(f"list_concat([CAST({SOS} AS BIGINT)], {cut('tgt_ids', L - 1)})", L)} AS decoder_input,
  {pad(f"list_concat({cut('tgt_ids', L - 1)}, [CAST({EOS} AS BIGINT)])", L)} AS label
  FROM enc)"""


def j(c: str, alias: str | None = None) -> str:
    return f"array_to_string({c}, ' ') AS {alias or c}"


def sql() -> dict[str, str]:
    ens = f"(CASE WHEN len(x) = 0 OR x[-1] <> {EOS} THEN list_concat(x, [CAST({EOS} AS BIGINT)]) ELSE x END)"
    return {
        "zip_by_position": f"WITH {PAIRS} SELECT idx, src_text, tgt_text FROM pairs",
        "two_direction_pairs": f"""WITH {PAIRS}
SELECT idx, 'user' AS src_lang, 'assistant' AS tgt_lang, src_text, tgt_text FROM pairs
UNION ALL SELECT idx, 'assistant', 'user', tgt_text, src_text FROM pairs""",
        "split_positional": f"""WITH {PAIRS}
SELECT idx, CASE WHEN idx < CAST(floor(CAST(0.9 AS DOUBLE) * (SELECT count(*) FROM pairs)) AS BIGINT)
            THEN 'train' ELSE 'validation' END AS split FROM pairs""",
        "split_stratified": f"""WITH {PAIRS},
st AS (SELECT idx, CAST(least(floor(len({split('tgt_text')}) / 10), 10) AS INTEGER) AS bucket,
              md5(CAST(idx AS VARCHAR) || '0') AS h FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, idx) - 1 AS r,
             count(*) OVER (PARTITION BY bucket) AS gs FROM st)
SELECT idx, bucket, CASE WHEN r < floor(CAST(0.98 AS DOUBLE) * gs) THEN 'train'
                         WHEN r < floor(CAST(0.99 AS DOUBLE) * gs) THEN 'validation' ELSE 'test' END AS split FROM r""",
        "build_vocab": f"""WITH {PAIRS}, {vocab_cte('src_text', 'vs')}, {vocab_cte('tgt_text', 'vt')},
sp AS (SELECT * FROM (VALUES ('[PAD]', CAST(0 AS BIGINT), CAST(0 AS BIGINT)), ('[UNK]', 1, 0),
                             ('[SOS]', 2, 0), ('[EOS]', 3, 0)) v(token, token_id, n))
SELECT token, token_id, n, 'src_text' AS side FROM vs UNION ALL SELECT *, 'src_text' FROM sp
UNION ALL SELECT token, token_id, n, 'tgt_text' FROM vt UNION ALL SELECT *, 'tgt_text' FROM sp""",
        "encode_tokens": f"WITH {ENCODED} SELECT idx, {j('src_ids')}, {j('tgt_ids')} FROM enc",
        "pack_seq2seq": f"WITH {PACKED} SELECT idx, {j('encoder_input')}, {j('decoder_input')}, {j('label')} FROM packed",
        "masks": f"""WITH {PACKED} SELECT idx,
  array_to_string(list_transform(encoder_input, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ' ') AS encoder_mask,
  array_to_string(list_transform(decoder_input, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ' ') AS decoder_padding_mask
FROM packed""",
        "mask_labels": f"""WITH {PACKED} SELECT idx,
  array_to_string(list_transform(label, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') AS label FROM packed""",
        "pad_to_longest": f"""WITH {ENCODED},
b AS (SELECT idx, 'src_ids' AS side, CAST(floor(idx / {BATCH}) AS BIGINT) AS batch_id, {cut('src_ids', 256)} AS ids FROM enc
      UNION ALL SELECT idx, 'tgt_ids', CAST(floor(idx / {BATCH}) AS BIGINT), {cut('tgt_ids', 256)} FROM enc),
bl AS (SELECT *, CAST(max(len(ids)) OVER (PARTITION BY side, batch_id) AS INTEGER) AS batch_len FROM b)
SELECT idx, side, batch_id, batch_len, array_to_string({pad('ids', 'batch_len')}, ' ') AS ids FROM bl""",
        "causal_mask": f"""WITH {PACKED},
r AS (SELECT idx, decoder_input AS dec, unnest(range({L})) AS row FROM packed),
m AS (SELECT idx, row, list_transform(range({L}), lambda c: CASE WHEN dec[c + 1] <> 0 AND c <= row THEN 1 ELSE 0 END) AS mask FROM r)
SELECT idx, CAST(row AS INTEGER) AS row, CAST(list_sum(mask) AS INTEGER) AS ones, md5(array_to_string(mask, ' ')) AS mask_md5
FROM m""",
        "shuffle": f"""WITH {PAIRS}, k AS (SELECT idx, md5(CAST(idx AS VARCHAR) || ':7:1') AS shuffle_key FROM pairs)
SELECT idx, shuffle_key, CAST(row_number() OVER (ORDER BY shuffle_key, idx) - 1 AS BIGINT) AS position FROM k""",
        "pack_two_files": f"""WITH {ENCODED},
e2 AS (SELECT idx, {cut(ens.replace('x', 'src_ids'), L - 2)} AS s, {cut(ens.replace('x', 'tgt_ids'), L - 2)} AS t FROM enc)
SELECT idx,
  array_to_string({pad(f"list_concat([CAST({SOS} AS BIGINT)], s, [CAST({EOS} AS BIGINT)])", L)}, ' ') AS encoder_input,
  array_to_string({pad(f"list_concat([CAST({SOS} AS BIGINT)], t, [CAST({EOS} AS BIGINT)])", L)}, ' ') AS decoder_input,
  array_to_string({pad(f"list_concat(t, [CAST({EOS} AS BIGINT)])", L)}, ' ') AS label
FROM e2""",
        "clean_sentences": f"""WITH {PAIRS}
SELECT 'src_text' AS side, {strip('src_text')} AS sentence FROM pairs WHERE {strip('src_text')} <> ''
UNION ALL SELECT 'tgt_text', {strip('tgt_text')} FROM pairs WHERE {strip('tgt_text')} <> ''""",
    }
