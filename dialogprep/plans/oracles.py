"""The same results as plain SQL over the driver's tables (DuckDB dialect)."""

TOKENS = r"'<\|im_start\|>|<\|im_end\|>|\p{L}+|\p{N}|\s|[^\s\p{L}\p{N}]'"

ROUTED = r"""
routed AS (
  SELECT conv_id, turn, role, text,
         CASE role WHEN 'user' THEN 0 ELSE 1 END AS half,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
  FROM conversations WHERE role IN ('user', 'assistant')
)"""

PIECES = ROUTED + f""",
pieces AS (
  SELECT conv_id, turn, role, half, regexp_extract_all(rendered, {TOKENS}, 0) AS toks FROM routed
)"""


def vocabulary(size: int) -> str:
    return f"""
counted AS (
  SELECT tok, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM pieces)
  WHERE tok NOT IN ('<|endoftext|>', '<|im_start|>', '<|im_end|>', '<|unk|>')
  GROUP BY tok ORDER BY n DESC, tok LIMIT {size}
),
vocab AS (
  SELECT 0 AS id, '<|endoftext|>' AS tok, 0::BIGINT AS n, TRUE AS special
  UNION ALL SELECT 1, '<|im_start|>', 0, TRUE
  UNION ALL SELECT 2, '<|im_end|>', 0, TRUE
  UNION ALL SELECT 3, '<|unk|>', 0, TRUE
  UNION ALL SELECT (3 + row_number() OVER (ORDER BY n DESC, tok))::INTEGER, tok, n, FALSE
  FROM counted
)"""


def encoded(size: int = 1000) -> str:
    """(conv_id, turn, half, role, spot, id): one row per token of each turn."""
    return f"""{PIECES}, {vocabulary(size)},
spread AS (
  SELECT conv_id, turn, role, half, unnest(toks) AS tok, unnest(range(len(toks))) AS spot FROM pieces
),
encoded AS (
  SELECT conv_id, turn, role, half, spot, coalesce(id, 3) AS id, coalesce(special, TRUE) AS special, s.tok
  FROM spread s LEFT JOIN vocab v ON s.tok = v.tok
)"""


def samples(length: int = 512, order: str = "half, turn, spot", size: int = 1000) -> str:
    """(conv_id, ids, sup): truncated dialogues."""
    return f"""{encoded(size)},
placed AS (
  SELECT conv_id, id, role = 'assistant' AND spot >= 3 AS supervised,
         row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS pos
  FROM encoded
),
firsts AS (
  SELECT conv_id, list(id ORDER BY pos) AS ids, list(supervised ORDER BY pos) AS sup
  FROM placed WHERE pos <= {length} GROUP BY conv_id
),
samples AS (
  SELECT c.conv_id, coalesce(ids, []::INTEGER[]) AS ids, coalesce(sup, []::BOOLEAN[]) AS sup
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN firsts USING (conv_id)
)"""


def csv(values: str) -> str:
    return f"array_to_string({values}, ',')"


def fill(value, count: str) -> str:
    return f"list_transform(range({count}), lambda i: {value})"


def padded(values: str, length, value) -> str:
    return f"list_concat({values}, {fill(value, f'greatest({length} - len({values}), 0)')})"


ASSISTANT_ONLY = (
    "list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN sup[i] THEN ids[i] ELSE -100 END)"
)

DIALOGUES = ROUTED + """,
dialogues AS (
  SELECT c.conv_id, coalesce(r.text, '') AS text, c.n_turns, c.n_users, c.n_replies
  FROM (SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_users,
               count(*) FILTER (role = 'assistant') AS n_replies
        FROM conversations GROUP BY conv_id) c
  LEFT JOIN (SELECT conv_id, string_agg(rendered, '' ORDER BY half, turn) AS text
             FROM routed GROUP BY conv_id) r USING (conv_id)
)"""

IMAGES = """
wanted AS (
  SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') = 0 THEN conv_id * 7 END AS image_id
  FROM conversations GROUP BY conv_id
),
featured AS (
  SELECT conv_id, image_id, embedding, label,
         row_number() OVER (ORDER BY conv_id) - 1 AS idx
  FROM wanted JOIN embeddings ON image_id = vec_id
)"""

LOGS = """
logs AS (
  SELECT vec_id // 10 AS sample_id, vec_id % 10 AS pos,
         CASE WHEN label = 0 THEN -100 ELSE label END AS label,
         embedding::DOUBLE[] AS student, list_reverse(embedding::DOUBLE[]) AS teacher,
         vec_id // 10 // 4 AS batch_id
  FROM embeddings
),
staged AS (
  SELECT *, lead(label) OVER (PARTITION BY sample_id ORDER BY pos) AS next_label,
         ln(list_sum(list_transform(student, lambda x: exp(x)))) AS lse,
         ln(list_sum(list_transform(student, lambda x: exp(x / 2)))) AS lse_s,
         ln(list_sum(list_transform(teacher, lambda x: exp(x / 2)))) AS lse_t
  FROM logs
),
terms AS (
  SELECT *, CASE WHEN next_label <> -100 THEN lse - student[next_label + 1] END AS ce,
         list_sum(list_transform(range(1, len(student) + 1), lambda i:
           exp(teacher[i] / 2 - lse_t) * ((teacher[i] / 2 - lse_t) - (student[i] / 2 - lse_s)))) AS kl
  FROM staged
)"""

KL = "sum(kl) / count(DISTINCT sample_id) * 4"


def per_batch(loss: str) -> str:
    return f"""WITH {LOGS},
batches AS (
  SELECT batch_id, sum(ce) / count(ce) AS ce, {KL} AS kl, count(ce) AS n_counted,
         count(DISTINCT sample_id) AS n_samples
  FROM terms GROUP BY batch_id
)
{loss}"""


def weight(row: str, col: str, scale: float) -> str:
    return f"((31 * {row} + 17 * {col}) % 13 - 6) / {scale}"


def layer(vector: str, rows: int, cols: int, scale: float) -> str:
    """A list of ``rows`` outputs of the fixed linear layer over ``vector``."""
    product = f"{vector}[c + 1]::DOUBLE * ({weight('r', 'c', scale)})"
    return (
        f"list_transform(range({rows}), lambda r: (r % 5 - 2) / {scale} + "
        f"list_sum(list_transform(range({cols}), lambda c: {product})))"
    )


# erf by its power series, enough terms for arguments below 4 in size.
GELU = (
    "0.5 * h * (1 + 2 / sqrt(pi()) * list_sum(list_transform(range(60), lambda k: "
    "pow(-1, k) * pow(h / sqrt(2), 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))))"
)

SHADES = """
shades AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor((e::DOUBLE + 1) * 127.5)::INTEGER) AS p
  FROM embeddings
),
planes AS (
  SELECT vec_id, p AS red,
         CASE WHEN vec_id % 3 = 1 THEN p ELSE list_transform(p, lambda v: 255 - v) END AS green,
         CASE WHEN vec_id % 3 = 1 THEN p ELSE list_reverse(p) END AS blue
  FROM shades
)"""


def channel(plane: str, mean: float, std: float) -> str:
    """Sum over a plane enlarged twice each way, normalised as float32."""
    return (
        f"round(list_sum(list_transform({plane}, lambda v: "
        f"((v / 255.0::DOUBLE - {mean}::DOUBLE) / {std}::DOUBLE)::FLOAT::DOUBLE * 4)), 6)"
    )


def patch_mean(plane: str, mean: float, std: float) -> str:
    """Mean of one quarter of an 8x8 plane, normalised as float32."""
    at = "(patch_pos // 2 * 4 + k // 4) * 8 + patch_pos % 2 * 4 + k % 4 + 1"
    value = f"(({plane}[{at}] / 255.0::DOUBLE - {mean}::DOUBLE) / {std}::DOUBLE)::FLOAT::DOUBLE"
    return f"round(list_sum(list_transform(range(16), lambda k: {value})) / 16, 6)"


def _collated(column: str, made: str, value, multiple_of: int = 1) -> str:
    width = f"ceil(max(len({made})) OVER (PARTITION BY batch_id) / {multiple_of}.0) * {multiple_of}"
    return f"""WITH {samples()},
batched AS (
  SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS idx,
         (row_number() OVER (ORDER BY conv_id) - 1) // 4 AS batch_id FROM samples
),
wide AS (SELECT batch_id, idx, {made} AS v, ({width})::BIGINT AS width FROM batched)
SELECT batch_id, idx, {csv(padded('v', 'width', value))} AS {column} FROM wide"""


def _looked_up() -> str:
    return f"""WITH {samples()},
spots AS (SELECT conv_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM samples)
SELECT conv_id, pos, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total
FROM spots JOIN embeddings ON id % (SELECT count(*) FROM embeddings) = vec_id"""


def _fused() -> str:
    """Text: each id's vector. Image: four patches of 16, projected to the same width."""
    patch = "list_slice(embedding, i * 16 + 1, i * 16 + 16)"
    hidden = f"list_transform({layer('patch', 8, 16, 4.0)}, lambda h: {GELU})"
    return f"""WITH {IMAGES}, {samples()},
text_part AS (
  SELECT s.conv_id, sum(list_sum(e.embedding::DOUBLE[])) AS total
  FROM (SELECT conv_id, unnest({padded('ids', 512, 0)}) AS id FROM samples) s
  JOIN embeddings e ON s.id % (SELECT count(*) FROM embeddings) = e.vec_id GROUP BY s.conv_id
),
cut AS (
  SELECT conv_id, unnest(list_transform(range(4), lambda i: {patch})) AS patch FROM featured
),
hidden AS (SELECT conv_id, {hidden} AS g FROM cut),
image_part AS (
  SELECT conv_id, sum(list_sum({layer('g', 64, 8, 4.0)})) AS total FROM hidden GROUP BY conv_id
)
SELECT conv_id, 516 AS n_positions, round(t.total + i.total, 6) AS total,
       {csv(f"list_concat({fill(1, '4')}, {padded(fill(1, 'len(ids)'), 512, 0)})")} AS mask,
       {csv(f"list_concat({fill(-100, '4')}, {padded('ids', 512, -100)})")} AS labels
FROM samples JOIN text_part t USING (conv_id) JOIN image_part i USING (conv_id)"""


def _parts() -> str:
    """Every dialogue comes as blocks of three turn numbers per half."""
    return f"""WITH {ROUTED},
blocks AS (
  SELECT conv_id, turn,
         CASE role WHEN 'assistant' THEN 1 ELSE 0 END * 4503599627370496 + turn // 3 + 1 AS part
  FROM conversations
)
SELECT b.conv_id, part, coalesce(string_agg(rendered, '' ORDER BY half, b.turn), '') AS text
FROM blocks b LEFT JOIN routed r ON b.conv_id = r.conv_id AND b.turn = r.turn
GROUP BY b.conv_id, part"""


def _encode_sql() -> str:
    return f"""WITH {encoded()}
SELECT conv_id, turn, {csv('list(id ORDER BY spot)')} AS ids FROM encoded GROUP BY conv_id, turn"""


def _share(order: str, sort: str) -> str:
    return f"""SELECT '{order}' AS turn_order, sum(s)::BIGINT AS flagged, sum(512)::BIGINT AS total,
       round(100.0 * sum(s) / sum(512), 2)::DOUBLE AS percent
FROM (WITH {samples(order=sort)}
      SELECT len(list_filter(sup, lambda v: v)) AS s FROM samples)"""


def _indexed(order: str) -> str:
    return f"SELECT o_orderkey, row_number() OVER (ORDER BY {order}) - 1 AS idx FROM orders"


_DRAW = "('0x' || substr(md5(o_orderkey || ':17'), 1, 15))::BIGINT, o_orderkey"

_KEYS = """
keys AS (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS idx
  FROM (SELECT DISTINCT conv_id FROM conversations)
)"""

ORACLES = {
    "sample_count": "SELECT count(DISTINCT conv_id) AS n_records, count(*) AS n_turns FROM conversations",
    "sample_at_index": f"""WITH {_KEYS}
SELECT idx, conv_id, turn, role, text FROM conversations JOIN keys USING (conv_id)
WHERE idx IN (0, 7, 19)""",
    "optional_defaults": f"""WITH {DIALOGUES}
SELECT conv_id AS sample_id, CASE WHEN n_replies > 0 THEN n_turns ELSE 0 END AS n_turns,
       CASE WHEN n_replies > 0 THEN text ELSE '' END AS text FROM dialogues""",
    "image_path": """SELECT conv_id, turn, CASE role WHEN 'system' THEN '/elsewhere/' ELSE 'data/images/' END
       || conv_id * 7 || '.png' AS path FROM conversations""",
    "missing_image_rejects": f"""WITH {IMAGES}
SELECT w.conv_id, coalesce(w.image_id, -1) AS image_id, coalesce(e.label, -1) AS label,
       CASE WHEN w.image_id IS NULL THEN 'no_image' WHEN e.vec_id IS NULL THEN 'not_found'
            ELSE 'accepted' END AS reason
FROM wanted w LEFT JOIN embeddings e ON w.image_id = e.vec_id""",
    "missing_image_rejects_salted": """SELECT conv_id, turn, conv_id % 5 * 7 AS image_id, coalesce(label, -1) AS label,
       CASE WHEN vec_id IS NULL THEN 'not_found' ELSE 'accepted' END AS reason
FROM conversations LEFT JOIN embeddings ON conv_id % 5 * 7 = vec_id""",
    "role_routing": """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'input' ELSE 'target' END AS slot, text
FROM conversations WHERE role IN ('user', 'assistant')""",
    "render_turns": f"WITH {ROUTED} SELECT conv_id, turn, rendered FROM routed",
    "dialogue_grouped": f"WITH {DIALOGUES} SELECT conv_id, text FROM dialogues",
    "dialogue_interleaved": f"""WITH {ROUTED}
SELECT conv_id, coalesce(string_agg(rendered, '' ORDER BY c.turn), '') AS text
FROM conversations c LEFT JOIN routed r USING (conv_id, turn) GROUP BY conv_id""",
    "dialogue_parts": _parts(),
    "generation_prompt": """SELECT conv_id, turn, '<|im_start|>user' || chr(10) ||
       CASE role WHEN 'user' THEN text ELSE 'Describe this image.' END ||
       '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations""",
    "vocab_topk": f"WITH {PIECES}, {vocabulary(1000)} SELECT id, tok, n, special FROM vocab",
    "encode_tokens": _encode_sql(),
    "encode_tokens_by_join": _encode_sql(),
    "truncate_tokens": f"WITH {samples()} SELECT conv_id, len(ids) AS n_ids, {csv('ids')} AS ids FROM samples",
    "truncate_interleaved": f"""WITH {samples(order='turn, spot')}
SELECT conv_id, len(ids) AS n_ids, {csv('ids')} AS ids FROM samples""",
    "pad_fixed": f"WITH {samples()} SELECT conv_id, {csv(padded('ids', 512, 0))} AS input_ids FROM samples",
    "attention_mask": f"""WITH {samples()}
SELECT conv_id, {csv(padded(fill(1, 'len(ids)'), 512, 0))} AS attention_mask FROM samples""",
    "labels_clone": f"WITH {samples()} SELECT conv_id, {csv(padded('ids', 512, 0))} AS labels FROM samples",
    "labels_mask_pad": f"WITH {samples()} SELECT conv_id, {csv(padded('ids', 512, -100))} AS labels FROM samples",
    "labels_assistant_only": f"""WITH {samples()}
SELECT conv_id, {csv(padded(ASSISTANT_ONLY, 512, -100))} AS labels FROM samples""",
    "decode_tokens": f"""WITH {encoded()}
SELECT conv_id, turn, coalesce(string_agg(tok, '' ORDER BY spot) FILTER (NOT special), '') AS decoded
FROM encoded GROUP BY conv_id, turn""",
    "nested_records": f"""WITH {samples()}
SELECT conv_id AS sample_id, conv_id * 7 || '.png' AS image, {csv(padded('ids', 512, 0))} AS input_ids,
       {csv(padded(fill(1, 'len(ids)'), 512, 0))} AS attention_mask,
       {csv(padded(ASSISTANT_ONLY, 512, -100))} AS labels
FROM samples""",
    "dense_index": _indexed("o_orderkey"),
    "epoch_shuffle": _indexed(_DRAW),
    "micro_batches": f"WITH {_KEYS} SELECT conv_id, idx, idx // 4 AS batch_id FROM keys",
    "accumulation_steps": f"""WITH {_KEYS}
SELECT idx // 16 AS step, count(DISTINCT idx // 4) AS n_batches, count(*)::BIGINT AS n_samples
FROM keys GROUP BY step""",
    "collate_input_ids": _collated("input_ids", "ids", 0),
    "collate_attention_mask": _collated("attention_mask", fill(1, "len(ids)"), 0),
    "collate_labels": _collated("labels", "ids", -100),
    "collate_multiple_of": _collated("input_ids", "ids", 0, 8),
    "stack_features": f"""WITH {IMAGES}
SELECT idx // 4 AS batch_id, count(*) AS n, sum(len(embedding))::BIGINT AS n_values,
       round(sum(list_sum(embedding::DOUBLE[])), 6) AS total FROM featured GROUP BY batch_id""",
    "collate_batch": f"""WITH {IMAGES}, {samples()},
batched AS (
  SELECT idx, idx // 4 AS batch_id, ids, len(embedding) AS size,
         max(len(ids)) OVER (PARTITION BY idx // 4) AS width
  FROM samples JOIN featured USING (conv_id)
)
SELECT batch_id, count(*) AS n,
       string_agg({csv(padded('ids', 'width', 0))}, ';' ORDER BY idx) AS input_ids,
       string_agg({csv(padded(fill(1, 'len(ids)'), 'width', 0))}, ';' ORDER BY idx) AS attention_mask,
       string_agg({csv(padded('ids', 'width', -100))}, ';' ORDER BY idx) AS labels,
       string_agg(size::VARCHAR, ';' ORDER BY idx) AS sizes
FROM batched GROUP BY batch_id""",
    "embedding_lookup": _looked_up(),
    "embedding_lookup_by_join": _looked_up(),
    "linear_layer": f"""SELECT vec_id, unit, round(v, 6) AS value FROM (
  SELECT vec_id, unnest(range(8)) AS unit, unnest({layer('embedding', 8, 64, 32.0)}) AS v FROM embeddings)""",
    "project_vectors": f"""WITH hidden AS (
  SELECT vec_id, list_transform({layer('embedding', 8, 64, 4.0)}, lambda h: {GELU}) AS g FROM embeddings
)
SELECT vec_id, unit, round(v, 6) AS value FROM (
  SELECT vec_id, unnest(range(8)) AS unit, unnest({layer('g', 8, 8, 4.0)}) AS v FROM hidden)""",
    "fused_samples": _fused(),
    "fuse_sequence": """SELECT vec_id, pos, len(v) AS width, round(list_sum(v), 6) AS total FROM (
  SELECT vec_id, unnest(range(4)) AS pos,
         unnest(list_transform(range(4), lambda i: list_slice(embedding::DOUBLE[], i * 16 + 1, i * 16 + 16))) AS v
  FROM embeddings)""",
    "fuse_mask": f"""WITH {samples()}
SELECT conv_id, CASE WHEN conv_id % 10 <> 0 THEN
  {csv(f"list_concat({fill(1, '196')}, {padded(fill(1, 'len(ids)'), 512, 0)})")} END AS mask FROM samples""",
    "fuse_labels": f"""WITH {samples()}
SELECT conv_id, CASE WHEN conv_id % 10 <> 0 THEN
  {csv(f"list_concat({fill(-100, '196')}, {padded('ids', 512, 0)})")} END AS labels FROM samples""",
    "pair_logits": f"""WITH {LOGS}
SELECT sample_id, pos, label,
       round(list_sum(list_transform(range(1, 65), lambda i: student[i] * teacher[i])), 6) AS dot FROM logs""",
    "shift_labels": f"WITH {LOGS} SELECT sample_id, pos, label, next_label FROM staged WHERE next_label IS NOT NULL",
    "log_softmax": f"""WITH {LOGS}
SELECT sample_id, pos, unnest(range(len(student))) AS unit,
       unnest(list_transform(student, lambda x: round(x / 2 - lse_s, 6))) AS value FROM staged""",
    "softmax": f"""WITH {LOGS}
SELECT sample_id, pos, unnest(range(len(teacher))) AS unit,
       unnest(list_transform(teacher, lambda x: round(exp(x / 2 - lse_t), 6))) AS value FROM staged""",
    "ce_loss": f"""WITH {LOGS}
SELECT round(sum(ce) / count(ce), 6) AS ce, count(ce) AS n_counted, count(*) AS n_positions FROM terms""",
    "kl_loss": f"WITH {LOGS} SELECT round({KL}, 6) AS kl, count(DISTINCT sample_id) AS n_samples FROM terms",
    "kl_loss_mask_padding": f"""WITH {LOGS}
SELECT round(sum(CASE WHEN label <> -100 THEN kl ELSE 0 END) / count(DISTINCT sample_id) * 4, 6) AS kl,
       count(DISTINCT sample_id) AS n_samples FROM terms""",
    "distill_loss": f"""WITH {LOGS}
SELECT round(ce, 6) AS ce, round(kl, 6) AS kl, round(0.5 * ce + 0.5 * kl, 6) AS loss
FROM (SELECT sum(ce) / count(ce) AS ce, {KL} AS kl FROM terms)""",
    "distill_loss_per_batch": per_batch("""SELECT batch_id, round(ce, 6) AS ce, round(kl, 6) AS kl,
       round(0.5 * ce + 0.5 * kl, 6) AS loss, n_counted, n_samples FROM batches"""),
    "distill_loss_vocab_mismatch": per_batch("""SELECT batch_id,
       round(CASE WHEN batch_id % 2 = 0 THEN ce ELSE 0.5 * ce + 0.5 * kl END, 6) AS loss FROM batches"""),
    "distill_loss_no_teacher": per_batch("""SELECT batch_id,
       round(CASE WHEN batch_id % 3 = 0 THEN ce ELSE 0.5 * ce + 0.5 * kl END, 6) AS loss FROM batches"""),
    "hidden_state_mse": """SELECT label, round(sum(list_sum(list_transform(range(1, len(embedding) + 1), lambda i:
         pow(embedding[len(embedding) + 1 - i]::DOUBLE - embedding[i]::DOUBLE, 2)))) / sum(len(embedding)), 6) AS mse
FROM embeddings GROUP BY label""",
    "hidden_state_loss": f"""WITH {LOGS}
SELECT round(0.5 * sum(ce) / count(ce) + 0.5 * sum(list_sum(list_transform(range(1, 65), lambda i:
         pow(teacher[i] - student[i], 2)))) / sum(len(student)), 6) AS loss FROM terms""",
    "fused_ce_loss": f"""WITH {LOGS}
SELECT round(sum(ce) FILTER (pos >= 3) / (count(ce) FILTER (pos >= 3)), 6) AS ce,
       count(ce) FILTER (pos >= 3) AS n_counted, count(*) AS n_positions FROM terms""",
    "supervised_token_share": _share("grouped", "half, turn, spot") + " UNION ALL " + _share("interleaved", "turn, spot"),
    "flagged_share": """SELECT source, coalesce(sum(n_chars) FILTER (lang = 'en'), 0)::BIGINT AS flagged,
       sum(n_chars)::BIGINT AS total,
       round(100.0::DOUBLE * coalesce(sum(n_chars) FILTER (lang = 'en'), 0) / sum(n_chars), 2) AS percent
FROM documents GROUP BY source""",
    "batch_predict": f"""SELECT vec_id, round(list_max(s), 6) AS best_score, round(list_min(s), 6) AS worst_score
FROM (SELECT vec_id, {layer('embedding', 8, 64, 32.0)} AS s FROM embeddings)""",
    "batch_evaluate": f"""WITH {IMAGES}, {encoded()},
prompts AS (
  SELECT e.conv_id, e.turn, e.id, v.special, v.tok, spot,
         CASE WHEN embedding[1] > 0 THEN 8 ELSE 4 END AS n_words
  FROM encoded e JOIN featured USING (conv_id) JOIN vocab v ON e.id = v.id WHERE role = 'user'
)
SELECT conv_id, turn, coalesce(string_agg(tok, '' ORDER BY spot)
       FILTER (NOT special AND spot >= 3 AND spot < 3 + n_words), '') AS response
FROM (SELECT * FROM prompts
      UNION ALL
      SELECT conv_id, turn, v.id, v.special, v.tok, last + 1 + e.spot, n_words
      FROM (SELECT conv_id, turn, max(spot) AS last, any_value(n_words) AS n_words
            FROM prompts GROUP BY conv_id, turn),
           (VALUES (0, '<|im_start|>'), (1, 'assistant'), (2, chr(10))) e(spot, tok)
      JOIN vocab v ON v.tok = e.tok)
GROUP BY conv_id, turn""",
    "tokenizer_hook": f"""SELECT conv_id, turn,
       {csv("list_transform(string_split(text, ''), lambda c: unicode(c))")} AS ids FROM conversations""",
    "json_roundtrip": f"""WITH {DIALOGUES}
SELECT conv_id AS sample_id, conv_id * 7 || '.png' AS image, n_turns, text FROM dialogues""",
    "corrupt_quarantine": """WITH lines AS (
  SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id
)
SELECT CASE WHEN conv_id % 10 = 0 THEN 'quarantined' ELSE 'good' END AS status, count(*) AS n_rows,
       sum(CASE WHEN conv_id % 10 = 0 THEN 0 ELSE n_turns END)::BIGINT AS n_turns,
       sum(CASE WHEN conv_id % 10 = 0 THEN 40 ELSE 0 END)::BIGINT AS n_chars
FROM lines GROUP BY status""",
    "parquet_samples": f"""WITH {samples()}
SELECT conv_id, len(ids) AS n_ids, (len(ids) = 512)::INTEGER AS cut FROM samples""",
    "image_inventory": """SELECT vec_id AS image_id, CASE WHEN vec_id % 50 = 48 THEN 0 ELSE 1 END AS found,
       CASE WHEN vec_id % 50 = 48 THEN -1 WHEN vec_id % 50 = 49 THEN 0 ELSE 1 END AS large FROM embeddings""",
    "image_decode": f"""WITH {SHADES}
SELECT vec_id AS image_id, CASE WHEN vec_id % 50 = 49 THEN -1 ELSE 8 END AS height,
       CASE WHEN vec_id % 50 = 49 THEN -1 ELSE 8 END AS width,
       CASE WHEN vec_id % 50 = 49 THEN 0 ELSE 1 END AS readable,
       CASE WHEN vec_id % 50 <> 49 THEN array_to_string(list_transform(range(1, 65), lambda i:
         printf('%02X%02X%02X', red[i], green[i], blue[i])), '') END AS rgb
FROM planes WHERE vec_id % 50 <> 48""",
    "image_tensor": f"""WITH {SHADES}
SELECT vec_id AS image_id, 768 AS n_values, {channel('red', 0.48145466, 0.26862954)} AS red,
       {channel('green', 0.4578275, 0.26130258)} AS green, {channel('blue', 0.40821073, 0.27577711)} AS blue
FROM planes WHERE vec_id % 50 < 48""",
    "image_features": f"""WITH {SHADES},
spots AS (SELECT unnest(range(4)) AS patch_pos)
SELECT vec_id AS image_id, patch_pos::INTEGER AS patch_pos,
       {patch_mean('red', 0.48145466, 0.26862954)} AS red,
       {patch_mean('green', 0.4578275, 0.26130258)} AS green,
       {patch_mean('blue', 0.40821073, 0.27577711)} AS blue
FROM planes JOIN spots ON vec_id % 50 < 48""",
    "stream_dialogues": f"""WITH {DIALOGUES}
SELECT conv_id AS sample_id, conv_id * 7 || '.png' AS image, text FROM dialogues""",
}

# Sizes and positions are 32-bit in Spark.
_INTEGERS = {
    "optional_defaults": ["n_turns"], "json_roundtrip": ["n_turns"],
    "truncate_tokens": ["n_ids"], "truncate_interleaved": ["n_ids"], "parquet_samples": ["n_ids"],
    "stack_features": ["n_values"], "linear_layer": ["unit"], "project_vectors": ["unit"],
    "log_softmax": ["unit"], "softmax": ["unit"], "fuse_sequence": ["pos", "width"],
    "embedding_lookup": ["pos", "width"], "embedding_lookup_by_join": ["pos", "width"],
}
for _name, _columns in _INTEGERS.items():
    _casts = ", ".join(f"{c}::INTEGER AS {c}" for c in _columns)
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
ORACLES["decode_tokens_by_join"] = ORACLES["decode_tokens"]

_DATASET = f"""{IMAGES}, {SHADES}, {samples()},
stored AS (
  SELECT vec_id, vec_id % 50 = 49 AS junk,
         {channel('red', 0.48145466, 0.26862954)} + {channel('green', 0.4578275, 0.26130258)}
         + {channel('blue', 0.40821073, 0.27577711)} AS total
  FROM planes WHERE vec_id % 50 <> 48
),
checked AS (
  SELECT w.conv_id AS sample_id, s.ids, t.total,
         CASE WHEN w.image_id IS NULL THEN 'no_image' WHEN t.vec_id IS NULL THEN 'not_found'
              WHEN junk THEN 'unreadable' ELSE 'accepted' END AS reason
  FROM wanted w JOIN samples s USING (conv_id) LEFT JOIN stored t ON w.image_id = t.vec_id
)"""
ORACLES["dataset_samples"] = f"""WITH {_DATASET}
SELECT sample_id, reason, CASE WHEN reason = 'accepted' THEN {csv('ids')} ELSE '' END AS input_ids,
       CASE WHEN reason = 'accepted' THEN 768 ELSE 0 END::BIGINT AS n_values,
       CASE WHEN reason = 'accepted' THEN round(total, 3) ELSE 0 END AS total FROM checked"""
ORACLES["dataset_batches"] = f"""WITH {_DATASET},
ordered AS (
  SELECT ids, row_number() OVER (ORDER BY sample_id) - 1 AS idx FROM checked WHERE reason = 'accepted'
),
batched AS (
  SELECT idx, idx // 4 AS batch_id, ids, max(len(ids)) OVER (PARTITION BY idx // 4) AS width FROM ordered
)
SELECT batch_id, count(*) AS n, string_agg({csv(padded('ids', 'width', 0))}, ';' ORDER BY idx) AS input_ids,
       string_agg({csv(padded('ids', 'width', -100))}, ';' ORDER BY idx) AS labels,
       string_agg('768', ';' ORDER BY idx) AS sizes
FROM batched GROUP BY batch_id"""
ORACLES["mixed_layouts"] = """WITH rows AS (
  SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id
)
SELECT 'good' AS status, count(*) AS n_rows, count(*) AS n_positions, sum(n_turns)::BIGINT AS n_turns,
       sum(conv_id)::BIGINT AS ids FROM rows WHERE conv_id % 4 <> 3
UNION ALL SELECT 'quarantined', count(*), 0, 0, 0 FROM rows WHERE conv_id % 4 = 3"""
