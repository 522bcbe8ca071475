"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each query is a CTE chain over the driver's tables. Shared CTEs are defined
once below and pulled in with their dependencies by ``sql``. Floats are
rounded to 6 places and id arrays rendered as space-joined text on both sides.
"""

from __future__ import annotations

from quarry.params import (CONTEXT_SIZE, DELIMITER_PATTERN, MASK_ID, MAX_GENERATION_LENGTH, NUM_NEIGHBORS,
                           NUM_RETRIEVALS, SEED, TEMPERATURE, TOKEN_PATTERN, FIRST_TOKEN_ID, special_ids)

SP = special_ids()
EOS = SP["eos"]


def tok(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TOKEN_PATTERN}')"


def delimiter_tok(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{DELIMITER_PATTERN}')"


def u32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def encode_sql(src: str, key: str, text: str, max_len: int = CONTEXT_SIZE) -> str:
    """Rows ``(k, ids)``: the vocabulary ids of ``text`` for each ``key`` of ``src``."""
    return f"""
    SELECT s.{key} AS k, CASE WHEN s.{text} IS NULL THEN NULL
           ELSE list_slice(coalesce(x.ids, []::INTEGER[]), 1, {max_len}) END AS ids
    FROM {src} s LEFT JOIN (
      SELECT t.k, list(coalesce(v.token_id, {SP['oov']}) ORDER BY t.pos) AS ids
      FROM (SELECT k, unnest(tk) AS token, unnest(range(1, len(tk) + 1)) AS pos
            FROM (SELECT {key} AS k, {tok(text)} AS tk FROM {src} WHERE {text} IS NOT NULL)) t
      LEFT JOIN vocab v ON v.token = t.token
      GROUP BY t.k) x ON x.k = s.{key}"""


def ctes(ctx: int = CONTEXT_SIZE, gen: int = MAX_GENERATION_LENGTH, k: int = NUM_NEIGHBORS,
         n_sample: int = NUM_RETRIEVALS, temperature: float = TEMPERATURE, seed: int = SEED,
         epochs: int = 1):
    c = {}
    c["questions"] = ([], """
      SELECT CASE WHEN u.conv_id % 10 = 0 THEN 'eval' WHEN u.conv_id % 10 = 1 THEN 'test'
                  ELSE 'train' END AS split,
             u.conv_id * 100 + u.turn AS sample_id, u.text AS question,
             CASE WHEN u.conv_id % 10 = 1 THEN NULL ELSE a.text END AS answer
      FROM conversations u LEFT JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
      WHERE u.role = 'user'""")
    c["blocks"] = ([], """
      SELECT doc_id AS block_id, text FROM documents""")
    c["block_vec"] = (["blocks"], """
      SELECT b.block_id, e.embedding FROM blocks b JOIN embeddings e ON e.vec_id = b.block_id""")
    c["qvec"] = (["questions"], """
      SELECT q.split, q.sample_id, e.embedding FROM questions q
      JOIN embeddings e ON e.vec_id = q.sample_id % (SELECT count(*) FROM embeddings)""")
    c["scored"] = (["qvec", "block_vec"], """
      SELECT q.sample_id, b.block_id,
             list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
      FROM qvec q, block_vec b""")
    c["hits"] = (["scored", "questions"], f"""
      SELECT h.*, q.split FROM (
        SELECT sample_id, block_id, score,
               row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, block_id) AS rank
        FROM scored) h JOIN questions q USING (sample_id)
      WHERE rank <= {k}""")
    c["corpus"] = ([], "SELECT text FROM documents UNION ALL SELECT text FROM conversations")
    c["vocab"] = (["corpus"], f"""
      SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) - 1 + {FIRST_TOKEN_ID})::INTEGER AS token_id
      FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest({tok('text')}) AS token FROM corpus)
            GROUP BY token)""")
    c["block_tok"] = (["blocks", "vocab"], f"""
      SELECT k AS block_id, ids AS token_ids FROM ({encode_sql('blocks', 'block_id', 'text', ctx)})""")
    c["q_tok"] = (["questions", "vocab"], f"""
      SELECT k AS sample_id, ids AS question_ids FROM ({encode_sql('questions', 'sample_id', 'question', ctx)})""")
    c["a_tok"] = (["questions", "vocab"], f"""
      SELECT k AS sample_id, ids AS answer_ids FROM ({encode_sql('questions', 'sample_id', 'answer', ctx)})""")
    c["sampled"] = (["hits"], f"""
      SELECT sample_id, block_id, score,
             row_number() OVER (PARTITION BY sample_id ORDER BY gk DESC, block_id) AS pos
      FROM (SELECT sample_id, block_id, score,
                   score / {temperature} - ln(-ln(({u32(str(seed), '0', 'sample_id', 'block_id')} + 0.5)
                                                  / 4294967296.0)) AS gk
            FROM hits)
      QUALIFY pos <= {n_sample}""")
    c["sampled_ep"] = (["hits"], f"""
      SELECT epoch, sample_id, block_id,
             row_number() OVER (PARTITION BY epoch, sample_id ORDER BY gk DESC, block_id) AS pos
      FROM (SELECT e.epoch, sample_id, block_id,
                   score / {temperature} - ln(-ln(({u32(str(seed), 'e.epoch', 'sample_id', 'block_id')} + 0.5)
                                                  / 4294967296.0)) AS gk
            FROM hits, (SELECT range AS epoch FROM range({epochs})) e)
      QUALIFY pos <= {n_sample}""")
    c["sel_ctx_ep"] = (["sampled_ep", "block_tok"], """
      SELECT s.epoch, s.sample_id, list(b.token_ids ORDER BY s.pos) AS ctxs
      FROM sampled_ep s JOIN block_tok b USING (block_id) GROUP BY s.epoch, s.sample_id""")
    c["qa_tok_ep"] = (["qa_tok"], f"""
      SELECT t.*, e.epoch FROM qa_tok t, (SELECT range AS epoch FROM range({epochs})) e""")
    c["sel_ctx"] = (["sampled", "block_tok"], """
      SELECT s.sample_id, list(b.token_ids ORDER BY s.pos) AS ctxs
      FROM sampled s JOIN block_tok b USING (block_id) GROUP BY s.sample_id""")
    c["qa_tok"] = (["questions", "q_tok", "a_tok"], """
      SELECT q.split, q.sample_id, t.question_ids, a.answer_ids
      FROM questions q JOIN q_tok t USING (sample_id) JOIN a_tok a USING (sample_id)""")
    return c


def sql(body: str, *needed: str, **params) -> str:
    defs = ctes(**params)
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in defs[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({defs[n][1]})" for n in order) + "\n" + body


def rep(n_expr: str, value: int) -> str:
    """A list of ``n_expr`` copies of ``value``."""
    return f"list_transform(range(greatest({n_expr}, 0)), lambda _x: {value})"


def pad_cut(arr: str, n: int, pad: int) -> str:
    return f"list_slice(list_concat({arr}, {rep(f'{n} - len({arr})', pad)}), 1, {n})"


def assembled_sql(mode: str = "multiple", helpers: bool = True, approach: str = "cached_pretok",
                  ctx: int = CONTEXT_SIZE, gen: int = MAX_GENERATION_LENGTH, per_epoch: bool = False) -> str:
    """Body producing ``split, sample_id, [epoch,] input_ids, label_ids`` as lists
    (``per_epoch`` reads ``qa_tok_ep`` / ``sel_ctx_ep``)."""
    qh, ch, ah = SP["question"], SP["context"], SP["answer"]
    q = f"list_concat([{qh}], t.question_ids)" if helpers else "t.question_ids"
    if helpers and mode == "multiple":
        ctxs = f"flatten(list_transform(coalesce(s.ctxs, []), lambda c: list_concat([{ch}], c)))"
    elif helpers:
        ctxs = f"list_concat([{ch}], flatten(coalesce(s.ctxs, [])))"
    else:
        ctxs = "flatten(coalesce(s.ctxs, []))"
    a_help = f"[{ah}]" if helpers else "[]::INTEGER[]"
    a_len = 1 if helpers else 0
    if approach == "cached_pretok":
        prefix = (f"list_concat({q}, list_slice({ctxs}, 1, greatest({ctx} - (len({q}) + {gen} + {a_len}), 0)),"
                  f" {a_help})")
    else:
        prefix = f"list_concat({q}, {a_help})"
    src = ("qa_tok_ep t LEFT JOIN sel_ctx_ep s USING (epoch, sample_id)" if per_epoch
           else "qa_tok t LEFT JOIN sel_ctx s USING (sample_id)")
    ep = "t.epoch, " if per_epoch else ""
    inner = f"""
      SELECT t.split, t.sample_id, {ep}
             CASE WHEN t.split = 'test' THEN {prefix} ELSE list_concat({prefix}, t.answer_ids) END AS raw_in,
             CASE WHEN t.split = 'test' THEN NULL
                  ELSE list_concat({rep(f'len({prefix})', MASK_ID)}, t.answer_ids) END AS raw_lab
      FROM {src}"""
    return f"""
      SELECT split, sample_id, {'epoch, ' if per_epoch else ''}{pad_cut('raw_in', ctx, EOS)} AS input_ids,
             CASE WHEN raw_lab IS NULL THEN NULL
                  ELSE {pad_cut(f'list_concat(raw_lab, [{EOS}])', ctx, MASK_ID)} END AS label_ids
      FROM ({inner})"""
