"""Registered queries: one per operator of the inventory, over the driver's tables.

Each ``q_*`` takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names and value rendering match the SQL twin in ``ORACLE`` (floats rounded to
6 places, id arrays as space-joined text, counts as BIGINT).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry import oracle as O
from quarry.functions.arrays import attention_mask, ids_text, pad_cut, strip_padding, strip_padding_2d, strip_special
from quarry.functions.text import delimiter_tokens, fmt_duration, fmt_sections, strip_ws, tokens
from quarry.operators import ann as AN
from quarry.operators import ann_leaves as AL
from quarry.operators import assembly as A
from quarry.operators import batching as B
from quarry.operators import metrics as M
from quarry.operators import stats as S
from quarry.operators.encoder import encoder_hook, hashing_embedder
from quarry.operators.retrieval import cached_lookup, gather_blocks, select_by_index
from quarry.operators.pruned import mips_pruned
from quarry.operators.sampling import gumbel_sample, gumbel_sample_rows, hash_sample, paired_subset
from quarry.operators.search import mips_exact, topk_rank
from quarry.operators.vocab import Vocab, read_vocab_file, write_vocab_file
from quarry.params import (BATCHES_BETWEEN_EVALS, CONTEXT_SIZE, EMA_CONSTANT, IVF_REORDER, MASK_ID, NUMBER_EVAL_BATCHES,
                           NUM_RETRIEVALS, PASSAGE_LENGTH_FRACTIONS, PASSAGE_LENGTH_SAMPLE, PQ_DIMS_PER_BLOCK,
                           QA_LENGTH_FRACTIONS, RAGGED_PAD_ID, SAVE_PERIOD_MIN, SEED, SPLIT_CARDINALITIES,
                           TEMPERATURE, special_ids)
from quarry.plans import pipeline as P
from quarry.session import scratch_path, ship_package
from quarry.sources import cache_io as CI
from quarry.sources import tables
from quarry.sources import versions as CV
from quarry.sources.padded import PaddedCache, sink_padded_parts
from quarry.sources.bucketed import bucket_cache, bucketed_lookup
from quarry.streaming import metrics_stream as MS
from quarry.streaming.arrivals import arriving, by_key, by_time
from quarry.streaming.keyed_state import KeyedAverage
from quarry.streaming.live_stream import LiveRetrieval

SP = special_ids()
EOS = SP["eos"]
LOOKUP_BUCKETS = 32
ARRIVALS = 10
_VOCABS: dict = {}

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def skey(spark: SparkSession):
    """Cache key of a live session (a new session never reuses an old entry)."""
    return (spark.sparkContext.applicationId, id(spark))


def vocab_for(spark: SparkSession, sf_dir: str) -> Vocab:
    key = (skey(spark), sf_dir)
    if key not in _VOCABS:
        _VOCABS[key] = P.corpus_vocab(spark, sf_dir)
    return _VOCABS[key]


def cache_for(spark, sf_dir):
    return P.retrieval_cache(spark, sf_dir, vocab_for(spark, sf_dir))


def samples_for(spark, sf_dir, **kw):
    return P.training_samples(cache_for(spark, sf_dir), **kw)


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# Sources and projections
# ---------------------------------------------------------------------------

@register("src_questions", O.sql("SELECT split, sample_id, question, answer FROM questions", "questions"))
def q_src_questions(spark, sf):
    return tables.questions(spark, sf)


@register("qa_project", O.sql(
    "SELECT sample_id, question, answer, answer IS NOT NULL AS has_answer FROM questions", "questions"))
def q_qa_project(spark, sf):
    return tables.questions(spark, sf).select("sample_id", "question", "answer",
                                              F.col("answer").isNotNull().alias("has_answer"))


@register("src_blocks", O.sql("SELECT block_id, text FROM blocks", "blocks"))
def q_src_blocks(spark, sf):
    return tables.blocks(spark, sf, with_vectors=False)


@register("src_vectors", O.sql("""
    SELECT block_id, len(embedding)::BIGINT AS dim,
           round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS sq_norm
    FROM block_vec""", "block_vec"))
def q_src_vectors(spark, sf):
    from quarry.functions.arrays import dot
    v = tables.block_vectors(spark, sf, dim=64)
    return v.select("block_id", F.size("embedding").cast("long").alias("dim"),
                    r6(dot(F.col("embedding"), F.col("embedding"))).alias("sq_norm"))


@register("src_vocab", O.sql("SELECT token, token_id FROM vocab", "vocab"))
def q_src_vocab(spark, sf):
    return vocab_for(spark, sf).df.select("token", "token_id")


@register("vocab_encode", O.sql("""
    SELECT sample_id, array_to_string(question_ids, ' ') AS question_ids FROM q_tok""", "q_tok"))
def q_vocab_encode(spark, sf):
    voc = vocab_for(spark, sf)
    return voc.encode_into(tables.questions(spark, sf), {"ids": "question"}, CONTEXT_SIZE).select(
        "sample_id", ids_text(F.col("ids")).alias("question_ids"))


def question_ids(spark, sf):
    """Questions with ``ids``, by a column function or a join as the vocabulary's size asks."""
    return vocab_for(spark, sf).encode_into(tables.questions(spark, sf), {"ids": "question"}, CONTEXT_SIZE)


@register("vocab_decode", O.sql(f"""
    SELECT t.sample_id, coalesce(d.txt, '') AS decoded FROM q_tok t LEFT JOIN (
      SELECT sample_id, string_agg(coalesce(v.token, '<< ' || x.id || ' >>'), ' ' ORDER BY x.pos) AS txt
      FROM (SELECT sample_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos
            FROM (SELECT sample_id, list_concat([{SP['question']}], question_ids) AS ids FROM q_tok)) x
      LEFT JOIN vocab v ON v.token_id = x.id GROUP BY sample_id) d USING (sample_id)""", "q_tok", "vocab"))
def q_vocab_decode(spark, sf):
    voc = vocab_for(spark, sf)
    q = voc.encode_into(tables.questions(spark, sf), {"ids": "question"}, CONTEXT_SIZE)
    q = q.withColumn("ids", F.concat(F.array(F.lit(SP["question"])), "ids"))
    return voc.decode_into(q, {"decoded": "ids"}).select("sample_id", "decoded")


@register("truncate_field", O.sql(f"""
    SELECT sample_id, len({O.tok('question')})::BIGINT AS n_tokens,
           len(question_ids)::BIGINT AS n_kept
    FROM questions JOIN q_tok USING (sample_id)""", "questions", "q_tok"))
def q_truncate_field(spark, sf):
    return question_ids(spark, sf).select(
        "sample_id", F.size(tokens(F.col("question"))).cast("long").alias("n_tokens"),
        F.size("ids").cast("long").alias("n_kept"))


@register("shortest_answer", """
    SELECT conv_id, regexp_replace(arg_min(text, struct_pack(l := length(text), t := turn)),
                                   '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS answer,
           count(*)::BIGINT AS n_answers
    FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def q_shortest_answer(spark, sf):
    qa = tables.first_question_shortest_answer(spark, sf)
    return qa.select("conv_id", "answer", F.col("n_answers").cast("long"))


@register("enum_check", O.sql("""
    SELECT split, count(*)::BIGINT AS n FROM questions
    WHERE split IN ('train', 'eval', 'test') GROUP BY split""", "questions"))
def q_enum_check(spark, sf):
    qs = tables.questions(spark, sf)
    return (qs.select(tables.check_split(F.col("split")).alias("split"))
              .groupBy("split").agg(F.count(F.lit(1)).alias("n")))


@register("split_variant", O.sql("""
    SELECT split, count(*)::BIGINT AS n, count(answer)::BIGINT AS n_with_answer
    FROM questions GROUP BY split""", "questions"))
def q_split_variant(spark, sf):
    qs = tables.questions(spark, sf)
    return qs.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                   F.count("answer").alias("n_with_answer"))


# ---------------------------------------------------------------------------
# Search, gather, lookups
# ---------------------------------------------------------------------------

@register("mips_exact", O.sql(
    "SELECT sample_id, rank::BIGINT AS rank, block_id, round(score, 6) AS score FROM hits", "hits"))
def q_mips_exact(spark, sf):
    h = P.retrieval_hits(spark, sf)
    return h.select("sample_id", "rank", "block_id", r6(F.col("score")).alias("score"))


@register("topk_rank", """
    SELECT event_type, event_id, value, rank::BIGINT AS rank FROM (
      SELECT event_type, event_id, value,
             row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
      FROM events) WHERE rank <= 5""")
def q_topk_rank(spark, sf):
    ev = tables.read_table(spark, sf, "events").select("event_type", "event_id", "value")
    out = topk_rank(ev, "event_type", [F.desc("value"), F.asc("event_id")], 5)
    return out.withColumn("rank", F.col("rank").cast("long"))


@register("gather_blocks", O.sql("""
    SELECT h.sample_id, h.rank::BIGINT AS rank, h.block_id, b.text
    FROM hits h JOIN blocks b USING (block_id)""", "hits", "blocks"))
def q_gather_blocks(spark, sf):
    qs = tables.questions(spark, sf)
    h = P.retrieval_hits(spark, sf, qs=qs, with_split=False).select("sample_id", "rank", "block_id")
    return gather_blocks(h, tables.blocks(spark, sf, with_vectors=False), n_hits=qs.count() * 10)


@register("collect_retrievals", O.sql("""
    SELECT sample_id, count(*)::BIGINT AS n,
           string_agg(block_id::VARCHAR, ' ' ORDER BY rank) AS block_ids,
           round(sum(score), 6) AS score_sum
    FROM hits GROUP BY sample_id""", "hits"))
def q_collect_retrievals(spark, sf):
    c = cache_for(spark, sf)
    r = F.col("retrievals")
    return c.select("sample_id", F.size(r).cast("long").alias("n"),
                    F.array_join(F.transform(r, lambda x: x["block_id"].cast("string")), " ").alias("block_ids"),
                    r6(F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x["score"])).alias("score_sum"))


@register("cached_lookup", O.sql("""
    SELECT r.split, r.sample_id, (h.n IS NOT NULL) AS found, coalesce(h.n, 0)::BIGINT AS n_retrievals
    FROM (SELECT split, sample_id FROM questions
          UNION ALL SELECT 'test', 1000000000000 + item_id FROM benchmark) r
    LEFT JOIN (SELECT sample_id, count(*) AS n FROM hits GROUP BY sample_id) h USING (sample_id)""",
    "questions", "hits"))
def q_cached_lookup(spark, sf):
    c = cache_for(spark, sf)
    req = tables.questions(spark, sf).select("split", "sample_id").unionByName(
        tables.benchmark_questions(spark, sf).select("split", "sample_id"))
    out = cached_lookup(req, c.select("split", "sample_id", "retrievals"))
    return out.select("split", "sample_id", "found",
                      F.size("retrievals").cast("long").alias("n_retrievals"))


@register("bucketed_lookup", ORACLE["cached_lookup"])
def q_bucketed_lookup(spark, sf):
    # The same lookups against the cache as a bucketed, sorted table: the cache is not shuffled.
    path = scratch_path(spark, "buckets")
    name = "quarry_" + path.rsplit("-", 1)[-1]
    bucket_cache(cache_for(spark, sf).select("split", "sample_id", "retrievals"), name, LOOKUP_BUCKETS, path=path)
    req = tables.questions(spark, sf).select("split", "sample_id").unionByName(
        tables.benchmark_questions(spark, sf).select("split", "sample_id"))
    out = bucketed_lookup(spark, req, name, LOOKUP_BUCKETS)
    return out.select("split", "sample_id", "found", F.size("retrievals").cast("long").alias("n_retrievals"))


# ---------------------------------------------------------------------------
# Sampling and assembly
# ---------------------------------------------------------------------------

@register("gumbel_sample", O.sql(
    "SELECT sample_id, pos::BIGINT AS pos, block_id FROM sampled", "sampled"))
def q_gumbel_sample(spark, sf):
    h = P.retrieval_hits(spark, sf)
    from quarry.operators.retrieval import collect_retrievals
    per_q = collect_retrievals(h, "sample_id", ["block_id", "score"])
    sel = gumbel_sample(F.col("retrievals"), F.col("sample_id"), NUM_RETRIEVALS, TEMPERATURE, SEED)
    return (per_q.select("sample_id", F.posexplode(sel).alias("pos", "r"))
                 .select("sample_id", (F.col("pos") + 1).cast("long").alias("pos"),
                         F.col("r.block_id").alias("block_id")))


@register("gumbel_sample_rows", O.sql(
    "SELECT sample_id, pos::BIGINT AS pos, block_id FROM sampled", "sampled"))
def q_gumbel_sample_rows(spark, sf):
    # The same draws from the hits as rows: no list is built, any number of candidates.
    out = gumbel_sample_rows(P.retrieval_hits(spark, sf).select("sample_id", "block_id", "score"))
    return out.select("sample_id", F.col("draw").alias("pos"), "block_id")


@register("select_by_index", O.sql("""
    SELECT sample_id, string_agg(s.block_id::VARCHAR, ' ' ORDER BY s.pos) AS block_ids
    FROM sampled s GROUP BY sample_id""", "sampled"))
def q_select_by_index(spark, sf):
    # The sampled positions are turned into 0-based indexes into the rank-ordered
    # retrieval list, then gathered in-row.
    c = cache_for(spark, sf)
    sel = gumbel_sample(F.col("retrievals"), F.col("sample_id"), NUM_RETRIEVALS, TEMPERATURE, SEED)
    idx = F.transform(sel, lambda r: (r["rank"] - 1).cast("int"))
    picked = select_by_index(F.col("retrievals"), idx)
    return c.select("sample_id", F.array_join(
        F.transform(picked, lambda r: r["block_id"].cast("string")), " ").alias("block_ids"))


def _samples_query(name, mode="multiple", helpers=True, approach="cached_pretok"):
    body = f"""
      SELECT split, sample_id, array_to_string(input_ids, ' ') AS input_ids,
             array_to_string(label_ids, ' ') AS label_ids
      FROM ({O.assembled_sql(mode, helpers, approach)})"""

    @register(name, O.sql(body, "qa_tok", "sel_ctx"))
    def q(spark, sf):
        s = samples_for(spark, sf, helper_mode=mode, use_helper_words=helpers, approach=approach)
        return s.select("split", "sample_id", ids_text(F.col("input_ids")).alias("input_ids"),
                        ids_text(F.col("label_ids")).alias("label_ids"))
    return q


_samples_query("assemble_retrieval")
_samples_query("concat_contexts", mode="once")
_samples_query("helper_words")     # question, context and answer words on; off is the parameter use_helper_words
_samples_query("assemble_naked", approach="naked_lm")


def _fin_sql(cols: str) -> str:
    return O.sql(f"SELECT {cols} FROM ({O.assembled_sql()})", "qa_tok", "sel_ctx")


@register("finalize_sample", _fin_sql(f"""
    split, sample_id, len(input_ids)::BIGINT AS n_input, len(label_ids)::BIGINT AS n_label,
    len(list_filter(input_ids, lambda x: x = {EOS}))::BIGINT AS n_eos_input,
    len(list_filter(label_ids, lambda x: x <> {MASK_ID}))::BIGINT AS n_scored"""))
def q_finalize_sample(spark, sf):
    s = samples_for(spark, sf)
    return s.select("split", "sample_id", F.size("input_ids").cast("long").alias("n_input"),
                    F.when(F.col("label_ids").isNull(), None).otherwise(F.size("label_ids")).cast("long")
                    .alias("n_label"),
                    F.size(F.filter("input_ids", lambda x: x == EOS)).cast("long").alias("n_eos_input"),
                    F.when(F.col("label_ids").isNull(), None).otherwise(
                        F.size(F.filter("label_ids", lambda x: x != MASK_ID))).cast("long").alias("n_scored"))


@register("context_budget", O.sql(f"""
    SELECT sample_id, ({CONTEXT_SIZE} - (len(question_ids) + 1 + 350 + 1))::BIGINT AS budget,
           least(greatest({CONTEXT_SIZE} - (len(question_ids) + 1 + 350 + 1), 0),
                 len(flatten(list_transform(coalesce(s.ctxs, []), lambda c: list_concat([0], c)))))::BIGINT
             AS n_context_tokens
    FROM qa_tok LEFT JOIN sel_ctx s USING (sample_id)""", "qa_tok", "sel_ctx"))
def q_context_budget(spark, sf):
    c = cache_for(spark, sf)
    sel = gumbel_sample(F.col("retrievals"), F.col("sample_id"), NUM_RETRIEVALS, TEMPERATURE, SEED)
    ctx = A.concat_contexts(F.transform(sel, lambda r: r["token_ids"]), F.array(F.lit(SP["context"])))
    q_len = F.size("question_ids") + 1
    limit = A.context_budget(q_len, CONTEXT_SIZE, 350, 1)
    return c.select("sample_id", limit.cast("long").alias("budget"),
                    F.size(F.slice(ctx, 1, F.greatest(limit, F.lit(0)))).cast("long").alias("n_context_tokens"))


@register("prompt_extract", _fin_sql(f"""
    split, sample_id, array_to_string(CASE WHEN split = 'test'
        THEN list_slice(input_ids, 1, len(input_ids) - coalesce(list_position(list_transform(
                 list_reverse(input_ids), lambda x: x <> {EOS}), true) - 1, len(input_ids)))
        ELSE list_transform(list_filter(list_zip(input_ids, label_ids),
                 lambda p: p[2] = {MASK_ID} AND p[1] <> {EOS}), lambda p: p[1]) END, ' ') AS prompt_ids"""))
def q_prompt_extract(spark, sf):
    s = samples_for(spark, sf)
    pr = A.prompt_extract(F.col("input_ids"), F.col("label_ids"), F.col("split") == "test", EOS)
    return s.select("split", "sample_id", ids_text(pr).alias("prompt_ids"))


@register("row_map", ORACLE["prompt_extract"])
def q_row_map(spark, sf):
    # The same prompts as prompt_extract, built as a chain of dataset closures.
    prompts = (cache_for(spark, sf)
               .transform(P.make_retrieve_and_merge())
               .transform(P.make_prompt_prep(EOS)))
    return prompts.select("split", "sample_id", ids_text(F.col("prompt_ids")).alias("prompt_ids"))


@register("strip_special", _fin_sql(f"""
    sample_id, array_to_string(list_filter(input_ids, lambda x: x >= 0 AND x <> {EOS}), ' ') AS ids"""))
def q_strip_special(spark, sf):
    s = samples_for(spark, sf)
    return s.select("sample_id", ids_text(strip_special(F.col("input_ids"), EOS)).alias("ids"))


@register("attention_mask", _fin_sql(f"""
    sample_id, len(list_filter(input_ids, lambda x: x <> {EOS}))::BIGINT AS n_attended,
    len(input_ids)::BIGINT AS n"""))
def q_attention_mask(spark, sf):
    s = samples_for(spark, sf)
    m = attention_mask(F.col("input_ids"), EOS)
    return s.select("sample_id", F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_attended"),
                    F.size(m).cast("long").alias("n"))


@register("context_count", _fin_sql(f"""
    sample_id, len(list_filter(input_ids, lambda x: x = {SP['context']}))::BIGINT AS n_contexts"""))
def q_context_count(spark, sf):
    s = samples_for(spark, sf)
    return s.select("sample_id", A.context_count(F.col("input_ids"), SP["context"]).cast("long")
                    .alias("n_contexts"))


@register("strip_padding", O.sql("""
    SELECT sample_id, array_to_string(question_ids, ' ') AS question_ids FROM q_tok""", "q_tok"))
def q_strip_padding(spark, sf):
    # Dense import form: ids padded with -1 to the model size, as stored by the
    # reference cache; stripping the trailing pad recovers the ragged ids.
    dense = pad_cut(F.col("ids"), CONTEXT_SIZE, RAGGED_PAD_ID)
    return question_ids(spark, sf).select(
        "sample_id", ids_text(strip_padding(dense, RAGGED_PAD_ID)).alias("question_ids"))


@register("encoder_inputs", O.sql(f"""
    SELECT sample_id, array_to_string(list_concat([{SP['cls']}], question_ids, [{SP['sep']}]), ' ') AS input_ids,
           (len(question_ids) + 2)::BIGINT AS n_mask
    FROM q_tok""", "q_tok"))
def q_encoder_inputs(spark, sf):
    e = A.encoder_inputs(F.col("ids"), SP["cls"], SP["sep"])
    return question_ids(spark, sf).select(
        "sample_id", ids_text(e["input_ids"]).alias("input_ids"),
        F.aggregate(e["input_mask"], F.lit(0).cast("long"), lambda a, x: a + x).alias("n_mask"))


@register("align_longest", _fin_sql(f"""
    sample_id, len(list_filter(input_ids, lambda x: x <> {EOS}))::BIGINT AS n_real,
    (CASE WHEN label_ids IS NULL THEN 0 ELSE len(label_ids) END)::BIGINT AS n_labels,
    greatest(len(input_ids), coalesce(len(label_ids), 0))::BIGINT AS n_pairs,
    array_to_string(list_transform(list_zip(input_ids, coalesce(label_ids, [])),
      lambda p: coalesce(p[1]::VARCHAR, '_') || ':' || coalesce(p[2]::VARCHAR, '_')), ' ') AS pairs"""))
def q_align_longest(spark, sf):
    s = samples_for(spark, sf)
    z = F.arrays_zip(F.col("input_ids").alias("i"), F.coalesce(F.col("label_ids"), F.array().cast("array<int>")).alias("l"))
    text = lambda x: F.coalesce(x.cast("string"), F.lit("_"))
    return s.select("sample_id",
                    F.size(F.filter(z, lambda p: p["i"].isNotNull() & (p["i"] != EOS))).cast("long").alias("n_real"),
                    F.size(F.filter(z, lambda p: p["l"].isNotNull())).cast("long").alias("n_labels"),
                    F.size(z).cast("long").alias("n_pairs"),
                    F.array_join(F.transform(z, lambda p: F.concat(text(p["i"]), F.lit(":"), text(p["l"]))), " ").alias("pairs"))


@register("strip_padding_2d", O.sql("""
    SELECT sample_id, CASE WHEN len(question_ids) > 4 THEN '[' || array_to_string(list_slice(question_ids, 1, 4), ' ') || '][][' ||
             array_to_string(list_slice(question_ids, 5, 8), ' ') || ']'
           WHEN len(question_ids) > 0 THEN '[' || array_to_string(question_ids, ' ') || ']' ELSE '' END AS rows
    FROM q_tok""", "q_tok"))
def q_strip_padding_2d(spark, sf):
    # Rank-2 dense form, as neighbour lists are stored: rows padded with -1 to one width, an empty
    # row between filled ones and empty rows at the end. Only the latter go.
    q = vocab_for(spark, sf).encode_into(tables.questions(spark, sf), {"ids": "question"}, CONTEXT_SIZE)
    none = F.array().cast("array<int>")
    dense = F.transform(F.array(F.slice("ids", 1, 4), none, F.slice("ids", 5, 4), none, none), lambda r: pad_cut(r, 4, RAGGED_PAD_ID))
    rows = F.transform(strip_padding_2d(dense), lambda r: F.concat(F.lit("["), ids_text(r), F.lit("]")))
    return q.select("sample_id", F.array_join(rows, "").alias("rows"))


# ---------------------------------------------------------------------------
# Scalar functions
# ---------------------------------------------------------------------------

@register("fmt_duration", """
    SELECT event_type, printf('%02d:%02d:%02d.%03d', h::BIGINT, m::BIGINT, floor(r2)::BIGINT,
                              floor((r2 - floor(r2)) * 1000)::BIGINT) AS span
    FROM (SELECT event_type, h, m, r1 - m * 60 AS r2 FROM (
      SELECT event_type, h, r1, floor(r1 / 60) AS m FROM (
        SELECT event_type, h, s - h * 3600 AS r1 FROM (
          SELECT event_type, s, floor(s / 3600) AS h FROM (
            SELECT event_type, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s
            FROM events GROUP BY event_type)))))""")
def q_fmt_duration(spark, sf):
    ev = tables.read_table(spark, sf, "events")
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts"))
    return (ev.groupBy("event_type").agg((span / 1e6).alias("s"))
              .select("event_type", fmt_duration(F.col("s")).alias("span")))


@register("fmt_sections", O.sql("""
    SELECT sample_id, replace(regexp_replace(replace(regexp_replace(replace(regexp_replace(t, 'Question:\\n+', 'Question:', 'g'), 'Question:', chr(10) || chr(10) || 'Question:' || chr(10)), 'Answer:\\n+', 'Answer:', 'g'), 'Answer:', chr(10) || chr(10) || 'Answer:' || chr(10)), 'Context:\\n+', 'Context:', 'g'), 'Context:', chr(10) || chr(10) || 'Context:' || chr(10)) AS text
    FROM (SELECT sample_id, 'Question:' || chr(10) || question || chr(10) || 'Answer:' || chr(10) ||
                 coalesce(answer, '') AS t FROM questions)""", "questions"))
def q_fmt_sections(spark, sf):
    qs = tables.questions(spark, sf)
    t = F.concat(F.lit("Question:\n"), F.col("question"), F.lit("\nAnswer:\n"), F.coalesce("answer", F.lit("")))
    return qs.select("sample_id", fmt_sections(t).alias("text"))


# ---------------------------------------------------------------------------
# Length study and checks
# ---------------------------------------------------------------------------


WS = r"[ \t\n\r\f\x0B]"
STRIP_SQL = f"regexp_replace({{}}, '^{WS}+|{WS}+$', '', 'g')"

QA_LEN_SQL = f"""
    SELECT len({O.tok(f"{STRIP_SQL.format('q')} || ' ' || {STRIP_SQL.format('a')}")}) AS len FROM (
      SELECT u.conv_id, arg_min(u.text, u.turn) AS q FROM conversations u
      WHERE u.role = 'user' AND (CASE WHEN u.conv_id % 10 = 0 THEN 'eval' WHEN u.conv_id % 10 = 1 THEN 'test'
                                      ELSE 'train' END) = 'train'
      GROUP BY u.conv_id) JOIN (
      SELECT conv_id, arg_min(text, struct_pack(l := length(text), t := turn)) AS a
      FROM conversations WHERE role = 'assistant' GROUP BY conv_id) USING (conv_id)"""

LEN_SAMPLE = 150   # below the table's size at every scale, so that the cut is seen
PASSAGE_LEN_SQL = f"SELECT doc_id, len({O.tok('text')}) AS len FROM documents WHERE text IS NOT NULL"
PASSAGE_SAMPLE_SQL = f"""
    SELECT doc_id, len({O.tok('text')}) AS len FROM documents
    ORDER BY {O.u32('7', 'doc_id')}, doc_id LIMIT {LEN_SAMPLE}"""


def qa_lengths(spark, sf):
    # The length study runs on the training split.
    qa = tables.first_question_shortest_answer(spark, sf).where(tables.split_of(F.col("conv_id")) == "train")
    txt = F.concat(strip_ws(F.col("question")), F.lit(" "), F.col("answer"))
    return qa.select(F.size(tokens(txt)).alias("len"))


def passage_sample(spark, sf, n=PASSAGE_LENGTH_SAMPLE):
    docs = tables.read_table(spark, sf, "documents").select("doc_id")
    text = tables.read_table(spark, sf, "documents").select("doc_id", "text")
    chosen = hash_sample(docs, "doc_id", n, SEED)  # ids only; the texts of the chosen follow
    return text.join(chosen, "doc_id", "left_semi").select("doc_id", F.size(tokens(F.col("text"))).alias("len"))


def passage_lengths(spark, sf):
    docs = tables.read_table(spark, sf, "documents").where(F.col("text").isNotNull())
    return docs.select(F.size(tokens(F.col("text"))).alias("len"))


def _cutoff_sql(src: str, fractions) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({f} AS DOUBLE) AS fraction, quantile_disc(len, {f})::BIGINT AS cutoff FROM ({src})"
        for f in fractions)


@register("length_hist", f"SELECT len::BIGINT AS len, count(*)::BIGINT AS cnt FROM ({QA_LEN_SQL}) GROUP BY len")
def q_length_hist(spark, sf):
    h = S.length_hist(qa_lengths(spark, sf))
    return h.select(F.col("len").cast("long"), F.col("cnt").cast("long"))


@register("cum_fraction", f"""
    SELECT len::BIGINT AS len, cnt::BIGINT AS cnt,
           round(sum(cnt) OVER (ORDER BY len) / sum(cnt) OVER (), 6) AS cum_frac
    FROM (SELECT len, count(*) AS cnt FROM ({QA_LEN_SQL}) GROUP BY len)""")
def q_cum_fraction(spark, sf):
    h = S.cum_fraction(S.length_hist(qa_lengths(spark, sf)))
    return h.select(F.col("len").cast("long"), F.col("cnt").cast("long"), r6(F.col("cum_frac")).alias("cum_frac"))


@register("length_cutoffs", _cutoff_sql(QA_LEN_SQL, QA_LENGTH_FRACTIONS))
def q_length_cutoffs(spark, sf):
    return S.length_cutoffs(qa_lengths(spark, sf), QA_LENGTH_FRACTIONS)


@register("retrieval_budget", f"""
    SELECT fraction, cutoff, i::BIGINT AS i, round_even(({CONTEXT_SIZE} - cutoff) / i, 0)::BIGINT AS budget
    FROM ({_cutoff_sql(QA_LEN_SQL, QA_LENGTH_FRACTIONS)}), range(1, 5) t(i)""")
def q_retrieval_budget(spark, sf):
    return S.retrieval_budget(S.length_cutoffs(qa_lengths(spark, sf), QA_LENGTH_FRACTIONS))


@register("len_sample", f"SELECT doc_id, len::BIGINT AS len FROM ({PASSAGE_SAMPLE_SQL})")
def q_len_sample(spark, sf):
    return passage_sample(spark, sf, LEN_SAMPLE).select("doc_id", F.col("len").cast("long"))


@register("passage_cutoffs", _cutoff_sql(PASSAGE_LEN_SQL, PASSAGE_LENGTH_FRACTIONS))
def q_passage_cutoffs(spark, sf):
    return S.length_cutoffs(passage_lengths(spark, sf), PASSAGE_LENGTH_FRACTIONS)


@register("unique_check", O.sql("""
    SELECT 'questions' AS "table", count(*)::BIGINT AS n, count(DISTINCT sample_id)::BIGINT AS n_distinct,
           count(*) = count(DISTINCT sample_id) AS ok FROM questions
    UNION ALL SELECT 'blocks', count(*), count(DISTINCT block_id), count(*) = count(DISTINCT block_id) FROM blocks
    UNION ALL SELECT 'events', count(*), count(DISTINCT event_id), count(*) = count(DISTINCT event_id) FROM events
    UNION ALL SELECT 'vocab', count(*), count(DISTINCT token), count(*) = count(DISTINCT token) FROM vocab""",
    "questions", "blocks", "vocab"))
def q_unique_check(spark, sf):
    parts = [S.unique_check(tables.questions(spark, sf), "sample_id", "questions"),
             S.unique_check(tables.blocks(spark, sf, with_vectors=False), "block_id", "blocks"),
             S.unique_check(tables.read_table(spark, sf, "events"), "event_id", "events"),
             S.unique_check(vocab_for(spark, sf).df, "token", "vocab")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table", F.col("n").cast("long"), F.col("n_distinct").cast("long"), "ok")


_EXP_SQL = " UNION ALL ".join(f"SELECT '{k}' AS split, {v}::BIGINT AS expected" for k, v in SPLIT_CARDINALITIES.items())


@register("cardinality_check", O.sql(f"""
    SELECT coalesce(g.split, e.split) AS split, coalesce(g.n, 0)::BIGINT AS n, e.expected,
           coalesce(g.n, 0) = e.expected AS ok
    FROM (SELECT split, count(*) AS n FROM questions GROUP BY split) g
    FULL JOIN ({_EXP_SQL}) e USING (split)""", "questions"))
def q_cardinality_check(spark, sf):
    return S.cardinality_check(tables.questions(spark, sf), SPLIT_CARDINALITIES)


@register("sample_checks", _fin_sql(f"""
    split, count(*)::BIGINT AS n,
    count(*) FILTER (WHERE list_contains(input_ids, -1))::BIGINT AS n_pad_input,
    count(*) FILTER (WHERE coalesce(list_contains(label_ids, -1), false))::BIGINT AS n_pad_label,
    count(*) FILTER (WHERE label_ids IS NOT NULL AND len(list_filter(label_ids, lambda x: x <> {MASK_ID})) = 0)::BIGINT AS n_all_masked,
    count(*) FILTER (WHERE len(list_filter(input_ids, lambda x: x <> {EOS})) = 0)::BIGINT AS n_empty_input,
    count(*) FILTER (WHERE len(list_filter(input_ids, lambda x: x >= 0)) = 0)::BIGINT AS n_all_negative
    """).replace("FROM (", "FROM (", 1) + " GROUP BY split")
def q_sample_checks(spark, sf):
    return S.sample_violations(samples_for(spark, sf), EOS)


#: Suspected totals, given by the caller; tables without one are only counted.
EXPECTED_ROWS = {"region": 5, "nation": 25, "embeddings": 1}


@register("count_records", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*)::BIGINT AS n_rows, {EXPECTED_ROWS.get(t, 'NULL')}::BIGINT AS expected, "
    f"count(*) = {EXPECTED_ROWS.get(t, 'NULL')} AS ok FROM {t}" for t in tables.TABLES))
def q_count_records(spark, sf):
    return S.count_records({t: tables.read_table(spark, sf, t) for t in tables.TABLES}, EXPECTED_ROWS)


# ---------------------------------------------------------------------------
# Metrics (events read as a metrics log: split = event_type, loss = value)
# ---------------------------------------------------------------------------

def _log(spark, sf):
    return tables.metrics_log(spark, sf)


STEP_SQL = "(epoch_us(ts) // 3600000000)::BIGINT"
LOSS_MEAN_SQL = f"""
    SELECT split, step, avg(m) AS loss, count(*)::BIGINT AS n_replicas FROM (
      SELECT event_type AS split, {STEP_SQL} AS step, user_id % 8 AS replica, avg(value) AS m
      FROM events GROUP BY ALL) GROUP BY split, step"""


def _loss_mean(spark, sf):
    log = _log(spark, sf)
    step = F.floor(M.epoch_micros(F.col("ts")) / F.lit(3600000000)).cast("long")
    return M.loss_mean(log, step, F.pmod("user_id", F.lit(8)))


@register("loss_mean", f"SELECT split, step, round(loss, 6) AS loss, n_replicas FROM ({LOSS_MEAN_SQL})")
def q_loss_mean(spark, sf):
    lm = _loss_mean(spark, sf)
    return lm.select("split", "step", r6(F.col("loss")).alias("loss"), F.col("n_replicas").cast("long"))


def _ema_sql(src: str, key: str, order: str, x: str, c: float = EMA_CONSTANT) -> str:
    return f"""list_reduce(list({x}) OVER (PARTITION BY {key} ORDER BY {order}
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda acc, v: {c} * acc + {1 - c} * v)"""


@register("perplexity", f"""
    SELECT split, step, printf('%.6e', exp(loss)) AS ppl,
           printf('%.6e', exp({_ema_sql('', 'split', 'step', 'loss')})) AS ppl_ema
    FROM ({LOSS_MEAN_SQL})""")
def q_perplexity(spark, sf):
    lm = M.ema(_loss_mean(spark, sf).select("split", "step", "loss"), "split", ["step"], "loss")
    # Perplexities span many orders of magnitude: compared at 7 significant digits.
    return lm.select("split", "step", F.format_string("%.6e", M.perplexity(F.col("loss"))).alias("ppl"),
                     F.format_string("%.6e", M.perplexity(F.col("ema"))).alias("ppl_ema"))


@register("ema", f"""
    SELECT event_type AS split, event_id, round({_ema_sql('', 'event_type', 'ts, event_id', 'value')}, 6) AS ema
    FROM events""")
def q_ema(spark, sf):
    log = _log(spark, sf).select("split", "event_id", "ts", "loss")
    out = M.ema(log, "split", ["ts", "event_id"], "loss")
    return out.select("split", "event_id", r6(F.col("ema")).alias("ema"))


@register("numeric_check", """
    SELECT event_type AS split, count(*) FILTER (WHERE isnan(value) OR isinf(value))::BIGINT AS n_bad,
           count(*)::BIGINT AS n FROM events GROUP BY event_type""")
def q_numeric_check(spark, sf):
    return M.numeric_check(_log(spark, sf), "loss")


@register("step_counters", """
    SELECT event_type AS split, event_id,
           row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::BIGINT AS batches,
           sum(json_extract_string(props, '$.k')::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS samples
    FROM events""")
def q_step_counters(spark, sf):
    log = _log(spark, sf).select("split", "event_id", "ts", "batch_size")
    out = M.step_counters(log, "split", ["ts", "event_id"], "batch_size")
    return out.select("split", "event_id", "batches", "samples")


@register("batch_duration", """
    SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 1e6, 6) AS duration_s
    FROM events""")
def q_batch_duration(spark, sf):
    log = _log(spark, sf).select("event_id", "ts")
    out = M.batch_duration(log, "ts", ["ts", "event_id"])
    return out.select("event_id", r6(F.col("duration_s")).alias("duration_s"))


CADENCE_SQL = f"""
    SELECT split, (unnest(acc[2:]))::BIGINT AS event_id FROM (
      SELECT event_type AS split,
             list_reduce(list([epoch_us(ts) / 1e6, event_id::DOUBLE] ORDER BY ts, event_id),
                         lambda acc, x: CASE WHEN x[1] >= acc[1] + {SAVE_PERIOD_MIN * 60}
                                             THEN list_concat([x[1]], acc[2:], [x[2]]) ELSE acc END) AS acc
      FROM events GROUP BY event_type)"""


@register("cadence_marks", CADENCE_SQL)
def q_cadence_marks(spark, sf):
    log = _log(spark, sf).select("split", "event_id", "ts")
    out = M.cadence_marks(log, "split", "ts", ["ts", "event_id"], SAVE_PERIOD_MIN * 60.0)
    return out.where("marked").select("split", "event_id")


# ---------------------------------------------------------------------------
# Shuffle, batches, epochs, replicas, schedule
# ---------------------------------------------------------------------------

BATCH = 8
POS_SQL = f"(row_number() OVER (PARTITION BY split ORDER BY {O.u32(str(SEED), '0', 'sample_id')}, sample_id) - 1)"
BATCHES_SQL = f"""
    SELECT split, sample_id, pos, (pos // {BATCH})::BIGINT AS batch_no, (pos % {BATCH})::BIGINT AS pos_in_batch,
           (CASE WHEN pos // {BATCH} < n // {BATCH} THEN {BATCH} ELSE n - (n // {BATCH}) * {BATCH} END)::BIGINT
             AS batch_rows
    FROM (SELECT split, sample_id, {POS_SQL} AS pos, count(*) OVER (PARTITION BY split) AS n FROM questions)
    WHERE split = 'test' OR pos // {BATCH} < n // {BATCH}"""


@register("seeded_shuffle", O.sql(f"SELECT split, sample_id, {POS_SQL}::BIGINT AS pos FROM questions", "questions"))
def q_seeded_shuffle(spark, sf):
    out = B.shuffled_positions(tables.questions(spark, sf).select("split", "sample_id"))
    return out.select("split", "sample_id", F.col("pos").cast("long"))


def _batches(spark, sf):
    return B.make_batches(tables.questions(spark, sf).select("split", "sample_id"), BATCH)


@register("make_batches", O.sql(
    f"SELECT split, sample_id, batch_no, pos_in_batch, batch_rows FROM ({BATCHES_SQL})", "questions"))
def q_make_batches(spark, sf):
    return _batches(spark, sf).select("split", "sample_id", "batch_no", "pos_in_batch", "batch_rows")


@register("replica_split", O.sql(f"""
    SELECT split, sample_id, batch_no, (pos_in_batch // (batch_rows // 3))::BIGINT AS replica
    FROM ({BATCHES_SQL}) WHERE batch_rows // 3 > 0 AND pos_in_batch // (batch_rows // 3) < 3""", "questions"))
def q_replica_split(spark, sf):
    return B.replica_split(_batches(spark, sf), 3).select("split", "sample_id", "batch_no", "replica")


@register("take_batches", O.sql(
    f"SELECT split, sample_id, batch_no FROM ({BATCHES_SQL}) WHERE batch_no < 2", "questions"))
def q_take_batches(spark, sf):
    return B.take_batches(_batches(spark, sf), 2).select("split", "sample_id", "batch_no")


@register("repeat_epochs", O.sql(f"""
    SELECT epoch::BIGINT AS epoch, split, sample_id,
           (row_number() OVER (PARTITION BY split, epoch ORDER BY {O.u32(str(SEED), 'epoch', 'sample_id')},
                                sample_id) - 1)::BIGINT AS pos
    FROM questions, range(3) t(epoch)""", "questions"))
def q_repeat_epochs(spark, sf):
    ep = B.repeat_epochs(tables.questions(spark, sf).select("split", "sample_id"), 3)
    out = B.shuffled_positions(ep, "sample_id", ("split",), SEED, epoch_col="epoch")
    return out.select(F.col("epoch").cast("long"), "split", "sample_id", F.col("pos").cast("long"))


_TR_SQL = f"(SELECT DISTINCT batch_no FROM ({BATCHES_SQL}) WHERE split = 'train')"
_NE_SQL = f"(SELECT count(DISTINCT batch_no) AS e FROM ({BATCHES_SQL}) WHERE split = 'eval')"


@register("schedule_interleave", O.sql(f"""
    SELECT (batch_no // {BATCHES_BETWEEN_EVALS})::BIGINT AS round, 'train' AS phase,
           (batch_no % {BATCHES_BETWEEN_EVALS})::BIGINT AS slot, batch_no FROM {_TR_SQL}
    UNION ALL
    SELECT r.round, 'eval', s.slot::BIGINT, ((r.round * {NUMBER_EVAL_BATCHES} + s.slot) % ne.e)::BIGINT
    FROM (SELECT DISTINCT batch_no // {BATCHES_BETWEEN_EVALS} AS round FROM {_TR_SQL}) r,
         range({NUMBER_EVAL_BATCHES}) s(slot), {_NE_SQL} ne
    WHERE ne.e > 0""", "questions"))
def q_schedule_interleave(spark, sf):
    b = _batches(spark, sf)
    return B.schedule_interleave(b.where(F.col("split") == "train"), b.where(F.col("split") == "eval"))


# ---------------------------------------------------------------------------
# Approximate search, recall, subsets
# ---------------------------------------------------------------------------


N_LEAVES, N_PROBED = 128, 32      # leaves of the registered index, and those a query probes: a quarter
N_QUERY_SAMPLE = 100
_ANN: dict = {}


KMEANS_ROUNDS, PQ_ROUNDS = 5, 4


def _leaves_sql() -> str:
    """CTEs ``x`` (blocks as whole numbers), ``c<i>`` (centroids of round i), ``leaf_of`` and ``leaves_of`` (first and
    second leaf): the oversampled starts, the k-means and the spilling of the index."""
    def dist(a, b):
        return f"(list_dot_product({a}, {a}) - 2 * list_dot_product({a}, {b}) + list_dot_product({b}, {b}))"
    near = """SELECT block_id, leaf FROM (SELECT x.block_id, c.leaf, row_number() OVER (PARTITION BY x.block_id ORDER BY
        list_dot_product(c.v, c.v) - 2 * list_dot_product(x.v, c.v), c.leaf) AS r FROM x, {c} c) WHERE r = 1"""
    hashed = f"{O.u32(str(SEED), 'block_id')}, block_id"
    parts = [f"""x AS MATERIALIZED (SELECT block_id, list_transform(embedding::DOUBLE[], lambda e: round(e * {AN.SCALE})) AS v FROM block_vec)""",
             f"k0 AS MATERIALIZED (SELECT 0 AS round, block_id, v FROM x ORDER BY {hashed} LIMIT 1)"]
    per_round = AL.OVERSAMPLING * N_LEAVES / AL.START_ROUNDS
    for i in range(AL.START_ROUNDS):
        u = f"(({O.u32(str(SEED), repr(f'start{i}'), 'block_id')})::DOUBLE + 0.5) / 4294967296.0"
        parts.append(f"""e{i} AS MATERIALIZED (SELECT x.block_id, any_value(x.v) AS v, min({dist('x.v', 'k.v')}) AS d FROM x, k{i} k GROUP BY x.block_id)""")
        parts.append(f"""k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} UNION ALL SELECT {i + 1}, block_id, v FROM e{i}
            WHERE {u} * (SELECT sum(d::HUGEINT)::DOUBLE FROM e{i}) < {per_round} * d)""")
    parts.append(f"""ks AS MATERIALIZED (SELECT row_number() OVER (ORDER BY round, block_id) AS j, v FROM (SELECT * FROM k{AL.START_ROUNDS}
        UNION ALL (SELECT {AL.START_ROUNDS + 1}, block_id, v FROM x ORDER BY {hashed} LIMIT {N_LEAVES})))""")
    parts.append(f"""kw AS MATERIALIZED (SELECT ks.j, ks.v, coalesce(w, 0)::DOUBLE AS w FROM ks LEFT JOIN (SELECT j, count(*) AS w FROM (
        SELECT x.block_id, ks.j, row_number() OVER (PARTITION BY x.block_id ORDER BY {dist('x.v', 'ks.v')}, ks.j) AS r FROM x, ks)
        WHERE r = 1 GROUP BY j) USING (j))""")
    parts.append(f"""kt AS (SELECT 0 AS i, j, v, w, 1e300::DOUBLE AS far, row_number() OVER (ORDER BY w DESC, j) = 1 AS pick FROM kw
        UNION ALL SELECT i + 1, j, v, w, far, w * far > 0 AND row_number() OVER (ORDER BY w * far DESC, j) = 1
        FROM (SELECT t.i, t.j, t.v, t.w, least(t.far, {dist('t.v', 'p.v')}) AS far FROM kt t, (SELECT v FROM kt WHERE pick) p) WHERE i < {N_LEAVES - 1})""")
    parts.append("c0 AS MATERIALIZED (SELECT i AS leaf, v FROM kt WHERE pick)")
    for i in range(KMEANS_ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.leaf, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (
            SELECT leaf, list(m ORDER BY d) AS v FROM (SELECT leaf, d, round(sum(e::BIGINT) / count(*)) AS m FROM (
              SELECT a.leaf, unnest(x.v) AS e, unnest(range(1, len(x.v) + 1)) AS d FROM a{i} a JOIN x USING (block_id))
            GROUP BY leaf, d) GROUP BY leaf) n USING (leaf))""")
    c = f"c{KMEANS_ROUNDS}"
    parts.append(f"leaf_of AS MATERIALIZED ({near.format(c=c)})")
    along = ("(list_dot_product(x.v, x.v) - list_dot_product(x.v, c.v) - list_dot_product(x.v, o.v) + list_dot_product(o.v, c.v))")
    parts.append(f"""leaves_of AS MATERIALIZED (SELECT block_id, leaf, 0 AS spill FROM leaf_of UNION ALL SELECT block_id, leaf, 1 FROM (
        SELECT block_id, leaf, row_number() OVER (PARTITION BY block_id ORDER BY cost, leaf) AS r FROM (
          SELECT x.block_id, c.leaf, {dist('x.v', 'c.v')} + CASE WHEN {dist('x.v', 'o.v')} > 0 THEN {along} * {along} / {dist('x.v', 'o.v')} ELSE 0 END AS cost
          FROM x JOIN leaf_of l USING (block_id) JOIN {c} o ON o.leaf = l.leaf JOIN {c} c ON c.leaf <> l.leaf)) WHERE r = 1)""")
    return ", ".join(parts)


def _with_leaves(body: str, *needed: str) -> str:
    text = O.sql("", "block_vec", *needed).rstrip() + ", " + _leaves_sql() + body
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_PROBES = f"""(SELECT sample_id, leaf FROM (SELECT q.sample_id, c.leaf, row_number() OVER (PARTITION BY q.sample_id ORDER BY
              list_dot_product(q.embedding::DOUBLE[], list_transform(c.v, lambda e: e / {AN.SCALE})) DESC, c.leaf) AS r
            FROM qvec q, c{KMEANS_ROUNDS} c) WHERE r <= {N_PROBED})"""
_PROBED = f"""
    (SELECT sample_id AS qid, r AS rank, block_id, score FROM (
       SELECT sample_id, block_id, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, block_id) AS r
       FROM (SELECT q.sample_id, b.block_id, any_value(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS score
             FROM qvec q JOIN {_PROBES} p USING (sample_id) JOIN leaves_of l ON l.leaf = p.leaf JOIN block_vec b ON b.block_id = l.block_id
             GROUP BY q.sample_id, b.block_id)) WHERE r <= 10)"""


def ann_index(spark, sf):
    """Centroids and the index: every vector in its first and second leaf, written once, a folder per leaf."""
    key = (skey(spark), sf)
    if key not in _ANN:
        bv = tables.block_vectors(spark, sf)
        cents, assigned = AN.ivf_train(bv, N_LEAVES, rounds=KMEANS_ROUNDS, oversampled=True)
        _ANN[key] = (cents, AN.write_index(AL.second_leaf(assigned, cents), scratch_path(spark, "index")))
    return _ANN[key]


def _probed(spark, sf, leaves=N_PROBED, k=10):
    cents, index = ann_index(spark, sf)
    return AN.ivf_probe(_qv(spark, sf), index, cents, leaves, k, spilled=True)


def _qv(spark, sf):
    return tables.query_vectors(spark, sf).select(F.col("sample_id").alias("qid"), "embedding")


@register("ivf_train", _with_leaves(" SELECT block_id, leaf FROM leaf_of"))
def q_ivf_train(spark, sf):
    _, index = ann_index(spark, sf)
    return index.where("spill = 0").select("block_id", "leaf")


@register("ivf_spill", _with_leaves(" SELECT block_id, leaf, spill FROM leaves_of"))
def q_ivf_spill(spark, sf):
    _, index = ann_index(spark, sf)
    return index.select("block_id", "leaf", "spill")


@register("ivf_probe", O.sql(
    "SELECT sample_id, rank::BIGINT AS rank, block_id, round(score, 6) AS score FROM hits", "hits"))
def q_ivf_probe(spark, sf):
    # All leaves probed: must equal exact search.
    out = _probed(spark, sf, N_LEAVES)
    return out.select(F.col("qid").alias("sample_id"), "rank", "block_id", r6(F.col("score")).alias("score"))


@register("mips_pruned", O.sql(
    "SELECT sample_id, rank::BIGINT AS rank, block_id, round(score, 6) AS score FROM hits", "hits"))
def q_mips_pruned(spark, sf):
    # Exact: leaves whose bound lies below a query's floor are never scored; the twin scores every pair.
    cents, index = ann_index(spark, sf)
    out = mips_pruned(_qv(spark, sf), index.where("spill = 0"), cents)
    return out.select(F.col("qid").alias("sample_id"), "rank", "block_id", r6(F.col("score")).alias("score"))


@register("ivf_probe_pruned", _with_leaves(
    f" SELECT qid AS sample_id, rank::BIGINT AS rank, block_id, round(score, 6) AS score FROM {_PROBED}", "qvec"))
def q_ivf_probe_pruned(spark, sf):
    out = _probed(spark, sf)
    return out.select(F.col("qid").alias("sample_id"), "rank", "block_id", r6(F.col("score")).alias("score"))


@register("live_retrieve", O.sql("""
    SELECT h.sample_id, h.rank::BIGINT AS rank, h.block_id, b.text
    FROM hits h JOIN blocks b USING (block_id)""", "hits", "blocks"))
def q_live_retrieve(spark, sf):
    # Every leaf is probed, each vector in its first leaf: the passages are those of the exact search.
    cents, index = ann_index(spark, sf)
    hits = AN.ivf_probe(_qv(spark, sf), index.where("spill = 0"), cents, N_LEAVES, 10)
    out = gather_blocks(hits.select(F.col("qid").alias("sample_id"), "rank", "block_id"),
                        tables.blocks(spark, sf, with_vectors=False), n_hits=_qv(spark, sf).count() * 10)
    return out.select("sample_id", "rank", "block_id", "text")


def _pq(spark, sf):
    """Codebooks of residuals and the coded index."""
    key = ("pq", skey(spark), sf)
    if key not in _ANN:
        cents, index = ann_index(spark, sf)
        path = scratch_path(spark, "codebooks")
        AL.residual_books(index.where("spill = 0"), cents, PQ_DIMS_PER_BLOCK, rounds=PQ_ROUNDS).write.parquet(path)
        books = spark.read.parquet(path)
        _ANN[key] = (books, AN.write_index(AL.residual_codes(index, cents, books), scratch_path(spark, "coded")))
    return _ANN[key]


def _codes_sql() -> str:
    """CTEs ``y`` (residuals to first and second leaves by sub-space), ``g`` (codebooks) and ``code_of``."""
    width, c = PQ_DIMS_PER_BLOCK, f"c{KMEANS_ROUNDS}"
    dist = "(list_dot_product(y.r, y.r) - 2 * list_dot_product(y.r, g.r) + list_dot_product(g.r, g.r))"
    near = """SELECT y.block_id, y.spill, y.sub, g.code, row_number() OVER (PARTITION BY y.block_id, y.spill, y.sub ORDER BY {d}, g.code) AS n
        FROM y JOIN {g} g USING (sub){where}"""
    parts = [f"""z AS MATERIALIZED (SELECT x.block_id, l.leaf, l.spill, list_transform(list_zip(x.v, c.v), lambda p: p[1] - p[2]) AS r
        FROM x JOIN leaves_of l USING (block_id) JOIN {c} c ON c.leaf = l.leaf)""",
             f"""y AS MATERIALIZED (SELECT block_id, spill, sub, list_slice(r, {width} * sub + 1, {width} * sub + {width}) AS r
        FROM z, (SELECT range AS sub FROM range(64 // {width})))""",
             f"""g0 AS MATERIALIZED (SELECT sub, row_number() OVER (PARTITION BY sub ORDER BY block_id) - 1 AS code, r FROM y WHERE spill = 0 AND block_id IN (
        SELECT block_id FROM x ORDER BY {O.u32(str(SEED), 'block_id')}, block_id LIMIT {AN.PQ_CODES}))"""]
    for i in range(PQ_ROUNDS):
        parts.append(f"""g{i + 1} AS MATERIALIZED (SELECT g.sub, g.code, coalesce(m.r, g.r) AS r FROM g{i} g LEFT JOIN (
            SELECT sub, code, list(m ORDER BY d) AS r FROM (SELECT sub, code, d, round(sum(e::BIGINT) / count(*)) AS m FROM (
              SELECT y.sub, a.code, unnest(y.r) AS e, unnest(range(1, len(y.r) + 1)) AS d
              FROM ({near.format(d=dist, g=f'g{i}', where=' WHERE y.spill = 0')}) a JOIN y USING (block_id, spill, sub) WHERE a.n = 1)
            GROUP BY sub, code, d) GROUP BY sub, code) m USING (sub, code))""")
    parts.append(f"""code_of AS MATERIALIZED (SELECT block_id, spill, sub, code FROM ({near.format(d=dist, g=f'g{PQ_ROUNDS}', where='')}) WHERE n = 1)""")
    return ", ".join(parts)


def _with_codes(body: str, *needed: str) -> str:
    return _with_leaves(", " + _codes_sql() + body, *needed)


@register("pq_codes", _with_codes("""
    SELECT block_id, leaf, spill, codes FROM leaves_of JOIN (
      SELECT block_id, spill, string_agg(substr('0123456789ABCDEF', (hi + 1)::INT, 1) || substr('0123456789ABCDEF', (lo + 1)::INT, 1), '' ORDER BY pair) AS codes
      FROM (SELECT block_id, spill, sub // 2 AS pair, max(code) FILTER (sub % 2 = 0) AS lo, max(code) FILTER (sub % 2 = 1) AS hi
            FROM code_of GROUP BY block_id, spill, sub // 2) GROUP BY block_id, spill) USING (block_id, spill)"""))
def q_pq_codes(spark, sf):
    _, coded = _pq(spark, sf)
    return coded.select("block_id", "leaf", "spill", F.hex("codes").alias("codes"))


_CODED = f"""(SELECT qid, r AS rank, block_id, score FROM (SELECT qid, block_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block_id) AS r
    FROM (SELECT q.sample_id AS qid, v.block_id, max(list_dot_product(q.embedding::DOUBLE[], v.v)) AS score
          FROM qvec q JOIN {_PROBES} p USING (sample_id) JOIN (
            SELECT l.block_id, l.leaf, list_transform(list_zip(c.v, k.r), lambda e: e[1] / {AN.SCALE} + e[2] / {AN.SCALE}) AS v
            FROM leaves_of l JOIN c{KMEANS_ROUNDS} c ON c.leaf = l.leaf JOIN (
              SELECT block_id, spill, flatten(list(g.r ORDER BY sub)) AS r FROM code_of JOIN g{PQ_ROUNDS} g USING (sub, code) GROUP BY block_id, spill) k
            ON k.block_id = l.block_id AND k.spill = l.spill) v ON v.leaf = p.leaf
          GROUP BY q.sample_id, v.block_id)) WHERE r <= {IVF_REORDER})"""


def _coded_hits(spark, sf):
    cents, _ = ann_index(spark, sf)
    books, coded = _pq(spark, sf)
    return AN.ivf_probe(_qv(spark, sf), coded, cents, N_PROBED, IVF_REORDER, codebooks=books, spilled=True)


@register("pq_score", _with_codes(
    f" SELECT qid AS sample_id, rank::BIGINT AS rank, block_id, round(score, 6) AS score FROM {_CODED}", "qvec"))
def q_pq_score(spark, sf):
    return _coded_hits(spark, sf).select(F.col("qid").alias("sample_id"), "rank", "block_id", r6(F.col("score")).alias("score"))


@register("rerank_exact", O.sql(f"""
    SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, block_id))::BIGINT AS rank, block_id,
           round(score, 6) AS score
    FROM (SELECT sample_id, block_id, score FROM (
            SELECT q.sample_id, b.block_id, list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
                   row_number() OVER (PARTITION BY q.sample_id ORDER BY list_dot_product(q.embedding::DOUBLE[],
                     list_transform(b.embedding::DOUBLE[], lambda x: round(x * 127) / 127)) DESC, b.block_id) AS r
            FROM qvec q, block_vec b) WHERE r <= {IVF_REORDER})
    QUALIFY rank <= 10""", "qvec", "block_vec"))
def q_rerank_exact(spark, sf):
    # Candidates by compressed vectors (one byte per coordinate) to the documented reorder
    # depth, re-ranked on the full ones: questions x 100 candidates, whatever the number of blocks.
    qv, bv = _qv(spark, sf), tables.block_vectors(spark, sf)
    approx = mips_exact(qv, AN.scalar_quantise(bv), IVF_REORDER, qid_col="qid")
    nq = qv.count()
    out = AN.rerank_exact(approx, qv, bv, 10, n_candidates=nq * IVF_REORDER, query_bytes=nq * 64 * 8)
    return out.select(F.col("qid").alias("sample_id"), "rank", "block_id", r6(F.col("score")).alias("score"))


_RERANKED = f"""(SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, block_id) AS rank, block_id, exact AS score FROM (
    SELECT h.qid, h.block_id, list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS exact
    FROM {_CODED} h JOIN qvec q ON q.sample_id = h.qid JOIN block_vec b USING (block_id)) QUALIFY rank <= 10)"""


def reranked(spark, sf):
    """The approximate pipeline as one: leaves, compressed scores, reorder depth, exact top 10."""
    qv = _qv(spark, sf)
    nq = qv.count()
    return AN.rerank_exact(_coded_hits(spark, sf), qv, tables.block_vectors(spark, sf), 10, n_candidates=nq * IVF_REORDER, query_bytes=nq * 64 * 8)


@register("pq_rerank", _with_codes(
    f" SELECT qid AS sample_id, rank::BIGINT AS rank, block_id, round(score, 6) AS score FROM {_RERANKED}", "qvec"))
def q_pq_rerank(spark, sf):
    return reranked(spark, sf).select(F.col("qid").alias("sample_id"), "rank", "block_id", r6(F.col("score")).alias("score"))


def _recall(spark, sf, mode, found=None):
    approx = found if found is not None else _probed(spark, sf)
    if mode == "all":
        exact = mips_exact(_qv(spark, sf), tables.block_vectors(spark, sf), 10, qid_col="qid")
        return AN.recall(approx, exact, mode="all")
    emb = tables.read_table(spark, sf, "embeddings")
    n = emb.count()
    own = tables.questions(spark, sf).select(F.col("sample_id").alias("qid"),
                                             F.pmod("sample_id", F.lit(n)).alias("own_id"))
    return AN.recall(approx, own, mode="any", self_col="own_id")


_RECALL_ALL = """
    SELECT 'all' AS mode, count(p.block_id) / count(*) AS recall, count(p.block_id)::BIGINT AS count_goods, count(*)::BIGINT AS count_total
    FROM hits h LEFT JOIN {found} p ON p.qid = h.sample_id AND p.block_id = h.block_id"""


@register("recall_all", _with_leaves(_RECALL_ALL.format(found=_PROBED), "qvec", "hits"))
def q_recall_all(spark, sf):
    return _recall(spark, sf, "all")


@register("recall_reranked", _with_codes(_RECALL_ALL.format(found=_RERANKED), "qvec", "hits"))
def q_recall_reranked(spark, sf):
    return _recall(spark, sf, "all", reranked(spark, sf))


@register("recall_any", _with_leaves(f"""
    SELECT 'any' AS mode, count(p.block_id) / count(*) AS recall, count(p.block_id)::BIGINT AS count_goods, count(*)::BIGINT AS count_total
    FROM (SELECT sample_id, sample_id % (SELECT count(*) FROM embeddings) AS own FROM questions) q
    LEFT JOIN {_PROBED} p ON p.qid = q.sample_id AND p.block_id = q.own""", "qvec"))
def q_recall_any(spark, sf):
    return _recall(spark, sf, "any")


QS_SQL = f"""SELECT vec_id, embedding FROM embeddings
             ORDER BY {O.u32(str(SEED), 'vec_id')}, vec_id LIMIT {N_QUERY_SAMPLE}"""


def _query_sample(spark, sf):
    from quarry.operators.sampling import query_sample
    emb = tables.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return query_sample(emb, "vec_id", N_QUERY_SAMPLE, SEED)


@register("query_sample", f"SELECT vec_id, len(embedding)::BIGINT AS dim FROM ({QS_SQL})")
def q_query_sample(spark, sf):
    return _query_sample(spark, sf).select("vec_id", F.size("embedding").cast("long").alias("dim"))


@register("recall_match", O.sql(f"""
    SELECT 'any' AS mode, count(*) FILTER (WHERE hit) / count(*) AS recall,
           count(*) FILTER (WHERE hit)::BIGINT AS count_goods, count(*)::BIGINT AS count_total
    FROM (SELECT q.vec_id, bool_or(t.block_id = q.vec_id) AS hit FROM ({QS_SQL}) q JOIN (
            SELECT qid, block_id FROM (
              SELECT q.vec_id AS qid, b.block_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
                     list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.block_id) AS r
              FROM ({QS_SQL}) q, block_vec b) WHERE r <= 10) t ON t.qid = q.vec_id
          GROUP BY q.vec_id)""", "block_vec"))
def q_recall_match(spark, sf):
    # Self-recall of exact search: sampled vectors as queries; is the vector's own
    # passage among its top 10?
    qs = _query_sample(spark, sf).select(F.col("vec_id").alias("qid"), "embedding")
    found = mips_exact(qs, tables.block_vectors(spark, sf), 10, qid_col="qid")
    own = qs.select("qid", F.col("qid").alias("own_id"))
    return AN.recall(found, own, mode="any", self_col="own_id")


@register("id_intersect", O.sql("""
    SELECT a.sample_id, count(b.block_id)::BIGINT AS n_shared
    FROM hits a JOIN questions qa ON qa.sample_id = a.sample_id
    JOIN questions qb ON qb.sample_id = a.sample_id + 2
    LEFT JOIN hits b ON b.sample_id = a.sample_id + 2 AND b.block_id = a.block_id
    GROUP BY a.sample_id""", "hits", "questions"))
def q_id_intersect(spark, sf):
    # Passages shared by the top-10 lists of consecutive questions of a conversation.
    c = cache_for(spark, sf).select("sample_id", F.transform("retrievals", lambda r: r["block_id"]).alias("ids"))
    nxt = c.select((F.col("sample_id") - 2).alias("sample_id"), F.col("ids").alias("next_ids"))
    return c.join(nxt, "sample_id").select(
        "sample_id", F.size(F.array_intersect("ids", "next_ids")).cast("long").alias("n_shared"))


@register("paired_subset", O.sql(f"""
    SELECT (row_number() OVER (ORDER BY block_id) - 1)::BIGINT AS new_id, block_id,
           length(text)::BIGINT AS n_chars, len(embedding)::BIGINT AS dim
    FROM (SELECT * FROM blocks ORDER BY {O.u32(str(SEED), 'block_id')}, block_id LIMIT 100)
    LEFT JOIN block_vec USING (block_id)""", "blocks", "block_vec"))
def q_paired_subset(spark, sf):
    d = tables.blocks(spark, sf, with_vectors=False)
    v = tables.block_vectors(spark, sf)
    total = d.count()
    sub = paired_subset(d.select("block_id"), "block_id", 100, {"text": d, "vec": v}, SEED, total)
    return (sub["text"].join(sub["vec"].drop("new_id"), "block_id", "left")  # some passages have no vector
            .select("new_id", "block_id", F.length("text").cast("long").alias("n_chars"),
                    F.size("embedding").cast("long").alias("dim")))


# ---------------------------------------------------------------------------
# Sinks and sources (round trips through the shared checkpoint folder)
# ---------------------------------------------------------------------------


SHARDS = 8
_SHARD_SQL = f"""
    SELECT q.split, q.sample_id, ((row_number() OVER (PARTITION BY q.split ORDER BY q.sample_id) - 1) % {SHARDS})
             AS shard, coalesce(h.n, 0) AS n_hits
    FROM questions q LEFT JOIN (SELECT sample_id, count(*) AS n FROM hits GROUP BY sample_id) h USING (sample_id)"""


def _written_cache(spark, sf):
    key = ("cache-path", skey(spark), sf)
    if key not in _ANN:
        _ANN[key] = CI.sink_cache(cache_for(spark, sf), scratch_path(spark, "cache"), SHARDS)
    return _ANN[key]


@register("sink_cache", O.sql(f"""
    SELECT split, shard::BIGINT AS shard, count(*)::BIGINT AS n_rows, sum(n_hits)::BIGINT AS n_retrievals
    FROM ({_SHARD_SQL}) GROUP BY split, shard""", "questions", "hits"))
def q_sink_cache(spark, sf):
    path = CI.sink_cache(cache_for(spark, sf), scratch_path(spark, "cache"), SHARDS)
    back = CI.src_cache(spark, path)
    return back.groupBy("split", F.col("shard").cast("long").alias("shard")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("retrievals")).cast("long").alias("n_retrievals"))


_CACHED = O.sql("""
    SELECT t.sample_id, array_to_string(t.question_ids, ' ') AS question_ids,
           array_to_string(t.answer_ids, ' ') AS answer_ids,
           (SELECT string_agg(h.block_id::VARCHAR, ' ' ORDER BY h.rank) FROM hits h WHERE h.sample_id = t.sample_id)
             AS block_ids
    FROM qa_tok t WHERE t.split = 'train'""", "qa_tok", "hits")


def _cached_rows(back):
    return back.select("sample_id", ids_text(F.col("question_ids")).alias("question_ids"),
                       ids_text(F.col("answer_ids")).alias("answer_ids"),
                       F.array_join(F.transform("retrievals", lambda r: r["block_id"].cast("string")), " ")
                       .alias("block_ids"))


@register("src_cache", _CACHED)
def q_src_cache(spark, sf):
    return _cached_rows(CI.src_cache(spark, _written_cache(spark, sf), "train"))


@register("src_padded_cache", _CACHED)
def q_src_padded_cache(spark, sf):
    # Dense, padded records read by name: a partition per shard, one split listed, arrays ragged again.
    ship_package(spark)
    parts = P.retrieval_parts(spark, sf, vocab_for(spark, sf)).stored()
    path = sink_padded_parts(parts, scratch_path(spark, "padded"), SHARDS)
    spark.dataSource.register(PaddedCache)
    back = (spark.read.format("padded_cache").option("split", "train")
            .option("columns", "sample_id,question_ids,answer_ids,block_ids").load(path))
    return back.select("sample_id", ids_text(F.col("question_ids")).alias("question_ids"), ids_text(F.col("answer_ids")).alias("answer_ids"),
                       F.array_join(F.transform("block_ids", lambda b: b.cast("string")), " ").alias("block_ids"))


@register("cache_version", _CACHED)
def q_cache_version(spark, sf):
    # Written in two goes as by a job that was stopped between splits, published, verified and read back.
    root, splits = scratch_path(spark, "versions"), ["train", "eval", "test"]
    cache = P.retrieval_parts(spark, sf, vocab_for(spark, sf)).stored()
    CV.write_version(cache, root, "first", ["train"], SHARDS)
    CV.write_version(cache, root, "first", splits, SHARDS)
    CV.publish(spark, root, "first", splits)
    return _cached_rows(CV.read_version(spark, root, ["train"], verify=True))


@register("shard_paths", O.sql(f"""
    SELECT split, shard::BIGINT AS shard, 1::BIGINT AS n_files, count(*)::BIGINT AS n_rows
    FROM ({_SHARD_SQL}) GROUP BY split, shard""", "questions", "hits"))
def q_shard_paths(spark, sf):
    files = CI.shard_paths(CI.src_cache(spark, _written_cache(spark, sf)))
    return files.groupBy("split", F.col("shard").cast("long").alias("shard")).agg(
        F.count_distinct("path").cast("long").alias("n_files"), F.sum("n_rows").cast("long").alias("n_rows"))


_TEST_PROMPT_SQL = f"""
    SELECT sample_id, list_slice(input_ids, 1, len(input_ids) - coalesce(list_position(list_transform(
             list_reverse(input_ids), lambda x: x <> {EOS}), true) - 1, len(input_ids))) AS ids
    FROM ({O.assembled_sql()}) WHERE split = 'test'"""


@register("sink_generations", O.sql(f"""
    SELECT 'test' AS split, 'cached_pretok' AS approach, p.sample_id, coalesce(d.txt, '') AS text,
           {SEED}::BIGINT AS seed
    FROM ({_TEST_PROMPT_SQL}) p LEFT JOIN (
      SELECT sample_id, string_agg(coalesce(v.token, '<< ' || x.id || ' >>'), ' ' ORDER BY x.pos) AS txt
      FROM (SELECT sample_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM ({_TEST_PROMPT_SQL})) x
      LEFT JOIN vocab v ON v.token_id = x.id GROUP BY sample_id) d USING (sample_id)""",
    "qa_tok", "sel_ctx", "vocab"))
def q_sink_generations(spark, sf):
    # The generation step itself is not built; the rows written are the decoded
    # prompts a generator would receive, with the run parameters.
    voc = vocab_for(spark, sf)
    s = samples_for(spark, sf).where(F.col("split") == "test")
    prompt = A.prompt_extract(F.col("input_ids"), F.col("label_ids"), F.lit(True), EOS)
    gen = voc.decode_into(s.select("split", F.lit("cached_pretok").alias("approach"), "sample_id", prompt.alias("prompt")),
                          {"text": "prompt"}).drop("prompt")
    path = CI.sink_generations(gen, scratch_path(spark, "generations"),
                               {"seed": SEED, "temperature": TEMPERATURE, "num_retrievals": NUM_RETRIEVALS})
    back = spark.read.json(path)
    return back.select("split", "approach", "sample_id", "text",
                       F.get_json_object("params", "$.seed").cast("long").alias("seed"))


@register("sink_recall", ORACLE["recall_match"])
def q_sink_recall(spark, sf):
    path = CI.sink_report(q_recall_match(spark, sf), scratch_path(spark, "recall"))
    back = spark.read.schema("mode string, recall double, count_goods long, count_total long").json(path)
    return back


@register("collate", O.sql(f"""
    SELECT split, batch_no, count(*)::BIGINT AS n_rows, count(DISTINCT replica)::BIGINT AS n_replicas FROM (
      SELECT split, sample_id, batch_no, (pos_in_batch // (batch_rows // 3))::BIGINT AS replica
      FROM ({BATCHES_SQL}) WHERE batch_rows // 3 > 0 AND pos_in_batch // (batch_rows // 3) < 3)
    GROUP BY split, batch_no""", "questions"))
def q_collate(spark, sf):
    shares = B.replica_split(_batches(spark, sf), 3)
    return shares.groupBy("split", "batch_no").agg(F.count(F.lit(1)).alias("n_rows"),
                                                F.count_distinct("replica").cast("long").alias("n_replicas"))


# ---------------------------------------------------------------------------
# Streaming twins (must equal their batch versions)
# ---------------------------------------------------------------------------

def _events(sf):
    # The table itself is the stream's source. As a pattern the path may be a file or a folder.
    return f"{sf.rstrip('/')}/events.parque[t]"


@register("ema_stream", ORACLE["ema"])
def q_ema_stream(spark, sf):
    out = MS.ema_stream(spark, _events(sf), MS.events_schema(spark, sf))
    return out.select("split", "event_id", r6(F.col("ema")).alias("ema"))


@register("ema_keyed_stream", ORACLE["ema"])
def q_ema_keyed_stream(spark, sf):
    # The log arrives in ten files; rows wait in the engine's keyed state, a group per key and hour.
    log = tables.read_table(spark, sf, "events")
    path = arriving(log, by_time(log, M.epoch_micros(F.col("ts")), ARRIVALS), ARRIVALS)
    out = KeyedAverage(spark, path, log.schema).run()
    return out.select("split", "event_id", r6(F.col("ema")).alias("ema"))


@register("live_retrieve_stream", _with_leaves(f"""
    SELECT h.qid AS sample_id, h.rank::BIGINT AS rank, h.block_id, b.text FROM {_PROBED} h JOIN blocks b USING (block_id)""", "qvec", "blocks"))
def q_live_retrieve_stream(spark, sf):
    # Questions arrive in five files; each micro-batch reads the leaves it needs of the stored index.
    cents, index = ann_index(spark, sf)
    asked = tables.query_vectors(spark, sf).select("sample_id", "embedding")
    live = LiveRetrieval(spark, index, cents, tables.blocks(spark, sf, with_vectors=False), nprobe=N_PROBED)
    out = live.run(arriving(asked, by_key(F.col("sample_id"), 5), 5), asked.schema)
    return out.select("sample_id", "rank", "block_id", "text")


@register("cadence_stream", CADENCE_SQL)
def q_cadence_stream(spark, sf):
    return MS.cadence_stream(spark, _events(sf), MS.events_schema(spark, sf),
                             SAVE_PERIOD_MIN * 60.0)


@register("counters_stream", """
    SELECT event_type AS split, count(*)::BIGINT AS batches,
           sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS samples
    FROM events GROUP BY event_type""")
def q_counters_stream(spark, sf):
    return MS.counters_stream(spark, _events(sf), MS.events_schema(spark, sf))


# ---------------------------------------------------------------------------
# Encoder hook, vocabulary file round trip, batch-padded encoder inputs
# ---------------------------------------------------------------------------



@register("encoder_hook", O.sql(f"""
    SELECT sample_id, 64::BIGINT AS dim, (count(*) FILTER (WHERE c <> 0))::BIGINT AS n_nonzero, arg_max(j, c * 64 - j)::BIGINT AS top
    FROM (SELECT q.sample_id, r.j, coalesce(sum(s), 0) AS c FROM q_tok q CROSS JOIN (SELECT range AS j FROM range(64)) r
          LEFT JOIN (SELECT sample_id, h % 64 AS j, CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END AS s FROM (
              SELECT sample_id, (unnest(list_concat([{SP['cls']}], list_slice(question_ids, 1, 126), [{SP['sep']}]))::BIGINT
                     * 2654435761) % 4294967296 AS h FROM q_tok)) t ON t.sample_id = q.sample_id AND t.j = r.j
          GROUP BY q.sample_id, r.j) GROUP BY sample_id""", "q_tok"))
def q_encoder_hook(spark, sf):
    # Whole-number features behind the unit vector: which coordinates are set, and the largest.
    v = encoder_hook(F.col("ids"), hashing_embedder(64), 64, max_len=128, cls_id=SP["cls"], sep_id=SP["sep"])
    e = question_ids(spark, sf).select("sample_id", v.alias("v"))
    return e.select("sample_id", F.size("v").cast("long").alias("dim"),
                    F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("n_nonzero"),
                    (F.array_position("v", F.array_max("v")) - 1).cast("long").alias("top"))


@register("src_vocab_file", O.sql("SELECT token, token_id FROM vocab", "vocab"))
def q_src_vocab_file(spark, sf):
    path = write_vocab_file(vocab_for(spark, sf).df, scratch_path(spark, "vocab"))
    return read_vocab_file(spark, path)


@register("delimiter_tokens", f"""
    SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM (SELECT doc_id, {O.delimiter_tok('text')} AS t FROM documents)""")
def q_delimiter_tokens(spark, sf):
    t = delimiter_tokens(F.col("text"))
    return tables.read_table(spark, sf, "documents").select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


_DELIMITER_VOCAB = f"""(SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) - 1 + {O.FIRST_TOKEN_ID})::INTEGER AS token_id, cnt::BIGINT AS cnt
    FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest({O.delimiter_tok('text')}) AS token FROM (
            SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY token))"""


def delimiter_vocab(spark, sf):
    key = (skey(spark), sf, "delimiter")
    if key not in _VOCABS:
        _VOCABS[key] = P.corpus_vocab(spark, sf, "delimiter")
    return _VOCABS[key]


@register("src_vocab_delimiter", f"SELECT token, token_id, cnt FROM {_DELIMITER_VOCAB}")
def q_src_vocab_delimiter(spark, sf):
    return delimiter_vocab(spark, sf).df.select("token", "token_id", "cnt")


@register("vocab_encode_delimiter", O.sql(f"""
    SELECT q.sample_id, coalesce(string_agg(v.token_id::VARCHAR, ' ' ORDER BY pos), '') AS question_ids
    FROM questions q LEFT JOIN (SELECT sample_id, unnest(t) AS token, unnest(range(len(t))) AS pos
           FROM (SELECT sample_id, {O.delimiter_tok('question')} AS t FROM questions)) x ON x.sample_id = q.sample_id AND pos < {CONTEXT_SIZE}
    LEFT JOIN {_DELIMITER_VOCAB} v USING (token) GROUP BY q.sample_id""", "questions"))
def q_vocab_encode_delimiter(spark, sf):
    voc = delimiter_vocab(spark, sf)
    return voc.encode_into(tables.questions(spark, sf), {"ids": "question"}, CONTEXT_SIZE).select(
        "sample_id", ids_text(F.col("ids")).alias("question_ids"))


@register("encoder_batch_pad", O.sql(f"""
    SELECT split, sample_id, batch_no,
           (max(len(question_ids) + 2) OVER (PARTITION BY split, batch_no))::BIGINT AS padded_len,
           (len(question_ids) + 2)::BIGINT AS n_mask
    FROM ({BATCHES_SQL}) JOIN q_tok USING (sample_id)""", "questions", "q_tok"))
def q_encoder_batch_pad(spark, sf):
    # Encoder inputs padded to the longest row of their batch (window per batch:
    # groups are batch-sized).
    from pyspark.sql import Window
    b = _batches(spark, sf).join(question_ids(spark, sf).select("sample_id", F.col("ids").alias("question_ids")), "sample_id")
    e = A.encoder_inputs(F.col("question_ids"), SP["cls"], SP["sep"])
    x = b.select("split", "sample_id", "batch_no", e["input_ids"].alias("ids"))
    w = Window.partitionBy("split", "batch_no")
    mx = F.max(F.size("ids")).over(w)
    padded = F.concat(F.col("ids"), F.array_repeat(F.lit(0), mx - F.size("ids")))
    return x.select("split", "sample_id", "batch_no", F.size(padded).cast("long").alias("padded_len"),
                    F.size("ids").cast("long").alias("n_mask"))


@register("src_question_records", O.sql("""
    SELECT split, sample_id, question, answer, (CASE WHEN answer IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_answers
    FROM questions""", "questions"))
def q_src_question_records(spark, sf):
    q = tables.questions_from_records(tables.qa_records(spark, sf))
    return q.select("split", "sample_id", "question", "answer",
                    F.coalesce(F.size("answers"), F.lit(0)).cast("long").alias("n_answers"))


FEED_EPOCHS, FEED_REPLICAS = 2, 3
_FEED_POS_SQL = f"""
    SELECT split, sample_id, epoch, pos, n FROM (
      SELECT split, sample_id, epoch,
             row_number() OVER (PARTITION BY split, epoch ORDER BY {O.u32(str(SEED), 'epoch', 'sample_id')}, sample_id) - 1 AS pos,
             count(*) OVER (PARTITION BY split, epoch) AS n
      FROM questions, (SELECT range AS epoch FROM range({FEED_EPOCHS})) e)"""
_FEED_PLACED_SQL = f"""
    SELECT split, sample_id, epoch, pos // {BATCH} AS batch_no,
           (pos % {BATCH}) // nullif((CASE WHEN pos // {BATCH} < n // {BATCH} THEN {BATCH} ELSE n - (n // {BATCH}) * {BATCH} END)
                              // {FEED_REPLICAS}, 0) AS replica
    FROM ({_FEED_POS_SQL})
    WHERE (split = 'test' OR pos // {BATCH} < n // {BATCH})
      AND (CASE WHEN pos // {BATCH} < n // {BATCH} THEN {BATCH} ELSE n - (n // {BATCH}) * {BATCH} END) // {FEED_REPLICAS} > 0"""


@register("training_feed", O.sql(f"""
    SELECT a.epoch::BIGINT AS epoch, a.split, a.sample_id, p.batch_no::BIGINT AS batch_no,
           p.replica::BIGINT AS replica, array_to_string(a.input_ids, ' ') AS input_ids,
           array_to_string(a.label_ids, ' ') AS label_ids
    FROM ({O.assembled_sql(per_epoch=True)}) a
    JOIN ({_FEED_PLACED_SQL}) p USING (split, sample_id, epoch)
    WHERE p.replica < {FEED_REPLICAS}""", "qa_tok_ep", "sel_ctx_ep", "questions", epochs=FEED_EPOCHS))
def q_training_feed(spark, sf):
    feed = P.training_feed(cache_for(spark, sf), epochs=FEED_EPOCHS, batch_size=BATCH, replicas=FEED_REPLICAS)
    return feed.select(F.col("epoch").cast("long"), "split", "sample_id", "batch_no", "replica",
                       ids_text(F.col("input_ids")).alias("input_ids"), ids_text(F.col("label_ids")).alias("label_ids"))


@register("cache_checks", O.sql("""
    SELECT t.split, count(*)::BIGINT AS n,
           count(*) FILTER (WHERE coalesce(h.n, 0) <> 10)::BIGINT AS n_wrong_k,
           count(*) FILTER (WHERE len(t.question_ids) = 0)::BIGINT AS n_empty_question,
           count(*) FILTER (WHERE t.split <> 'test' AND (t.answer_ids IS NULL OR len(t.answer_ids) = 0))::BIGINT
             AS n_missing_answer,
           count(*) FILTER (WHERE list_contains(t.question_ids, -1)
                              OR coalesce(list_contains(t.answer_ids, -1), false))::BIGINT AS n_pad_left
    FROM qa_tok t LEFT JOIN (SELECT sample_id, count(*) AS n FROM hits GROUP BY sample_id) h USING (sample_id)
    GROUP BY t.split""", "qa_tok", "hits"))
def q_cache_checks(spark, sf):
    return S.cache_violations(cache_for(spark, sf), 10)


@register("shard_lists", O.sql(f"""
    SELECT split, count(*)::BIGINT AS n_shards, string_agg(shard::VARCHAR, ' ' ORDER BY shard) AS shards
    FROM (SELECT DISTINCT split, shard FROM ({_SHARD_SQL})) GROUP BY split""", "questions", "hits"))
def q_shard_lists(spark, sf):
    files = CI.shard_lists(CI.src_cache(spark, _written_cache(spark, sf)))
    return files.select("split", F.size("shards").cast("long").alias("n_shards"),
                        F.array_join(F.transform("shards", lambda s: s["shard"].cast("string")), " ").alias("shards"))


@register("loss_mean_stream", f"SELECT split, step, round(loss, 6) AS loss, n_replicas FROM ({LOSS_MEAN_SQL})")
def q_loss_mean_stream(spark, sf):
    out = MS.loss_mean_stream(spark, _events(sf), MS.events_schema(spark, sf))
    return out.select("split", "step", r6(F.col("loss")).alias("loss"), F.col("n_replicas").cast("long"))


@register("src_blocks_positional", O.sql("""
    SELECT (row_number() OVER (ORDER BY block_id) - 1)::BIGINT AS block_pos, text FROM blocks""", "blocks"))
def q_src_blocks_positional(spark, sf):
    # Passages exported without ids, in id order (a range-partitioned sort writes
    # part files whose names follow that order), then imported by position.
    path = scratch_path(spark, "blocks-positional")
    b = tables.blocks(spark, sf, with_vectors=False)
    b.repartitionByRange("block_id").sortWithinPartitions("block_id").select("text").write.parquet(path)
    return tables.import_positional(spark, path, "block_pos")


@register("ema_stream_event_time", ORACLE["ema"])
def q_ema_stream_event_time(spark, sf):
    # Folded in event-time order under a 2-hour delay, flushed at the end of the input.
    out = MS.ema_stream_event_time(spark, _events(sf), MS.events_schema(spark, sf))
    return out.select("split", "event_id", r6(F.col("ema")).alias("ema"))
