"""Prompt / label assembly as array expressions over the cache table.

All of it is narrow column algebra (``concat``, ``slice``, ``array_repeat``,
``transform``) evaluated inside whole-stage code generation; nothing here
shuffles.

Layout of a finished sample (helper words on, mode ``multiple``)::

    input  = Q q..  C c1..  C c2..  A a..   then eos padding
    labels = -100 ......................... a.. eos  then -100 padding

The context budget is ``context_size - (len(Q + question) + max_generation_length
+ len(A))``; context positions at or past it are dropped (helper ids count as
positions). The budget uses the fixed generation length, not the answer's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.arrays import pad_cut, strip_trailing
from quarry.params import CONTEXT_SIZE, HELPER_MODES, MASK_ID, MAX_GENERATION_LENGTH, special_ids


def _arr(*ids) -> Column:
    return F.array(*[F.lit(int(i)) for i in ids])


def helper_words(specials: dict) -> dict:
    """Helper token arrays (question, context, answer)."""
    return {k: _arr(specials[k]) for k in ("question", "context", "answer")}


def concat_contexts(selected: Column, context_helper: Column | None, mode: str = "multiple") -> Column:
    """Flatten selected contexts (ARRAY<ARRAY<INT>>) in order, with the context helper
    before each one (``multiple``) or before the first only (``once``)."""
    if mode not in HELPER_MODES:
        raise ValueError(f"helper mode {mode!r} not in {HELPER_MODES}")
    if context_helper is None:
        return F.flatten(selected)
    if mode == "multiple":
        return F.flatten(F.transform(selected, lambda c: F.concat(context_helper, c)))
    return F.concat(context_helper, F.flatten(selected))


def context_budget(question_len: Column, context_size: int, max_generation_length: int,
                   answer_helper_len: int) -> Column:
    return F.lit(context_size) - (question_len + F.lit(max_generation_length) + F.lit(answer_helper_len))


def assemble(question_ids: Column, answer_ids: Column, is_test: Column, *,
             contexts: Column | None = None, approach: str = "cached_pretok",
             use_helper_words: bool = True, helper_mode: str = "multiple",
             context_size: int = CONTEXT_SIZE, max_generation_length: int = MAX_GENERATION_LENGTH,
             specials: dict | None = None) -> Column:
    """``STRUCT<input_ids, label_ids>`` before padding (labels without the final eos).

    ``approach='cached_pretok'`` uses ``contexts`` (the sampled contexts, in
    order); ``'naked_lm'`` ignores them. ``label_ids`` is NULL on test rows.
    """
    sp = specials or special_ids()
    hw = helper_words(sp) if use_helper_words else None
    q = F.concat(hw["question"], question_ids) if hw else question_ids
    a_help = hw["answer"] if hw else F.array().cast("array<int>")
    a_len = 1 if hw else 0
    if approach == "cached_pretok":
        if contexts is None:
            raise ValueError("cached_pretok needs contexts")
        ctx = concat_contexts(contexts, hw["context"] if hw else None, helper_mode)
        limit = context_budget(F.size(q), context_size, max_generation_length, a_len)
        ctx = F.slice(ctx, 1, F.greatest(limit, F.lit(0)))
        prefix = F.concat(q, ctx, a_help)
    elif approach == "naked_lm":
        prefix = F.concat(q, a_help)
    else:
        raise ValueError(f"unsupported approach {approach!r}")
    answer_ids = F.coalesce(answer_ids, F.array().cast("array<int>"))  # a question nobody answered
    inputs = F.when(is_test, prefix).otherwise(F.concat(prefix, answer_ids))
    labels = F.when(is_test, F.lit(None).cast("array<int>")).otherwise(
        F.concat(F.array_repeat(F.lit(MASK_ID), F.size(prefix)), answer_ids))
    return F.struct(inputs.alias("input_ids"), labels.alias("label_ids"))


def finalize_sample(assembled: Column, context_size: int = CONTEXT_SIZE, eos: int | None = None) -> Column:
    """Labels get eos appended; inputs pad with eos, labels with -100; both cut to
    ``context_size`` (a full row therefore loses its label eos)."""
    eos = special_ids()["eos"] if eos is None else eos
    inputs = pad_cut(assembled["input_ids"], context_size, eos)
    labels = F.when(assembled["label_ids"].isNull(), F.lit(None).cast("array<int>")).otherwise(
        pad_cut(F.concat(assembled["label_ids"], _arr(eos)), context_size, MASK_ID))
    return F.struct(inputs.alias("input_ids"), labels.alias("label_ids"))


def prompt_extract(input_ids: Column, label_ids: Column, is_test: Column, eos: int) -> Column:
    """The prompt part of a finished sample.

    Non-test: positions with label -100 and input not eos. Test (no labels):
    the input without its trailing eos padding.
    """
    pairs = F.arrays_zip(input_ids.alias("i"), label_ids.alias("l"))
    kept = F.transform(F.filter(pairs, lambda p: (p["l"] == MASK_ID) & (p["i"] != eos)), lambda p: p["i"])
    return F.when(is_test, strip_trailing(input_ids, eos)).otherwise(kept)


def context_count(input_ids: Column, context_id: int) -> Column:
    """Number of context sections (context helper ids) in an assembled sample."""
    return F.size(F.filter(input_ids, lambda x: x == context_id))


def encoder_inputs(ids: Column, cls_id: int, sep_id: int) -> Column:
    """``CLS ids SEP`` with an all-ones mask and zero segment ids."""
    seq = F.concat(_arr(cls_id), ids, _arr(sep_id))
    return F.struct(seq.alias("input_ids"), F.array_repeat(F.lit(1), F.size(seq)).alias("input_mask"),
                    F.array_repeat(F.lit(0), F.size(seq)).alias("segment_ids"))
