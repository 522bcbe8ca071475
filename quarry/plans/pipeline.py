"""End-to-end jobs: retrieval caching and training-sample preparation.

Plan shape of ``retrieval_cache`` (shuffles named):

1. questions: conversation self-join on (conv_id, turn)             -- shuffle
2. ``mips_exact``: block table streamed, queries broadcast (size-checked);
   per-query candidate merge                                          -- shuffle 1
   (the hit set, questions x k rows, is checkpointed: it is read twice)
3. only passages that were hit are tokenised, once each (semi join against
   the broadcast distinct hit ids); the hit set is broadcast into the passage
   stream when its row bound allows, so passages are never shuffled
4. regroup k hits per question (bounded groups), join question ids    -- shuffle 2
   (a cache that is only written goes by ``sources.parts``, where this shuffle also deals the rows to their files)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.assembly import assemble, finalize_sample
from quarry.operators.retrieval import MAX_BROADCAST_HIT_BYTES
from quarry.operators.sampling import gumbel_sample
from quarry.operators.search import mips_exact
from quarry.operators.vocab import Vocab, build_vocab, read_vocab_file
from quarry.params import (CONTEXT_SIZE, MAX_GENERATION_LENGTH, NUM_NEIGHBORS, NUM_RETRIEVALS,
                           SEED, TEMPERATURE, special_ids)
from quarry.session import checkpoint_dir, spread
from quarry.sources import tables
from quarry.sources.parts import CacheParts


def corpus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text the vocabulary is built from: passages and conversation turns."""
    d = tables.read_table(spark, sf_dir, "documents").select("text")
    c = tables.read_table(spark, sf_dir, "conversations").select("text")
    return spread(d.unionByName(c))


def corpus_vocab(spark: SparkSession, sf_dir: str, tokenizer: str = "whitespace") -> Vocab:
    return Vocab(build_vocab(corpus_text(spark, sf_dir), tokenizer=tokenizer), tokenizer=tokenizer)


def given_vocab(spark: SparkSession, path: str, tokenizer: str = "whitespace") -> Vocab:
    """A vocabulary file instead of a count over the corpus: one token per line, ids in line order."""
    return Vocab(read_vocab_file(spark, path), tokenizer=tokenizer)


def retrieval_hits(spark: SparkSession, sf_dir: str, k: int = NUM_NEIGHBORS,
                   qs: DataFrame | None = None, with_split: bool = True, **search_kw) -> DataFrame:
    """``[split,] sample_id, rank, block_id, score`` -- exact top-k per question."""
    qs = qs if qs is not None else tables.questions(spark, sf_dir)
    qv = tables.query_vectors(spark, sf_dir, qs)
    bv = tables.block_vectors(spark, sf_dir)
    hits = mips_exact(qv, bv, k, qid_col="sample_id", **search_kw)
    return hits.join(qs.select("split", "sample_id"), "sample_id") if with_split else hits


def block_tokens(spark: SparkSession, sf_dir: str, vocab: Vocab,
                 max_len: int = CONTEXT_SIZE) -> DataFrame:
    """``block_id, token_ids`` -- every passage tokenised once, cut to the model size."""
    text = tables.blocks(spark, sf_dir, with_vectors=False)
    return vocab.encode_into(text, {"token_ids": "text"}, max_len).select("block_id", "token_ids")


def retrieval_parts(spark: SparkSession, sf_dir: str, vocab: Vocab, k: int = NUM_NEIGHBORS,
                    context_size: int = CONTEXT_SIZE, qs: DataFrame | None = None, **search_kw) -> CacheParts:
    """What the cache is made of: encoded questions, hits, and the tokens of every passage that was hit."""
    qs = qs if qs is not None else tables.questions(spark, sf_dir)
    checkpoint_dir(spark)
    # The hit set (questions x k rows) is materialised once in the shared
    # checkpoint folder: it is read twice below and the search must not rerun.
    hits = retrieval_hits(spark, sf_dir, k, qs, with_split=False, **search_kw).checkpoint(eager=True)
    n_hits = qs.count() * k  # upper bound on the hit set (row total, bounded metadata)
    # Tokenise only passages that were hit, each once.
    text = tables.blocks(spark, sf_dir, with_vectors=False)
    hit_ids = hits.select("block_id").distinct()
    if n_hits * 8 <= MAX_BROADCAST_HIT_BYTES:
        hit_ids = F.broadcast(hit_ids)
    hit_text = spread(text.join(hit_ids, "block_id", "left_semi"))
    tokens = vocab.encode_into(hit_text, {"token_ids": "text"}, context_size, drop=("text",)).select("block_id", "token_ids")
    fields = vocab.encode_into(spread(qs), {"question_ids": "question", "answer_ids": "answer"}, context_size,
                               drop=("question", "answer")).select("split", "sample_id", "question_ids", "answer_ids")
    return CacheParts(fields, hits, tokens, n_hits)


def retrieval_cache(spark: SparkSession, sf_dir: str, vocab: Vocab, k: int = NUM_NEIGHBORS,
                    context_size: int = CONTEXT_SIZE, qs: DataFrame | None = None,
                    **search_kw) -> DataFrame:
    """``split, sample_id, question_ids, answer_ids, retrievals`` (the cache table)."""
    return retrieval_parts(spark, sf_dir, vocab, k, context_size, qs, **search_kw).whole()


def training_samples(cache: DataFrame, *, num_retrievals: int = NUM_RETRIEVALS,
                     temperature: float = TEMPERATURE, seed: int = SEED, epoch=0,
                     approach: str = "cached_pretok", use_helper_words: bool = True,
                     helper_mode: str = "multiple", context_size: int = CONTEXT_SIZE,
                     max_generation_length: int = MAX_GENERATION_LENGTH,
                     allow_fewer: bool = False,
                     keep=()) -> DataFrame:
    """Cache -> ``split, sample_id, [keep...,] input_ids, label_ids`` (labels NULL on test).

    Narrow: sampling, assembly and padding are in-row expressions. ``epoch`` may
    be a column (one draw per epoch).
    """
    sp = special_ids()
    is_test = F.col("split") == "test"
    contexts = None
    if approach == "cached_pretok":
        sel = gumbel_sample(F.col("retrievals"), F.col("sample_id"), num_retrievals, temperature,
                            seed, epoch, allow_fewer)
        contexts = F.transform(sel, lambda r: r["token_ids"])
    raw = assemble(F.col("question_ids"), F.col("answer_ids"), is_test, contexts=contexts,
                   approach=approach, use_helper_words=use_helper_words, helper_mode=helper_mode,
                   context_size=context_size, max_generation_length=max_generation_length,
                   specials=sp)
    fin = finalize_sample(raw, context_size, sp["eos"])
    return cache.select("split", "sample_id", *keep, fin["input_ids"].alias("input_ids"),
                        fin["label_ids"].alias("label_ids"))


def training_feed(cache: DataFrame, *, epochs: int, batch_size: int, replicas: int, seed: int = SEED,
                  **sample_kw) -> DataFrame:
    """What the training loop consumes: per epoch a fresh keyed shuffle, batches
    (partial last batch dropped except on test), contiguous replica shares, and a
    fresh Gumbel draw of contexts per (epoch, sample).

    Positions are computed on the light ``(split, sample_id, epoch)`` table (a
    range-partitioned scan); the heavy cache rows join once on ``sample_id`` and
    assembly is narrow.
    """
    from quarry.operators.batching import make_batches, repeat_epochs, replica_split
    light = repeat_epochs(cache.select("split", "sample_id"), epochs)
    placed = replica_split(make_batches(light, batch_size, seed=seed, epoch_col="epoch"), replicas)
    placed = placed.select("split", "sample_id", "epoch", "batch_no", "replica", "pos_in_batch")
    heavy = cache.select("sample_id", "question_ids", "answer_ids", "retrievals")
    joined = placed.join(heavy, "sample_id")
    return training_samples(joined, seed=seed, epoch=F.col("epoch"),
                            keep=("epoch", "batch_no", "replica", "pos_in_batch"), **sample_kw)


# ---------------------------------------------------------------------------
# Closures for DataFrame.transform (the reference's dataset map functions)
# ---------------------------------------------------------------------------

def make_retrieve_and_merge(**sample_kw):
    """Returns ``cache -> samples``: sampling + assembly + padding, for ``df.transform``."""
    def retrieve_and_merge(cache: DataFrame) -> DataFrame:
        return training_samples(cache, **sample_kw)
    return retrieve_and_merge


def make_prompt_prep(eos: int | None = None):
    """Returns ``samples -> prompts``: the generation input of each finished sample."""
    from quarry.operators.assembly import prompt_extract
    eos = special_ids()["eos"] if eos is None else eos

    def prompt_prep(samples: DataFrame) -> DataFrame:
        is_test = F.col("split") == "test"
        return samples.select("split", "sample_id", prompt_extract(
            F.col("input_ids"), F.col("label_ids"), is_test, eos).alias("prompt_ids"))
    return prompt_prep
