"""Command-line jobs: the reference's batch scripts as Spark jobs.

    python -m quarry.jobs cache   --data DIR --out PATH [--k 10] [--shards 2048] [--vocab FILE] [--tokenizer whitespace|delimiter]
    python -m quarry.jobs samples --cache PATH --out PATH [--split train] [--epochs 1] [--batch 8] [--replicas 1]
    python -m quarry.jobs recall  --data DIR --out PATH [--leaves 1000] [--nprobe 100] [--k 10] [--mode all] [--reorder 100]
    python -m quarry.jobs lengths --data DIR --out PATH
    python -m quarry.jobs metrics --data DIR --out PATH

``DIR`` holds the input tables as ``<name>.parquet``. Outputs are Parquet
(tables) or JSON (reports). The session comes from the cluster configuration
(``spark-submit``); intermediate state goes to its ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.params import (CONTEXT_SIZE, IVF_LEAVES_TO_SEARCH, IVF_NUM_LEAVES, IVF_REORDER, IVF_TRAINING_SAMPLE,
                           MAX_GENERATION_LENGTH, NUM_NEIGHBORS, NUM_RETRIEVALS, NUM_SHARDS, PASSAGE_LENGTH_FRACTIONS,
                           PASSAGE_LENGTH_SAMPLE, QA_LENGTH_FRACTIONS, SAVE_PERIOD_MIN, SEED, TEMPERATURE)
from quarry.session import checkpoint_dir, ship_package


def job_cache(spark, a):
    from quarry.plans import pipeline as P
    from quarry.sources.cache_io import sink_cache
    vocab = P.given_vocab(spark, a.vocab, a.tokenizer) if a.vocab else P.corpus_vocab(spark, a.data, a.tokenizer)
    cache = P.retrieval_cache(spark, a.data, vocab, k=a.k, context_size=a.context_size)
    if a.version:   # splits that an earlier run of this version has written stay as they are
        from quarry.sources.versions import publish, write_version
        splits = sorted(r["split"] for r in cache.select("split").distinct().collect())   # a few names
        write_version(cache, a.out, a.version, splits, a.shards)
        publish(spark, a.out, a.version, splits)
        vocab.df.write.mode("overwrite").parquet(f"{a.out}/data/{a.version}/_vocab")
        return
    sink_cache(cache, a.out, a.shards)
    # next to the shards ("_" prefix: skipped by partition discovery), after the overwrite
    vocab.df.write.mode("overwrite").parquet(a.out + "/_vocab")


def job_samples(spark, a):
    from quarry.plans import pipeline as P
    from quarry.sources.cache_io import src_cache
    cache = src_cache(spark, a.cache, a.split)
    kw = dict(num_retrievals=a.num_retrievals, temperature=a.temperature, context_size=a.context_size,
              max_generation_length=a.max_generation_length, approach=a.approach,
              use_helper_words=not a.no_helper_words, helper_mode=a.helper_mode)
    feed = P.training_feed(cache, epochs=a.epochs, batch_size=a.batch, replicas=a.replicas, seed=a.seed, **kw)
    from quarry.operators.stats import observe_sample_checks, strict_sample_checks
    from quarry.params import special_ids
    eos = special_ids()["eos"]
    if a.strict:
        feed = strict_sample_checks(feed, eos)
    feed, obs = observe_sample_checks(feed, eos)
    feed.write.mode("overwrite").partitionBy("split", "epoch").parquet(a.out)
    print({"sample_checks": obs.get})


def job_recall(spark, a):
    """Recall of the whole approximate pipeline: leaves, scores of compressed vectors, exact scores of the best
    ``--reorder`` (0: exact scores in the probed leaves, nothing compressed). The index is written by leaf."""
    from quarry.operators import ann as AN
    from quarry.operators import ann_leaves as AL
    from quarry.operators.sampling import query_sample
    from quarry.operators.search import mips_exact
    from quarry.session import scratch_path
    from quarry.sources import tables
    from quarry.sources.cache_io import sink_report
    blocks = tables.block_vectors(spark, a.data)
    cents, assigned = AN.ivf_train(blocks, a.leaves, training_sample=a.training_sample, oversampled=True)
    if not a.single_leaf:
        assigned = AL.second_leaf(assigned, cents)
    index = AN.write_index(assigned, scratch_path(spark, "index"))
    emb = tables.read_table(spark, a.data, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    qs = query_sample(emb, "qid", a.queries, a.seed)
    if a.reorder:
        books = AL.residual_books(index if a.single_leaf else index.where("spill = 0"), cents, training_sample=a.training_sample)
        coded = AN.write_index(AL.residual_codes(index, cents, books), scratch_path(spark, "coded"))
        best = AN.ivf_probe(qs, coded, cents, a.nprobe, a.reorder, codebooks=books, spilled=not a.single_leaf)
        approx = AN.rerank_exact(best, qs, blocks, a.k, n_candidates=a.queries * a.reorder)
    else:
        approx = AN.ivf_probe(qs, index, cents, a.nprobe, a.k, spilled=not a.single_leaf)
    if a.mode == "all":
        report = AN.recall(approx, mips_exact(qs, blocks, a.k, qid_col="qid"), mode="all")
    else:
        report = AN.recall(approx, qs.select("qid", F.col("qid").alias("own")), mode="any", self_col="own")
    flags = {"leaves": a.leaves, "nprobe": a.nprobe, "k": a.k, "queries": a.queries, "reorder": a.reorder, "spilled": not a.single_leaf}
    sink_report(report.withColumn("flags", F.to_json(F.struct(*[F.lit(v).alias(n) for n, v in flags.items()]))), a.out)


def job_lengths(spark, a):
    from quarry.operators import stats as S
    from quarry.plans import queries as Q
    qa = Q.qa_lengths(spark, a.data)
    S.cum_fraction(S.length_hist(qa)).write.mode("overwrite").parquet(a.out + "/qa_hist")
    cut = S.length_cutoffs(qa, QA_LENGTH_FRACTIONS)
    S.retrieval_budget(cut).write.mode("overwrite").parquet(a.out + "/qa_budget")
    S.length_cutoffs(Q.passage_lengths(spark, a.data), PASSAGE_LENGTH_FRACTIONS) \
        .write.mode("overwrite").parquet(a.out + "/passage_cutoffs")


def job_metrics(spark, a):
    from quarry.operators import metrics as M
    from quarry.sources import tables
    log = tables.metrics_log(spark, a.data)
    log = log if a.lenient else M.assert_numeric(log, "loss")  # a NaN or infinite loss ends the run
    step = F.floor(M.epoch_micros(F.col("ts")) / F.lit(3600000000)).cast("long")
    lm = M.loss_mean(log, step, F.pmod("user_id", F.lit(8)))
    lm = M.ema(lm.select("split", "step", "loss"), "split", ["step"], "loss")
    lm.select("split", "step", "loss", "ema", M.perplexity(F.col("loss")).alias("ppl"),
              M.perplexity(F.col("ema")).alias("ppl_ema")).write.mode("overwrite").parquet(a.out + "/steps")
    marks = M.cadence_marks(log.select("split", "event_id", "ts"), "split", "ts", ["ts", "event_id"],
                            SAVE_PERIOD_MIN * 60.0)
    marks.where("marked").write.mode("overwrite").parquet(a.out + "/checkpoint_marks")


def main(argv=None):
    p = argparse.ArgumentParser(prog="quarry.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("cache")
    c.add_argument("--data", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--k", type=int, default=NUM_NEIGHBORS)
    c.add_argument("--shards", type=int, default=NUM_SHARDS)
    c.add_argument("--context-size", type=int, default=CONTEXT_SIZE)
    c.add_argument("--vocab", default=None, help="vocabulary file, a token per line; without it one is built from the tables")
    c.add_argument("--version", default=None, help="write a version of the cache and publish it; a stopped run goes on with its missing splits")
    c.add_argument("--tokenizer", default="whitespace", choices=["whitespace", "delimiter"])
    s = sub.add_parser("samples")
    s.add_argument("--cache", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--split", default=None)
    s.add_argument("--epochs", type=int, default=1)
    s.add_argument("--batch", type=int, default=8)
    s.add_argument("--replicas", type=int, default=1)
    s.add_argument("--seed", type=int, default=SEED)
    s.add_argument("--num-retrievals", type=int, default=NUM_RETRIEVALS)
    s.add_argument("--temperature", type=float, default=TEMPERATURE)
    s.add_argument("--context-size", type=int, default=CONTEXT_SIZE)
    s.add_argument("--max-generation-length", type=int, default=MAX_GENERATION_LENGTH)
    s.add_argument("--approach", default="cached_pretok", choices=["cached_pretok", "naked_lm"])
    s.add_argument("--helper-mode", default="multiple", choices=["multiple", "once"])
    s.add_argument("--no-helper-words", action="store_true")
    s.add_argument("--strict", action="store_true", help="fail on the first sample breaking an invariant")
    r = sub.add_parser("recall")
    r.add_argument("--data", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--leaves", type=int, default=IVF_NUM_LEAVES)
    r.add_argument("--nprobe", type=int, default=IVF_LEAVES_TO_SEARCH)
    r.add_argument("--k", type=int, default=NUM_NEIGHBORS)
    r.add_argument("--queries", type=int, default=PASSAGE_LENGTH_SAMPLE)
    r.add_argument("--mode", default="all", choices=["all", "any"])
    r.add_argument("--reorder", type=int, default=IVF_REORDER, help="exact scores for so many of the best compressed ones (0: nothing compressed)")
    r.add_argument("--training-sample", type=int, default=IVF_TRAINING_SAMPLE, help="vectors that leaves and codebooks are trained on")
    r.add_argument("--single-leaf", action="store_true", help="no second leaf per vector")
    r.add_argument("--seed", type=int, default=SEED)
    for name in ("lengths", "metrics"):
        x = sub.add_parser(name)
        x.add_argument("--data", required=True)
        x.add_argument("--out", required=True)
        if name == "metrics":
            x.add_argument("--lenient", action="store_true", help="carry NaN and infinite losses instead of failing")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"quarry-{a.job}").getOrCreate()
    checkpoint_dir(spark)
    ship_package(spark)
    {"cache": job_cache, "samples": job_samples, "recall": job_recall, "lengths": job_lengths,
     "metrics": job_metrics}[a.job](spark, a)


if __name__ == "__main__":
    main()
