"""Streamed retrieval against the batch query: several micro-batches, a replayed one, a stream that goes on, odd questions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann as AN
from quarry.operators import ann_leaves as AL
from quarry.operators.retrieval import gather_blocks
from quarry.session import scratch_path
from quarry.streaming.arrivals import arriving, by_key
from quarry.streaming.live_stream import LiveRetrieval

NPROBE, K = 3, 5
ASKED = "sample_id long, embedding array<double>"


@pytest.fixture(scope="module")
def stored(spark):
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(12, 8))
    x = spots[rng.integers(0, 12, 500)] + rng.normal(size=(500, 8)) * 0.2
    x[:160] = x[0]      # a third of all passages has one vector: ties
    blocks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "block_id long, embedding array<double>")
    cents, assigned = AN.ivf_train(blocks, 12, oversampled=True)
    index = AN.write_index(AL.second_leaf(assigned, cents), scratch_path(spark, "index"))
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "block_id long, text string")
    return cents, index, texts, x


def questions(spark, x, ids, shift=0.0):
    return spark.createDataFrame([(i, (x[(i * 7) % len(x)] + shift).tolist()) for i in ids], ASKED)


def batch_answer(stored, asked):
    cents, index, texts, _ = stored
    hits = AN.ivf_probe(asked.withColumnRenamed("sample_id", "qid"), index, cents, NPROBE, K, spilled=True)
    return rows(gather_blocks(hits.withColumnRenamed("qid", "sample_id"), texts))


def rows(df):
    return sorted((r["sample_id"], r["rank"], r["block_id"], round(r["score"], 9), r["text"]) for r in df.collect())


def live(spark, stored, path=None):
    cents, index, texts, _ = stored
    return LiveRetrieval(spark, index, cents, texts, nprobe=NPROBE, k=K, path=path)


def test_micro_batches_a_replay_and_a_later_start_equal_the_batch_query(spark, stored):
    asked = questions(spark, stored[3], range(60))
    path = arriving(asked, by_key(F.col("sample_id"), 4), 4)
    first = live(spark, stored)
    first.run(path, asked.schema)
    assert len(first.leaves_read) >= 4
    assert rows(first.answers()) == batch_answer(stored, asked)
    # a batch that runs again overwrites its own answers
    n = sorted(first.leaves_read)[1]
    again = spark.read.parquet(f"{first.path}/asked/{n}").withColumnRenamed("qid", "sample_id")
    first.batch(spark.createDataFrame(again.collect(), again.schema), n)
    assert rows(first.answers()) == batch_answer(stored, asked)
    # a new process goes on with what arrived since; question 3 arrives again, with another vector
    more = questions(spark, stored[3], [3, *range(60, 75)], shift=0.5)
    more.coalesce(1).write.mode("append").parquet(path)
    second = live(spark, stored, first.path)
    second.run(path, asked.schema)
    assert len(second.leaves_read) == 1
    assert rows(second.answers()) == batch_answer(stored, asked.where("sample_id <> 3").unionByName(more))


def test_a_batch_reads_its_own_leaves_only(spark, stored):
    one = live(spark, stored)
    asked = questions(spark, stored[3], [5])
    path = scratch_path(spark, "one")
    asked.write.parquet(path)
    one.run(path, asked.schema)
    assert max(one.leaves_read.values()) == NPROBE
    plan = one.needed([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "leaf" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_odd_questions(spark, stored):
    good = stored[3][9].tolist()
    odd = spark.createDataFrame([(1, None), (2, [1.0, None] + [0.0] * 6), (3, [float("nan")] * 8), (None, good), (4, []),
                                 (5, good), (5, good)], ASKED)
    path = scratch_path(spark, "odd")
    odd.coalesce(1).write.parquet(path)
    spark.createDataFrame([], ASKED).coalesce(1).write.mode("append").parquet(path)
    out = live(spark, stored)
    out.run(path, odd.schema)
    assert rows(out.answers()) == batch_answer(stored, spark.createDataFrame([(5, good)], ASKED))
