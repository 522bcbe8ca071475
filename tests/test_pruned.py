"""Pruned exact search and draws from candidate rows, against the operators that see everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann as AN
from quarry.operators.pruned import group_bounds, mips_pruned
from quarry.operators.retrieval import collect_retrievals
from quarry.operators.sampling import gumbel_sample, gumbel_sample_rows
from quarry.operators.search import mips_exact


def clustered(spark, n=3000, groups=20, dim=8, seed=3):
    """Blocks around a few far centres, with repeated vectors (ties) and one group of a third of all."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 10
    of = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, groups, n))
    x = centres[of] + rng.normal(size=(n, dim)) * 0.3
    x[50:90] = x[50]
    blocks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "block_id long, embedding array<double>").repartition(6)
    qs = np.concatenate([x[40:100], rng.normal(size=(40, dim)) * 10, np.zeros((1, dim))])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "qid long, embedding array<double>").repartition(3)
    return blocks, queries, n


def found(df):
    return sorted((r.qid, r.rank, r.block_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("kw", [{}, {"broadcast_bytes": 0, "max_tile_rows": 100}])
def test_rows_of_the_exact_search_from_fewer_pairs(spark, kw):
    blocks, queries, n = clustered(spark)
    cents, assigned = AN.ivf_train(blocks, 20, rounds=3, oversampled=True)
    got, work = mips_pruned(queries, assigned, cents, 10, with_work=True, **kw)
    assert found(got) == found(mips_exact(queries, blocks, 10, qid_col="qid"))
    scored = work.where("qid < 100").agg(F.sum("blocks")).first()[0]
    assert scored < 0.6 * 100 * n                                     # of all pairs
    assert work.where("qid = 100").first().blocks == n               # the zero vector's scores are all equal


def test_bounds_hold(spark):
    blocks, _, n = clustered(spark, 500)
    cents, assigned = AN.ivf_train(blocks, 7, rounds=2)
    c = {r.leaf: np.array(r.embedding) for r in cents.collect()}
    rows = assigned.collect()
    bounds = {r.leaf: r for r in group_bounds(assigned, cents).collect()}
    assert sum(b.n for b in bounds.values()) == n
    for r in rows:
        v = np.array(r.embedding)
        assert np.linalg.norm(v - c[r.leaf]) <= bounds[r.leaf].radius + 1e-12 and np.linalg.norm(v) <= bounds[r.leaf].norm + 1e-12


def test_few_blocks_and_empty_tables(spark):
    blocks, queries, _ = clustered(spark, 100, 4)
    cents, assigned = AN.ivf_train(blocks, 4, rounds=2)
    few = assigned.where("block_id < 5")
    assert found(mips_pruned(queries, few, cents, 10)) == found(mips_exact(queries, blocks.where("block_id < 5"), 10, qid_col="qid"))
    assert mips_pruned(queries.limit(0), assigned, cents, 10).collect() == []
    assert mips_pruned(queries, assigned.limit(0), cents, 10).collect() == []


def test_draws_from_rows_equal_draws_in_the_row(spark):
    rows = [(s, b, ((s * 31 + b * 17) % 97) / 97) for s in range(30) for b in range(5 + s * 13)]
    rows += [(77, b, (b % 101) / 101) for b in range(5000)]
    cands = spark.createDataFrame(rows, "sample_id long, block_id long, score double").repartition(7)
    listed = collect_retrievals(cands.withColumn("rank", F.lit(1)), "sample_id", ["block_id", "score"])
    inrow = listed.select("sample_id", F.posexplode(gumbel_sample(F.col("retrievals"), F.col("sample_id"))).alias("pos", "r"))
    out = gumbel_sample_rows(cands.withColumn("extra", F.lit("x")))
    assert out.columns == ["sample_id", "block_id", "score", "extra", "draw"]
    assert sorted((r.sample_id, r.draw, r.block_id) for r in out.collect()) == sorted(
        (r.sample_id, r.pos + 1, r.r.block_id) for r in inrow.collect())
    assert out.groupBy("sample_id").count().where("count != 5").count() == 0


def test_draws_keep_k_rows_a_task_before_the_shuffle(spark):
    plan = gumbel_sample_rows(spark.range(10).selectExpr("id % 2 AS sample_id", "id AS block_id", "0.5D AS score"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in text and "WindowGroupLimit" in text


def test_few_null_and_no_candidates(spark):
    rows = [(1, 1, 0.5), (1, 2, None), (2, 9, None)]
    cands = spark.createDataFrame(rows, "sample_id long, block_id long, score double")
    got = sorted((r.sample_id, r.draw, r.block_id) for r in gumbel_sample_rows(cands, 2).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 9)]
    assert gumbel_sample_rows(cands.limit(0)).collect() == []
