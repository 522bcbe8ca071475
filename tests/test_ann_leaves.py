"""Oversampled starts, second leaves and packed residual codes against NumPy, and the recall they reach."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann as AN
from quarry.operators import ann_leaves as AL
from quarry.operators.search import mips_exact

from tests.conftest import SF_SMALL

SF_BENCH = "/root/testdata/sf0.1"


def table(spark, x, parts=3, name="block_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>").repartition(parts)


def clustered(seed=1, n=400, dim=8):
    rng = np.random.default_rng(seed)
    spots = rng.normal(size=(12, dim))
    x = spots[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.05
    x[: n // 3] = spots[0] + rng.normal(size=(n // 3, dim)) * 0.01   # a third in one spot
    return x


def test_starts_depend_on_the_data_alone(spark):
    x = clustered()
    found = [AL.oversampled_starts(table(spark, x, p), 12) for p in (1, 5)]
    assert found[0].shape == (12, 8) and (found[0] == found[1]).all()
    d = AL._squared(np.rint(x * AN.SCALE), found[0]).min(1)
    # every spot has a start near it, which the 12 vectors first in hash order do not manage
    assert np.sqrt(d.max()) / AN.SCALE < 0.6
    from quarry.operators.sampling import hash_sample
    first = np.array([r.embedding for r in hash_sample(table(spark, x), "block_id", 12).collect()])
    assert np.sqrt(AL._squared(x, first).min(1).max()) > 0.6


def test_fewer_points_than_leaves(spark):
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]])
    cents, assigned = AN.ivf_train(table(spark, x), 5, oversampled=True)
    assert cents.count() == 2
    spilled = AL.second_leaf(assigned, cents)
    assert sorted((r.block_id, r.leaf) for r in spilled.collect()) == [(i, leaf) for i in range(4) for leaf in (0, 1)]
    one, only = AN.ivf_train(table(spark, x[:1]), 3, oversampled=True)
    assert one.count() == 1 and AL.second_leaf(only, one).count() == 1


def test_thinning():
    c = np.array([[0.0], [1.0], [10.0], [11.0], [10.0]])
    assert AL.thinned(c, np.array([5.0, 1, 1, 1, 1]), 3).ravel().tolist() == [0, 11, 1]
    assert len(AL.thinned(c, np.ones(5), 9)) == 4     # equal candidates are taken once


def test_second_leaf(spark):
    x = clustered(2)
    cents, assigned = AN.ivf_train(table(spark, x), 7, oversampled=True)
    c = AL.whole_centroids(cents)
    rows = AL.second_leaf(assigned, cents).collect()
    whole = np.trunc(x * AN.SCALE + np.copysign(0.5, x))
    first = {r.block_id: r.leaf for r in rows if r.spill == 0}
    second = {r.block_id: r.leaf for r in rows if r.spill == 1}
    assert len(rows) == 2 * len(x)
    for i, v in enumerate(whole):
        assert first[i] == ((v - c) ** 2).sum(1).argmin()
        r = v - c[first[i]]
        cost = [((v - k) ** 2).sum() + (r @ (v - k)) ** 2 / max(r @ r, 1e-9) if j != first[i] else np.inf for j, k in enumerate(c)]
        assert second[i] == int(np.argmin(cost))


def test_codes_pack_and_unpack():
    import pyarrow as pa
    for n_sub in (1, 2, 5, 32):
        codes = np.random.default_rng(n_sub).integers(0, 16, (50, n_sub)).astype(np.uint8)
        packed = AL.pack_codes(codes)
        assert packed.shape == (50, (n_sub + 1) // 2)
        assert (AL.unpack_codes(pa.array([p.tobytes() for p in packed], pa.binary()), n_sub) == codes).all()


@pytest.mark.parametrize("dim", [8, 7])
def test_residual_scores(spark, dim):
    x, q = clustered(3, dim=dim), np.random.default_rng(4).normal(size=(9, dim))
    queries = table(spark, q, 2, "qid")
    cents, assigned = AN.ivf_train(table(spark, x), 6, oversampled=True)
    index = AL.second_leaf(assigned, cents)
    books = AL.residual_books(assigned, cents, 2, rounds=4)
    coded = AL.residual_codes(index, cents, books)
    book, valid = AN._codebook_arrays(books)
    c = AL.whole_centroids(cents)
    best: dict = {}
    probed = {i: set(np.argsort(-(v @ (c / AN.SCALE).T), kind="stable")[:3].tolist()) for i, v in enumerate(q)}
    for r in index.collect():
        rest = (np.trunc(np.array(r.embedding) * AN.SCALE + np.copysign(0.5, r.embedding)) - c[r.leaf])[None]
        code = AL.nearest_codes(rest, np.rint(book * AN.SCALE), valid)[0]
        approx = c[r.leaf] / AN.SCALE + np.concatenate([book[s, k] for s, k in enumerate(code)])[:dim]
        for i, v in enumerate(q):
            if r.leaf in probed[i]:
                best[i, r.block_id] = max(best.get((i, r.block_id), -np.inf), float(v @ approx))
    for kw in ({}, {"broadcast_bytes": 0, "max_tile_rows": 40}):   # where the index lies; shuffled in tiles
        got = AN.ivf_probe(queries, coded, cents, 3, 10, codebooks=books, spilled=True, **kw).collect()
        for i in range(len(q)):
            want = sorted(((-s, b) for (j, b), s in best.items() if j == i))[:10]
            mine = sorted((r.rank, r.block_id, r.score) for r in got if r.qid == i)
            assert [m[0] for m in mine] == list(range(1, len(want) + 1))
            assert np.allclose([m[2] for m in mine], [-w[0] for w in want]) and len({m[1] for m in mine}) == len(mine)


def test_recall_on_the_embeddings(spark):
    """The first 500 vectors as queries, a quarter of the leaves probed; codes are an eighth of 32-bit numbers."""
    x = spark.read.parquet(f"{SF_BENCH}/embeddings.parquet").select(F.col("vec_id").alias("block_id"), "embedding")
    q = x.where("block_id < 500").withColumnRenamed("block_id", "qid")
    cents, assigned = AN.ivf_train(x, 128, rounds=5, oversampled=True)
    index = AL.second_leaf(assigned, cents)
    exact = mips_exact(q, x, 10, qid_col="qid")
    assert AN.recall(AN.ivf_probe(q, index, cents, 32, 10, spilled=True), exact).first().recall >= 0.9
    assert AN.recall(AN.ivf_probe(q, assigned, cents, 32, 10), exact).first().recall < 0.85   # what the second leaf is for
    books = AL.residual_books(assigned, cents, 2, rounds=4)
    coded = AL.residual_codes(index, cents, books)
    best = AN.ivf_probe(q, coded, cents, 32, 100, codebooks=books, spilled=True)
    assert AN.recall(AN.rerank_exact(best, q, x, 10), exact).first().recall >= 0.9
    assert coded.agg(F.max(F.length("codes")), F.min(F.length("codes"))).first() == (16, 16)
    assert AN.pq_encode(assigned.limit(1), books).select(F.size("codes")).first()[0] * 4 == 128


def test_index_is_read_by_leaf(spark):
    from quarry.session import scratch_path
    x = clustered(5)
    cents, assigned = AN.ivf_train(table(spark, x), 6, oversampled=True)
    index = AN.write_index(AL.second_leaf(assigned, cents), scratch_path(spark, "leaf-index"))
    files = {f.rsplit("/", 2)[-2] for f in index.where("leaf IN (1, 2)").inputFiles()}
    assert files <= {f"leaf={k}" for k in range(6)} and len(index.inputFiles()) <= 6 * 2
    assert index.count() == 2 * len(x)


def test_recall_job(spark):
    from quarry import jobs
    from quarry.session import scratch_path
    for extra in ([], ["--reorder", "0"], ["--single-leaf"], ["--mode", "any"]):
        out = scratch_path(spark, "recall-job")
        jobs.main(["recall", "--data", SF_SMALL, "--out", out, "--leaves", "8", "--nprobe", "4", "--queries", "20", *extra])
        r = spark.read.json(out).first()
        assert 0.3 < r.recall <= 1 and json.loads(r.flags)["spilled"] == ("--single-leaf" not in extra)
