"""A coded index sent to the queries gives the rows of a probe in place; few pairs are scored in double precision."""

import numpy as np
import pytest

from quarry.operators import ann as AN
from quarry.operators import ann_leaves as AL
from quarry.operators import search as S
from quarry.session import scratch_path


def rows(df):
    return sorted((r["qid"], r["rank"], r["block_id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    x[100:140] = x[100]                # ties
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "block_id long, embedding array<double>")
    cents, assigned = AN.ivf_train(b, 8, rounds=3, oversampled=True)
    index = AN.write_index(AL.second_leaf(assigned, cents), scratch_path(spark, "index"))
    books = AL.residual_books(index.where("spill = 0"), cents, 2, rounds=2)
    asked = [(i, v.tolist()) for i, v in enumerate(np.concatenate([rng.normal(size=(60, 8)), x[100:110]]))]
    q = spark.createDataFrame([*asked, asked[3], asked[3]], "qid long, embedding array<double>")     # a query that comes again
    return q, cents, AN.write_index(AL.residual_codes(index, cents, books), scratch_path(spark, "coded")), books


@pytest.mark.parametrize("parts, held", [(1, 1000), (1, 7), (3, 7)])
def test_the_rows_of_a_probe_in_place(spark, coded, monkeypatch, parts, held):
    q, cents, index, books = coded

    def probe():
        return AN.ivf_probe(q, index, cents, 3, 9, codebooks=books, spilled=True)
    want = rows(probe())
    assert len(want) == 70 * 9
    monkeypatch.setattr(AN, "STREAM_ROWS", 0)
    monkeypatch.setattr(AN, "LEAF_ROWS", 50)
    monkeypatch.setattr(AN, "_coded_parts", lambda *a: parts)
    monkeypatch.setattr(S, "queries_a_pass", lambda *a: held)
    got = probe()
    assert rows(got) == want
    # with one part a query's rows are whole where they are made: nothing is merged
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("Window" in plan) == (parts > 1)


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    rng = np.random.default_rng(3)
    q, b = rng.normal(size=(200, 16)), rng.normal(size=(40_000, 16))
    seen, real = [], S.products
    monkeypatch.setattr(S, "products", lambda x, y: seen.append(len(x)) or real(x, y))
    top = S.TopK(q, 10)
    for lo in range(0, len(b), 4096):
        top.update(b[lo:lo + 4096], np.arange(lo, min(lo + 4096, len(b))))
    scores = q @ b.T
    for r, s, i in top.kept():
        for n in range(len(q)):
            assert i[r == n].tolist() == np.lexsort((np.arange(len(b)), -scores[n]))[:10].tolist()
    assert sum(seen) < 200 * 10 * 6, sum(seen)


def test_scores_that_are_not_numbers_reach_every_bound():
    b = np.random.default_rng(4).normal(size=(3000, 4))
    b[2500] = np.nan
    top = S.TopK(np.ones((3, 4)), 5)
    top.update(b[:2000], np.arange(2000))
    top.update(b[2000:], np.arange(2000, 3000))
    assert all(np.isfinite(s[np.isin(r, [0, 1, 2])][:5]).any() for r, s, i in top.kept())
