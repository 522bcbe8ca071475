"""Searches whose queries don't fit a task are made in passes, with the same rows; what a task holds is bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann as AN
from quarry.operators import ann_leaves as AL
from quarry.operators import search as S
from quarry.operators import vocab
from quarry.session import scratch_path


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 8))
    x[100:150] = x[100]      # ties
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "block_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([rng.normal(size=(90, 8)), x[100:110]]))],
                              "qid long, embedding array<double>")
    return q, b, x


def rows(df):
    return sorted((r["qid"], r["rank"], r["block_id"], round(r["score"], 9)) for r in df.collect())


def sizes(monkeypatch):
    """Rows of the query matrices sent from the driver."""
    sent, real = [], S._to_matrix

    def seen(df, id_col, dim):
        out = real(df, id_col, dim)
        sent.append((id_col, len(out[0])))
        return out
    monkeypatch.setattr(S, "_to_matrix", seen)
    return sent


def test_exact_search_in_passes(spark, vectors, monkeypatch):
    q, b, x = vectors
    whole = rows(S.mips_exact(q, b, 7, qid_col="qid"))
    monkeypatch.setattr(S, "queries_a_pass", lambda *a: 20)
    monkeypatch.setattr(S, "BLOCK_SIDE_BYTES", 0)
    sent = sizes(monkeypatch)
    assert rows(S.mips_exact(q, b, 7, qid_col="qid")) == whole
    assert len(sent) == 5 and max(n for _, n in sent) < 60
    monkeypatch.setattr(S, "BLOCK_SIDE_BYTES", 1 << 30)
    assert rows(S.mips_exact(q, b, 7, qid_col="qid")) == whole


def test_probe_and_codes_in_passes(spark, vectors, monkeypatch):
    q, b, x = vectors
    cents, assigned = AN.ivf_train(b, 8, oversampled=True)
    index = AN.write_index(AL.second_leaf(assigned, cents), scratch_path(spark, "index"))
    books = AL.residual_books(index.where("spill = 0"), cents, 2, rounds=2)
    coded = AN.write_index(AL.residual_codes(index, cents, books), scratch_path(spark, "coded"))

    def both():
        return (rows(AN.ivf_probe(q, index, cents, 3, 9, spilled=True)), rows(AN.ivf_probe(q, coded, cents, 3, 9, codebooks=books, spilled=True)))
    whole = both()
    monkeypatch.setattr(S, "queries_a_pass", lambda *a: 20)
    sent = sizes(monkeypatch)
    assert both() == whole
    asked = [n for c, n in sent if c == "qid"]
    assert len(asked) == 10 and max(asked) < 60
    # decoded brute force
    c = np.array([r["embedding"] for r in cents.orderBy("leaf").collect()])
    book = AN._codebook_arrays(books)[0]
    best: dict = {}
    for r in coded.collect():
        numbers = AL.unpack_codes(__import__("pyarrow").array([bytes(r["codes"])]), len(book))[0]
        best.setdefault(r["block_id"], {})[r["leaf"]] = c[r["leaf"]] + book[np.arange(len(book)), numbers].reshape(-1)
    for r in q.where("qid % 10 = 0").collect():
        v = np.array(r["embedding"])
        leaves = set(np.lexsort((np.arange(len(c)), -(c @ v)))[:3].tolist())
        found = sorted((-max(float(v @ d) for leaf, d in of.items() if leaf in leaves), k) for k, of in best.items() if leaves & set(of))[:9]
        mine = [x for x in whole[1] if x[0] == r["qid"]]
        assert np.allclose([-s for s, _ in found], [x[3] for x in mine])


def test_rerank_without_broadcast_candidates(spark, vectors, monkeypatch):
    q, b, x = vectors
    approx = S.mips_exact(q, AN.scalar_quantise(b), 30, qid_col="qid")
    small = rows(AN.rerank_exact(approx, q, b, 5, n_candidates=3000, query_bytes=6400))
    monkeypatch.setattr(AN, "MAX_BROADCAST_CANDIDATE_BYTES", 0)
    monkeypatch.setattr(S, "BLOCK_SIDE_BYTES", 20_000)
    out = AN.rerank_exact(approx, q, b, 5, n_candidates=3000, query_bytes=6400)
    assert rows(out) == small and len(small) == 500
    assert "Broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_what_a_task_holds_does_not_grow():
    for k in (10, 100):
        assert S.queries_a_pass(64, k, 128) * (64 * 12 + k * 72 + 128 * 16) <= 128 << 20
    assert vocab.MAX_VOCAB_BYTES <= 16 << 20
    top = S.TopK(np.random.default_rng(0).normal(size=(50, 8)), 5)
    for lo in range(0, 200_000, 10_000):
        top.update(np.random.default_rng(lo).normal(size=(10_000, 8)), np.arange(lo, lo + 10_000))
        assert all(b.size <= 1 << 17 for b in top.best)
