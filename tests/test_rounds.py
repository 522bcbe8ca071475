"""Whole tables, null keys and values, and both ways of looking tokens up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from quarry.functions.arrays import strip_padding_2d
from quarry.operators.metrics import ema, step_counters
from quarry.operators.ranks import global_rank
from quarry.operators.scan import ordered_scan
from quarry.operators.vocab import Vocab, build_vocab, read_vocab_file, write_vocab_file
from quarry.params import FIRST_TOKEN_ID, special_ids
from quarry.session import size_in_bytes
from quarry.sources import tables


def test_every_passage_and_question_is_read(spark):
    docs = tables.read_table(spark, SF_CHECK, "documents").count()
    conv = tables.read_table(spark, SF_CHECK, "conversations")
    assert tables.blocks(spark, SF_CHECK, with_vectors=False).count() == docs
    assert tables.blocks(spark, SF_CHECK).count() == docs
    assert tables.questions(spark, SF_CHECK).count() == conv.where("role = 'user'").count()


def test_vocabulary_holds_every_token(spark):
    docs = tables.read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    vocab = Vocab(build_vocab(docs))
    joined = Vocab(vocab.df, max_bytes=0)
    assert vocab.tokens is not None and joined.tokens is None
    a = vocab.decode_into(vocab.encode_into(docs, {"ids": "text"}), {"back": "ids"})
    b = joined.decode_into(joined.encode_into(docs, {"ids": "text"}), {"back": "ids"})
    rows = {r.doc_id: r for r in a.collect()}
    for r in b.collect():
        assert r.ids == rows[r.doc_id].ids and r.back == rows[r.doc_id].back
        assert special_ids()["oov"] not in r.ids
        assert r.back == " ".join(r.text.lower().split())
    strange = spark.createDataFrame([(1, "certainlynotthere the"), (2, None), (3, "")], "doc_id long, text string")
    for v in (vocab, joined):
        got = {r.doc_id: r for r in v.decode_into(v.encode_into(strange, {"ids": "text"}), {"back": "ids"}).collect()}
        assert got[1].ids[0] == 0 and got[1].back.startswith("<< 0 >> ") and got[2].ids is None and got[3].ids == []


def test_vocabulary_file(spark, tmp_path):
    words = spark.createDataFrame([(f"t{i:05d}",) for i in range(3000)], "token string")
    vocab = global_rank(words, ["token"], "token_id").withColumn("token_id", (F.col("token_id") + FIRST_TOKEN_ID).cast("int"))
    path = write_vocab_file(vocab, str(tmp_path / "v"))
    got = read_vocab_file(spark, path).orderBy("token_id").collect()
    assert [(r.token, r.token_id) for r in got] == [(f"t{i:05d}", i + FIRST_TOKEN_ID) for i in range(3000)]


@pytest.mark.parametrize("parts", [1, 4])
def test_scan_with_null_keys_and_values(spark, parts):
    """Against SQL windows; whole numbers beyond 2**53 stay exact, other columns pass through untouched."""
    big = 9007199254740993
    rows = [(None if i % 5 == 0 else i % 3, i, None if i % 4 == 1 else i * 7 + big, big + i, None if i % 2 else big)
            for i in range(200)]
    df = spark.createDataFrame(rows, "k long, t long, x long, y long, z long")
    df.createOrReplaceTempView("scan_rows")
    want = {r.t: r for r in spark.sql("""SELECT *, row_number() OVER w - 1 AS n, sum(x) OVER w AS s, lag(x) OVER (PARTITION BY k ORDER BY t) AS l
        FROM scan_rows WINDOW w AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)""").collect()}
    for kind, name, value in (("row_number", "n", None), ("sum", "s", "x"), ("lag", "l", "x")):
        out = ordered_scan(df, "k", ["t"], kind, value, "o", n_parts=parts).collect()
        assert len(out) == 200
        for r in out:
            assert r.o == want[r.t][name] and (r.k, r.x, r.y, r.z) == tuple(want[r.t][c] for c in "kxyz")
    counters = step_counters(df, "k", ["t"], "x").collect()
    assert all(r.batches == want[r.t].n + 1 and r.samples == (want[r.t].s or 0) for r in counters)


@pytest.mark.parametrize("parts", [1, 5])
def test_average_skips_nulls_and_takes_seeds(spark, parts):
    rows = [(None if i % 7 == 0 else i % 2, i, None if i < 9 or i % 3 == 0 else float(i), 9007199254740993 if i % 2 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, t long, x double, z long")
    seeds = spark.createDataFrame([(None, 100.0), (1, 7.0)], "k long, seed double")
    for table, start in ((None, {}), (seeds, {None: 100.0, 1: 7.0})):
        want, state = {}, dict(start)
        for k, t, x, z in sorted(rows, key=lambda r: r[1]):
            if x is not None:
                state[k] = x if state.get(k) is None else 0.9 * state[k] + 0.1 * x
            want[t] = (state.get(k), z)
        out = ordered_scan(df, "k", ["t"], "ema", "x", "o", n_parts=parts, constant=0.9, seeds=table).collect()
        assert len(out) == 120
        for r in out:
            v, z = want[r.t]
            assert r.z == z and ((v is None and r.o is None) or abs(v - r.o) < 1e-9)
    assert ema(df.limit(0), "k", ["t"], "x").collect() == []


def test_small_parts(spark):
    df = spark.createDataFrame([([[1, 2], [-1, -1], [3, -1], [-1, -1]],), ([[-1], [-1]],), ([],)], "a array<array<int>>")
    assert [r[0] for r in df.select(strip_padding_2d(F.col("a"))).collect()] == [[[1, 2], [], [3]], [], []]
    assert [size_in_bytes(x) for x in ("134217728", "134217728b", "256MB", "1g", "64k", "16m")] == [
        134217728, 134217728, 256 << 20, 1 << 30, 64 << 10, 16 << 20]


def test_search_paths_agree_on_doubles(spark):
    from quarry.operators import search as S
    rng = np.random.default_rng(0)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(20)], "sample_id long, embedding array<double>")
    b = spark.createDataFrame([(i, (rng.normal(size=8) + 1e-9 * i).tolist()) for i in range(500)], "block_id long, embedding array<double>")
    key = lambda df: sorted((r.sample_id, r.rank, r.block_id, r.score) for r in df.collect())
    first = key(S.mips_exact(q, b, 5))
    old = S.FLOOR_ROWS, S.BLOCK_CHUNK
    S.FLOOR_ROWS = 0
    try:
        assert [x[:3] for x in key(S.mips_exact(q, b, 5))] == [x[:3] for x in first]
    finally:
        S.FLOOR_ROWS, S.BLOCK_CHUNK = old
    assert [x[:3] for x in key(S.mips_exact(q, b, 5, broadcast_bytes=64 * 20))] == [x[:3] for x in first]


def test_leaves_don_t_depend_on_partitions(spark):
    from quarry.operators import ann as AN
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * (0.01 if i % 3 == 0 else 1)).tolist()) for i in range(600)]   # a third in one spot
    b = spark.createDataFrame(rows, "block_id long, embedding array<double>")
    q = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(15)], "qid long, embedding array<double>")
    found = []
    for parts in (1, 7):
        cents, assigned = AN.ivf_train(b.repartition(parts), 5)
        books = AN.pq_train(b.repartition(parts), 2, codes=4)
        leaves = {r.block_id: r.leaf for r in assigned.collect()}
        hits = sorted((r.qid, r.rank, r.block_id) for r in AN.ivf_probe(q, assigned, cents, 2, 4).collect())
        far = sorted((r.qid, r.rank, r.block_id) for r in AN.ivf_probe(q, assigned, cents, 2, 4, broadcast_bytes=0).collect())
        assert hits == far          # scored in place or after a shuffle
        found.append((leaves, hits, sorted((r.subspace, r.code, tuple(r.centroid)) for r in books.collect())))
    assert found[0] == found[1] and len(set(found[0][0].values())) > 1


def test_compressed_search_finds_most(spark):
    from quarry.operators import ann as AN
    from quarry.operators.search import mips_exact
    rng = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    b = spark.createDataFrame([(i, unit(rng.normal(size=16))) for i in range(800)], "block_id long, embedding array<double>")
    q = spark.createDataFrame([(i, unit(rng.normal(size=16))) for i in range(20)], "qid long, embedding array<double>")
    cents, assigned = AN.ivf_train(b, 8)
    books = AN.pq_train(b)
    approx = AN.ivf_probe(q, AN.pq_encode(assigned, books), cents, 6, 100, codebooks=books)
    top = AN.rerank_exact(approx, q, b, 10, n_candidates=2000, query_bytes=20 * 16 * 8)
    exact = mips_exact(q, b, 10, qid_col="qid")
    assert AN.recall(top, exact, mode="all").first().recall > 0.9
