"""Operator cases: sampling, search, scans, batching, functions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import fmt_duration
from quarry.operators import batching as B
from quarry.operators import metrics as M
from quarry.operators.retrieval import cached_lookup
from quarry.operators.sampling import gumbel_sample
from quarry.operators.scan import ordered_scan
from quarry.operators.search import mips_exact


def test_gumbel_k_all_is_permutation(spark):
    df = spark.createDataFrame([(1, [(1, 10, 0.5), (2, 11, 0.1), (3, 12, 0.9)])],
                               "sid long, r array<struct<rank:int, block_id:long, score:double>>")
    got = df.select(gumbel_sample(F.col("r"), F.col("sid"), 3, 0.03, 7).alias("s")).first()["s"]
    assert sorted(x["block_id"] for x in got) == [10, 11, 12]


def test_gumbel_k_too_big(spark):
    df = spark.createDataFrame([(1, [(1, 10, 0.5), (2, 11, 0.1), (3, 12, 0.9)])],
                               "sid long, r array<struct<rank:int, block_id:long, score:double>>")
    with pytest.raises(Exception):
        df.select(gumbel_sample(F.col("r"), F.col("sid"), 5, 0.03, 7)).collect()
    got = df.select(gumbel_sample(F.col("r"), F.col("sid"), 5, 0.03, 7, allow_fewer=True).alias("s")).first()
    assert len(got["s"]) == 3


def test_gumbel_first_draw_matches_softmax(spark):
    n = 20000
    rows = [(i, [(1, 0, 0.0), (2, 1, 1.0), (3, 2, 2.0)]) for i in range(n)]
    df = spark.createDataFrame(rows, "sid long, r array<struct<rank:int, block_id:long, score:double>>")
    first = df.select(gumbel_sample(F.col("r"), F.col("sid"), 1, 1.0, 7)[0]["block_id"].alias("b"))
    freq = {r["b"]: r["count"] / n for r in first.groupBy("b").count().collect()}
    z = sum(math.exp(x) for x in (0, 1, 2))
    for b, s in ((0, 0.0), (1, 1.0), (2, 2.0)):
        assert abs(freq.get(b, 0) - math.exp(s) / z) < 0.015


def test_unknown_id_lookup(spark):
    cache = spark.createDataFrame([("train", 1, [(1, 10, 0.5)])],
                                  "split string, sample_id long, retrievals array<struct<rank:int, block_id:long, score:double>>")
    req = spark.createDataFrame([("train", 1), ("train", 2)], "split string, sample_id long")
    out = {r["sample_id"]: r for r in cached_lookup(req, cache).collect()}
    assert out[1]["found"] and len(out[1]["retrievals"]) == 1
    assert not out[2]["found"] and out[2]["retrievals"] == []


def _vec_df(spark, rows, idc):
    return spark.createDataFrame(rows, f"{idc} long, embedding array<float>")


def test_mips_tie_smaller_id_first(spark):
    q = _vec_df(spark, [(1, [1.0, 0.0])], "qid")
    b = _vec_df(spark, [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.0]), (9, [1.0, 0.0])], "block_id")
    got = [r["block_id"] for r in mips_exact(q, b, 2, qid_col="qid").orderBy("rank").collect()]
    assert got == [3, 5]


def test_mips_paths_agree(spark):
    rng = np.random.default_rng(0)
    qv = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(40)]
    bv = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    q, b = _vec_df(spark, qv, "qid"), _vec_df(spark, bv, "block_id").repartition(4)
    brute = {}
    Q = np.array([v for _, v in qv], dtype=np.float64)
    Bm = np.array([v for _, v in bv], dtype=np.float64)
    S = Q @ Bm.T
    for i in range(len(qv)):
        order = sorted(range(len(bv)), key=lambda j: (-S[i, j], j))[:5]
        brute[i] = order
    for kw in ({}, {"broadcast_bytes": 10, "query_tile_rows": 16, "block_tile_rows": 64}):
        got = {}
        for r in mips_exact(q, b, 5, qid_col="qid", **kw).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["block_id"])
        assert got == brute, kw


def test_mips_small_block_side(spark):
    rng = np.random.default_rng(1)
    qv = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(50)]
    bv = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(6)]
    q, b = _vec_df(spark, qv, "qid"), _vec_df(spark, bv, "block_id")
    a = mips_exact(q, b, 3, qid_col="qid").orderBy("qid", "rank").collect()
    c = mips_exact(q, b, 3, qid_col="qid", broadcast_bytes=300).orderBy("qid", "rank").collect()
    assert [(r.qid, r.block_id) for r in a] == [(r.qid, r.block_id) for r in c]


def test_scan_matches_sequential_with_hot_key(spark):
    random.seed(3)
    rows = [("hot" if random.random() < 0.6 else f"k{random.randint(0, 5)}", i, random.random() * 10)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    for kind, kw in (("row_number", {}), ("sum", {}), ("ema", {"constant": 0.9}), ("lag", {}),
                     ("cadence", {"period": 25.0})):
        out = ordered_scan(df, "k", ["t"], kind, None if kind == "row_number" else ("t" if kind == "cadence" else "x"),
                           "o", n_parts=7, **kw)
        got = {(r["k"], r["t"]): r["o"] for r in out.collect()}
        state = {}
        for k, t, x in sorted(rows, key=lambda r: (r[0], r[1])):
            s = state.get(k)
            if kind == "row_number":
                v = 0 if s is None else s + 1
                state[k] = v
            elif kind == "sum":
                v = x + (s or 0.0)
                state[k] = v
            elif kind == "ema":
                v = x if s is None else 0.9 * s + 0.1 * x
                state[k] = v
            elif kind == "lag":
                v = s
                state[k] = x
            else:
                v = s is None or t >= s + 25.0
                if v:
                    state[k] = t
            g = got[(k, t)]
            if isinstance(v, float):
                assert abs(g - v) < 1e-9 * max(1, abs(v)), (kind, k, t)
            else:
                assert g == v, (kind, k, t)


def test_ema_fixture(spark):
    df = spark.createDataFrame([("train", 1, 10.0), ("train", 2, 20.0)], "split string, t long, x double")
    got = [r["ema"] for r in M.ema(df, "split", ["t"], "x", 0.9).orderBy("t").collect()]
    assert got[0] == 10.0 and abs(got[1] - 11.0) < 1e-12


def test_cadence_fixture(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [("run", i, base + dt.timedelta(minutes=m)) for i, m in enumerate([0, 10, 20, 25, 41])]
    df = spark.createDataFrame(rows, "run string, id long, ts timestamp_ntz")
    last = (base - dt.datetime(1970, 1, 1)).total_seconds()
    out = M.cadence_marks(df, "run", "ts", ["ts", "id"], 20 * 60.0, last_mark_s=last)
    assert sorted(r["id"] for r in out.where("marked").collect()) == [2, 4]


def test_fmt_duration(spark):
    df = spark.createDataFrame([(3661.5,), (0.0,), (400000.25,)], "s double")
    got = [r[0] for r in df.select(fmt_duration(F.col("s"))).collect()]
    assert got == ["01:01:01.500", "00:00:00.000", "111:06:40.250"]


def test_batches_and_replicas(spark):
    df = spark.createDataFrame([(s, i) for s in ("train", "test") for i in range(7)], "split string, sample_id long")
    b = B.make_batches(df, 3)
    n = {r["split"]: r["n"] for r in b.groupBy("split").agg(F.countDistinct("batch_no").alias("n")).collect()}
    assert n == {"train": 2, "test": 3}
    one = spark.createDataFrame([("train", i) for i in range(7)], "split string, sample_id long")
    r = B.replica_split(B.make_batches(one, 7), 3)
    shares = {x["replica"]: x["n"] for x in r.groupBy("replica").count().withColumnRenamed("count", "n").collect()}
    assert shares == {0: 2, 1: 2, 2: 2}


def test_schedule(spark):
    tr = spark.createDataFrame([(i,) for i in range(7)], "batch_no long")
    ev = spark.createDataFrame([(i,) for i in range(3)], "batch_no long")
    s = B.schedule_interleave(tr, ev, 5, 1).orderBy("round", F.desc("phase"), "slot").collect()
    assert [(r["round"], r["phase"]) for r in s] == [(0, "train")] * 5 + [(0, "eval")] + [(1, "train")] * 2 + [(1, "eval")]
    assert [r["batch_no"] for r in s if r["phase"] == "eval"] == [0, 1]


def test_ivf_salted_tiles_equal_exact(spark):
    from quarry.operators import ann as AN
    rng = np.random.default_rng(5)
    # one dominant cluster: most blocks land in the same leaf
    base = np.concatenate([rng.normal(size=(240, 8)) * 0.05 + 3.0, rng.normal(size=(60, 8))])
    bv = [(i, base[i].astype(np.float32).tolist()) for i in range(len(base))]
    qv = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(30)]
    b, q = _vec_df(spark, bv, "block_id"), _vec_df(spark, qv, "qid")
    cents, assigned = AN.ivf_train(b, 4)
    exact = {(r.qid, r.rank): r.block_id for r in mips_exact(q, b, 5, qid_col="qid").collect()}
    for kw in ({}, {"broadcast_bytes": 1}):   # broadcast query matrix / vectors carried per probe
        got = {(r.qid, r.rank): r.block_id
               for r in AN.ivf_probe(q, assigned, cents, 4, 5, max_tile_rows=25, **kw).collect()}
        assert got == exact, kw


def test_pq_rerank_full_depth_equals_exact(spark):
    from quarry.operators import ann as AN
    rng = np.random.default_rng(6)
    bv = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    qv = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(10)]
    b, q = _vec_df(spark, bv, "block_id"), _vec_df(spark, qv, "qid")
    cents, assigned = AN.ivf_train(b, 3)
    books = AN.pq_train(assigned, dims_per_block=4)
    coded = AN.pq_encode(assigned, books)
    approx = AN.ivf_probe(q, coded, cents, 3, 120, codebooks=books)
    assert approx.count() == 10 * 120
    re = AN.rerank_exact(approx, q, b, 5)
    exact = {(r.qid, r.rank): r.block_id for r in mips_exact(q, b, 5, qid_col="qid").collect()}
    assert {(r.qid, r.rank): r.block_id for r in re.collect()} == exact


def test_scan_null_key(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 5.0)], "k string, t long, x double")
    got = {(r["k"], r["t"]): r["o"] for r in ordered_scan(df, "k", ["t"], "sum", "x", "o", n_parts=2).collect()}
    assert got == {(None, 1): 1.0, (None, 2): 3.0, ("a", 1): 5.0}


def test_shortest_answer_in_row(spark):
    from quarry.sources.tables import shortest_answer
    df = spark.createDataFrame([(["abcd", " x", "yz"],)], "a array<string>")
    assert df.select(shortest_answer(F.col("a"))).first()[0] == "x"


def test_scan_carries_state_across_arrow_batches(spark):
    random.seed(4)
    rows = [("hot" if random.random() < 0.7 else "cold", i, random.random()) for i in range(2500)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {(r["k"], r["t"]): (r["o"], r["p"]) for r in
               ordered_scan(df, "k", ["t"], "ema", "x", "o", n_parts=3, constant=0.8, position="p").collect()}
        lag = {(r["k"], r["t"]): r["o"] for r in ordered_scan(df, "k", ["t"], "lag", "x", "o", n_parts=3).collect()}
        cad = {(r["k"], r["t"]): r["o"] for r in
               ordered_scan(df, "k", ["t"], "cadence", "t", "o", n_parts=3, period=7.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    state, pos, prev, last = {}, {}, {}, {}
    for k, t, x in sorted(rows, key=lambda r: (r[0], r[1])):
        v = x if k not in state else 0.8 * state[k] + 0.2 * x
        state[k] = v
        p = pos.get(k, -1) + 1
        pos[k] = p
        assert abs(got[(k, t)][0] - v) < 1e-9 and got[(k, t)][1] == p
        assert lag[(k, t)] == prev.get(k)
        prev[k] = x
        mark = k not in last or t >= last[k] + 7.0
        if mark:
            last[k] = t
        assert cad[(k, t)] == mark


def test_mips_tiled_with_empty_tiles(spark):
    q = _vec_df(spark, [(i, [float(i), 1.0]) for i in range(5)], "qid")
    b = _vec_df(spark, [(7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [1.0, 1.0])], "block_id")
    a = {(r.qid, r.rank): r.block_id for r in mips_exact(q, b, 2, qid_col="qid").collect()}
    t = {(r.qid, r.rank): r.block_id for r in mips_exact(q, b, 2, qid_col="qid", broadcast_bytes=1,
                                                           query_tile_rows=2, block_tile_rows=1).collect()}
    assert a == t and len(a) == 10


def test_hash_sample_threshold_path_equals_top_n(spark):
    from quarry.operators import sampling as SM
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    from pyspark.sql import functions as F
    from quarry.functions.keyed import hash32
    top = df.orderBy(hash32(F.lit(7), F.col("k")), "k").limit(1234)
    assert {r["k"] for r in SM.hash_sample(df, "k", 1234, 7).collect()} == {r["k"] for r in top.collect()}
