import zlib

import numpy as np
import pyarrow as pa

from quarry.llm import language_id as L


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in L.start(3, 4).items()}
    x, y = rng.integers(0, 4, (3, 6)), np.array([0, 2, 1])
    loss, grad = L.gradients(p, x, y)
    for k in p:
        for _ in range(8):
            at = tuple(rng.integers(0, d) for d in p[k].shape)
            if k.startswith("in_"):
                at = (at[0], rng.integers(0, 4), at[2])
            moved = dict(p)
            moved[k] = p[k].copy()
            moved[k][at] += 1e-6
            assert abs((L.gradients(moved, x, y)[0] - loss) / 1e-6 - grad[k][at]) < 1e-4


def naive(p, text):
    """Position by position, window by window, without lanes."""
    raw, total = np.frombuffer(text.encode(), np.uint8), np.zeros(len(p["bias"]))
    n = p["rec_f"].shape[1]
    for c in range(0, len(raw), L.WINDOW):
        part = raw[c:c + L.WINDOW]
        states = {}
        for d, way in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            h = np.zeros((1, n))
            for t in way:
                h, _ = L.cell(p[f"in_{d}"], p[f"rec_{d}"], part[t:t + 1], h)
                states[d, t] = h
        for t in range(len(part)):
            e = np.exp(np.concatenate([states["f", t], states["b", t]], 1) @ p["out"] + p["bias"])[0]
            total += e / e.sum()
    return total / max(len(raw), 1)


def test_lanes_against_positions(monkeypatch):
    monkeypatch.setattr(L, "LANES", 3)
    p = L.start(3, 5)
    texts = ["", "a", "é" * 200, "some text " * 30, "x" * 128, "y" * 129]
    assert np.allclose(L.probabilities(p, pa.array(texts)), [naive(p, t) for t in texts], atol=1e-4)


def rows_of(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def test_held_out_accuracy(spark):
    from quarry.llm.queries import QUERIES
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in rows_of(spark, d).collect()}
    got = QUERIES["op3_language_id"](spark, d).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    test = [r for r in got if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert len(test) > 200 and np.mean([docs[r.doc_id].lang == r.lang_pred for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_are_not_learnt(spark):
    """A network fitted on rows whose held-out languages were changed is the same network."""
    from pyspark.sql import functions as F
    docs = rows_of(spark, "/root/testdata/sf0.001")
    changed = docs.withColumn("lang", F.when(L.held_out(), "xx").otherwise(F.col("lang")))
    a, b = (L.fit(x.where(~L.held_out()), steps=3) for x in (docs, changed))
    assert a["languages"] == b["languages"] and "xx" not in b["languages"]
    assert all((a[k] == b[k]).all() for k in a if k != "languages")


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, score double, held_out int"
    rows = [(i, "the cat and the dog " * 5 if i % 2 else "der hund und die katze " * 5, "en" if i % 2 else "de", None, 1.0, 1) for i in range(60)]
    odd = [(100, None, "en", None, None, None), (101, "", None, None, None, None), (102, "123 !?", None, None, None, None),
           (None, "the dog", None, None, None, None), (None, "the dog", "fr", None, None, None), (103, "der hund " * 100_000, None, None, None, None)]
    got = L.identify(spark.createDataFrame(rows + odd, schema)).collect()
    assert len(got) == 66
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0.0
    assert by[103].lang_pred == "de" and by[1].lang_pred == "en"
    assert {(r.held_out, r.lang_pred) for r in got if r.doc_id is None} == {(False, by[1].lang_pred)}
    none = L.identify(spark.createDataFrame([(1, "text", None, None, None, None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert L.identify(spark.createDataFrame([], schema)).collect() == []
