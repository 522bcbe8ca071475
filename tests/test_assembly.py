"""Hand-written assembly cases (context 16, reserve 4, Q=1, C=2, A=3, eos=0)."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import assembly as A
from quarry.operators.stats import sample_violations

CTX, GEN = 16, 4
SP = {"question": 1, "context": 2, "answer": 3, "eos": 0}
M = -100


def run(spark, q, ctxs, ans, split="train", **kw):
    df = spark.createDataFrame([(split, q, ctxs, ans)],
                               "split string, q array<int>, c array<array<int>>, a array<int>")
    approach = kw.pop("approach", "cached_pretok")
    gen = kw.pop("max_generation_length", GEN)
    raw = A.assemble(F.col("q"), F.col("a"), F.col("split") == "test",
                     contexts=F.col("c") if approach == "cached_pretok" else None, approach=approach,
                     context_size=CTX, max_generation_length=gen, specials=SP, **kw)
    fin = A.finalize_sample(raw, CTX, SP["eos"])
    r = df.select("split", fin["input_ids"].alias("i"), fin["label_ids"].alias("l")).first()
    return r["i"], r["l"]


def test_plain(spark):
    i, l = run(spark, [10, 11], [[20, 21], [22]], [30, 31])
    assert i == [1, 10, 11, 2, 20, 21, 2, 22, 3, 30, 31] + [0] * 5
    assert l == [M] * 9 + [30, 31, 0] + [M] * 4


def test_mode_once(spark):
    i, _ = run(spark, [10, 11], [[20, 21], [22]], [30, 31], helper_mode="once")
    assert i == [1, 10, 11, 2, 20, 21, 22, 3, 30, 31] + [0] * 6


def test_budget_cut(spark):
    i, _ = run(spark, [10, 11], [list(range(100, 120)), list(range(200, 220))], [30])
    # limit = 16 - (3 + 4 + 1) = 8 context positions, helper id included
    assert i[:3] == [1, 10, 11]
    assert i[3:11] == [2] + list(range(100, 107))
    assert i[11:13] == [3, 30]


def test_negative_budget_is_flagged(spark):
    q = list(range(10, 24))  # 14 tokens: question part alone is 15 with its helper
    i, l = run(spark, q, [[20, 21]], [30, 31])
    assert 2 not in i and len(i) == 16 and len(l) == 16
    assert all(x == M for x in l)
    df = spark.createDataFrame([("train", i, l)], "split string, input_ids array<int>, label_ids array<int>")
    v = sample_violations(df, 0).first()
    assert v["n_all_masked"] == 1


def test_exact_fit_loses_label_eos(spark):
    # input: Q + 4 question + C + 4 ctx + A + 5 answer = 16
    i, l = run(spark, [10, 11, 12, 13], [[20, 21, 22, 23]], [30, 31, 32, 33, 34], max_generation_length=1)
    assert len(i) == 16 and 0 not in i
    assert l[-5:] == [30, 31, 32, 33, 34]


def test_test_split(spark):
    i, l = run(spark, [10, 11], [[20]], None, split="test")
    assert l is None
    assert i == [1, 10, 11, 2, 20, 3] + [0] * 10


def test_naked(spark):
    i, l = run(spark, [10, 11], None, [30, 31], approach="naked_lm")
    assert i == [1, 10, 11, 3, 30, 31] + [0] * 10
    assert l == [M] * 4 + [30, 31, 0] + [M] * 9


def test_helpers_off(spark):
    i, l = run(spark, [10, 11], [list(range(100, 120))], [30], use_helper_words=False)
    # limit = 16 - (2 + 4 + 0) = 10
    assert i == [10, 11] + list(range(100, 110)) + [30] + [0] * 3
    assert l == [M] * 12 + [30, 0] + [M] * 2


def test_prompt_extract(spark):
    i, l = run(spark, [10, 11], [[20]], [30])
    df = spark.createDataFrame([("train", i, l), ("test", i, None)],
                               "split string, input_ids array<int>, label_ids array<int>")
    rows = df.select(A.prompt_extract(F.col("input_ids"), F.col("label_ids"), F.col("split") == "test", 0)
                     .alias("p")).collect()
    assert rows[0]["p"] == [1, 10, 11, 2, 20, 3]
    assert rows[1]["p"] == [1, 10, 11, 2, 20, 3, 30]


def test_invalid_mode():
    with pytest.raises(ValueError):
        A.concat_contexts(F.col("x"), F.col("y"), "twice")


def test_observed_and_strict_checks(spark):
    from quarry.operators.stats import observe_sample_checks, strict_sample_checks
    q = list(range(10, 24))
    i, l = run(spark, q, [[20, 21]], [30, 31])          # negative budget: all labels masked
    ok_i, ok_l = run(spark, [10, 11], [[20]], [30])
    df = spark.createDataFrame([("train", 1, i, l), ("train", 2, ok_i, ok_l)],
                               "split string, sample_id long, input_ids array<int>, label_ids array<int>")
    observed, obs = observe_sample_checks(df, 0)
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get["n"] == 2 and obs.get["n_all_masked"] == 1
    with pytest.raises(Exception):
        strict_sample_checks(df, 0).collect()
    assert strict_sample_checks(df.where("sample_id = 2"), 0).count() == 1
