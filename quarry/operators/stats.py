"""Length studies and data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.params import CONTEXT_SIZE, MASK_ID, MAX_NUM_RETRIEVALS_STUDY, RAGGED_PAD_ID


def length_hist(lengths: DataFrame, col: str = "len") -> DataFrame:
    """``len, cnt``: samples per length (partial + final aggregation)."""
    return lengths.groupBy(F.col(col).alias("len")).agg(F.count(F.lit(1)).alias("cnt"))


def cum_fraction(hist: DataFrame) -> DataFrame:
    """Running share of samples by length, computed on the histogram only.

    The histogram has one row per distinct length (bounded by the longest
    sample), so the ordered window here never sees raw rows.
    """
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("cnt").over(Window.partitionBy(F.lit(1)))
    return hist.select("len", "cnt", (F.sum("cnt").over(w) / total).alias("cum_frac"))


def length_cutoffs(lengths: DataFrame, fractions, col: str = "len") -> DataFrame:
    """``fraction, cutoff``: the smallest length covering each fraction of samples.

    ``percentile_disc`` keeps a value -> count map (bounded by distinct lengths)
    and aggregates partially on the map side.
    """
    aggs = [F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {col})").alias(f"c{i}")
            for i, f in enumerate(fractions)]
    one = lengths.agg(*aggs)
    stack = ", ".join(f"CAST({f} AS DOUBLE), c{i}" for i, f in enumerate(fractions))
    return one.selectExpr(f"stack({len(fractions)}, {stack}) AS (fraction, cutoff)").select(
        "fraction", F.col("cutoff").cast("long").alias("cutoff"))


def retrieval_budget(cutoffs: DataFrame, context_size: int = CONTEXT_SIZE,
                     max_retrievals: int = MAX_NUM_RETRIEVALS_STUDY) -> DataFrame:
    """For each cutoff and i in 1..max: ``(context_size - cutoff) / i`` rounded half-even."""
    ex = (cutoffs.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(max_retrievals))))
                 .withColumn("i", F.col("i").cast("long")))
    return ex.withColumn("budget", F.bround((F.lit(context_size) - F.col("cutoff")) / F.col("i"), 0)
                         .cast("long"))


def unique_check(df: DataFrame, cols, name: str) -> DataFrame:
    """``table, n, n_distinct, ok`` -- row count equals distinct count of ``cols``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*[F.col(c) for c in cols]).alias("n_distinct"))
    return n.select(F.lit(name).alias("table"), "n", "n_distinct", (F.col("n") == F.col("n_distinct")).alias("ok"))


def count_records(tables: dict, expected: dict | None = None) -> DataFrame:
    """``table, n_rows, expected, ok``: records per table against a suspected total, where one is given."""
    out = None
    for name, df in tables.items():
        want = F.lit((expected or {}).get(name)).cast("long")
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", want.alias("expected"), (F.col("n_rows") == want).alias("ok"))
        out = c if out is None else out.unionByName(c)
    return out


def cardinality_check(df: DataFrame, expected: dict, key: str = "split") -> DataFrame:
    """``split, n, expected, ok`` against an expectation table given as an argument."""
    spark = df.sparkSession
    exp = spark.createDataFrame([(k, int(v)) for k, v in expected.items()], f"{key} string, expected long")
    got = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (got.join(F.broadcast(exp), key, "full")
               .select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "expected",
                       (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("ok")))


def sample_violations(samples: DataFrame, eos: int) -> DataFrame:
    """Per split: counts of rows breaking each finished-sample invariant."""
    checks = _violation_exprs(eos)
    checks["n_all_negative"] = F.forall(F.col("input_ids"), lambda x: x < 0)
    return samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(e).alias(k) for k, e in checks.items()])


def retrieval_count_violations(cache: DataFrame, k: int) -> Column:
    return F.count_if(F.size(F.col("retrievals")) != k)


def cache_violations(cache, k: int):
    """Per split: cache rows breaking the cache invariants (k neighbours per row,
    non-empty question, an answer on every non-test row, no -1 padding left)."""
    r, q, a = F.col("retrievals"), F.col("question_ids"), F.col("answer_ids")
    return cache.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size(r) != k).alias("n_wrong_k"),
        F.count_if(F.size(q) == 0).alias("n_empty_question"),
        F.count_if((F.col("split") != "test") & (a.isNull() | (F.size(a) == 0))).alias("n_missing_answer"),
        F.count_if(F.exists(q, lambda x: x == RAGGED_PAD_ID)
                   | F.coalesce(F.exists(a, lambda x: x == RAGGED_PAD_ID), F.lit(False))).alias("n_pad_left"))


def _violation_exprs(eos: int):
    i, lab = F.col("input_ids"), F.col("label_ids")
    return {
        "n_pad_input": F.exists(i, lambda x: x == RAGGED_PAD_ID),
        "n_pad_label": F.coalesce(F.exists(lab, lambda x: x == RAGGED_PAD_ID), F.lit(False)),
        "n_all_masked": lab.isNotNull() & F.forall(lab, lambda x: x == MASK_ID),
        "n_empty_input": (F.size(i) == 0) | F.forall(i, lambda x: x == eos),
    }


def observe_sample_checks(samples, eos: int):
    """Attach the sample invariants as in-flight metrics (``DataFrame.observe``):
    counted while the samples are written, no extra pass. Returns
    ``(observed_df, observation)``; read ``observation.get`` after the action."""
    from pyspark.sql import Observation
    obs = Observation("sample_checks")
    metrics = [F.count(F.lit(1)).alias("n")] + [F.count_if(e).alias(k) for k, e in _violation_exprs(eos).items()]
    return samples.observe(obs, *metrics), obs


def strict_sample_checks(samples, eos: int):
    """Fail the job at the first sample breaking an invariant (debug-check mode)."""
    bad = None
    for k, e in _violation_exprs(eos).items():
        cond = F.when(e, F.lit(k))
        bad = cond if bad is None else F.coalesce(bad, cond)
    return samples.withColumn("input_ids", F.when(bad.isNull(), F.col("input_ids")).otherwise(
        F.raise_error(F.concat(F.lit("sample check failed: "), bad, F.lit(" in sample "),
                               F.col("sample_id").cast("string")))))
