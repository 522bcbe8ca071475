"""Training-metric tables: loss means, perplexity, moving averages, counters,
batch durations and the checkpoint cadence -- batch versions.

All per-key running quantities go through ``ordered_scan`` (range-partitioned,
no single-task window). Streaming twins live in ``quarry.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.scan import ordered_scan
from quarry.params import EMA_CONSTANT

EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (no time-zone shift)."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(EPOCH_NTZ)), ts.cast("timestamp_ntz"))


def loss_mean(log: DataFrame, step: Column, replica: Column, loss: str = "loss") -> DataFrame:
    """Mean over sub-batches per replica, then mean of the replica means (not pooled)."""
    per_rep = (log.select("split", step.alias("step"), replica.alias("replica"), F.col(loss))
                  .groupBy("split", "step", "replica").agg(F.avg(loss).alias("_m")))
    return per_rep.groupBy("split", "step").agg(F.avg("_m").alias("loss"),
                                               F.count(F.lit(1)).alias("n_replicas"))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def numeric_check(df: DataFrame, col: str, key: str = "split") -> DataFrame:
    """Count NaN / infinite values per key (the run fails on any in strict use)."""
    x = F.col(col)
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return df.groupBy(key).agg(F.count_if(bad).alias("n_bad"), F.count(F.lit(1)).alias("n"))


def assert_numeric(df: DataFrame, col: str) -> DataFrame:
    """Strict form: the job fails at the first NaN / infinite value."""
    x = F.col(col)
    return df.withColumn(col, F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(
        F.concat(F.lit(f"non-finite {col}: "), x.cast("string")))).otherwise(x))


def ema(df: DataFrame, key, order, value: str, constant: float = EMA_CONSTANT,
        seed_value: float | None = None, out: str = "ema", seeds: DataFrame | None = None) -> DataFrame:
    """Running ``avg = c*avg + (1-c)*x`` per key in order; the first value initialises
    unless ``seed_value`` is given (settable average) or ``seeds`` has one for the key."""
    return ordered_scan(df, key, order, "ema", value, out, constant=constant, seed_value=seed_value, seeds=seeds)


def step_counters(df: DataFrame, key, order, batch_size: str) -> DataFrame:
    """``batches`` (1-based running count) and ``samples`` (running sum of batch sizes)."""
    s = ordered_scan(df, key, order, "sum", batch_size, out="_samples", position="_rn")  # one pass
    return (s.withColumn("batches", (F.col("_rn") + 1).cast("long"))
             .withColumn("samples", F.coalesce(F.col("_samples"), F.lit(0)).cast("long")).drop("_rn", "_samples"))


def batch_duration(df: DataFrame, ts: str, order, key: str | None = None) -> DataFrame:
    """Seconds since the previous row of the same run (one clock for all splits)."""
    keyed = df.withColumn("_run", F.col(key) if key else F.lit(0)).withColumn(
        "_us", epoch_micros(F.col(ts)))
    out = ordered_scan(keyed, "_run", order, "lag", "_us", "_prev_us")
    return out.withColumn("duration_s", (F.col("_us") - F.col("_prev_us")) / F.lit(1e6)).drop(
        "_run", "_us", "_prev_us")


def cadence_marks(df: DataFrame, key, ts: str, order, period_s: float,
                  last_mark_s: float | None = None, out: str = "marked", seeds: DataFrame | None = None) -> DataFrame:
    """True where at least ``period_s`` passed since the last *marked* row of the key.
    With no ``last_mark_s`` the first row is marked."""
    keyed = df.withColumn("_t", epoch_micros(F.col(ts)).cast("double") / F.lit(1e6))
    return ordered_scan(keyed, key, order, "cadence", "_t", out, period=period_s,
                        seed_value=last_mark_s, seeds=seeds).drop("_t")
