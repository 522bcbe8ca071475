"""Batching, epochs, replica shares and the train / eval schedule.

Row positions come from ``ordered_scan(kind='row_number')`` -- a range-
partitioned scan -- never from a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.keyed import shuffle_key
from quarry.operators.scan import ordered_scan
from quarry.params import BATCHES_BETWEEN_EVALS, NUMBER_EVAL_BATCHES, SEED


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """Finite repeat: every row once per epoch (bounded fan-out ``epochs``)."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def shuffled_positions(df: DataFrame, id_col: str = "sample_id", key_cols=("split",),
                       seed: int = SEED, epoch_col: str | None = None) -> DataFrame:
    """Add ``pos``: 0-based position per key in a seeded (per-epoch) shuffle order."""
    keys = list(key_cols) + ([epoch_col] if epoch_col else [])
    ep = F.col(epoch_col) if epoch_col else F.lit(0)
    keyed = df.withColumn("_shuffle_key", shuffle_key(seed, ep, F.col(id_col)))
    out = ordered_scan(keyed, keys, ["_shuffle_key", id_col], "row_number", out="pos")
    return out.drop("_shuffle_key")


def make_batches(df: DataFrame, batch_size: int, id_col: str = "sample_id", key_cols=("split",),
                 seed: int = SEED, epoch_col: str | None = None,
                 keep_remainder_splits=("test",)) -> DataFrame:
    """Add ``batch_no``, ``pos_in_batch`` and ``batch_rows``; the partial last batch
    is dropped except for splits in ``keep_remainder_splits``."""
    keys = list(key_cols) + ([epoch_col] if epoch_col else [])
    pos = shuffled_positions(df, id_col, key_cols, seed, epoch_col)
    totals = pos.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = pos.join(F.broadcast(totals), keys)  # one row per key: bounded
    full = F.floor(F.col("_n") / batch_size)
    batch_no = F.floor(F.col("pos") / batch_size)
    keep = F.col("split").isin(*keep_remainder_splits) if keep_remainder_splits else F.lit(False)
    out = out.withColumn("batch_no", batch_no.cast("long")).where(keep | (F.col("batch_no") < full))
    rows = F.when(F.col("batch_no") < full, F.lit(batch_size)).otherwise(F.col("_n") - full * batch_size)
    return (out.withColumn("pos_in_batch", (F.col("pos") % batch_size).cast("long"))
               .withColumn("batch_rows", rows.cast("long")).drop("_n"))


def replica_split(batched: DataFrame, replicas: int, keep_remainder: bool = False) -> DataFrame:
    """Contiguous share per replica: ``quanta = batch_rows div R``; row goes to
    ``pos_in_batch div quanta``; rows past ``R * quanta`` are dropped unless kept."""
    quanta = F.floor(F.col("batch_rows") / replicas)
    rep = F.when(quanta > 0, F.floor(F.col("pos_in_batch") / quanta)).otherwise(F.lit(replicas))
    out = batched.withColumn("replica", rep.cast("long"))
    return out if keep_remainder else out.where(F.col("replica") < replicas)


def take_batches(batched: DataFrame, n: int) -> DataFrame:
    return batched.where(F.col("batch_no") < n)


def schedule_interleave(train_batches: DataFrame, eval_batches: DataFrame,
                        n: int = BATCHES_BETWEEN_EVALS, m: int = NUMBER_EVAL_BATCHES) -> DataFrame:
    """``round, phase, slot, batch_no``: n train batches then m eval batches per round.

    Train batch b runs in round ``b div n``; each round that ran any training
    is followed by eval batches ``(r*m + j) mod E`` (the eval set cycles).
    Inputs hold one row per batch (``batch_no``).
    """
    tr = train_batches.select("batch_no").distinct()
    n_eval = eval_batches.select("batch_no").distinct().count()  # row total: bounded metadata
    train = tr.select(F.floor(F.col("batch_no") / n).cast("long").alias("round"), F.lit("train").alias("phase"),
                      (F.col("batch_no") % n).cast("long").alias("slot"), F.col("batch_no").cast("long"))
    rounds = train.select("round").distinct()
    if n_eval == 0 or m == 0:
        return train
    ev = (rounds.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
          .withColumn("slot", F.col("slot").cast("long"))
          .select("round", F.lit("eval").alias("phase"), "slot",
                  ((F.col("round") * m + F.col("slot")) % F.lit(n_eval)).cast("long").alias("batch_no")))
    return train.unionByName(ev)
