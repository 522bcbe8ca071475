"""Structured Streaming twins of the metric scans.

The metrics log arrives as files, in any order. Every micro-batch (``foreachBatch``) is folded with the same
range-partitioned ``ordered_scan`` as the batch version, started from each key's state, so a key with
most of the rows still spreads over many tasks. Between batches three small or bounded tables are kept:

* ``state``: per key its average or last mark, and the last (time, id) that was folded;
* ``buffer``: rows that are not yet older than the newest time seen by ``delay``; they wait for rows
  that belong before them;
* ``late``: rows that arrived after their place had been folded. They can't be folded any more, so they are
  written out, never dropped silently.

When a bounded input ends, the buffer is flushed, so every row is either folded or in the late table. All tables
of a batch are written under its number in the shared checkpoint folder and read by the next one: a batch that
runs again after a failure starts from the same tables and overwrites its own.

Counters are a plain streaming aggregation. Per-step loss means are windowed per replica under a
watermark in update mode; each batch writes the means that changed, and the newest one of a window counts, so steps that
are still open at the end of the input are part of the result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.metrics import epoch_micros
from quarry.operators.scan import ordered_scan
from quarry.params import EMA_CONSTANT
from quarry.session import scratch_path

STATE = "split string, seed double, done_us long, done_id long, seen long"


def _source(spark: SparkSession, source_dir: str, schema: T.StructType, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)


class _Fold:
    """Micro-batches ``(split, event_id, _us, x)`` folded by ``scan(ready, seeds) -> (split, event_id, _us, o, seed)``."""

    def __init__(self, spark: SparkSession, name: str, scan, delay_us: int, late_path: str | None):
        self.spark, self.scan, self.delay_us = spark, scan, delay_us
        self.base = scratch_path(spark, name)
        self.late = late_path or f"{self.base}/late"
        self.last = -1
        self.row_schema = T.StructType([T.StructField("split", T.StringType()), T.StructField("event_id", T.LongType()),
                                        T.StructField("_us", T.LongType()), T.StructField("x", T.DoubleType())])

    def _read(self, table: str, n: int, schema) -> DataFrame:
        if n < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{table}/{n}")

    def _written(self, df: DataFrame, table: str, n: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{table}/{n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{table}/{n}")

    def batch(self, rows: DataFrame, n: int, flush: bool = False):
        state = self._read("state", n - 1, STATE)
        known = state.select(F.col("split").alias("_s"), "done_us", "done_id")
        rows = self._written(rows.select("split", "event_id", "_us", "x"), "in", n)
        rows = rows.join(known, rows["split"].eqNullSafe(F.col("_s")), "left")
        old = F.coalesce((F.col("_us") < F.col("done_us")) | ((F.col("_us") == F.col("done_us")) & (F.col("event_id") <= F.col("done_id"))),
                         F.lit(False))
        names = ["split", "event_id", "_us", "x"]
        rows.where(old).select(*names).write.mode("overwrite").parquet(f"{self.late}/batch={n}")
        waiting = rows.where(~old).select(*names).unionByName(self._read("buffer", n - 1, self.row_schema))
        seen = waiting.agg(F.max("_us")).first()[0]
        before = state.agg(F.max("seen")).first()[0]
        seen = max((x for x in (seen, before) if x is not None), default=None)
        ripe = F.lit(True) if flush or seen is None else F.coalesce(F.col("_us") <= F.lit(seen - self.delay_us), F.lit(True))
        self._written(waiting.where(~ripe), "buffer", n)
        out = self._written(self.scan(waiting.where(ripe), state.select("split", "seed")), "out", n)
        place = F.struct("_us", "event_id")
        ends = out.groupBy(F.col("split").alias("_k")).agg(F.max(place).alias("_end"), F.max_by("seed", place).alias("_seed"), F.count("*").alias("_n"))
        joined = state.join(ends, state["split"].eqNullSafe(F.col("_k")), "full")
        fresh = F.col("_n").isNotNull()
        after = joined.select(F.when(fresh, F.col("_k")).otherwise(F.col("split")).alias("split"), F.coalesce("_seed", "seed").alias("seed"),
                              F.coalesce("_end._us", "done_us").alias("done_us"), F.coalesce("_end.event_id", "done_id").alias("done_id"),
                              F.lit(seen).cast("long").alias("seen"))
        self._written(after, "state", n)
        self.last = n

    def run(self, rows: DataFrame) -> DataFrame:
        """Runs the stream to the end of its input, flushes, and returns the folded rows."""
        q = (rows.writeStream.foreachBatch(lambda df, n: self.batch(df, n))
             .option("checkpointLocation", f"{self.base}/checkpoint").start())
        q.processAllAvailable()
        q.stop()
        self.batch(self.spark.createDataFrame([], self.row_schema), self.last + 1, flush=True)
        parts = [f"{self.base}/out/{n}" for n in range(self.last + 1)]
        return self.spark.read.schema(self.spark.read.parquet(parts[-1]).schema).parquet(*parts)


def _micros(delay: str) -> int:
    n, unit = delay.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def ema_stream(spark: SparkSession, source_dir: str, schema: T.StructType, *, constant: float = EMA_CONSTANT,
               delay: str = "0 seconds", files_per_trigger: int = 1, key: str = "event_type", value: str = "value",
               late_path: str | None = None) -> DataFrame:
    """Streaming EMA per split in event-time order: ``split, event_id, ema``. Rows up to ``delay`` out of
    order are folded in their place; later ones go to ``late_path`` (``batch=n`` folders)."""
    rows = _source(spark, source_dir, schema, files_per_trigger).select(
        F.col(key).alias("split"), "event_id", epoch_micros(F.col("ts")).alias("_us"), F.col(value).cast("double").alias("x"))

    def scan(ready, seeds):
        out = ordered_scan(ready, "split", ["_us", "event_id"], "ema", "x", "o", constant=constant, seeds=seeds)
        return out.select("split", "event_id", "_us", "o", F.col("o").alias("seed"))
    out = _Fold(spark, "ema-stream", scan, _micros(delay), late_path).run(rows)
    return out.select("split", "event_id", F.col("o").alias("ema"))


def ema_stream_event_time(spark: SparkSession, source_dir: str, schema: T.StructType, *, delay: str = "2 hours",
                          **kw) -> DataFrame:
    """``ema_stream`` for files that arrive out of order by up to ``delay``."""
    return ema_stream(spark, source_dir, schema, delay=delay, **kw)


def cadence_stream(spark: SparkSession, source_dir: str, schema: T.StructType, period_s: float, *,
                   delay: str = "0 seconds", files_per_trigger: int = 1, key: str = "event_type",
                   late_path: str | None = None) -> DataFrame:
    """Streaming cadence marks (``split, event_id`` of marked rows); the first row of a key is marked."""
    rows = _source(spark, source_dir, schema, files_per_trigger).select(
        F.col(key).alias("split"), "event_id", epoch_micros(F.col("ts")).alias("_us"))
    rows = rows.withColumn("x", F.col("_us").cast("double") / F.lit(1e6))

    def scan(ready, seeds):
        out = ordered_scan(ready, "split", ["_us", "event_id"], "cadence", "x", "o", period=float(period_s), seeds=seeds)
        # max_by skips rows without a mark: the newest marked time is the key's state
        return out.select("split", "event_id", "_us", "o", F.when(F.col("o"), F.col("x")).alias("seed"))
    fold = _Fold(spark, "cadence-stream", _last_known(scan), _micros(delay), late_path)
    return fold.run(rows).where("o").select("split", "event_id")


def _last_known(scan):
    """A scan whose ``seed`` is the key's largest one on every row (marked times only grow)."""
    def run(ready, seeds):
        out = scan(ready, seeds)
        last = out.groupBy(F.col("split").alias("_g")).agg(F.max("seed").alias("_m"))
        return out.join(last, out["split"].eqNullSafe(F.col("_g")), "left").withColumn("seed", F.col("_m")).drop("_g", "_m")
    return run


def counters_stream(spark: SparkSession, source_dir: str, schema: T.StructType, *,
                    files_per_trigger: int = 1, key: str = "event_type") -> DataFrame:
    """Running counters per split (``split, batches, samples``), complete mode; each
    micro-batch's full result replaces the previous one in the sink folder."""
    src = _source(spark, source_dir, schema, files_per_trigger)
    agg = (src.select(F.col(key).alias("split"),
                      F.get_json_object("props", "$.k").cast("long").alias("batch_size"))
              .groupBy("split").agg(F.count(F.lit(1)).alias("batches"), F.sum("batch_size").alias("samples")))
    out_path = scratch_path(spark, "counters-out")

    def write(batch_df, epoch_id):
        batch_df.write.mode("overwrite").parquet(out_path)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", scratch_path(spark, "counters-ckpt")).start())
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out_path)


def loss_mean_stream(spark: SparkSession, source_dir: str, schema: T.StructType, *, step: str = "1 hour",
                     delay: str = "2 hours", replicas: int = 8, files_per_trigger: int = 1,
                     key: str = "event_type", value: str = "value") -> DataFrame:
    """Event-time version of ``loss_mean``: per (step window, split, replica) mean,
    then the mean of the replica means per (step window, split).

    The windows' state is bounded by the watermark (``delay``); a batch emits the windows it changed, and the newest
    mean of each is taken when the output is read. Output: ``split, step (hours since epoch), loss, n_replicas``.
    """
    src = _source(spark, source_dir, schema, files_per_trigger).withColumn(
        "_et", F.timestamp_micros(epoch_micros(F.col("ts"))))  # the same epoch value as the zone-less column
    per_rep = (src.withWatermark("_et", delay)
                  .groupBy(F.window("_et", step).alias("w"), F.col(key).alias("split"),
                           F.pmod(F.col("user_id"), F.lit(replicas)).alias("replica"))
                  .agg(F.avg(value).alias("m")))
    per_rep = per_rep.select("split", "replica", F.floor(F.unix_micros(F.col("w.start")) / F.lit(3600000000)).cast("long").alias("step"), "m")
    out_path = scratch_path(spark, "loss-mean-out")

    def write(batch_df, n):
        batch_df.write.mode("overwrite").parquet(f"{out_path}/batch={n}")

    q = (per_rep.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", scratch_path(spark, "loss-mean-ckpt")).start())
    q.processAllAvailable()
    q.stop()
    last = (spark.read.parquet(out_path).groupBy("split", "step", "replica")
            .agg(F.max_by(F.struct("m"), "batch").alias("m")))
    return last.groupBy("split", "step").agg(F.avg("m.m").alias("loss"), F.count(F.lit(1)).alias("n_replicas"))


def events_schema(spark: SparkSession, sf_dir: str) -> T.StructType:
    return spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
