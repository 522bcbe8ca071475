"""Moving average in Spark's keyed state, by event time.

``foreachBatch`` folds of ``metrics_stream`` keep waiting rows in tables; here they wait in the engine's own state.
A key is cut into *slices* of event time, ``(key, floor(time / slice))``, each a group of its own: a key with most of
the rows is spread over its slices, and a group holds the rows of one slice until the watermark has passed its end
(event-time timeout). Then the slice's rows come out in order with their affine map ``x -> a x + b`` from the average
at the slice's start, and its state is removed. Slices close in order of time, so a micro-batch composes the maps of
the slices that it closed (one row a slice) with the key's average so far (one row a key, written under the
batch's number: a batch that runs again overwrites its own).

* Rows up to ``delay`` out of order, over any number of files, are folded in their place; ties by ``event_id``.
* Rows behind the watermark can't be folded any more. They are counted and, unless ``allow_late``, the run fails.
* A row without a time has no place: it comes out at once with a null average and changes nothing. A null value
  shows the average so far and changes nothing. A null key is a key like any other. No rows: no rows.
* When a bounded input has ended, a closing row far in the future (in a folder of the stream's own) lets every slice close.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.metrics import epoch_micros
from quarry.operators.scan import _affine_prefix
from quarry.params import EMA_CONSTANT
from quarry.session import scratch_path, ship_package
from quarry.streaming.metrics_stream import _micros, _source

CLOSING_US = 250_000_000_000_000_000    # a time in the year 9892: the closing row's
WAITING = np.dtype([("id", "i8"), ("us", "i8"), ("x", "f8"), ("known", "?")])
MAPS = "split string, slice long, event_id long, us long, a double, b double, first double"
CARRY = "split string, carry double"


def slice_maps(rows: np.ndarray, constant: float):
    """``rows`` of a slice in order with, after each, the map ``a, b`` since the slice's start and its first known value."""
    rows = rows[np.lexsort((rows["id"], rows["us"]))]
    a, b, first = np.ones(len(rows)), np.zeros(len(rows)), np.full(len(rows), np.nan)
    at = np.flatnonzero(rows["known"])
    if len(at):
        A, B = _affine_prefix(np.full(len(at), constant), (1 - constant) * rows["x"][at])
        last = np.searchsorted(at, np.arange(len(rows)), side="right") - 1
        seen = last >= 0
        a[seen], b[seen], first[seen] = A[last[seen]], B[last[seen]], rows["x"][at[0]]
    return rows, a, b, first


def _as_rows(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros(len(pdf), WAITING)
    out["id"], out["us"] = pdf["event_id"].to_numpy(), pdf["us"].fillna(0).to_numpy().astype(np.int64)
    out["known"] = pdf["known"].to_numpy().astype(bool)
    out["x"] = pdf["x"].fillna(0.0).to_numpy()
    return out


def _slices(constant: float, slice_us: int):
    """The group function of a slice: waits for the watermark, then gives the slice's rows with their maps."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        split, slice_no = key
        if slice_no is None or (isinstance(slice_no, float) and math.isnan(slice_no)):   # no time: no place
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"split": split, "slice": None, "event_id": pdf["event_id"], "us": None,
                                        "a": None, "b": None, "first": None}).astype({"slice": "Int64", "us": "Int64"})
            return
        held = [np.frombuffer(state.get[0], WAITING)] if state.exists else []
        if not state.hasTimedOut:
            held += [_as_rows(pdf) for pdf in batches if len(pdf)]
            end_ms = (int(slice_no) + 1) * slice_us // 1000
            if state.getCurrentWatermarkMs() <= end_ms:
                state.update((np.concatenate(held).tobytes(),))
                state.setTimeoutTimestamp(max(end_ms, 1))
                return
        rows, a, b, first = slice_maps(np.concatenate(held), constant)
        if state.exists:
            state.remove()
        yield pd.DataFrame({"split": split, "slice": int(slice_no), "event_id": rows["id"], "us": rows["us"],
                            "a": a, "b": b, "first": first})

    return fold


def compose(ends: pd.DataFrame) -> pd.DataFrame:
    """Slices of one key in order with the average at each one's start and, in the last row (no slice), after all."""
    ends = ends.sort_values("slice")
    carry = None if pd.isna(ends["carry"].iat[0]) else float(ends["carry"].iat[0])
    starts = []
    for r in ends.itertuples(index=False):
        starts.append(carry)
        begun = r.first if carry is None else carry     # the first value initialises
        carry = None if pd.isna(begun) else r.a * begun + r.b
    split = ends["split"].iat[0]
    return pd.DataFrame({"split": [split] * (len(ends) + 1), "slice": pd.array([*ends["slice"], None], dtype="Int64"),
                         "start": pd.Series([*starts, carry], dtype="float64")})


class KeyedAverage:
    """``ema`` of ``value`` per ``key`` in event time. ``run()`` gives ``split, event_id, ema`` of a bounded input;
    ``late`` then is the number of rows behind the watermark, ``batches`` that of micro-batches with closed slices."""

    def __init__(self, spark: SparkSession, source_dir: str, schema: T.StructType, *, constant: float = EMA_CONSTANT,
                 slice_: str = "1 hour", delay: str = "2 hours", files_per_trigger: int = 1, key: str = "event_type",
                 value: str = "value", allow_late: bool = False):
        ship_package(spark)
        self.spark, self.delay, self.allow_late = spark, delay, allow_late
        self.constant, self.slice_us = constant, _micros(slice_)
        self.base = scratch_path(spark, "keyed-average")
        self.late, self.batches = 0, 0
        src = _source(spark, source_dir, schema, files_per_trigger).select(
            F.col(key).cast("string").alias("split"), F.col("event_id").cast("long").alias("event_id"),
            epoch_micros(F.col("ts")).alias("us"), F.col(value).cast("double").alias("x"))
        self.rows_schema = src.schema
        self._closing([])
        self.rows = src.unionByName(_source(spark, f"{self.base}/closing", self.rows_schema, 1))

    def _closing(self, rows: list):
        self.spark.createDataFrame(rows, "split string, event_id long, us long, x double").coalesce(1).write.mode(
            "append").parquet(f"{self.base}/closing")

    def maps(self) -> DataFrame:
        """The stream of closed slices' rows."""
        timed = self.rows.withColumn("_et", F.timestamp_micros("us")).withWatermark("_et", self.delay)
        # (a condition on the event time is not moved below the watermark, which must see the closing row)
        timed = timed.where(F.col("_et").isNull() | (F.unix_micros("_et") < F.lit(CLOSING_US)))
        timed = timed.select("split", F.floor(F.col("us") / F.lit(self.slice_us)).cast("long").alias("slice"), "event_id", "us",
                             "x", F.col("x").isNotNull().alias("known"), "_et")
        return timed.groupBy("split", "slice").applyInPandasWithState(
            _slices(self.constant, self.slice_us), MAPS, "waiting binary", "append", GroupStateTimeout.EventTimeTimeout)

    def _carry(self, n: int) -> DataFrame:
        if n < 0:
            return self.spark.createDataFrame([], CARRY)
        return self.spark.read.schema(CARRY).parquet(f"{self.base}/carry/{n}")

    def batch(self, closed: DataFrame, n: int):
        """Composes the slices closed in batch ``n`` with the averages after batch ``n - 1``."""
        closed.write.mode("overwrite").parquet(f"{self.base}/maps/{n}")
        closed = self.spark.read.schema(MAPS).parquet(f"{self.base}/maps/{n}")
        place = F.struct("us", "event_id")
        ends = closed.where("slice IS NOT NULL").groupBy("split", "slice").agg(
            F.max_by(F.struct("a", "b"), place).alias("m"), F.max("first").alias("first"))
        before = self._carry(n - 1).withColumnRenamed("split", "_s")
        ends = ends.join(before, F.col("split").eqNullSafe(F.col("_s")), "left").select(
            "split", "slice", F.col("m.a").alias("a"), F.col("m.b").alias("b"), "first", "carry")
        starts = ends.groupBy("split").applyInPandas(compose, "split string, slice long, start double")
        starts.write.mode("overwrite").parquet(f"{self.base}/starts/{n}")
        starts = self.spark.read.schema("split string, slice long, start double").parquet(f"{self.base}/starts/{n}")
        after = starts.where("slice IS NULL").select("split", F.col("start").alias("_after"), F.lit(True).alias("_new"))
        joined = after.join(before, F.col("split").eqNullSafe(F.col("_s")), "full")
        joined.select(F.when(F.col("_new"), F.col("split")).otherwise(F.col("_s")).alias("split"),
                      F.when(F.col("_new"), F.col("_after")).otherwise(F.col("carry")).alias("carry")).write.mode(
            "overwrite").parquet(f"{self.base}/carry/{n}")
        named = starts.where("slice IS NOT NULL").select(F.col("split").alias("_s"), F.col("slice").alias("_n"), "start")
        out = closed.join(named, F.col("split").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_n")), "left")
        out.select("split", "event_id", (F.col("a") * F.coalesce("start", "first") + F.col("b")).alias("ema")).write.mode(
            "overwrite").parquet(f"{self.base}/out/batch={n}")
        self.batches = n + 1

    def run(self) -> DataFrame:
        q = (self.maps().writeStream.outputMode("append").foreachBatch(self.batch)
             .option("checkpointLocation", f"{self.base}/checkpoint").start())
        try:
            q.processAllAvailable()
            self._closing([(None, 0, CLOSING_US, None)])
            q.processAllAvailable()
            self.late = sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])
        finally:
            q.stop()
        if self.late and not self.allow_late:
            raise ValueError(f"{self.late} rows came later than {self.delay}")
        return self.spark.read.schema("split string, event_id long, ema double").parquet(f"{self.base}/out").drop("batch")

