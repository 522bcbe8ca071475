"""Ordered scans per key without a single-task window.

Running counters, running sums, an exponential moving average, ``lag`` and
the "mark when P has passed since the last mark" cadence all depend on every
earlier row of their key. A ``Window.partitionBy(key)`` puts a whole key in
one task; with a key holding a third of the rows that task is the job. Here a
scan runs in steps instead:

1. **range partition** on (key, order) into ``n`` balanced partitions, written with the
   partition's number to the shared checkpoint folder (stable input, lineage cut). A key with many
   rows spreads over many partitions; its rows of one partition are a *segment*;
2. **segment summaries**: one row per segment (at most ``partitions + keys`` rows), composed per
   key in partition order, give every segment its incoming state;
3. **apply**: each segment is scanned from its incoming state.

``row_number`` (0-based), ``sum`` (inclusive) and ``lag`` (previous row's value, NULL first) are
SQL windows over segments and over the summaries. ``ema`` (first value initialises unless a seed is
given) and ``cadence`` (True where the row is marked) fold the value column in Arrow batches; all other
columns pass through as Arrow data, and a task holds one batch and the state of the key in progress (the
cadence summary keeps the times of one segment, as its chain needs the whole run).

A NULL key is a key like any other. A NULL value is skipped, as SQL aggregates do: it changes no sum or
average (the row shows the state so far) and is never marked. Sums of whole numbers are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import checkpoint_dir, scratch_path

BROADCAST_SUMMARY_ROWS = 1_000_000
ROWS_PER_PARTITION = 2_000_000     # upper bound per range partition
MIN_ROWS_PER_PARTITION = 20_000    # below this, extra partitions only add task overhead
BYTES_PER_PARTITION = 256 << 20    # estimated input bytes per range partition


def _affine_prefix(a: np.ndarray, b: np.ndarray):
    """Inclusive prefix composition of maps x -> a_i x + b_i (Hillis-Steele, stable)."""
    A, B = a.astype(np.float64).copy(), b.astype(np.float64).copy()
    s, n = 1, len(A)
    while s < n:
        A_prev = np.concatenate([np.ones(s), A[:-s]])
        B_prev = np.concatenate([np.zeros(s), B[:-s]])
        B = A * B_prev + B
        A = A * A_prev
        s *= 2
    return A, B


def _cadence_terminal(t: np.ndarray, period: float) -> np.ndarray:
    """For each row j, the time of the last mark when marking starts at j."""
    n = len(t)
    nxt = np.searchsorted(t, t + period, side="left")
    p = np.where(nxt < n, nxt, np.arange(n))
    for _ in range(max(1, int(math.ceil(math.log2(max(n, 2)))) + 1)):
        p = p[p]
    return t[p]


def _cadence_marks(t: np.ndarray, period: float, last: float | None) -> tuple[np.ndarray, float | None]:
    n = len(t)
    marks = np.zeros(n, dtype=bool)
    j = 0 if last is None else int(np.searchsorted(t, last + period, side="left"))
    while j < n:
        marks[j] = True
        last = float(t[j])
        j = int(np.searchsorted(t, t[j] + period, side="left"))
    return marks, last


def _partitions(df: DataFrame) -> int:
    """Enough range partitions to keep each within ``ROWS_PER_PARTITION``, and up to the cluster's
    parallelism when there are enough rows to share."""
    n_rows = df.count()
    par = df.sparkSession.sparkContext.defaultParallelism
    try:  # optimizer size estimate (no job): also bound the bytes one task holds
        est_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001
        est_bytes = 0
    # (join size estimates can be far too high: the byte term never asks
    # for partitions of fewer than 1000 rows)
    by_bytes = min(math.ceil(est_bytes / BYTES_PER_PARTITION), math.ceil(n_rows / 1000))
    n_parts = max(1, math.ceil(n_rows / ROWS_PER_PARTITION), by_bytes,
                  min(par, math.ceil(n_rows / MIN_ROWS_PER_PARTITION)))
    return min(n_parts, max(1, n_rows))


def _with_segments(rows: DataFrame, keys: list, table: DataFrame) -> DataFrame:
    """``rows`` with the columns that ``table`` holds per (segment, key), keys matched null-safely."""
    named = table.select(F.col("_pid").alias("_sp"), *[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)],
                         *[c for c in table.columns if c != "_pid" and c not in keys])
    if table.count() <= BROADCAST_SUMMARY_ROWS:   # at most partitions + keys rows
        named = F.broadcast(named)
    cond = F.col("_pid") == F.col("_sp")
    for i, k in enumerate(keys):
        cond = cond & rows[k].eqNullSafe(F.col(f"_sk{i}"))
    return rows.join(named, cond, "left").drop("_sp", *[f"_sk{i}" for i in range(len(keys))])


def ordered_scan(df: DataFrame, keys, order, kind: str, value: str | None = None,
                 out: str = "scan", *, n_parts: int | None = None, constant: float | None = None,
                 seed_value: float | None = None, period: float | None = None,
                 position: str | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Add column ``out``: the scan ``kind`` of ``value`` per ``keys`` in ``order``
    (and, with ``position``, the row's 0-based position in its key).

    ``cadence`` reads ``value`` as a time in seconds and ``period`` in seconds;
    ``seed_value`` is the incoming average (``ema``) or last-mark time (``cadence``) of every key,
    ``seeds`` a table ``keys..., seed`` of those of single keys (a null or missing seed: ``seed_value``).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    if kind not in ("row_number", "sum", "ema", "lag", "cadence"):
        raise ValueError(kind)
    if kind == "ema" and not (constant is not None and constant < 1):
        raise ValueError("ema needs a constant < 1")
    if kind == "cadence" and not (period and period > 0):
        raise ValueError("cadence needs a period > 0")
    spark = df.sparkSession
    checkpoint_dir(spark)
    sort_cols = keys + order
    dealt = df.repartitionByRange(n_parts or _partitions(df), *sort_cols).withColumn("_pid", F.spark_partition_id())
    path = scratch_path(spark, "scan")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    segment = Window.partitionBy(*keys, "_pid").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if kind in ("row_number", "sum", "lag"):
        return _windowed(dealt, df.columns, keys, order, kind, value, out, position, segment, before)
    return _folded(dealt, df, keys, order, kind, value, out, position, segment, before, float(constant or 0.0),
                   float(period or 0.0), seed_value, seeds)


def _windowed(dealt, names, keys, order, kind, value, out, position, segment, before):
    upto = segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if kind == "sum":
        aggs.append(F.sum(value).alias("_s"))
    if kind == "lag":
        aggs.append(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])).alias("_l"))
    table = dealt.groupBy(*keys, "_pid").agg(*aggs)
    cols = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0")]
    if kind == "sum":
        cols.append(F.sum("_s").over(before).alias("_s0"))
    if kind == "lag":
        cols.append(F.lag("_l").over(Window.partitionBy(*keys).orderBy("_pid")).getField("v").alias("_l0"))
    path = scratch_path(dealt.sparkSession, "segments")
    table.select(*keys, "_pid", *cols).write.parquet(path)
    table = dealt.sparkSession.read.parquet(path)
    rows = dealt.withColumn("_p", F.row_number().over(segment) - 1)
    if kind == "sum":
        rows = rows.withColumn("_v", F.sum(value).over(upto))
    if kind == "lag":
        rows = rows.withColumn("_v", F.lag(value).over(segment))
    rows = _with_segments(rows, keys, table)
    place = (F.col("_n0") + F.col("_p")).cast("long")
    if kind == "row_number":
        result = place
    elif kind == "sum":
        result = F.coalesce(F.col("_s0") + F.col("_v"), F.col("_v"), F.col("_s0"))
    else:
        result = F.when(F.col("_p") == 0, F.col("_l0")).otherwise(F.col("_v"))
    return rows.select(*[F.col(f"`{c}`") for c in names], result.alias(out), *([place.alias(position)] if position else []))


def _folded(dealt, df, keys, order, kind, value, out, position, segment, before, c, per, seed_value, seeds):
    spark = df.sparkSession
    # the key as one number, so that runs of a key are found without comparing nulls
    rows = dealt.withColumn("_k", F.xxhash64(*keys, F.concat_ws("", *[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])))
    rows = rows.withColumn("_x", F.col(value).cast("double")).sortWithinPartitions("_pid", *keys, *order)
    names_sum = ["_pid", "_k", "n", "a", "b", "first", "head_t", "head_g"]

    def summarise(batches):
        # Streams the (sorted) partition batch by batch; only the current segment's accumulators are held
        # (cadence keeps the segment's times: its chain summary needs the whole run).
        cur, done = None, []  # [run, n, A, B, first, times]

        def emit(run):
            key, n, A, B, first, times = run
            head_t = head_g = None
            if kind == "cadence":
                seg = np.concatenate(times)
                if len(seg):
                    g = _cadence_terminal(seg, per)
                    h = min(int(np.searchsorted(seg, seg[0] + per, side="right")) + 1, len(seg))
                    head_t, head_g = seg[:h].tolist(), g[:h].tolist()
            return [*key, n, A, B, first, head_t, head_g]

        for b in batches:
            if not b.num_rows:
                continue
            pid, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            known = np.asarray(b.column(2).is_valid())
            for lo, hi in _runs(pid, k):
                seg = x[lo:hi][known[lo:hi]]
                A, B = 1.0, 0.0
                if kind == "ema" and len(seg):
                    Ap, Bp = _affine_prefix(np.full(len(seg), c), (1 - c) * seg)
                    A, B = float(Ap[-1]), float(Bp[-1])
                key = (int(pid[lo]), int(k[lo]))
                if cur is None or cur[0] != key:
                    if cur is not None:
                        done.append(emit(cur))
                    cur = [key, 0, 1.0, 0.0, None, []]
                cur[1] += hi - lo
                cur[3] = A * cur[3] + B
                cur[2] *= A
                if cur[4] is None and len(seg):
                    cur[4] = float(seg[0])
                if kind == "cadence":
                    cur[5].append(seg)
            if len(done) >= 1024:
                yield _rows_of(done, names_sum)
                done = []
        if cur is not None:
            done.append(emit(cur))
        if done:
            yield _rows_of(done, names_sum)

    table = rows.select("_pid", "_k", "_x").mapInArrow(
        summarise, "_pid int, _k long, n long, a double, b double, first double, head_t array<double>, head_g array<double>")
    incoming = rows.select("_k", *keys).dropDuplicates(["_k"])
    if seeds is not None:
        named = seeds.select(*[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)], F.col("seed").cast("double").alias("_seed"))
        cond = None
        for i, k in enumerate(keys):
            part = incoming[k].eqNullSafe(F.col(f"_sk{i}"))
            cond = part if cond is None else cond & part
        incoming = incoming.join(named, cond, "left").select("_k", "_seed")
    else:
        incoming = incoming.select("_k", F.lit(None).cast("double").alias("_seed"))
    table = table.join(incoming.withColumn("_seed", F.coalesce("_seed", F.lit(seed_value).cast("double"))), "_k")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pid")
        out_n, out_v, cnt = [], [], 0
        state = None if pd.isna(pdf["_seed"].iat[0]) else float(pdf["_seed"].iat[0])
        for r in pdf.itertuples(index=False):
            out_n.append(cnt)
            out_v.append(state)
            cnt += r.n
            if kind == "ema":
                start = r.first if state is None else state  # the first value initialises
                state = None if pd.isna(start) else r.a * start + r.b
            elif r.head_t is not None and len(r.head_t):
                ht, hg = np.asarray(r.head_t), np.asarray(r.head_g)
                j = 0 if state is None else int(np.searchsorted(ht, state + per, side="left"))
                if j < len(ht):
                    state = float(hg[j])
                # else: no row of this segment reaches the next mark
        return pd.DataFrame({"_pid": pdf["_pid"].to_numpy(), "_k": pdf["_k"].to_numpy(), "_n0": out_n,
                             "_v0": pd.Series(out_v, dtype="float64")})

    path = scratch_path(spark, "segments")
    table.groupBy("_k").applyInPandas(starts, "_pid int, _k long, _n0 long, _v0 double").write.parquet(path)
    table = spark.read.parquet(path).select(F.col("_pid").alias("_sp"), F.col("_k").alias("_sk"), "_n0", "_v0")
    if table.count() <= BROADCAST_SUMMARY_ROWS:   # at most partitions + keys rows
        table = F.broadcast(table)
    joined = rows.join(table, (F.col("_pid") == F.col("_sp")) & (F.col("_k") == F.col("_sk")), "left")
    joined = joined.drop("_sp", "_sk").sortWithinPartitions("_pid", *keys, *order)
    names = df.columns
    work = ["_pid", "_k", "_x", "_n0", "_v0"]
    out_type = T.DoubleType() if kind == "ema" else T.BooleanType()
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, out_type)] + (
        [T.StructField(position, T.LongType())] if position else []))

    def apply(batches):
        # Streams the partition; the state of the key run in progress is carried from one Arrow batch to the next.
        carry = None  # (run, next position, state)
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(i) for i, n in enumerate(work)}
            pid, k = cols["_pid"].to_numpy(), cols["_k"].to_numpy()
            x = cols["_x"].to_numpy(zero_copy_only=False).astype(np.float64)
            known = np.asarray(cols["_x"].is_valid())
            res = np.full(b.num_rows, np.nan) if kind == "ema" else np.zeros(b.num_rows, bool)
            pos = np.empty(b.num_rows, dtype=np.int64)
            for lo, hi in _runs(pid, k):
                run = (int(pid[lo]), int(k[lo]))
                if carry is not None and carry[0] == run:
                    n0, state = carry[1], carry[2]
                else:
                    n0, state = cols["_n0"][int(lo)].as_py(), cols["_v0"][int(lo)].as_py()
                pos[lo:hi] = n0 + np.arange(hi - lo)
                at = lo + np.flatnonzero(known[lo:hi])
                if kind == "ema":
                    if len(at):
                        A, B = _affine_prefix(np.full(len(at), c), (1 - c) * x[at])
                        vals = A * (x[at[0]] if state is None else state) + B
                        last = np.searchsorted(at, np.arange(lo, hi), side="right") - 1
                        first = np.nan if state is None else state
                        res[lo:hi] = np.where(last >= 0, vals[np.maximum(last, 0)], first)
                        state = float(vals[-1])
                    elif state is not None:
                        res[lo:hi] = state
                else:
                    res[at], state = _cadence_marks(x[at], per, state)
                carry = (run, n0 + hi - lo, state)
            found = pa.array(res, mask=np.isnan(res)) if kind == "ema" else pa.array(res)
            kept = [b.column(len(work) + i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, found, *([pa.array(pos)] if position else [])],
                                             names=[*names, out, *([position] if position else [])])

    return joined.select(*work, *[F.col(f"`{n}`") for n in names]).mapInArrow(apply, schema)


def _runs(pid: np.ndarray, key: np.ndarray):
    """(start, stop) of runs of one segment in a sorted batch."""
    change = np.ones(len(pid), dtype=bool)
    change[1:] = (pid[1:] != pid[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(change)
    yield from zip(starts, np.append(starts[1:], len(pid)))


def _rows_of(rows: list, names: list):
    types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
