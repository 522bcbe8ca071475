"""The moving average in keyed state against a plain loop, over many files, out of order, with odd rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.session import scratch_path
from quarry.streaming.keyed_state import KeyedAverage

SCHEMA = "event_id long, ts timestamp, event_type string, value double"
C = 0.9


def rows_of(n, seed=1):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "hot", "cold", None])
        # several rows share a time, some have no value
        rows.append((i, start + dt.timedelta(minutes=3 * (i // 3)), key, None if rng.random() < 0.1 else rng.uniform(-5, 5)))
    return rows


def expected(rows):
    out, state = {}, {}
    for i, ts, key, x in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        if x is not None:
            state[key] = C * state.get(key, x) + (1 - C) * x
        out[i] = (key, state.get(key))
    out.update({r[0]: (r[2], None) for r in rows if r[1] is None})
    return out


def written(spark, files):
    path = scratch_path(spark, "arrivals")
    for rows in files:   # one file each, in this order
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path).schema


def found(df):
    rows = df.collect()
    out = {r["event_id"]: (r["split"], r["ema"]) for r in rows}
    assert len(rows) == len(out)
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        assert a[i][0] == b[i][0]
        assert a[i][1] == (None if b[i][1] is None else pytest.approx(b[i][1], abs=1e-9)), i


def test_ten_micro_batches_out_of_order_equal_the_loop(spark):
    rows = rows_of(300)
    rows.append((1000, None, "hot", 3.0))
    near = [r for _, r in sorted(((k + random.Random(k).randrange(-20, 20)), r) for k, r in enumerate(rows))]
    path, schema = written(spark, [near[k::1][:31] for k in range(0, len(near), 31)])
    avg = KeyedAverage(spark, path, schema, constant=C, slice_="30 minute", delay="2 hours")
    same(found(avg.run()), expected(rows))
    assert avg.batches >= 10 and avg.late == 0


def test_rows_behind_the_watermark_are_counted_and_fail_the_run(spark):
    rows = rows_of(120)
    first, late = rows[10:], rows[:10]
    path, schema = written(spark, [first[:50], first[50:], first[:0], late])
    avg = KeyedAverage(spark, path, schema, constant=C, slice_="10 minute", delay="10 minutes", allow_late=True)
    same(found(avg.run()), expected(first))
    assert avg.late == 10
    with pytest.raises(ValueError, match="10 rows"):
        KeyedAverage(spark, path, schema, constant=C, slice_="10 minute", delay="10 minutes").run()


def test_no_rows(spark):
    path, schema = written(spark, [[]])
    avg = KeyedAverage(spark, path, schema, constant=C)
    assert avg.run().select(F.count("*")).first()[0] == 0
