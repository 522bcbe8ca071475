"""The padded cache read by name: equal to what was written, a partition per shard, only the splits asked for."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.session import scratch_path, ship_package
from quarry.sources.padded import PaddedCache, dense, ragged, shards, sink_padded

CACHE = "split string, sample_id long, q array<long>, blocks array<int>, passages array<array<long>>, note string"


def cache_rows():
    rows = []
    for i in range(60):
        split = "train" if i % 3 else "eval"
        rows.append((split, i, list(range(1, 1 + i % 7)), [i, i + 1][: i % 3], [[j] * (j + 1) for j in range(i % 4)], f"n{i}"))
    rows.append(("eval", 100, None, None, None, None))
    rows.append(("eval", 101, [5, -1, 6], [], [[], [3]], ""))     # a pad inside stays; an empty row before a filled one too
    return rows


@pytest.fixture(scope="module")
def written(spark):
    ship_package(spark)
    spark.dataSource.register(PaddedCache)
    return sink_padded(spark.createDataFrame(cache_rows(), CACHE), scratch_path(spark, "padded"), 4)


def plain(df):
    return sorted(((r["split"], r["sample_id"], r["q"], r["blocks"], r["passages"], r["note"]) for r in df.collect()), key=lambda r: r[:2])


def test_the_rows_come_back_ragged(spark, written):
    stored = spark.read.parquet(written)
    wide = stored.groupBy("split").agg(F.collect_set(F.size("q")).alias("w")).collect()
    assert all(len([w for w in r["w"] if w > 0]) == 1 for r in wide)      # dense: one width a split
    back = spark.read.format("padded_cache").load(written)
    assert back.rdd.getNumPartitions() == 8
    assert plain(back) == sorted(cache_rows(), key=lambda r: r[:2])


def test_only_the_splits_and_columns_asked_for(spark, written):
    one = spark.read.format("padded_cache").option("split", "eval").option("columns", "sample_id,split").load(written)
    assert one.columns == ["sample_id", "split"] and one.rdd.getNumPartitions() == 4
    assert sorted(r["sample_id"] for r in one.collect()) == sorted(r[1] for r in cache_rows() if r[0] == "eval")


def test_a_filter_on_the_split_is_pushed(spark, written):
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        some = spark.read.format("padded_cache").option("pushdown", "true").load(written).where("split = 'train' AND sample_id > 30")
        assert some.rdd.getNumPartitions() == 4
        assert sorted(r["sample_id"] for r in some.collect()) == sorted(r[1] for r in cache_rows() if r[0] == "train" and r[1] > 30)
    finally:
        spark.conf.set(name, "false")


def test_missing_splits_and_columns_are_named(spark, written):
    with pytest.raises(Exception, match="no cache files match"):
        spark.read.format("padded_cache").option("split", "nowhere").load(written)
    with pytest.raises(Exception, match="no_such"):
        spark.read.format("padded_cache").option("columns", "no_such").load(written)
    assert shards(scratch_path(spark, "nothing")) == []
    assert dense(spark.createDataFrame([], CACHE)).count() == 0


def test_ragged_handles_slices_nulls_and_both_dimensions():
    flat = pa.array([[1, -1], [-1, -1], None, [2, -1, 3, -1], []], pa.list_(pa.int64()))
    assert ragged(flat).to_pylist() == [[1], [], None, [2, -1, 3], []]
    assert ragged(flat.slice(2)).to_pylist() == [None, [2, -1, 3], []]
    assert ragged(pa.array([], pa.list_(pa.int64()))).to_pylist() == []
    deep = pa.array([[[1, -1], [-1, -1]], [[-1], [4], [-1]], None], pa.list_(pa.list_(pa.int64())))
    assert ragged(deep).to_pylist() == [[[1]], [[], [4]], None]
