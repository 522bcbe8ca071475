"""Versions of the cache and its bucketed form."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators.retrieval import cached_lookup
from quarry.sources import versions as V
from quarry.sources.bucketed import bucket_cache, bucketed_lookup

SPLITS = ["eval", "test", "train"]


def cache(spark, n=300, shift=0):
    return spark.range(n).select(
        F.expr("element_at(array('eval', 'test', 'train'), cast(id % 3 as int) + 1)").alias("split"), F.col("id").alias("sample_id"),
        F.expr(f"CASE WHEN id % 7 > 0 THEN array(named_struct('block_id', id * 2 + {shift}, 'score', id / 7D)) END").alias("retrievals"))


def rows(df):
    return sorted((r.split, r.sample_id, str(r.retrievals)) for r in df.collect())


def test_old_or_new(spark, tmp_path):
    root = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, root)
    assert V.write_version(cache(spark), root, "a", SPLITS, 4) == SPLITS
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, root)                    # written, not yet published
    assert V.publish(spark, root, "a", SPLITS) == 1
    assert rows(V.read_version(spark, root, verify=True)) == rows(cache(spark))
    V.write_version(cache(spark, shift=1), root, "b", SPLITS, 4)
    before = V.read_version(spark, root)
    assert rows(before) == rows(cache(spark))
    assert V.publish(spark, root, "b", SPLITS) == 2
    assert rows(V.read_version(spark, root, verify=True)) == rows(cache(spark, shift=1))
    assert rows(before) == rows(cache(spark))           # a reader that has begun keeps its version
    assert rows(V.read_version(spark, root, ["test"])) == rows(cache(spark, shift=1).where("split = 'test'"))
    assert V.publish(spark, root, "a", SPLITS) == 3 and V.current_version(spark, root) == "a"


def test_a_stopped_job_goes_on(spark, tmp_path):
    root = str(tmp_path / "c")
    V.write_version(cache(spark), root, "a", ["eval"], 4)
    # stopped inside the next split: rows, but no manifest
    cache(spark, 9).where("split = 'test'").write.parquet(f"{root}/data/a/split=test/rows/split=test/shard=0")
    kept = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/data/a/split=eval/**/*.parquet", recursive=True)}
    with pytest.raises(ValueError, match="test, train"):
        V.publish(spark, root, "a", SPLITS)
    assert V.write_version(cache(spark), root, "a", SPLITS, 4) == ["test", "train"]
    assert kept == {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/data/a/split=eval/**/*.parquet", recursive=True)}
    V.publish(spark, root, "a", SPLITS)
    assert rows(V.read_version(spark, root, verify=True)) == rows(cache(spark))


def test_damage_is_seen(spark, tmp_path):
    root = str(tmp_path / "c")
    twice = cache(spark).unionByName(cache(spark, 10))
    V.write_version(twice, root, "a", SPLITS + ["none"], 4)
    V.publish(spark, root, "a", SPLITS)
    got = V.read_version(spark, root, verify=True)
    assert got.where("split = 'none'").count() == 0 and got.where("sample_id >= 10").count() == 290
    files = sorted(glob.glob(f"{root}/data/a/split=test/**/*.parquet", recursive=True))
    other = sorted(glob.glob(f"{root}/data/a/split=train/**/*.parquet", recursive=True))[0]
    with open(other, "rb") as f, open(files[0], "wb") as g:
        g.write(f.read())
    crc = os.path.join(os.path.dirname(files[0]), f".{os.path.basename(files[0])}.crc")
    os.replace(os.path.join(os.path.dirname(other), f".{os.path.basename(other)}.crc"), crc)
    with pytest.raises(V.DamagedCache, match="other rows"):
        V.read_version(spark, root, ["test"], verify=True)


def test_lookup_leaves_the_cache_where_it_lies(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS quarry_bucketed")
    bucket_cache(cache(spark).repartition(5), "quarry_bucketed", 16, path=str(tmp_path / "t"))
    asked = spark.createDataFrame([("eval", 0), ("eval", 0), ("test", 1), ("train", 1), ("none", 4), (None, None), ("test", 10**9)] + [
        ("train", i) for i in range(2, 300, 3)], "split string, sample_id long").withColumn("extra", F.lit(1))
    got = bucketed_lookup(spark, asked, "quarry_bucketed", 16)
    want = cached_lookup(asked, cache(spark))
    key = lambda r: (str(r.split), str(r.sample_id), str(r.retrievals), r.found, r.extra)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    spark.sql("DROP TABLE IF EXISTS quarry_bucketed")
