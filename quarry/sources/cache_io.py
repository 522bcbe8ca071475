"""Sinks and sources: the partitioned retrieval cache, generation results and
recall reports.

Layout of the cache: Parquet under ``<path>/split=<split>/shard=<n>/``, one
file per shard. Rows are dealt round-robin: the row with position ``i`` in
its split (ordered by ``sample_id``) goes to shard ``i mod num_shards``. The
position comes from a range-partitioned scan; the write is one
``repartition(split, shard)`` so each shard is written by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.operators.scan import ordered_scan
from quarry.params import MAX_BROADCAST_BYTES, NUM_SHARDS


MAX_BROADCAST_SHARD_MAP_ROWS = MAX_BROADCAST_BYTES // 32   # (split, id, shard) + overhead


def shard_map(light: DataFrame, num_shards: int, order_col: str = "sample_id") -> tuple:
    """``(split, id, shard)`` of the rows of ``(split, id)``, and their number."""
    pos = ordered_scan(light, "split", [order_col], "row_number", out="_pos")
    place = pos.select("split", order_col, F.pmod(F.col("_pos"), F.lit(num_shards)).cast("int").alias("shard"))
    return place, place.count()


def sink_cache(cache: DataFrame, path: str, num_shards: int = NUM_SHARDS, order_col: str = "sample_id",
               mode: str = "overwrite") -> str:
    """Write the cache dealt round-robin into ``num_shards`` shards per split.

    Positions are computed on the light ``(split, id)`` projection; the heavy
    rows (token arrays) meet the shard map through a broadcast join when the map
    is within its row bound, so they are shuffled exactly once -- by the
    ``repartition(split, shard)`` that gives every shard a single writer."""
    place, n = shard_map(cache.select("split", order_col), num_shards, order_col)
    if n <= MAX_BROADCAST_SHARD_MAP_ROWS:
        place = F.broadcast(place)
    out = cache.join(place, ["split", order_col])
    (out.repartition("split", "shard").write.mode(mode)
        .partitionBy("split", "shard").parquet(path))
    return path


def src_cache(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read the cache; with ``split`` only that split's files are listed (partition
    pruning by path). Nothing matching is an error naming the pattern."""
    pattern = f"{path}/split={split}" if split else path
    try:
        df = spark.read.option("basePath", path).parquet(pattern)
    except AnalysisException as e:
        raise FileNotFoundError(f"no cache files match {pattern}") from e
    if split:
        df = df.where(F.col("split") == split)
    return df


def shard_paths(cache: DataFrame) -> DataFrame:
    """``split, shard, path, n_rows``: the files behind a cache read, numbered by shard."""
    f = F.input_file_name()
    return (cache.select(f.alias("path"))
                 .select("path",
                         F.regexp_extract("path", r"split=([^/]+)", 1).alias("split"),
                         F.regexp_extract("path", r"shard=(\d+)", 1).cast("int").alias("shard"))
                 .groupBy("split", "shard", "path").agg(F.count(F.lit(1)).alias("n_rows")))


def sink_generations(gen: DataFrame, path: str, params: dict, mode: str = "append") -> str:
    """Write generation rows with the run parameters as a JSON column, under
    ``<path>/split=<s>/approach=<a>/``."""
    p = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(params.items())]))
    gen.withColumn("params", p).write.mode(mode).partitionBy("split", "approach").json(path)
    return path


def sink_report(report: DataFrame, path: str) -> str:
    """Write a (one-row) report as JSON (sink_recall)."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


def shard_lists(cache: DataFrame) -> DataFrame:
    """``split, shards ARRAY<STRUCT<shard, path>>`` sorted numerically by shard
    (one entry per file; bounded by the shard count)."""
    files = shard_paths(cache).select("split", "shard", "path")
    return files.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("shard", "path"))).alias("shards"))
