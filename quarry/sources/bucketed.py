"""The cache as a bucketed, sorted table, so that lookups never shuffle it.

A lookup by ``(split, sample_id)`` against plain files moves the whole cache for a handful of requests. Bucketed and sorted
by the keys, the cache lies as the join needs it: requests are dealt to the same buckets and merged with the files in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.retrieval import cached_lookup

BUCKETS = 256


def bucket_cache(cache: DataFrame, table: str, buckets: int = BUCKETS, keys=("split", "sample_id"), path: str | None = None) -> str:
    """Writes the cache as table ``table`` (in the warehouse, or at ``path``), a file per bucket, and returns its name."""
    first, *others = keys
    dealt = cache.repartition(buckets, *keys)       # the buckets' own hash: one writer, one file each
    writer = dealt.write.mode("overwrite").bucketBy(buckets, first, *others).sortBy(first, *others)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return table


def bucketed_lookup(spark: SparkSession, requests: DataFrame, table: str, buckets: int = BUCKETS,
                    keys=("split", "sample_id"), retr_col: str = "retrievals") -> DataFrame:
    """``cached_lookup`` against a bucketed cache: only the requests are shuffled, into the cache's buckets.

    Unknown and null ids keep an empty list and ``found = false``; repeated requests are answered each. The merge hint holds
    the cache where it lies even when it would be small enough to send."""
    cache = spark.table(table).hint("merge")
    return cached_lookup(requests.repartition(buckets, *keys), cache, keys, retr_col)
