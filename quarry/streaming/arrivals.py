"""A table as a stream of arriving files, for runs over a table that is at rest.

``arriving`` writes the table once, a folder per part, and then appends part after part to one folder: a file source that
orders files by their time reads the parts in order. Every row arrives once; a null part arrives with part 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import scratch_path


def arriving(df: DataFrame, part: Column, parts: int) -> str:
    """The folder of arriving files of ``df``; ``part`` is a whole number from 0 to ``parts - 1``."""
    spark = df.sparkSession
    base, path = scratch_path(spark, "parts"), scratch_path(spark, "arriving")
    df.withColumn("_part", F.coalesce(part, F.lit(0)).cast("int")).write.partitionBy("_part").parquet(base)
    whole = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(base)
    for k in range(parts):
        whole.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(path)
    return path


def by_time(df: DataFrame, micros: Column, parts: int) -> Column:
    """The part of a row when the rows are dealt by time into parts of about equal size."""
    shares = [k / parts for k in range(1, parts)]
    cuts = df.agg(F.percentile_approx(micros, F.array(*[F.lit(s) for s in shares]), F.lit(1000))).first()[0] or []
    part = F.lit(0)
    for c in cuts:      # parts - 1 numbers
        part = part + F.when(micros >= F.lit(c), 1).otherwise(0)
    return part


def by_key(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts))
