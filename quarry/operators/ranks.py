"""Row numbers of a whole table in DataFrame functions, without a window over all rows in one task.

Rows are range-partitioned in the order, written with their partition's number, numbered within it, and
moved on by the sizes of the partitions before (a row per partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import scratch_path


def global_rank(df: DataFrame, order: list, out: str) -> DataFrame:
    """``df`` with ``out``: the row's place from 0 in ``order`` (columns or names; it must be total for the
    result to be fixed)."""
    path = scratch_path(df.sparkSession, "rank")
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_local", local).join(sizes, "_part").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_from") + F.col("_local")).alias(out))
