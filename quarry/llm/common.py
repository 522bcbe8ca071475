"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TABLES: list = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: lineage ends at
    files every executor sees, and nothing upstream is computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    _TABLES.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_so_far() -> int:
    return len(_TABLES)


def remove_tables(spark: SparkSession, since: int, but: list) -> None:
    """Removes the tables written after the first ``since``, except those that the frames ``but`` read: an operator's
    scratch goes as soon as what follows from it has been written."""
    kept = [f for df in but for f in df.inputFiles()]
    for p in _TABLES[since:]:
        if not any(p.rsplit("/", 1)[-1] in f for f in kept):
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``QUARRY_TOKENIZERS`` names another folder."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
