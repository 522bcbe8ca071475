"""Versions of the retrieval cache: a reader sees a whole one, a writer that was stopped goes on where it was.

Layout below a root folder::

    data/<version>/split=<split>/shard=<n>/   the rows, as ``sink_cache`` deals them
    manifests/<version>/split=<split>/        a row per file (JSON): name, rows, checksum; complete with its ``_SUCCESS``
    published/<number>                        the name of the version that readers take; the greatest number holds

A split counts as written when its manifest is complete, so a job that ends between splits writes the others only. The
publication is one small file, written under a name of its own and renamed to the next number: a reader meets the version before
or the new one, and of two writers that race for a number one fails and tries the next.

A file's checksum is the sum of its rows' 64-bit hashes, which the order of rows doesn't change; computing and verifying
it is one distributed pass. Defined results: a split without rows has an empty manifest and reads as no rows; null columns
count in the checksum; repeated rows are kept and counted; a version that is published twice is taken from its last
publication; reading before any publication is a ``FileNotFoundError``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.params import NUM_SHARDS
from quarry.sources.cache_io import sink_cache
from quarry.sources.parts import CacheParts, sink_parts

MANIFEST = "file string, n_rows long, checksum string"


class DamagedCache(ValueError):
    """A file of a published version is missing, or holds other rows than its manifest says."""


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.exists(p)


def _names(spark, path: str) -> list:
    p, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _manifest_path(root: str, version: str, split: str) -> str:
    return f"{root}/manifests/{version}/split={split}"


def _data_path(root: str, version: str, split: str) -> str:
    return f"{root}/data/{version}/split={split}"


def _summed(rows: DataFrame) -> DataFrame:
    """``file, n_rows, checksum`` of the files behind a read."""
    name = F.regexp_extract(F.input_file_name(), r"(shard=[^/]+/[^/]+)$", 1)
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns) if c != "shard"])
    return (rows.select(name.alias("file"), hashed.cast("decimal(38,0)").alias("h")).groupBy("file")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("h").cast("string").alias("checksum")))


def written_splits(spark: SparkSession, root: str, version: str) -> list:
    """The splits of a version whose manifest is complete."""
    names = [n.removeprefix("split=") for n in _names(spark, f"{root}/manifests/{version}")]
    return [s for s in names if _exists(spark, f"{_manifest_path(root, version, s)}/_SUCCESS")]


def write_version(cache: DataFrame | CacheParts, root: str, version: str, splits: list, num_shards: int = NUM_SHARDS,
                  order_col: str = "sample_id") -> list:
    """Writes the splits that the version hasn't got, and returns their names. Nothing is published. Of a retrieval cache in its
    parts a split gathers its own passages only; a table is read anew for each."""
    whole = not isinstance(cache, CacheParts)
    spark = (cache if whole else cache.fields).sparkSession
    done = set(written_splits(spark, root, version))
    todo = [s for s in splits if s not in done]
    for split in todo:      # a few named splits; each is a Spark job over its rows
        rows, sink = (cache.where(F.col("split") == split), sink_cache) if whole else (cache.of(split), sink_parts)
        # the split's folder is whole again after a writer that was stopped in it
        sink(rows, f"{_data_path(root, version, split)}/rows", num_shards, order_col)
        data = f"{_data_path(root, version, split)}/rows/split={split}"
        found = _summed(_read_files(spark, [data], data)) if _exists(spark, data) else spark.createDataFrame([], MANIFEST)
        found.write.mode("overwrite").json(_manifest_path(root, version, split))
    return todo


def _read_files(spark: SparkSession, paths: list, base: str, schema=None) -> DataFrame:
    reader = spark.read.option("basePath", base)
    return (reader.schema(schema) if schema is not None else reader).parquet(*paths)


def publish(spark: SparkSession, root: str, version: str, splits: list) -> int:
    """Makes the version the one that readers take, once all ``splits`` are written; returns the publication's number."""
    missing = sorted(set(splits) - set(written_splits(spark, root, version)))
    if missing:
        raise ValueError(f"version {version} isn't whole: {', '.join(missing)} not written")
    tmp, fs = _files(spark, f"{root}/published/_{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(version.encode()))
    out.close()
    while True:
        number = max([int(n) for n in _names(spark, f"{root}/published") if n.isdigit()], default=0) + 1
        target, _ = _files(spark, f"{root}/published/{number:09d}")
        if not fs.exists(target) and fs.rename(tmp, target):
            return number


def current_version(spark: SparkSession, root: str) -> str:
    numbers = [n for n in _names(spark, f"{root}/published") if n.isdigit()]
    if not numbers:
        raise FileNotFoundError(f"no version is published under {root}")
    p, fs = _files(spark, f"{root}/published/{numbers[-1]}")
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str, version: str, split: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(_manifest_path(root, version, split))


def read_version(spark: SparkSession, root: str, splits: list | None = None, version: str | None = None,
                 verify: bool = False) -> DataFrame:
    """The rows of the published (or a named) version: exactly the files of its manifests, split by split.

    ``verify``: rows and checksums of every file are compared with the manifest first; ``DamagedCache`` on any difference."""
    version = version or current_version(spark, root)
    parts, schema = [], None
    for split in splits or written_splits(spark, root, version):
        base = f"{_data_path(root, version, split)}/rows"
        names = [r["file"] for r in manifest(spark, root, version, split).select("file").collect()]   # a row per shard
        paths = [f"{base}/split={split}/{n}" for n in names]
        gone = [p for p in paths if not _exists(spark, p)]
        if gone:
            raise DamagedCache(f"missing: {gone[0]}")
        if paths:
            parts.append((split, paths, base))
    if not parts:
        raise FileNotFoundError(f"version {version} has no rows under {root}")
    out = None
    for split, paths, base in parts:
        rows = _read_files(spark, paths, base, schema).withColumn("split", F.lit(split))
        schema = schema or rows.drop("split").schema
        if verify:
            stated = manifest(spark, root, version, split)
            seen = _summed(rows.drop("split"))
            wrong = stated.join(seen.withColumnRenamed("n_rows", "_n").withColumnRenamed("checksum", "_c"), "file", "left").where(
                ~(F.col("n_rows").eqNullSafe(F.col("_n")) & F.col("checksum").eqNullSafe(F.col("_c")))).head(1)
            if wrong:
                raise DamagedCache(f"split {split}: {wrong[0]['file']} holds other rows than its manifest says")
        out = rows if out is None else out.unionByName(rows)
    return out
