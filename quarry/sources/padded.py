"""The cache as dense, padded records, and a Spark data source that reads them by name.

``sink_padded`` writes every array of the cache padded with -1 to its split's greatest width (lists of arrays in both
dimensions), dealt into shards as ``sink_cache`` does. ``PaddedCache`` reads such a folder as the format ``padded_cache``::

    spark.dataSource.register(PaddedCache)
    spark.read.format("padded_cache").option("split", "train").option("columns", "sample_id,question_ids").load(path)

It plans a partition per shard, lists only the splits asked for (the option ``split``, or with ``pushdown`` true a filter on
``split`` in sessions that push filters to Python sources), reads only the columns asked for, and turns the padded arrays back into
ragged ones: trailing pads go, then trailing empty rows of a list of arrays. A pad inside an array stays.

Defined results: a null array stays null, one of pads only is empty; rows that repeat are kept; a split that isn't there (or an empty
cache) is a ``FileNotFoundError`` naming the pattern; an unknown column is a ``KeyError``. A task holds one Arrow batch.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from quarry.params import NUM_SHARDS, RAGGED_PAD_ID
from quarry.sources.cache_io import sink_cache
from quarry.sources.parts import CacheParts, sink_parts

BATCH_ROWS = 1024


def _is_list(t) -> bool:
    return isinstance(t, T.ArrayType)


def _padded(col, width):
    """``col`` with pads up to ``width`` entries."""
    fill = F.array_repeat(F.lit(RAGGED_PAD_ID).cast("long"), (width - F.size(col)).cast("int"))
    return F.concat(col.cast("array<bigint>"), fill)


def dense(cache: DataFrame, widths: list | None = None) -> DataFrame:
    """``cache`` with whole-number arrays, and lists of them, padded to the greatest width of their split. ``widths``: where they
    are known, a row per split with a width by column, in a list's case a pair (rows, entries of a row)."""
    flat = [f.name for f in cache.schema if _is_list(f.dataType) and isinstance(f.dataType.elementType, T.IntegralType)]
    deep = [f.name for f in cache.schema if _is_list(f.dataType) and _is_list(f.dataType.elementType)
            and isinstance(f.dataType.elementType.elementType, T.IntegralType)]
    if not flat and not deep:
        return cache
    if widths is not None:
        def known(name, at):
            asked = [(w["split"], w[name][at] if name in deep else w[name]) for w in widths]
            return F.coalesce(*[F.when(F.col("split").eqNullSafe(F.lit(s)), F.lit(n)) for s, n in asked], F.lit(0))
        wide = cache.select("*", *[known(c, 0).alias(f"_w_{c}") for c in flat + deep], *[known(c, 1).alias(f"_v_{c}") for c in deep])
    else:
        found = cache.groupBy(F.col("split").alias("_s")).agg(
            *[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(f"_w_{c}") for c in flat + deep],
            *[F.coalesce(F.max(F.array_max(F.transform(c, lambda r: F.size(r)))), F.lit(0)).alias(f"_v_{c}") for c in deep])
        wide = cache.join(F.broadcast(found), F.col("split").eqNullSafe(F.col("_s")))    # a row a split

    def both(name):
        inner = F.col(f"_v_{name}")
        rows = F.transform(F.col(name), lambda r: _padded(F.coalesce(r, F.array().cast("array<bigint>")), inner))
        blank = F.array_repeat(F.lit(RAGGED_PAD_ID).cast("long"), inner)
        return F.concat(rows, F.array_repeat(blank, (F.col(f"_w_{name}") - F.size(name)).cast("int")))

    return wide.select(*[_padded(F.col(c), F.col(f"_w_{c}")).alias(c) if c in flat else both(c).alias(c) if c in deep else F.col(f"`{c}`")
                         for c in cache.columns])


def sink_padded(cache: DataFrame, path: str, num_shards: int = NUM_SHARDS, order_col: str = "sample_id") -> str:
    return sink_cache(dense(cache), path, num_shards, order_col)


def sink_padded_parts(parts: CacheParts, path: str, num_shards: int = NUM_SHARDS) -> str:
    """A retrieval cache as dense records: ``block_ids`` and ``passages`` (tokens) in the place of ``retrievals``. Widths come from
    the parts, rows are dealt ragged, and pads are added in the stream of the task that writes them."""
    widths = [w.asDict() | {"block_ids": w["retrievals"], "passages": (w["retrievals"], w["token_ids"])} for w in parts.widths()]

    def shape(rows):
        own = [c for c in rows.columns if c not in ("retrievals", "shard")]
        return dense(rows.select(*own, F.transform("retrievals", lambda r: r["block_id"]).alias("block_ids"),
                                 F.transform("retrievals", lambda r: r["token_ids"]).alias("passages"), "shard"), widths)

    return sink_parts(parts, path, num_shards, shape=shape, compression="zstd")


def ragged(arr: pa.ListArray, pad: int = RAGGED_PAD_ID) -> pa.ListArray:
    """A padded array column without its pads."""
    starts = arr.offsets.to_numpy()
    values = arr.values
    if pa.types.is_list(values.type):
        values = ragged(values, pad)
        real = np.asarray(values.value_lengths().fill_null(0)) > 0
    else:
        real = np.asarray(pa.compute.fill_null(pa.compute.not_equal(values, pad), True))
    at = np.flatnonzero(real)
    before = np.searchsorted(at, starts[1:])
    last = at[np.maximum(before - 1, 0)] if len(at) else np.full(len(before), -1)
    n = np.where((before > 0) & (last >= starts[:-1]), last - starts[:-1] + 1, 0)
    gone = np.asarray(arr.is_null())
    n[gone] = 0
    ends = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(ends[-1]) + np.repeat(starts[:-1] - ends[:-1], n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(take, pa.int64())), mask=pa.array(gone))


def _filesystem(path: str):
    """The file system of a path as Spark writes it, and the path in it."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Shard(InputPartition):
    split: str
    shard: int
    files: list


class PaddedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, splits: list | None):
        self.names, self.path, self.splits = schema.names, path, splits

    def partitions(self):
        return shards(self.path, self.splits)

    def read(self, partition):
        import pyarrow.parquet as pq
        if partition is None:
            return
        stored = [n for n in self.names if n not in ("split", "shard")]
        files, _ = _filesystem(self.path)
        for name in partition.files:
            with files.open_input_file(name) as f:
                for b in pq.ParquetFile(f).iter_batches(BATCH_ROWS, columns=stored):
                    cols = []
                    for n in self.names:
                        if n == "split":
                            cols.append(pa.array([partition.split] * b.num_rows, pa.string()))
                        elif n == "shard":
                            cols.append(pa.array(np.full(b.num_rows, partition.shard, np.int32)))
                        else:
                            c = b.column(n)
                            cols.append(ragged(c) if pa.types.is_list(c.type) else c)
                    yield pa.RecordBatch.from_arrays(cols, names=self.names)


class PushingReader(PaddedReader):
    """For sessions with ``spark.sql.python.filterPushdown.enabled`` (others refuse a reader that takes filters)."""

    def pushFilters(self, filters):
        for f in filters:
            asked = None
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("split",):
                asked = {f.value}
            elif isinstance(f, In) and tuple(f.attribute) == ("split",):
                asked = set(f.value)
            if asked is None:
                yield f
            else:
                self.splits = sorted(asked if self.splits is None else asked & set(self.splits))


def shards(path: str, splits: list | None = None) -> list:
    """The shards of the splits asked for (None: all), by split and number."""
    from pyarrow import fs
    files, base = _filesystem(path)
    found: dict = {}
    for folder in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        split = unquote(folder.base_name.removeprefix("split="))
        if not folder.base_name.startswith("split=") or (splits is not None and split not in splits):
            continue
        for f in files.get_file_info(fs.FileSelector(folder.path, recursive=True)):
            if f.is_file and f.base_name.endswith(".parquet"):
                number = int(os.path.basename(os.path.dirname(f.path)).removeprefix("shard="))
                found.setdefault((split, number), []).append(f.path)
    return [Shard(s, n, sorted(names)) for (s, n), names in sorted(found.items())]


class PaddedCache(DataSource):
    """Format ``padded_cache``; options ``split`` (comma list), ``columns`` (comma list) and ``pushdown``."""

    @classmethod
    def name(cls):
        return "padded_cache"

    def _splits(self):
        asked = self.options.get("split")
        return [s.strip() for s in asked.split(",")] if asked else None

    def schema(self):
        import pyarrow.parquet as pq
        path, splits = self.options["path"], self._splits()
        parts = shards(path, splits)
        if not parts or (splits and {p.split for p in parts} != set(splits)):
            raise FileNotFoundError(f"no cache files match {path}/split={self.options.get('split') or '*'}")
        files, _ = _filesystem(path)
        with files.open_input_file(parts[0].files[0]) as f:
            stored = from_arrow_schema(pq.ParquetFile(f).schema_arrow)
        whole = T.StructType([*[T.StructField(f.name, f.dataType) for f in stored.fields], T.StructField("split", T.StringType()),
                              T.StructField("shard", T.IntegerType())])
        asked = self.options.get("columns")
        return T.StructType([whole[c.strip()] for c in asked.split(",")]) if asked else whole

    def reader(self, schema):
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else PaddedReader
        return kind(schema, self.options["path"], self._splits())
