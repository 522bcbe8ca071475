"""A retrieval cache in its parts, and a sink that moves a passage's tokens once.

The finished cache repeats a passage's tokens in every question that it answers, so its rows are many times the parts
they are made of. ``sink_parts`` therefore decides where a question's row goes (split, shard and file) on the light
columns, and sends each gathered passage there straight away: the shuffle that collects a question's passages is also the one
that gives every file a single writer. A shard has a file per ``ROWS_PER_FILE`` rows, so a task holds as much whatever the
number of questions.

Defined results are those of ``sink_cache`` over ``CacheParts.whole``: a row without a split or a sample id isn't written,
repeated sample ids meet every position that they have in their split, a question without hits keeps an empty list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieval import collect_retrievals, gather_blocks
from quarry.params import NUM_SHARDS
from quarry.session import scratch_path
from quarry.sources.cache_io import shard_map

ROWS_PER_FILE = 1024      # some 15 kB each with ten passages; Spark's reader holds up to 4096 rows of a file, decoded, per task


@dataclass(frozen=True)
class CacheParts:
    fields: DataFrame      # split, sample_id and the encoded columns of a question
    hits: DataFrame        # sample_id, rank, block_id, score
    tokens: DataFrame      # block_id, token_ids: every passage that was hit, once
    n_hits: int            # at most so many hits

    def whole(self) -> DataFrame:
        """The cache table: ``fields`` with ``retrievals`` in rank order."""
        per_q = collect_retrievals(gather_blocks(self.hits, self.tokens, n_hits=self.n_hits), "sample_id",
                                   ["block_id", "score", "token_ids"])
        return self.fields.join(per_q, "sample_id", "left").withColumn(
            "retrievals", F.coalesce("retrievals", F.array().cast(per_q.schema["retrievals"].dataType)))

    def stored(self) -> CacheParts:
        """The same with fields and tokens written once, for several writes from them."""
        def kept(df, name):
            path = scratch_path(df.sparkSession, name)
            df.write.parquet(path)
            return df.sparkSession.read.schema(df.schema).parquet(path)
        return replace(self, fields=kept(self.fields, "cache-fields"), tokens=kept(self.tokens, "cache-tokens"))

    def of(self, split: str) -> CacheParts:
        return replace(self, fields=self.fields.where(F.col("split") == split))

    def widths(self) -> list:
        """A row per split: the greatest sizes of the encoded columns, of ``retrievals`` and of a passage in them."""
        sized = self.tokens.select("block_id", F.size("token_ids").alias("_n"))
        lists = self.hits.select("sample_id", "block_id").join(sized, "block_id").groupBy("sample_id").agg(
            F.count(F.lit(1)).cast("int").alias("retrievals"), F.max("_n").alias("token_ids"))
        flat = [c for c in self.fields.columns if c not in ("split", "sample_id")]
        rows = self.fields.select("split", "sample_id", *[F.size(c).alias(c) for c in flat]).join(lists, "sample_id", "left")
        return rows.groupBy("split").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in [*flat, "retrievals", "token_ids"]]).collect()


def dealt(parts: CacheParts, num_shards: int = NUM_SHARDS, order_col: str = "sample_id") -> DataFrame:
    """The rows of the cache with their ``shard``, those of a file together in one partition."""
    place, n = shard_map(parts.fields.select("split", order_col), num_shards, order_col)
    files = max(1, math.ceil(n / (num_shards * ROWS_PER_FILE)))
    # never null behind the joins, and known to be so, or the write would sort the finished rows
    split = F.coalesce("split", F.lit("")).alias("split")
    at = [split, "shard", F.pmod(F.xxhash64("sample_id"), F.lit(files)).cast("int").alias("_file"), "sample_id"]
    asked = parts.hits.join(place.distinct(), "sample_id")
    gathered = gather_blocks(asked, parts.tokens, n_hits=parts.n_hits)
    own = [c for c in parts.fields.columns if c not in ("split", "sample_id")]
    hit, field = F.struct("rank", "block_id", "score", "token_ids"), F.struct(*own)
    fields = parts.fields.join(place, ["split", order_col])
    hit_type, field_type = gathered.select(hit.alias("r")).schema["r"].dataType, fields.select(field.alias("f")).schema["f"].dataType
    both = gathered.select(*at, hit.alias("_r"), F.lit(None).cast(field_type).alias("_f")).unionByName(
        fields.select(*at, F.lit(None).cast(hit_type).alias("_r"), field.alias("_f")))
    rows = both.repartition("split", "shard", "_file").groupBy("split", "shard", "_file", "sample_id").agg(
        F.array_sort(F.collect_list("_r")).alias("retrievals"), F.collect_list("_f").alias("_fs"))
    rows = rows.select("split", "shard", "sample_id", "retrievals", F.explode("_fs").alias("_f"))   # a row per repeated id
    return rows.select("split", "sample_id", *[F.col("_f")[c].alias(c) for c in own], "retrievals", "shard").sortWithinPartitions("split", "shard")


def sink_parts(parts: CacheParts, path: str, num_shards: int = NUM_SHARDS, order_col: str = "sample_id", shape=None,
               compression: str | None = None) -> str:
    """Writes the cache of ``parts`` in the layout of ``sink_cache``. ``shape``: a function of the rows, in a task's stream."""
    out = dealt(parts, num_shards, order_col)
    writer = (out if shape is None else shape(out)).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("split", "shard")
    (writer.option("compression", compression) if compression else writer).parquet(path)
    return path
