"""Gathering retrieved passages and looking up cached neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.params import MAX_BROADCAST_BYTES


HIT_ROW_BYTES = 48                 # (sample_id, rank, block_id, score) plus hash-table overhead
MAX_BROADCAST_HIT_BYTES = MAX_BROADCAST_BYTES // 8   # the driver builds and sends them: several times their size


def gather_blocks(hits: DataFrame, payload: DataFrame, block_id_col: str = "block_id",
                  n_hits: int | None = None) -> DataFrame:
    """Attach each hit's passage payload (text and/or token ids) by ``block_id``.

    An equi inner join. The passage table grows with the corpus and is never
    broadcast. When the hit set is known to be small enough (``n_hits`` rows,
    e.g. queries x k, within ``MAX_BROADCAST_HIT_BYTES``), the *hits* are
    broadcast and the passage table is streamed: passages are not shuffled at
    all and a hub passage hit by many questions costs nothing extra. Otherwise
    both sides shuffle on ``block_id`` and AQE's skew-join splitting handles hub
    passages.
    """
    if n_hits is not None and n_hits * HIT_ROW_BYTES <= MAX_BROADCAST_HIT_BYTES:
        return payload.join(F.broadcast(hits), block_id_col)
    return hits.join(payload, block_id_col)


def collect_retrievals(hits: DataFrame, key_cols, fields, rank_col: str = "rank",
                       out_col: str = "retrievals") -> DataFrame:
    """One row per key with its neighbours as ``ARRAY<STRUCT<rank, ...>>`` in rank order.

    Groups hold ``k`` rows each (bounded); ordering is explicit (sort by rank),
    never the arrival order of ``collect_list``.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    st = F.struct(F.col(rank_col).alias("rank"), *[F.col(c) for c in fields])
    return hits.groupBy(*keys).agg(F.array_sort(F.collect_list(st)).alias(out_col))


def cached_lookup(requests: DataFrame, cache: DataFrame, key_cols=("split", "sample_id"),
                  retr_col: str = "retrievals") -> DataFrame:
    """Requested ids -> cached neighbours; unknown ids keep an empty list and ``found = false``.

    Left equi join on (split, sample_id). (The reference answered unknown ids
    with row 1's neighbours; here they are visible instead.)
    """
    keys = list(key_cols)
    c = cache.select(*keys, F.col(retr_col).alias("_r"), F.lit(True).alias("_found"))
    out = requests.join(c, keys, "left")
    empty = F.array().cast(c.schema["_r"].dataType)
    return (out.withColumn(retr_col, F.coalesce(F.col("_r"), empty))
               .withColumn("found", F.coalesce(F.col("_found"), F.lit(False)))
               .drop("_r", "_found"))


def select_by_index(arr: Column, idx: Column) -> Column:
    """Take ``arr[i]`` for each 0-based ``i`` in ``idx`` (in-row gather, no shuffle)."""
    return F.transform(idx, lambda i: F.element_at(arr, i + 1))
