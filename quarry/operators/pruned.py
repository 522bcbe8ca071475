"""Exact search that leaves out groups of blocks which can't hold a hit.

A group (a leaf of the index, or any other grouping with a centre) is known by its number of blocks, the largest
distance ``r`` of a block to the centre ``c`` and the largest norm ``m``. A query's score with any of its blocks is at
most ``min(q.c + |q| r, |q| m)``. Each query is scored first against the groups of highest bound that together hold
``k`` blocks; the k-th of these scores is a floor under its k-th best score, and only the groups whose bound reaches the
floor are scored as well. What is left out can't enter the list, so the rows equal those of ``mips_exact``.

The bounds are a row per group (the centroids' own size bound holds for them); queries are streamed against them; blocks are
scored where the index lies, or in salted leaf tiles, by ``ivf_probe``.

Defined results: fewer than ``k`` blocks give all of them; equal scores go by the smaller block id; no queries or no blocks
give no rows; a block with a null vector or leaf is refused by ``ivf_probe`` as it is elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ann import ivf_probe
from quarry.operators.search import FLOOR_SLACK, topk_rank, vectors_to_matrix
from quarry.session import scratch_path

PROBES = "qid long, block_id long"


def group_bounds(assigned: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``leaf, n, radius, norm``: blocks, largest distance to the leaf's centre and largest norm, in one pass."""
    cents = {r["leaf"]: np.array(r["embedding"], dtype=np.float64) for r in centroids.collect()}   # one row a leaf
    sent = assigned.sparkSession.sparkContext.broadcast(cents)

    def measure(batches):
        seen: dict = {}
        for b in batches:
            leaf, x = b.column(0).to_numpy(), vectors_to_matrix(b.column(1))
            for g in np.unique(leaf):
                mine = x[leaf == g]
                far, norm = (np.sqrt((y ** 2).sum(1).max()) for y in (mine - sent.value[int(g)], mine))
                n, r, m = seen.get(int(g), (0, 0.0, 0.0))
                seen[int(g)] = (n + len(mine), max(r, far), max(m, norm))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64())] + [pa.array([v[i] for v in seen.values()], t) for i, t in
                                                  enumerate((pa.int64(), pa.float64(), pa.float64()))],
            names=["leaf", "n", "radius", "norm"])

    parts = assigned.select(F.col("leaf").cast("long").alias("leaf"), F.col(vec_col).alias("v")).mapInArrow(
        measure, "leaf long, n long, radius double, norm double")
    return parts.groupBy("leaf").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm"))


def _bounds(bounds: DataFrame, centroids: DataFrame):
    """``(leaves, centres, n, radius, norm)`` of the groups that hold blocks; a row per group."""
    rows = bounds.join(centroids.select("leaf", "embedding"), "leaf").orderBy("leaf").collect()
    return (np.array([r["leaf"] for r in rows], dtype=np.int64), np.array([r["embedding"] for r in rows], dtype=np.float64),
            *(np.array([r[c] for r in rows], dtype=np.float64) for c in ("n", "radius", "norm")))


def upper_bounds(q: np.ndarray, known) -> np.ndarray:
    """Queries x groups: the most that a block of the group can score, by more than rounding."""
    _, cents, _, radius, norm = known
    size = np.sqrt((q ** 2).sum(1))[:, None]
    most = np.minimum(q @ cents.T + size * radius, size * norm)
    return most + FLOOR_SLACK * size * (norm + radius)


def first_groups(most: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Queries x groups: whether a group is among those of highest bound that together hold ``k`` blocks."""
    order = np.argsort(-most, axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    chosen = np.zeros(most.shape, dtype=bool)
    np.put_along_axis(chosen, order, before < k, axis=1)
    return chosen


def _probes(rows: DataFrame, known, k: int, floors: bool) -> DataFrame:
    """Query x group probes from ``(qid, v[, floor])``: the first groups, or with floors all others that reach them."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def choose(batches):
        known = sent.value
        for b in batches:
            if b.num_rows == 0 or len(known[0]) == 0:
                continue
            most = upper_bounds(vectors_to_matrix(b.column(1)), known)
            chosen = first_groups(most, known[2], k)
            if floors:
                low = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                chosen = ~chosen & (most >= np.where(np.isnan(low), -np.inf, low)[:, None])
            r, g = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(known[0][g])], names=["qid", "block_id"])

    return rows.mapInArrow(choose, PROBES)


def mips_pruned(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int = 10, *, qid_col: str = "qid",
                vec_col: str = "embedding", bounds: DataFrame | None = None, with_work: bool = False, **probe):
    """``qid_col, rank, block_id, score`` -- the rows of ``mips_exact`` over the blocks of ``assigned`` (each in one leaf).

    ``bounds``: a written :func:`group_bounds` of the index. ``with_work``: also a DataFrame ``(qid, groups, blocks)`` of what
    each query was scored against. ``probe`` goes to ``ivf_probe``."""
    spark = queries.sparkSession

    def kept(df, name):
        path = scratch_path(spark, f"pruned-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    known = _bounds(bounds if bounds is not None else group_bounds(assigned, centroids, vec_col), centroids)
    rows = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(vec_col).cast("array<double>").alias("v"))
    search = dict(qid_col="qid", vec_col="v", **probe)
    blocks = assigned.select("block_id", "leaf", F.col(vec_col).cast("array<double>").alias("v"))
    first = kept(_probes(rows, known, k, False), "first")
    hits = kept(ivf_probe(rows, blocks, centroids, 0, k, probes=first, **search), "hits")
    floor = hits.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    rest = kept(_probes(rows.join(floor, "qid", "left").select("qid", "v", "floor"), known, k, True), "rest")
    more = ivf_probe(rows, blocks, centroids, 0, k, probes=rest, **search)
    out = topk_rank(hits.drop("rank").unionByName(more.drop("rank")), "qid", [F.desc("score"), F.asc("block_id")], k)
    out = out.select(F.col("qid").alias(qid_col), F.col("rank").cast("long").alias("rank"), "block_id", "score")
    if not with_work:
        return out
    sizes = spark.createDataFrame([(int(g), int(n)) for g, n in zip(known[0], known[2])], "leaf long, n long")
    work = (first.unionByName(rest).select("qid", F.col("block_id").alias("leaf")).join(F.broadcast(sizes), "leaf")
            .groupBy("qid").agg(F.count("*").alias("groups"), F.sum("n").alias("blocks")))
    return out, work
