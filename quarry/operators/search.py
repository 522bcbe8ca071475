"""Exact maximum-inner-product search and top-k ranking.

``mips_exact`` never materialises query x block pairs as rows. Scores are
computed inside tasks with a NumPy matrix product on Arrow batches, each task
keeps a running top-k per query, and only ``k`` candidates per query per task
leave it. A final ``row_number() <= k`` window (planned as a partial + final
``WindowGroupLimit``) merges candidates per query.

Physical shapes, chosen from row totals:

* **broadcast queries** (queries and their lists within ``TASK_BYTES``): the block
  table is streamed with ``mapInArrow`` -- it is never shuffled.
* **broadcast blocks** (more queries, block vectors within ``BLOCK_SIDE_BYTES``): the queries are streamed.
* **passes** (query matrix within ``broadcast_bytes``): the queries are dealt into parts of ``TASK_BYTES`` by a hash and
  each part is searched as above; what the driver and a task hold doesn't grow with the tables.
* **tiled** (larger query sets): queries are hashed into ``Q`` tiles and blocks
  into ``B`` tiles; each query row is replicated to the ``B`` block tiles and
  each block row to the ``Q`` query tiles (``explode(sequence)``, a bounded
  fan-out), and ``cogroup(...).applyInPandas`` scores one (query tile, block
  tile) pair per group. Group memory is bounded by the tile sizes.

Ties: score descending, then the smaller block id first.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import scratch_path, spread

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("block_id", T.LongType()),
    T.StructField("score", T.DoubleType())])

QUERY_CHUNK, BLOCK_CHUNK = 1024, 4096   # a score tile holds at most this many queries x blocks
SCREEN_CHUNK = 512                # blocks scored at once where every query has a bound: the scores stay in the cache of a core
FLOOR_SAMPLE = 65_536             # blocks whose scores give every query a lower bound for its k-th score
PAIRS_PER_TASK = 5_000_000_000    # ~1 min of scoring per task at ~7e7 pairs/s/core
CANDIDATE_ROWS_BUDGET = 2_000_000_000   # tasks x queries x k rows entering the merge shuffle
FLOOR_SLACK = 1e-9
PAIRS_AT_ONCE = 1 << 15
TASK_BYTES = 96 << 20             # queries and their lists that a task of Python holds; more queries are searched in passes
BLOCK_SIDE_BYTES = 64 << 20       # block vectors up to this size are sent to streamed queries rather than in passes
FLOOR_ROWS = 10_000_000           # above so many, tasks emit only rows that reach a sampled lower bound


def topk_rank(df: DataFrame, partition_by, order_by, k: int, rank_col: str = "rank") -> DataFrame:
    """Keep the best ``k`` rows per partition key; adds a 1-based ``rank``."""
    pcols = [partition_by] if isinstance(partition_by, (str, Column)) else list(partition_by)
    w = Window.partitionBy(*pcols).orderBy(*order_by)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# ---------------------------------------------------------------------------
# NumPy kernel
# ---------------------------------------------------------------------------

class _Best:
    """The best ``k`` scores of each of ``n`` queries (score descending, id ascending). What comes in is sorted only when
    enough has come; ``low`` holds each query's k-th score so far. ``once``: a block counts once, with its best score."""

    def __init__(self, n: int, k: int, once: bool):
        self.k, self.once, self.low = k, once, np.full(n, -np.inf)
        self.kept = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.more, self.size = [], 0

    def add(self, row: np.ndarray, score: np.ndarray, block: np.ndarray):
        self.more.append((row, score, block))
        self.size += len(row)
        if self.size > max(self.k * len(self.low), 1 << 12):
            self.settled()

    def settled(self):
        if self.more:
            r, s, i = (np.concatenate(x) for x in zip(self.kept, *self.more))
            if self.once:
                order = np.lexsort((-s, i, r))
                r, s, i = r[order], s[order], i[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
                r, s, i = r[new], s[new], i[new]
            order = np.lexsort((i, -s, r))
            r, s, i = r[order], s[order], i[order]
            at = np.arange(len(r)) - np.searchsorted(r, np.arange(len(self.low)))[r]
            last = at == self.k - 1
            self.low[r[last]] = s[last]
            self.kept = (r[at < self.k], s[at < self.k], i[at < self.k])
            self.more, self.size = [], 0
        return self.kept


def products(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; a pair's product is the same wherever it is computed."""
    return (q * b).sum(1)


def _reaching(asking: np.ndarray, blocks: np.ndarray, bound: np.ndarray, slack: np.ndarray, k: int):
    """``(rows, columns)`` of the scores that don't lie below their row's ``bound`` (a score that isn't a number reaches it).
    A row without a bound gets that of its ``k`` best in the tile. Most rows of a tile have no such score once their bounds
    have grown: a row is looked into only when its greatest score reaches."""
    down = asking.dtype.type(-np.inf)

    def rounded(x):   # down, so that the comparison in the tile's precision loses nothing
        return np.nextafter(x.astype(asking.dtype), down)

    new = np.isneginf(bound) if len(blocks) > k else np.zeros(len(bound), bool)
    if new.any():
        whole = new.all()
        scores, kth = (asking if whole else asking[new]) @ blocks.T, len(blocks) - k
        bound = bound.copy()
        bound[new] = np.partition(scores, kth, axis=1)[:, kth] - 2 * slack[new]
        if whole:
            yield np.divmod(np.flatnonzero(~(scores < rounded(bound)[:, None])), len(blocks))
            return
    bound = rounded(bound)
    for lo in range(0, len(blocks), SCREEN_CHUNK):
        scores = asking @ blocks[lo:lo + SCREEN_CHUNK].T
        rows = np.flatnonzero(~(scores.max(1) < bound))
        if len(rows):
            place = np.flatnonzero(~(scores[rows] < bound[rows, None]))
            r, c = np.divmod(place, scores.shape[1])
            yield rows[r], c + lo


class TopK:
    """Running top-k of a fixed query matrix against streamed block batches.

    A tile of scores is made in single precision. Only pairs that reach a query's k-th score so far, less what rounding can
    make of it, are scored in double precision, and only these count."""

    def __init__(self, qmat: np.ndarray, k: int, once: bool = False):
        self.q = np.asarray(qmat, dtype=np.float64)
        self.q32 = self.q.astype(np.float32)
        self.size = np.sqrt((self.q ** 2).sum(1))
        self.best = [_Best(min(QUERY_CHUNK, len(self.q) - lo), k, once) for lo in range(0, len(self.q), QUERY_CHUNK)]
        self.k = k

    def update(self, bmat: np.ndarray, bids: np.ndarray, only: np.ndarray | None = None, exact=None, norm: float = 0.0):
        """``only``: sorted places of the queries that the blocks are for; ``exact(queries, blocks)``: the scores of pairs,
        given as places, in place of products, ``norm`` a bound on the length of what they multiply the queries with."""
        if len(bids) == 0 or len(self.q) == 0:
            return
        for lo in range(0, len(bids), BLOCK_CHUNK):
            tile = np.asarray(bmat[lo:lo + BLOCK_CHUNK], dtype=np.float64)
            widest = max(norm, float(np.sqrt((tile ** 2).sum(1).max())))
            plain = np.isfinite(widest) and widest < 1e15 and bool((self.size < 1e15).all())
            low = tile.astype(np.float32) if plain else tile
            for n, best in enumerate(self.best):
                first = n * QUERY_CHUNK
                if only is None:
                    at = slice(first, first + len(best.low))
                    low_of = best.low
                else:
                    at = only[np.searchsorted(only, first):np.searchsorted(only, first + len(best.low))]
                    if not len(at):
                        continue
                    low_of = best.low[at - first]
                asking = (self.q32 if plain else self.q)[at]
                # twice the bound on the rounding of a product of such vectors in the tile's precision
                slack = self.size[at] * widest * ((tile.shape[1] + 8) * (2.0 ** -23 if plain else 2.0 ** -52)) + 1e-30
                for r, c in _reaching(asking, low, low_of - slack, slack, self.k):
                    q = r + first if only is None else at[r]
                    for i in range(0, len(q), PAIRS_AT_ONCE):
                        some, b = q[i:i + PAIRS_AT_ONCE], c[i:i + PAIRS_AT_ONCE]
                        s = products(self.q[some], tile[b]) if exact is None else exact(some, lo + b)
                        best.add(some - first, s, bids[lo + b])
                if best.size and 4 * np.isneginf(low_of).sum() > len(best.low):
                    best.settled()     # the next tile finds the bounds of many queries

    def kept(self):
        """``(place of the query, score, block)`` by query and rank, a part at a time."""
        for n, best in enumerate(self.best):
            r, s, i = best.settled()
            yield r + n * QUERY_CHUNK, s, i

    def batches(self, qids: np.ndarray, floor: np.ndarray | None = None):
        """The kept rows; with ``floor`` those that reach their query's lower bound."""
        for r, s, i in self.kept():
            if floor is not None:
                use = s >= floor[r]
                r, s, i = r[use], s[use], i[use]
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(qids[r], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())],
                                                 schema=_CAND_ARROW)

    def frame(self, qids: np.ndarray):
        """All kept rows as a pandas frame."""
        return pa.Table.from_batches(self.batches(qids), schema=_CAND_ARROW).to_pandas()


_CAND_ARROW = pa.schema([("qid", pa.int64()), ("block_id", pa.int64()), ("score", pa.float64())])


def vectors_to_matrix(col, dim: int | None = None) -> np.ndarray:
    """Arrow list<float> column -> float64 matrix; every row must have the same width."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.empty((0, dim or 0), dtype=np.float64)
    lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    d = int(lengths[0]) if dim is None else dim
    if (lengths != d).any():
        raise ValueError(f"vector widths differ (expected {d})")
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, d)


# ---------------------------------------------------------------------------
# Public operator
# ---------------------------------------------------------------------------

def mips_exact(queries: DataFrame, blocks: DataFrame, k: int = 10, *, qid_col: str = "sample_id",
               vec_col: str = "embedding", block_id_col: str = "block_id",
               broadcast_bytes: int = 512 << 20, query_tile_rows: int = 1 << 14,
               block_tile_rows: int = 1 << 16) -> DataFrame:
    """Top-``k`` blocks per query by inner product: ``qid_col, rank, block_id, score``."""
    q = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(vec_col).alias("v"))
    b = blocks.select(F.col(block_id_col).cast("long").alias("block_id"), F.col(vec_col).alias("v"))
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()  # one pass
    nq, dim = int(stats["n"]), int(stats["d"] or 0)
    part = queries_a_pass(dim, k)
    if nq <= part and nq * max(dim, 1) * 8 <= broadcast_bytes:
        # Each block task emits at most k candidates per query: size the tasks by work
        # (query x block pairs), not by input splits. coalesce() only ever merges splits (narrow).
        # With many tasks the merge would grow with them, so a sample of the blocks
        # first gives every query a lower bound for its k-th score, and tasks emit
        # only rows that reach it (the same result; about k x blocks / sample rows).
        nb = b.count()
        sc = q.sparkSession.sparkContext
        lo = max(1, math.ceil(nq * nb / PAIRS_PER_TASK))               # tasks never run too long
        hi = max(lo, CANDIDATE_ROWS_BUDGET // max(1, nq * k))           # merge volume stays bounded
        tasks = min(max(sc.defaultParallelism, lo), hi)
        floor = _floor(q, b, nq, nb, k, dim) if tasks * nq * k > FLOOR_ROWS else None
        cands = _broadcast_path(q, spread(b).coalesce(tasks), k, dim, floor)
    else:
        nb = b.count()
        if nb * max(dim, 1) * 8 <= min(broadcast_bytes, BLOCK_SIDE_BYTES):
            # dealt by work, so that a few large partitions don't hold all queries
            tasks = max(q.sparkSession.sparkContext.defaultParallelism, math.ceil(nq * nb / PAIRS_PER_TASK), math.ceil(nq / part))
            return _broadcast_blocks(q.repartition(tasks, "qid"), b, k, dim, qid_col)
        if nq * max(dim, 1) * 8 <= broadcast_bytes:
            cands = _passes(q, b, k, dim, nq, nb, part)
        else:
            cands = _tiled_path(q, b, k, nq, query_tile_rows, block_tile_rows)
    ranked = topk_rank(cands, "qid", [F.desc("score"), F.asc("block_id")], k)
    return ranked.select(F.col("qid").alias(qid_col), F.col("rank").cast("long").alias("rank"),
                         "block_id", "score")


def queries_a_pass(dim: int, k: int, probes: int = 0) -> int:
    """Queries whose vectors, lists of ``k`` and probes fit ``TASK_BYTES``."""
    return max(QUERY_CHUNK, TASK_BYTES // max(1, dim * 12 + k * 72 + probes * 16))


def parted(df: DataFrame, qid_col: str, n: int, name: str) -> list:
    """``df`` written once and read back in ``n`` parts by a hash of the query, the same for every table."""
    path = scratch_path(df.sparkSession, name)
    part = F.pmod(F.xxhash64(F.col(qid_col).cast("long")), F.lit(n)).cast("int")
    df.withColumn("_part", part).repartition(n, "_part").write.partitionBy("_part").parquet(path)
    stored = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path)
    return [stored.where(F.col("_part") == i).select(*df.columns) for i in range(n)]


def _passes(q: DataFrame, b: DataFrame, k: int, dim: int, nq: int, nb: int, part: int) -> DataFrame:
    """The broadcast path for one part of the queries after the other: neither the driver nor a task holds more than one.
    A pass has few tasks, as the passes run side by side, so few candidates are merged."""
    spark = q.sparkSession
    n = math.ceil(nq / part)
    path = scratch_path(spark, "searched")
    spread(b).write.parquet(path)
    b = spark.read.schema(b.schema).parquet(path)
    tasks = max(math.ceil(part * nb / PAIRS_PER_TASK), math.ceil(spark.sparkContext.defaultParallelism / n))
    found = [_broadcast_path(one, b.coalesce(tasks), k, dim) for one in parted(q, "qid", n, "queries")]
    return functools.reduce(DataFrame.union, found)


def _to_matrix(df: DataFrame, id_col: str, dim: int):
    """Columnar (Arrow) transfer of a size-checked vector table to ids + float64 matrix."""
    t = df.select(id_col, "v").toArrow()
    ids = t.column(id_col).to_numpy().astype(np.int64)
    mat = vectors_to_matrix(t.column("v"), dim) if len(ids) else np.empty((0, dim))
    return ids, mat  # float64, as in every other path: equal scores whatever the path


def _floor(q: DataFrame, b: DataFrame, nq: int, nb: int, k: int, dim: int) -> dict:
    """``qid -> score`` of the query's k-th best block in a keyed sample of the blocks (a row per query)."""
    share = min(1.0, FLOOR_SAMPLE / max(nb, 1))
    some = b.where(F.pmod(F.xxhash64("block_id", F.lit(29)), F.lit(1 << 31)) < int(share * (1 << 31)))
    ranked = topk_rank(_broadcast_path(q, some, k, dim), "qid", [F.desc("score"), F.asc("block_id")], k)
    rows = ranked.where(F.col("rank") == k).select("qid", "score").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def _broadcast_path(q: DataFrame, b: DataFrame, k: int, dim: int, floor: dict | None = None) -> DataFrame:
    spark = q.sparkSession
    qids, qmat = _to_matrix(q, "qid", dim)  # size-checked by the caller against broadcast_bytes
    low = None
    if floor is not None:
        # A product may differ in its last bits with the shape of its tile: the bound gives way by more than that
        # (against the largest product the query can have with the blocks' largest norm); the final rank is exact.
        low = np.array([floor.get(int(i), -np.inf) for i in qids])
        widest = b.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] or 0.0
        low = low - FLOOR_SLACK * np.sqrt((qmat.astype(np.float64) ** 2).sum(1) * widest)
    bc = spark.sparkContext.broadcast((qids, qmat, low))

    def score_partition(batches):
        ids, mat, low = bc.value
        top = TopK(mat, k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            bm = vectors_to_matrix(batch.column("v"), mat.shape[1])
            top.update(bm, batch.column("block_id").to_numpy(zero_copy_only=False).astype(np.int64))
        yield from top.batches(ids, low)

    return b.mapInArrow(score_partition, CANDIDATE_SCHEMA)


def _broadcast_blocks(q: DataFrame, b: DataFrame, k: int, dim: int, qid_col: str,
                      carry_vectors: bool = False) -> DataFrame:
    """Small block side (e.g. centroids): broadcast it and stream the queries.

    Every query sees all blocks inside one task, so its top-k is final: no merge
    shuffle at all."""
    spark = q.sparkSession
    bids, bmat = _to_matrix(b, "block_id", dim)  # size-checked by the caller against broadcast_bytes
    order = np.argsort(bids, kind="stable")
    bc = spark.sparkContext.broadcast((bids[order], bmat[order]))
    fields = [T.StructField(qid_col, T.LongType()), T.StructField("rank", T.LongType()),
              T.StructField("block_id", T.LongType()), T.StructField("score", T.DoubleType())]
    if carry_vectors:
        fields.append(T.StructField("v", q.schema["v"].dataType))
    schema = T.StructType(fields)
    names = [f.name for f in fields]

    def score_queries(batches):
        ids, mat = bc.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            qm = vectors_to_matrix(batch.column("v"), mat.shape[1] if mat.shape[0] else None)
            top = TopK(qm, k)
            top.update(mat, ids)
            qids = batch.column("qid").to_numpy(zero_copy_only=False).astype(np.int64)
            for r, score, block in top.kept():
                rank = np.arange(1, len(r) + 1) - np.searchsorted(r, r)
                cols = [pa.array(qids[r], pa.int64()), pa.array(rank, pa.int64()), pa.array(block, pa.int64()), pa.array(score, pa.float64())]
                if carry_vectors:
                    cols.append(batch.column("v").take(pa.array(r)))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return q.mapInArrow(score_queries, schema)


def topk_small_side(queries: DataFrame, small: DataFrame, k: int, *, qid_col: str, small_id_col: str,
                    vec_col: str = "embedding", max_bytes: int = 512 << 20,
                    carry_vectors: bool = False) -> DataFrame:
    """Top-k of a bounded, broadcast ``small`` set (e.g. centroids) for every query:
    ``qid_col, rank, block_id, score[, v]`` (``v``: the query vector, carried so
    callers need no join back). Raises if ``small`` exceeds ``max_bytes``."""
    q = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(vec_col).alias("v"))
    b = small.select(F.col(small_id_col).cast("long").alias("block_id"), F.col(vec_col).alias("v"))
    dim_row = b.select(F.size("v").alias("d")).head(1)
    dim = int(dim_row[0]["d"]) if dim_row else 0
    if b.count() * max(dim, 1) * 8 > max_bytes:
        raise ValueError("small side exceeds its broadcast bound")
    return _broadcast_blocks(q, b, k, dim, qid_col, carry_vectors)


def _tiled_path(q: DataFrame, b: DataFrame, k: int, nq: int, query_tile_rows: int,
                block_tile_rows: int) -> DataFrame:
    nb = b.count()
    n_qt = max(1, math.ceil(nq / query_tile_rows))
    n_bt = max(1, math.ceil(nb / block_tile_rows))
    qt = (q.withColumn("qt", F.pmod(F.xxhash64("qid"), F.lit(n_qt)))
           .withColumn("bt", F.explode(F.sequence(F.lit(0), F.lit(n_bt - 1)))))
    bt = (b.withColumn("bt", F.pmod(F.xxhash64("block_id"), F.lit(n_bt)))
           .withColumn("qt", F.explode(F.sequence(F.lit(0), F.lit(n_qt - 1)))))

    def score_tile(qpdf, bpdf):
        import pandas as pd
        if len(qpdf) == 0 or len(bpdf) == 0:
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "block_id": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="float64")})
        qm = np.stack(qpdf["v"].to_numpy()).astype(np.float64)
        top = TopK(qm, k)
        bm = np.stack(bpdf["v"].to_numpy()).astype(np.float64)
        top.update(bm, bpdf["block_id"].to_numpy(dtype=np.int64))
        return top.frame(qpdf["qid"].to_numpy(dtype=np.int64))

    return (qt.groupBy("qt", "bt").cogroup(bt.groupBy("qt", "bt"))
              .applyInPandas(score_tile, CANDIDATE_SCHEMA))
