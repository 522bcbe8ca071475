"""Leaves of the approximate index: oversampled starts, a second leaf per vector, and packed codes of residuals.

* ``oversampled_starts``: k-means|| -- a few rounds in which every row becomes a candidate with a probability in
  proportion to its squared distance from the candidates so far (a keyed draw per row and round), then the
  candidates, weighted by the rows nearest to them, are thinned to the number of leaves. All distances are whole
  numbers and their sum is exact, so the starts depend on the data alone.
* ``second_leaf``: every vector also goes to the leaf for which |r'|^2 + (r.r' / |r|)^2 is least, r and r' being its
  residuals in the first leaf and in that one: a query for which the first leaf looks bad (r lies along the query)
  is then likely to meet the vector in the second.
* ``residual_books`` / ``residual_codes``: codebooks of residuals to the leaf's centroid and their codes, two to a
  byte in a ``BINARY`` (a sub-space with an even number in the low half). Scores add the leaf's term back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.keyed import hash32
from quarry.operators import ann as AN
from quarry.params import PQ_DIMS_PER_BLOCK, SEED

START_ROUNDS, OVERSAMPLING = 4, 2


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres (whole numbers below 2**53: exact)."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def draw(seed: int, name: str, id_col: str):
    return (hash32(F.lit(seed), F.lit(name), F.col(id_col)).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def oversampled_starts(rows: DataFrame, num_leaves: int, *, seed: int = SEED, rounds: int = START_ROUNDS,
                       id_col: str = "block_id", vec_col: str = "embedding") -> np.ndarray:
    """At most ``num_leaves`` starting centroids as whole numbers (fewer where there are fewer different rows).

    A round reads the rows twice (sum of the distances, draw); about ``OVERSAMPLING * num_leaves`` candidates come to
    the driver in all, plus the ``num_leaves`` rows first in hash order, so that there are always enough."""
    from quarry.operators.sampling import hash_sample
    spark = rows.sparkSession
    rows = rows.select(id_col, vec_col)

    def gathered(df):
        t = df.select(id_col, vec_col).toArrow()
        return AN._fixed_point(t.column(vec_col))[np.argsort(t.column(id_col).to_numpy(), kind="stable")]

    cands = gathered(hash_sample(rows, id_col, 1, seed))
    per_round = OVERSAMPLING * num_leaves / rounds
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(cands)

        def nearest(batches):
            for b in batches:
                d = _squared(AN._fixed_point(b.column(1)), sent.value).min(1) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d, pa.float64())], names=[*b.schema.names, "d"])

        schema = T.StructType([*rows.schema.fields, T.StructField("d", T.DoubleType())])
        far = rows.mapInArrow(nearest, schema)
        total = float(far.agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0] or 0)
        if not total:
            break
        drawn = gathered(far.where(draw(seed, f"start{k}", id_col) * F.lit(total) < F.lit(per_round) * F.col("d")))
        if len(drawn):
            cands = np.concatenate([cands, drawn])
    cands = np.concatenate([cands, gathered(hash_sample(rows, id_col, num_leaves, seed))])
    sent = spark.sparkContext.broadcast(cands)

    def weigh(batches):
        count = np.zeros(len(sent.value), np.int64)
        for b in batches:
            if b.num_rows:
                count += np.bincount(_squared(AN._fixed_point(b.column(0)), sent.value).argmin(1), minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["c", "n"])

    weights = np.zeros(len(cands))
    for r in rows.select(vec_col).mapInArrow(weigh, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        weights[r["c"]] = r["n"]
    return thinned(cands, weights, num_leaves)


def thinned(cands: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The heaviest candidate, then again and again that with the largest weight times squared distance from those taken
    (the first of equal ones), until ``n`` are taken or none is left apart from them."""
    taken, far = [int(weights.argmax())], np.full(len(cands), np.inf)
    while len(taken) < n:
        far = np.minimum(far, _squared(cands, cands[taken[-1:]])[:, 0])
        gain = weights * far
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        taken.append(best)
    return cands[taken]


def second_leaf(assigned: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``assigned`` with a row per vector and leaf: the first and the second, and ``spill`` 0 or 1."""
    cents = whole_centroids(centroids)
    sent = assigned.sparkSession.sparkContext.broadcast(cents)
    v, at = assigned.columns.index(vec_col), assigned.columns.index("leaf")
    names = [*assigned.columns, "spill"]
    schema = T.StructType([*assigned.schema.fields, T.StructField("spill", T.IntegerType())])

    def both(batches):
        c = sent.value
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(n, np.int32))], names=names)
            if n and len(c) > 1:
                x, first = AN._fixed_point(b.column(v)), b.column(at).to_numpy()
                cols = list(b.columns)
                cols[at] = pa.array(spilled_to(x, c, first), pa.int64())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.ones(n, np.int32))], names=names)

    return assigned.mapInArrow(both, schema)


def spilled_to(x: np.ndarray, c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row the leaf (other than ``first``) with the least |r'|^2 + (r.r')^2 / |r|^2, the lowest of equal ones."""
    xc, c1 = x @ c.T, c[first]
    xx = (x * x).sum(1)
    along = xx[:, None] - xc - (x * c1).sum(1)[:, None] + c1 @ c.T
    own = xx - 2 * (x * c1).sum(1) + (c1 * c1).sum(1)
    cost = xx[:, None] - 2 * xc + (c * c).sum(1)[None, :]
    cost = cost + np.where(own[:, None] > 0, along * along / np.where(own > 0, own, 1)[:, None], 0)
    cost[np.arange(len(x)), first] = np.inf
    return cost.argmin(1)


def whole_centroids(centroids: DataFrame) -> np.ndarray:
    """Leaves x dimensions, as the whole numbers the leaves were trained in."""
    rows = centroids.orderBy("leaf").collect()   # one row a leaf
    return np.rint(np.array([r["embedding"] for r in rows], dtype=np.float64) * AN.SCALE)


def _residuals(batch, v: int, at: int, c: np.ndarray) -> np.ndarray:
    return AN._fixed_point(batch.column(v)) - c[batch.column(at).to_numpy()]


def residual_books(assigned: DataFrame, centroids: DataFrame, dims_per_block: int = PQ_DIMS_PER_BLOCK, *,
                   training_sample: int | None = None, seed: int = SEED, rounds: int = 10, id_col: str = "block_id",
                   vec_col: str = "embedding") -> DataFrame:
    """Codebooks (``subspace, code, centroid``) of the residuals of first leaves."""
    sent = assigned.sparkSession.sparkContext.broadcast(whole_centroids(centroids))

    def rest(batches):
        for b in batches:
            r = _residuals(b, 1, 2, sent.value) / AN.SCALE if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(r), pa.list_(pa.float64()))], names=[id_col, vec_col])

    schema = T.StructType([assigned.schema[id_col], T.StructField(vec_col, T.ArrayType(T.DoubleType()))])
    rows = assigned.select(id_col, vec_col, "leaf").mapInArrow(rest, schema)
    return AN.pq_train(rows, dims_per_block, training_sample=training_sample, seed=seed, rounds=rounds, id_col=id_col, vec_col=vec_col)


def residual_codes(assigned: DataFrame, centroids: DataFrame, books: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``assigned`` with ``codes BINARY`` in the place of its vectors: the nearest code of every sub-space, two to a byte."""
    book, valid = AN._codebook_arrays(books)
    if book.shape[1] > 16:
        raise ValueError("two codes to a byte need codebooks of at most 16")
    sent = assigned.sparkSession.sparkContext.broadcast((whole_centroids(centroids), np.rint(book * AN.SCALE), valid))
    v, at = assigned.columns.index(vec_col), assigned.columns.index("leaf")
    rest = [c for c in assigned.columns if c != vec_col]
    schema = T.StructType([*[assigned.schema[c] for c in rest], T.StructField("codes", T.BinaryType())])

    def encode(batches):
        c, bk, ok = sent.value
        for b in batches:
            packed = pack_codes(nearest_codes(_residuals(b, v, at, c), bk, ok)) if b.num_rows else np.zeros((0, 1), np.uint8)
            cols = [b.column(x) for x in rest] + [pa.array([p.tobytes() for p in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, "codes"])

    return assigned.mapInArrow(encode, schema)


def nearest_codes(r: np.ndarray, book: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Rows x sub-spaces: the nearest code, the lowest of equal ones."""
    n_sub, _, width = book.shape
    r = np.pad(r, ((0, 0), (0, n_sub * width - r.shape[1]))).reshape(len(r), n_sub, width)
    out = np.empty((len(r), n_sub), np.uint8)
    for s in range(n_sub):
        out[:, s] = np.where(valid[s][None], _squared(r[:, s], book[s]), np.inf).argmin(1)
    return out


def pack_codes(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def packed_rows(col, n_sub: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, (n_sub + 1) // 2)


def unpack_codes(col, n_sub: int) -> np.ndarray:
    """Rows x sub-spaces of a ``BINARY`` column, or of its bytes as a matrix."""
    packed = col if isinstance(col, np.ndarray) else packed_rows(col, n_sub)
    out = np.empty((len(packed), 2 * packed.shape[1]), np.int64)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :n_sub]
