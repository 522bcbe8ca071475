"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

An entry c becomes the whole number x = floor(1024 c) + 100000. With X the rows of whole numbers less their
mean, the bidiagonalisation alternates u = X v and X'u over the distributed rows::

    alpha_j u_j = X v_j - beta_(j-1) u_(j-1)        beta_j v_(j+1) = X'u_j - alpha_j v_j

Both sides are fully reorthogonalised. The long vectors u_j are never stored: each is X p_j for a short vector
p_j that follows the same recurrence, so one pass over the rows gives u = X p and z = X'u together, and the
inner products of the u's that the reorthogonalisation needs are those of the p's with the z's. The small
bidiagonal matrix's SVD gives components (right vectors) and deviations (singular values over sqrt n).

By default there are as many steps as dimensions. The Krylov space is then the whole space and equal
eigenvalues, which one Krylov sequence cannot tell apart, are all found: a sequence that ends early goes on
from a fresh vector orthogonal to all before it. ``steps`` cuts this for wide vectors whose first components
stand apart; a step is one pass.

A pass sends one short vector per task to the driver, from at most ``TASKS`` tasks (the scan is coalesced to
them), added in the order of the partitions, so a lost executor's repeated task changes nothing. Sums of whole
numbers are exact. Nothing is keyed, so repeated vectors, however many, cause no skew.

Defined results: a vector that is null or holds a null, NaN or infinite entry is left out, as is one whose
length is not the most frequent one (the longer of equally frequent ones; empty vectors don't count); entries are
limited to 2^48 after scaling; a null ``vec_id`` stays null; repeated rows are rows of their own; as many
components come out as the covariance has eigenvalues above 1e-12 of the largest (none where all vectors are
equal); a ``deviation`` beyond a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import written

SCALE, SHIFT = 1024, 100000
LIMIT = float(1 << 48)
COMPONENTS = 8
TASKS = 1024
SMALLEST = 1e-12
BREAKDOWN = 1e-10


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the vectors without missing or non-finite entries."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("_v")).where(F.col("_v").isNotNull())
    bad = F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform("_v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))).cast("long") + SHIFT)
    return rows.where((F.size("_v") > 0) & ~bad).select("vec_id", whole.alias("x"))


class Rows:
    """The fit list: whole-number rows of one width, their number and exact sums, and passes over them."""

    def __init__(self, whole: DataFrame):
        widths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.d = widths["d"] if widths else 0
        self.table = whole.where(F.size("x") == self.d)
        self.n, self.sums = 0, [0] * self.d
        if self.d:
            self.table = written(self.table, "whitening")
            for count, *sums in self._partials(_exact_sums(self.d), "s array<string>", "s"):
                self.n += int(count)
                self.sums = [a + int(b) for a, b in zip(self.sums, sums)]
        #: mean = low + rest: a whole number taken off exactly and a fraction below one.
        self.low = np.array([s // self.n for s in self.sums] if self.n else [], dtype=np.int64)
        self.rest = np.array([s % self.n / self.n for s in self.sums] if self.n else [], dtype=np.float64)

    def _partials(self, fn, schema: str, col: str) -> list:
        found = self.table.select("x").coalesce(TASKS).mapInArrow(fn, f"part int, {schema}").collect()
        return [r[col] for r in sorted(found, key=lambda r: r["part"])]

    def total(self, fn, size: int) -> np.ndarray:
        """Sum over all rows of ``fn(centred block) -> vector``."""
        out = np.zeros(size)
        for part in self._partials(_block_sums(fn, self.low, self.rest, size), "s array<double>", "s"):
            out += np.array(part)
        return out


def _centred(batch, low, rest) -> np.ndarray:
    return (batch.column("x").flatten().to_numpy().reshape(-1, len(low)) - low) - rest


def _exact_sums(d: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        n, sums = 0, [0] * d
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            n += len(x)
            for k in range(0, len(x), 8192):  # 8192 entries of at most 2^48 and a bit stay below 2^63
                sums = [a + int(c) for a, c in zip(sums, x[k:k + 8192].sum(axis=0))]
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          "s": pa.array([[str(n)] + [str(s) for s in sums]], pa.list_(pa.string()))})
    return run


def _block_sums(fn, low, rest, size: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        out = np.zeros(size)
        for b in batches:
            if b.num_rows:
                out += fn(_centred(b, low, rest))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          "s": pa.array([out.tolist()], pa.list_(pa.float64()))})
    return run


def _two_products(p):
    """u = X p and then X'u, of a block of rows."""
    return lambda x: x.T @ (x @ p)


def _against(w: np.ndarray, basis: list) -> np.ndarray:
    """``w`` less its parts along the orthonormal ``basis``, taken off twice."""
    for _ in range(2):
        for v in basis:
            w = w - (v @ w) * v
    return w


def _fresh(d: int, basis: list, seed: int) -> np.ndarray:
    w = _against(np.random.default_rng(seed).standard_normal(d), basis)
    return w / np.linalg.norm(w)


def bidiagonalise(product, d: int, steps: int | None = None):
    """``(V, B)`` with X V = U B: columns of V orthonormal, B upper bidiagonal (``steps`` wide, all of ``d`` by default).

    ``product(p)`` is X'(X p). The scale of the first step decides what counts as zero.
    """
    steps = min(steps or d, d)
    vs, ps, zs, alphas, betas = [_fresh(d, [], 0)], [], [], [], []
    scale = 0.0
    for j in range(steps):
        v = vs[j]
        p = v - betas[j - 1] * ps[j - 1] if j else v
        z = product(p)
        for _ in range(2):  # u = X p against the earlier u's, by their short forms
            for pi, zi in zip(ps, zs):
                c = zi @ p
                p, z = p - c * pi, z - c * zi
        alpha = float(np.sqrt(max(p @ z, 0.0)))
        scale = max(scale, alpha)
        if alpha <= BREAKDOWN * scale or alpha == 0.0:
            alpha, p, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, z = p / alpha, z / alpha
        alphas.append(alpha)
        ps.append(p)
        zs.append(z)
        if j + 1 == steps:
            break
        w = _against(z - alpha * v, vs)
        beta = float(np.linalg.norm(w))
        if beta <= BREAKDOWN * scale or beta == 0.0:
            beta, w = 0.0, _fresh(d, vs, j + 1)
        else:
            w = w / beta
        betas.append(beta)
        vs.append(w)
    b = np.diag(alphas)
    for j, beta in enumerate(betas):
        b[j, j + 1] = beta
    return np.array(vs).T, b


class Whitening:
    """Components (columns), their variances, the covariance's trace and the fit list they come from."""

    def __init__(self, rows: Rows, components: int = COMPONENTS, steps: int | None = None):
        self.rows = rows
        d = rows.d
        self.components, self.variances, self.trace = np.zeros((d, 0)), np.zeros(0), 0.0
        if rows.n == 0:
            return
        v, b = bidiagonalise(lambda p: rows.total(_two_products(p), d), d, steps)
        _, s, qt = np.linalg.svd(b)
        e = s ** 2 / rows.n
        keep = int(np.sum(e[:components] > SMALLEST * e[0])) if e[0] > 0 else 0
        found = v @ qt.T[:, :keep]
        for j in range(keep):  # either sign will do: the entry of largest size is positive
            c = found[:, j]
            found[:, j] = c / np.linalg.norm(c) * (1 if c[np.argmax(np.abs(c))] > 0 else -1)
        self.components, self.variances = found, e[:keep]
        self.trace = rows.total(lambda x: np.array([np.einsum("ij,ij->", x, x)]), 1)[0] / rows.n

    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)

    def identity_error(self) -> float:
        """Largest entry of the whitened rows' covariance less the identity."""
        m, k = self.matrix(), len(self.variances)
        if k == 0:
            return 0.0
        mean = self.rows.total(lambda x: (x @ m).sum(axis=0), k) / self.rows.n
        cov = self.rows.total(lambda x: (lambda w: (w.T @ w).ravel())(x @ m - mean), k * k).reshape(k, k) / self.rows.n
        return float(np.abs(cov - np.eye(k)).max())

    def transform(self) -> DataFrame:
        """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row per vector and component."""
        rows, m, k = self.rows, self.matrix(), len(self.variances)
        vec_id = rows.table.schema["vec_id"].dataType
        schema = T.StructType([T.StructField("vec_id", vec_id), T.StructField("component", T.IntegerType()),
                               T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                               T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                               T.StructField("identity_error", T.DoubleType())])
        if k == 0:
            return rows.table.sparkSession.createDataFrame([], schema)
        n, low, rest, over = rows.n, rows.low, rows.rest, np.array([s % rows.n for s in rows.sums], dtype=object)
        explained, error = self.variances / self.trace, self.identity_error()

        def run(batches):
            import pyarrow as pa
            for b in batches:
                if not b.num_rows:
                    continue
                x = _centred(b, low, rest)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n, dtype=np.int64)), pa.array(_deviations(b, low, over, n), pa.int64()).take(at),
                    pa.array((x @ m).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return rows.table.mapInArrow(run, schema)


def _deviations(batch, low, over, n: int) -> list:
    """Per row the sum of (n x - S)^2, exact: S = n low + over, so n x - S = n (x - low) - over."""
    off = batch.column("x").flatten().to_numpy().reshape(-1, len(low)) - low
    if (n * (float(np.abs(off).max()) + 1.0)) ** 2 * len(low) < 2.0 ** 62:
        return ((n * off - over.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * off.astype(object) - over) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, steps: int | None = None, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    return Whitening(Rows(whole_numbers(vectors, id_col, vector_col)), components, steps).transform()
