"""Sampling and shuffling, all keyed (deterministic, engine independent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.keyed import gumbel_key, hash32
from quarry.operators.ranks import global_rank
from quarry.operators.search import topk_rank
from quarry.params import MAX_BROADCAST_BYTES, NUM_RETRIEVALS, SEED, TEMPERATURE

CHOSEN_ROW_BYTES = 64   # of a broadcast table of chosen ids


def gumbel_sample(retrievals: Column, sample_id: Column, k: int = NUM_RETRIEVALS,
                  temperature: float = TEMPERATURE, seed: int = SEED, epoch=0,
                  allow_fewer: bool = False) -> Column:
    """``k`` draws without replacement from softmax(score / T) over an in-row list.

    Gumbel top-k: each element gets ``score / T - ln(-ln(u))`` with ``u`` keyed on
    (seed, epoch, sample_id, block_id); the ``k`` largest keys win, in descending
    key order (smaller block id first on a tie). Runs inside the row -- no
    explode, no shuffle. Fewer than ``k`` elements is an error unless
    ``allow_fewer``.
    """
    ep = epoch if isinstance(epoch, Column) else F.lit(epoch)
    keyed = F.transform(retrievals, lambda r: F.struct(
        (-gumbel_key(r["score"], temperature, F.lit(seed), ep, sample_id, r["block_id"])).alias("nk"),
        r["block_id"].alias("bid"), r.alias("r")))
    picked = F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["r"])
    if allow_fewer:
        return picked
    return F.when(F.size(retrievals) >= k, picked).otherwise(F.raise_error(F.format_string(
        "sample %s has %d retrievals, %d requested", sample_id.cast("string"), F.size(retrievals),
        F.lit(k))))


def gumbel_sample_rows(candidates: DataFrame, k: int = NUM_RETRIEVALS, temperature: float = TEMPERATURE, seed: int = SEED,
                       epoch=0, id_col: str = "sample_id", block_id_col: str = "block_id", score_col: str = "score") -> DataFrame:
    """The draws of :func:`gumbel_sample` from candidate rows, for any number of candidates per sample: the rows' columns
    with ``draw`` (1 to ``k``).

    Each task keeps the ``k`` largest keys of every sample it meets (the window's group limit runs before the
    shuffle), so a sample with a third of all rows sends k rows a task. Samples with fewer candidates give all of them;
    candidates with a null score have no chance and go last; no rows give no rows."""
    ep = epoch if isinstance(epoch, Column) else F.lit(epoch)
    key = gumbel_key(F.col(score_col), temperature, F.lit(seed), ep, F.col(id_col), F.col(block_id_col))
    out = topk_rank(candidates.withColumn("_key", key), id_col, [F.desc_nulls_last("_key"), F.asc(block_id_col)], k, "draw")
    return out.withColumn("draw", F.col("draw").cast("long")).drop("_key")


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows chosen without replacement by keyed hash order (query_sample, len_sample).

    The limit is the operator itself. A histogram of the hash's top 16 bits (at most 65 536 rows, partial
    aggregation) locates the bucket holding the n-th row; rows below it are kept as they are and only
    that one bucket (about total / 65 536 rows) is ordered and cut.
    """
    keyed = df.withColumn("_h", hash32(F.lit(seed), F.col(id_col)))
    keyed = keyed.withColumn("_b", F.shiftright(F.col("_h"), 16))
    hist = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("c")).orderBy("_b").collect()  # <= 65 536 rows
    below, cut = 0, None
    for r in hist:
        if below + r["c"] >= n:
            cut = r["_b"]
            break
        below += r["c"]
    if cut is None:                      # fewer than n rows: all of them
        return keyed.drop("_h", "_b")
    inside = keyed.where(F.col("_b") < cut)
    edge = keyed.where(F.col("_b") == cut).orderBy("_h", id_col).limit(n - below)
    return inside.unionByName(edge).drop("_h", "_b")


def paired_subset(ids: DataFrame, id_col: str, n: int, tables: dict, seed: int = SEED,
                  total: int | None = None) -> dict:
    """Choose ``n`` ids (``n < total``) and apply the same ids to every table.

    Returns ``{name: table filtered by left-semi join}``; each keeps its own
    columns plus ``new_id``, the id's position among the chosen ids in sorted
    order. The chosen ids are broadcast to the tables while they are below the broadcast bound.
    """
    if total is not None and n >= total:
        raise ValueError(f"subset size {n} must be smaller than the total {total}")
    chosen = hash_sample(ids.select(id_col).distinct(), id_col, n, seed)
    numbered = global_rank(chosen, [id_col], "new_id")
    if n * CHOSEN_ROW_BYTES <= MAX_BROADCAST_BYTES:
        numbered = F.broadcast(numbered)
    return {name: t.join(numbered, id_col) for name, t in tables.items()}


def query_sample(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` points drawn without replacement to serve as search queries; asking
    for more points than exist is an error."""
    total = df.count()  # row total: bounded metadata
    if n > total:
        raise ValueError(f"query sample of {n} exceeds the {total} available points")
    return hash_sample(df, id_col, n, seed)
