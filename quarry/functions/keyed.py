"""Deterministic keyed randomness.

No ``rand()``: a draw is a hash of its key (seed, epoch, ids), so a re-run, a
retried task or another engine reproduces it. The first 32 bits of an md5
digest give an integer ``h``; the uniform is ``(h + 0.5) / 2^32``, strictly
inside (0, 1), so ``-ln(-ln(u))`` is always finite.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(*parts) -> Column:
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def hash32(*parts) -> Column:
    """First 32 bits of md5 over ``parts`` joined with '|', as BIGINT."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


def keyed_uniform(*parts) -> Column:
    return (hash32(*parts).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def gumbel_key(score: Column, temperature: float, *parts) -> Column:
    """``score / T + Gumbel(0, 1)`` noise drawn from the key."""
    u = keyed_uniform(*parts)
    return score / F.lit(float(temperature)) - F.ln(-F.ln(u))


def shuffle_key(seed: int, epoch, id_col: Column) -> Column:
    """Sort key of a seeded, per-epoch shuffle (ties broken by the id itself)."""
    return hash32(F.lit(seed), epoch if isinstance(epoch, Column) else F.lit(epoch), id_col)
