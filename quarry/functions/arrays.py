"""Array functions over token-id and vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.params import RAGGED_PAD_ID


def pad_cut(arr: Column, n: int, pad: int) -> Column:
    """Pad ``arr`` with ``pad`` up to ``n`` elements, then cut to ``n``."""
    filled = F.concat(arr, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(arr), F.lit(0))))
    return F.slice(filled, 1, n)


def dot(a: Column, b: Column) -> Column:
    """Inner product accumulated in DOUBLE, element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def ids_text(arr: Column) -> Column:
    """Space-joined decimal rendering of an id array (NULL stays NULL)."""
    return F.array_join(arr.cast("array<string>"), " ")


def strip_padding(arr: Column, pad: int = RAGGED_PAD_ID, trailing_only: bool = True) -> Column:
    """Remove dense padding. ``trailing_only`` removes only the trailing run
    (the import rule); otherwise every pad value is removed."""
    if not trailing_only:
        return F.filter(arr, lambda x: x != pad)
    return F.slice(arr, 1, F.size(arr) - _trailing_run(arr, pad))


def strip_padding_2d(arr: Column, pad: int = RAGGED_PAD_ID) -> Column:
    """Rank-2 version: strip each row's trailing pad, then drop the run of empty rows at the end (an
    empty row before a filled one keeps its place, so that ranks still line up)."""
    rows = F.transform(arr, lambda r: strip_padding(r, pad))
    return F.slice(rows, 1, F.size(rows) - _trailing_run(F.transform(rows, lambda r: F.least(F.size(r), F.lit(1))), 0))


def _trailing_run(arr: Column, value: int) -> Column:
    """Length of the run of ``value`` at the end of ``arr``."""
    first_other = F.array_position(F.transform(F.reverse(arr), lambda x: x != value), True)
    return F.when(first_other == 0, F.size(arr)).otherwise(first_other - 1)


def strip_trailing(arr: Column, value: int) -> Column:
    return F.slice(arr, 1, F.size(arr) - _trailing_run(arr, value))


def strip_special(arr: Column, eos: int) -> Column:
    """Keep ids ``>= 0`` that are not eos (decode preparation)."""
    return F.filter(arr, lambda x: (x >= 0) & (x != eos))


def attention_mask(arr: Column, eos: int | None = None) -> Column:
    """1 where the id is not eos, else 0; all ones when ``eos`` is None (encoder input)."""
    if eos is None:
        return F.array_repeat(F.lit(1), F.size(arr))
    return F.transform(arr, lambda x: F.when(x != eos, 1).otherwise(0))
