"""Running sums, maxima and last values over long ordered sequences, block by block.

A window over a whole sequence is one task. Here rows lie in blocks of bounded size: a window runs within
each block, the blocks' totals (one row each) are folded in two levels, and what a block takes over from
those before it is joined back. No task gets more than a block's rows, FAN totals, or a row for each FAN
blocks of its sequence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Totals that are folded at a time.
FAN = 4096

#: How totals of a sequence fold, and how what lies FAN blocks back joins what is near.
FOLDS = {
    "sum": (F.sum, lambda far, near: F.coalesce(far, F.lit(0)) + F.coalesce(near, F.lit(0))),
    "max": (F.max, lambda far, near: F.greatest(far, near)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda far, near: F.coalesce(near, far)),
}


def carried(totals: DataFrame, keys: list[str], block: str, folds: dict[str, str], fan: int | None = None, nulls: bool = False) -> DataFrame:
    """totals (one row a block, numbered in `block`) with each column of `folds` replaced by its fold over
    the earlier blocks of the same keys: "sum" (0 without any), "max" or "last" (null without any; null
    totals count as none). nulls: whether keys may be null."""
    top = "_top"
    numbered = totals.withColumn(top, F.floor(F.col(block) / (fan or FAN)).cast("long"))
    whole = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(block))) if kind == "last" else FOLDS[kind][0](c) for c, kind in folds.items()}
    tops = numbered.groupBy(*keys, top).agg(*(whole[c].alias(c) for c in folds))
    earlier = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    far = tops.select(*keys, top, *(FOLDS[kind][0](c).over(earlier(top, *keys)).alias(f"_far_{c}") for c, kind in folds.items()))
    near = numbered.select(*(c for c in numbered.columns if c not in folds), *(FOLDS[kind][0](c).over(earlier(block, *keys, top)).alias(c) for c, kind in folds.items()))
    joined = taken_over(near, far, [*keys, top], nulls)
    return joined.select(*((FOLDS[folds[c]][1](F.col(f"_far_{c}"), F.col(c)).alias(c) if c in folds else F.col(c)) for c in totals.columns))


def taken_over(rows: DataFrame, carry: DataFrame, on: list[str], nulls: bool = False) -> DataFrame:
    """rows with the columns of carry, which has one row for each block of rows. nulls: whether the keys
    `on` may be null. carry grows with the rows, so it is never broadcast."""
    if not nulls:
        return rows.join(carry.hint("merge"), on)
    other = carry.select(*(F.col(k).alias(f"_of_{k}") if k in on else F.col(k) for k in carry.columns))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in on))
    return rows.join(other.hint("merge"), same).drop(*(f"_of_{k}" for k in on))
