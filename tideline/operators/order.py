"""ORDER BY with ranks, and LIMIT/OFFSET.

Sorting a relation means to know each row's place. Ranks of a whole relation come from one distributed sort: the place in
the partition plus the rows of the partitions before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..changelog import WEIGHT, c, checkpoint, columns, expand, lift, minus

RANK = "__rank"


def ordering(df: DataFrame, by: Sequence[tuple[Column | str, bool]]) -> list[Column]:
    """Sort columns: (key, ascending) pairs, unbound first when ascending; ties by all columns in binary order."""
    keys = [(c(k) if isinstance(k, str) else k, up) for k, up in by]
    ties = [c(x).asc_nulls_first() for x in columns(df)]
    return [k.asc_nulls_first() if up else k.desc_nulls_last() for k, up in keys] + ties


def ranked(df: DataFrame, by: Sequence[tuple[Column | str, bool]], name: str = RANK) -> DataFrame:
    """One row for each copy with its place, from 0."""
    rows = expand(df)
    placed = checkpoint(rows.orderBy(*ordering(rows, by)).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # A row a partition.
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__start")))
    out = placed.withColumn("__part", part).join(starts, "__part")
    rank = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return lift(out.select(*[c(x) for x in columns(rows)], rank.cast("long").alias(name)))


def ranked_delta(old: DataFrame, new: DataFrame, delta: DataFrame, by: Sequence[tuple[Column | str, bool]], name: str = RANK) -> DataFrame:
    """Changed rows only: deleted ones with the place they had, added ones with the place they get. Rows that merely move
    up or down are not events."""
    own = columns(delta)
    gone = delta.where(F.col(WEIGHT) < 0).select(*[c(x) for x in own]).distinct()
    come = delta.where(F.col(WEIGHT) > 0).select(*[c(x) for x in own]).distinct()
    from ..changelog import touched

    return minus(touched(ranked(new, by, name), come, own), touched(ranked(old, by, name), gone, own))


def top(df: DataFrame, by: Sequence[tuple[Column | str, bool]], length: int | None, start: int = 0) -> DataFrame:
    """Rows start .. start + length in order; a bounded heap per task, no full sort."""
    rows = expand(df)
    out = rows.orderBy(*ordering(rows, by)).offset(start)
    return lift(out if length is None else out.limit(length))


def top_delta(old: DataFrame, new: DataFrame, by, length: int | None, start: int = 0) -> DataFrame:
    """Rows that leave the window and rows that enter it."""
    return minus(top(new, by, length, start), top(old, by, length, start))


def some(df: DataFrame, length: int | None, start: int = 0) -> DataFrame:
    """Any rows start .. start + length; which ones is not defined."""
    rows = expand(df).offset(start)
    return lift(rows if length is None else rows.limit(length))


def window_size(cardinality: int, length: int | None, start: int = 0) -> int:
    left = max(0, cardinality - start)
    return left if length is None else min(left, length)
