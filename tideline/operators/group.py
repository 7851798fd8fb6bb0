"""Grouping and aggregates of weighted bags, DISTINCT and REDUCED.

An aggregate sees a row as often as its weight says. A value that is null is skipped; a value that fails (is not what the
aggregate takes) makes the aggregate null for its group for as long as the row is there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..changelog import WEIGHT, c, columns, consolidate, minus, plus, touched


#: Aggregates that follow from sums of weights.
INVERTIBLE = ("count", "sum", "avg")


@dataclass(frozen=True)
class Agg:
    """kind: count, sum, avg, min, max, sample, concat; value: column (None: whole rows, for count); ok: false where the value is of the wrong kind."""

    kind: str
    value: Column | None = None
    distinct: bool = False
    separator: str = " "
    ok: Column | None = None

    def build(self, rows: Sequence[str]) -> Column:
        w = F.col(WEIGHT)
        if self.kind == "count" and self.value is None:
            if not self.distinct:
                return F.coalesce(F.sum(w), F.lit(0)).cast("long")
            # Whole rows; a struct of nulls only is still a row.
            return F.count_distinct(F.struct(*[c(x) for x in rows]) if rows else F.lit(1))
        v = self.value
        out = {
            "count": lambda: F.count_distinct(v) if self.distinct else F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0)).cast("long"),
            "sum": lambda: F.coalesce(F.sum_distinct(v) if self.distinct else F.sum(v * w), F.lit(0)),
            "avg": lambda: F.coalesce(F.try_divide(F.sum_distinct(v), F.count_distinct(v)) if self.distinct else F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))), F.lit(0)),
            "min": lambda: F.min(v),
            "max": lambda: F.max(v),
            "sample": lambda: F.min(v),
            "concat": lambda: self._concat(v, w),
        }[self.kind]()
        if self.ok is not None:
            out = F.when(~F.coalesce(F.max(v.isNotNull() & ~self.ok), F.lit(False)), out)
        return out

    def _concat(self, v: Column, w: Column) -> Column:
        """Values in order, equal ones side by side; the sort makes the result the same for any order of arrival."""
        if self.distinct:
            return F.array_join(F.array_sort(F.collect_set(v)), self.separator)
        many = F.collect_list(F.when(v.isNotNull(), F.struct(v.cast("string").alias("v"), w.alias("w"))))
        return F.array_join(F.flatten(F.transform(F.array_sort(many), lambda x: F.array_repeat(x["v"], x["w"].cast("int")))), self.separator)


def _alive(df: DataFrame) -> DataFrame:
    return df.where(F.col(WEIGHT) > 0)


def group(df: DataFrame, keys: Sequence[str], aggs: dict[str, Agg]) -> DataFrame:
    """A bag grouped by the keys; null is a key like any other. Without keys one row, whatever the input.

    Sums of weights need no net rows; other aggregates see the input consolidated.
    """
    rows = columns(df)
    plain = all(a.kind in INVERTIBLE and not a.distinct and a.ok is None for a in aggs.values())
    alive = df if plain else _alive(consolidate(df))
    built = [a.build(rows).alias(n) for n, a in aggs.items()]
    there = F.sum(WEIGHT).alias("__rows")
    if keys:
        out = alive.groupBy(*[c(k) for k in keys]).agg(there, *built).where("__rows > 0")
    else:
        out = alive.agg(there, *built)
    return out.drop("__rows").withColumn(WEIGHT, F.lit(1).cast("long"))


def group_delta(old: DataFrame, delta: DataFrame, keys: Sequence[str], aggs: dict[str, Agg]) -> DataFrame:
    """Groups that a change touches: their old rows retracted, their new rows added.

    Only the touched groups' rows of the old state are read; both aggregates run over those.
    """
    hit = delta.select(*[c(k) for k in keys]).distinct() if keys else delta
    before = touched(old, hit, keys)
    return minus(group(plus([before, delta]), keys, aggs), group(before, keys, aggs))


def sums_delta(state: DataFrame, delta: DataFrame, keys: Sequence[str], aggs: dict[str, Agg]) -> tuple[DataFrame, DataFrame]:
    """COUNT, SUM and AVG without the old rows: state holds per group __rows and for each aggregate its sum and count.

    Returns (new state, change of the result). State and change are of the size of the groups, not of the input.
    """
    w = F.col(WEIGHT)
    parts = [F.sum(w).alias("__rows")]
    for n, a in aggs.items():
        if a.kind not in INVERTIBLE or a.distinct:
            raise ValueError(f"{a.kind} can't be kept as sums")
        v = a.value if a.value is not None else F.lit(1)
        parts += [F.coalesce(F.sum(v * w) if a.kind != "count" else F.lit(0).cast("long"), F.lit(0)).alias(f"__s_{n}"), F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0)).alias(f"__n_{n}")]
    change = delta.groupBy(*[c(k) for k in keys]).agg(*parts)
    names = ["__rows", *[f"__{p}_{n}" for n in aggs for p in "sn"]]
    hit = touched(state, change, keys)
    after = plus([hit, change]).groupBy(*[c(k) for k in keys]).agg(*[F.sum(x).alias(x) for x in names])

    def shown(s: DataFrame) -> DataFrame:
        out = []
        for n, a in aggs.items():
            total, many = c(f"__s_{n}"), c(f"__n_{n}")
            out.append({"count": many.cast("long"), "sum": total, "avg": F.when(many == 0, F.lit(0)).otherwise(total / many)}[a.kind].alias(n))
        return s.where(F.col("__rows") > 0).select(*[c(k) for k in keys], *out, F.lit(1).cast("long").alias(WEIGHT))

    change_out = minus(shown(after), shown(hit))
    return after, change_out


def sums_state(df: DataFrame, keys: Sequence[str], aggs: dict[str, Agg]) -> DataFrame:
    """The state of sums_delta for a whole bag."""
    w = F.col(WEIGHT)
    parts = [F.sum(w).alias("__rows")]
    for n, a in aggs.items():
        v = a.value if a.value is not None else F.lit(1)
        parts += [F.coalesce(F.sum(v * w) if a.kind != "count" else F.lit(0).cast("long"), F.lit(0)).alias(f"__s_{n}"), F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0)).alias(f"__n_{n}")]
    return df.groupBy(*[c(k) for k in keys]).agg(*parts)


def distinct(df: DataFrame) -> DataFrame:
    """Rows that are there, once each."""
    return _alive(consolidate(df)).withColumn(WEIGHT, F.lit(1).cast("long"))


def distinct_delta(old: DataFrame, delta: DataFrame) -> DataFrame:
    """A row appears when its count leaves 0 and goes when it comes back to 0."""
    before = touched(old, delta.select(*[c(x) for x in columns(delta)]).distinct(), columns(delta))
    return minus(distinct(plus([before, delta])), distinct(before))


reduced, reduced_delta = distinct, distinct_delta
