"""Joins of weighted bags.

Each function takes the full state of both sides. `*_delta` functions take old states and changes and give the change of
the result; they touch only keys that change. Natural equality on shared columns, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..changelog import WEIGHT, c, columns, consolidate, minus, negate, on, plus, touched


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    have = set(columns(b))
    return [x for x in columns(a) if x in have]


def _multiplied(joined: DataFrame, a: DataFrame, b: DataFrame, own: list[str], rest: list[str]) -> DataFrame:
    return joined.select(*[a[f"`{x}`"] for x in own], *[b[f"`{x}`"] for x in rest], (a[WEIGHT] * F.coalesce(b[WEIGHT], F.lit(1))).alias(WEIGHT))


def _aliased(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """b with fresh attributes, as both sides may stem from one table."""
    return a, b.select(*[c(x).alias(x) for x in b.columns])


def inner(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, small: str | None = None) -> DataFrame:
    """Rows that agree on the keys; unbound keys match nothing. Without keys the product of both. The physical join is the
    planner's choice by size; small='left' or 'right' only hints at a side whose size the caller has checked."""
    a, b = _aliased(a, b)
    keys = shared(a, b) if keys is None else list(keys)
    if small:
        a, b = (F.broadcast(a), b) if small == "left" else (a, F.broadcast(b))
    rest = [x for x in columns(b) if x not in keys]
    if not keys:
        return _multiplied(a.crossJoin(b), a, b, columns(a), rest)
    cond = on(a, b, keys[:0])
    for k in keys:
        cond = cond & (a[f"`{k}`"] == b[f"`{k}`"])
    return _multiplied(a.join(b, cond), a, b, columns(a), rest)


def inner_delta(a_old: DataFrame, da: DataFrame, b_old: DataFrame, db: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Changed left rows with the new right side, and old left rows with the right side's changes."""
    b_new = plus([b_old, db])
    return consolidate(plus([inner(da, b_new, keys), inner(a_old, db, keys)]))


def compatible(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, loose: Sequence[str] | None = None) -> DataFrame:
    """Rows whose shared columns agree or are unbound on a side; the result takes the bound value. loose: the keys that can be
    unbound (all, if not given).

    Rows with all keys bound on both sides go through an equality join; only rows with an unbound key, on whichever
    side, are compared with the other side's rows, by equality of the keys bound in both.
    """
    keys = shared(a, b) if keys is None else list(keys)
    if not keys:
        return inner(a, b, [])
    may = list(keys) if loose is None else [k for k in keys if k in loose]
    out = [*columns(a), *[x for x in columns(b) if x not in keys]]

    def bound(df: DataFrame) -> Column:
        cond = F.lit(True)
        for k in keys:
            cond = cond & c(k).isNotNull()
        return cond

    def by_pattern(left: DataFrame, right: DataFrame) -> DataFrame:
        """One equality join for each set of keys bound on both sides."""
        parts = []
        for mask in range(1 << len(may)):
            for other in range(1 << len(may)):
                if mask == other == (1 << len(may)) - 1:
                    continue
                x, y = left, right
                for i, k in enumerate(may):
                    x = x.where(c(k).isNotNull() if mask >> i & 1 else c(k).isNull())
                    y = y.where(c(k).isNotNull() if other >> i & 1 else c(k).isNull())
                free = [k for i, k in enumerate(may) if not (mask >> i & 1 and other >> i & 1)]
                y = y.withColumnsRenamed({k: f"__r_{k}" for k in free})
                j = inner(x, y, [k for k in keys if k not in free])
                j = j.withColumns({k: F.coalesce(c(k), c(f"__r_{k}")) for k in free})
                parts.append(j.select(*[c(n) for n in out], WEIGHT))
        return plus(parts)

    exact = inner(a.where(bound(a)), b.where(bound(b)), keys).select(*[c(n) for n in out], WEIGHT)
    return consolidate(plus([exact, by_pattern(a, b)]))


def _counted(b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that the right side has, each once."""
    return b.groupBy(*[c(k) for k in keys]).agg(F.sum(WEIGHT).alias("__n")).where(F.col("__n") > 0).select(*[c(k).alias(k) for k in keys])


def _partners(a: DataFrame, b: DataFrame, keys: Sequence[str], loose: Sequence[str], condition: Column | None) -> DataFrame:
    """Joined rows, where keys among `loose` fit anything if unbound on a side; __l_<key> keeps what the left row had."""
    marked = a.withColumns({f"__l_{k}": c(k) for k in keys}) if loose else a
    joined = compatible(marked, b, keys, loose) if loose else inner(marked, b, keys)
    return joined if condition is None else joined.where(condition)


def _with_partners(a: DataFrame, joined: DataFrame, keys: Sequence[str], loose: Sequence[str]) -> DataFrame:
    """The left rows of joined ones."""
    own = [c(f"__l_{x}").alias(x) if loose and x in keys else c(x) for x in columns(a)]
    return consolidate(joined.select(*own, WEIGHT))


def semi(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, condition: Column | None = None, loose: Sequence[str] = ()) -> DataFrame:
    """Left rows, with their weights, whose key the right side has (EXISTS). Without keys: all, if the right side has rows. A
    condition is on columns of both rows; keys among `loose` fit anything if unbound."""
    keys = shared(a, b) if keys is None else list(keys)
    if condition is not None or loose:
        b = b if condition is not None else _counted(b, keys).withColumn(WEIGHT, F.lit(1).cast("long"))
        return touched(a, _with_partners(a, _partners(a, b, keys, loose, condition), keys, loose), columns(a))
    if not keys:
        some = b.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).alias("__n")).where("__n > 0")
        return a.crossJoin(F.broadcast(some)).drop("__n")
    return touched(a, _counted(b, keys), keys)


def anti(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, condition: Column | None = None, loose: Sequence[str] = ()) -> DataFrame:
    """Left rows that semi leaves (NOT EXISTS). Null equals null in keys that are not loose."""
    keys = shared(a, b) if keys is None else list(keys)
    if condition is not None or loose:
        b = b if condition is not None else _counted(b, keys).withColumn(WEIGHT, F.lit(1).cast("long"))
        return anti(a, _with_partners(a, _partners(a, b, keys, loose, condition), keys, loose), columns(a))
    if not keys:
        none = b.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).alias("__n")).where("__n <= 0")
        return a.crossJoin(F.broadcast(none)).drop("__n")
    k = _counted(b, keys).withColumnsRenamed({x: f"__k_{x}" for x in keys})
    cond = F.lit(True)
    for x in keys:
        cond = cond & a[f"`{x}`"].eqNullSafe(k[f"`__k_{x}`"])
    return a.join(k, cond, "left_anti")


def minus_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """MINUS: anti on the shared columns; with none shared the left side stays as it is."""
    keys = shared(a, b)
    return anti(a, b, keys) if keys else a


def left(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, condition: Column | None = None, loose: Sequence[str] = ()) -> DataFrame:
    """OPTIONAL: joined rows, and left rows without a partner padded with nulls. The condition, on columns of the joined
    row, decides about partners. Keys among `loose` fit anything if unbound on a side, and take the bound value."""
    keys = shared(a, b) if keys is None else list(keys)
    rest = [x for x in columns(b) if x not in keys]
    if condition is None and keys and not loose:
        a, b = _aliased(a, b)
        cond = F.lit(True)
        for k in keys:
            cond = cond & (a[f"`{k}`"] == b[f"`{k}`"])
        return _multiplied(a.join(b, cond, "left"), a, b, columns(a), rest)
    joined = _partners(a, b, keys, loose, condition)
    bare = anti(a, _with_partners(a, joined, keys, loose), columns(a))
    joined = joined.drop(*[f"__l_{k}" for k in keys]) if loose else joined
    kinds = dict(b.dtypes)
    return plus([joined, bare.withColumns({x: F.lit(None).cast(kinds[x]) for x in rest})])


def _key_delta(op, a_old: DataFrame, da: DataFrame, b_old: DataFrame, db: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new - old of a non-linear join, over the keys that either side's changes touch."""
    names = [c(k) for k in keys]
    hit = plus([da.select(*names), db.select(*names)]).distinct() if keys else da
    cut = lambda df: touched(df, hit, keys)
    # Cut before consolidating: only the touched part of a state is put together.
    a0, b0 = cut(a_old), cut(b_old)
    a1, b1 = consolidate(plus([a0, cut(da)])), consolidate(plus([b0, cut(db)]))
    a0, b0 = consolidate(a0), consolidate(b0)
    return minus(op(a1, b1), op(a0, b0))


def _touching(keys: Sequence[str], loose: Sequence[str]) -> list[str]:
    """The keys by which a change finds the rows it touches: an unbound key touches rows of any value."""
    return [k for k in keys if k not in loose]


def semi_delta(a_old, da, b_old, db, keys=None, condition=None, loose=()) -> DataFrame:
    keys = shared(a_old, b_old) if keys is None else keys
    return _key_delta(lambda a, b: semi(a, b, keys, condition, loose), a_old, da, b_old, db, _touching(keys, loose))


def anti_delta(a_old, da, b_old, db, keys=None, condition=None, loose=()) -> DataFrame:
    keys = shared(a_old, b_old) if keys is None else keys
    return _key_delta(lambda a, b: anti(a, b, keys, condition, loose), a_old, da, b_old, db, _touching(keys, loose))


def minus_delta(a_old, da, b_old, db) -> DataFrame:
    keys = shared(a_old, b_old)
    return anti_delta(a_old, da, b_old, db, keys) if keys else consolidate(da)


def left_delta(a_old, da, b_old, db, keys=None, condition=None, loose=()) -> DataFrame:
    keys = shared(a_old, b_old) if keys is None else keys
    return _key_delta(lambda a, b: left(a, b, keys, condition, loose), a_old, da, b_old, db, _touching(keys, loose))


def compatible_delta(a_old, da, b_old, db, keys=None, loose=None) -> DataFrame:
    """Bilinear, like inner_delta."""
    return consolidate(plus([compatible(da, consolidate(plus([b_old, db])), keys, loose), compatible(a_old, db, keys, loose)]))


__all__ = ["anti", "anti_delta", "compatible", "compatible_delta", "inner", "inner_delta", "left", "left_delta", "minus_delta", "minus_rows", "negate", "semi", "semi_delta", "shared"]
