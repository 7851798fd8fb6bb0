"""Changelogs: DataFrames whose rows carry a signed weight.

A relation is a bag of rows; a changelog says by how much each row's multiplicity changes. WEIGHT holds the change, EPOCH
(optional) the round in which it happened. All other columns are the relation's own; null means unbound.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEIGHT = "__w"
EPOCH = "__epoch"
META = (WEIGHT, EPOCH)


class NegativeWeight(ValueError):
    """A row was deleted more often than it was added."""


def columns(df: DataFrame) -> list[str]:
    """The relation's own columns."""
    return [c for c in df.columns if c not in META]


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def lift(df: DataFrame, weight: int | Column = 1, epoch: int | None = None) -> DataFrame:
    """A plain table as additions (or with the weight given)."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    out = df.withColumn(WEIGHT, w.cast("long"))
    return out if epoch is None else out.withColumn(EPOCH, F.lit(epoch))


def epoch_of(log: DataFrame, epoch: int) -> DataFrame:
    """The changes of one round."""
    return log.where(F.col(EPOCH) == epoch).drop(EPOCH)


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(WEIGHT, -F.col(WEIGHT))


def plus(parts: Iterable[DataFrame]) -> DataFrame:
    """Changes put together; cancelling rows stay until consolidate()."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return consolidate(plus([a, negate(b)]))


def consolidate(df: DataFrame) -> DataFrame:
    """Each row once, with its net weight; rows of weight 0 go. Partial sums are taken before the shuffle."""
    own = columns(df)
    if not own:
        return df.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
    return df.groupBy(*[c(x) for x in own]).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def integrate(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The bag after all rounds (up to one): consolidated rows of positive weight."""
    if EPOCH in log.columns:
        log = (log if upto is None else log.where(F.col(EPOCH) <= upto)).drop(EPOCH)
    return consolidate(log)


def expand(df: DataFrame) -> DataFrame:
    """One plain row for each copy. For what must see rows: ranks, limits, concatenation, user aggregates."""
    own = [c(x) for x in columns(df)]
    return df.where(F.col(WEIGHT) > 0).select(*own, F.explode(F.array_repeat(F.lit(0), F.col(WEIGHT).cast("int"))).alias("__copy")).drop("__copy")


def validate(df: DataFrame) -> DataFrame:
    """df, failing when it runs if a weight is negative."""
    bad = F.raise_error(F.concat(F.lit("deletion of a row that is not there, weight "), F.col(WEIGHT).cast("string")))
    return df.withColumn(WEIGHT, F.when(F.col(WEIGHT) < 0, bad.cast("long")).otherwise(F.col(WEIGHT)))


def set_normalise(log: DataFrame, seq: Sequence[str] = (EPOCH,)) -> DataFrame:
    """The log of a set: an addition of what is present and a deletion of what is absent go.

    A row is present after an event if the event adds, so an event counts if its sign differs from the one before
    (absent at first). `seq` orders the events of a row.
    """
    w = Window.partitionBy(*[c(x) for x in columns(log) if x not in seq]).orderBy(*[c(x) for x in seq])
    before = F.coalesce(F.lag(F.col(WEIGHT) > 0).over(w), F.lit(False))
    return log.withColumn("__before", before).where((F.col(WEIGHT) > 0) != F.col("__before")).withColumn(WEIGHT, F.signum(WEIGHT).cast("long")).drop("__before")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two sides."""
    return reduce(lambda x, y: x & y, [left[f"`{k}`"].eqNullSafe(right[f"`{k}`"]) for k in keys], F.lit(True))


def touched(df: DataFrame, keys: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows whose key is among the keys (null equals null). Without names all rows are."""
    if not names:
        return df
    k = keys.select(*[c(n).alias(f"__k_{n}") for n in names])
    cond = reduce(lambda x, y: x & y, [df[f"`{n}`"].eqNullSafe(k[f"`__k_{n}`"]) for n in names])
    return df.join(k, cond, "left_semi")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"tideline-{uuid.uuid4().hex}"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, its lineage cut."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
