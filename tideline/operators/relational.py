"""Linear operators: what they do to a bag they do to its changes, row by row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..changelog import EPOCH, META, WEIGHT, c, columns, consolidate, lift, plus


def project(df: DataFrame, names: Sequence[str | Column]) -> DataFrame:
    meta = [c(m) for m in META if m in df.columns]
    return df.select(*[c(n) if isinstance(n, str) else n for n in names], *meta)


def extend(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Add computed columns. An expression that fails should give null (try_ functions), which is unbound."""
    return df.withColumns(dict(new))


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; null (an error or unbound) drops the row."""
    return df.where(predicate)


def union(*parts: DataFrame) -> DataFrame:
    """Bag union; columns that a part lacks are unbound in its rows."""
    return plus(parts)


def given(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """Rows that come with the query, as a local relation: the planner knows its size and broadcasts a small one. A table
    made from a list counts as endless, and a join with it moves all rows of a frequent key into one task."""
    if not rows or not schema:
        return spark.createDataFrame(list(rows), schema)
    shape = StructType.fromDDL(schema)
    kinds = to_arrow_schema(shape)
    arrays = [pa.array(list(x), type=f.type) for x, f in zip(zip(*rows), kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=kinds), shape)


def values(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """An inline relation; None is UNDEF."""
    return lift(given(spark, schema, rows))


def nothing(spark: SparkSession) -> DataFrame:
    """The relation of one row without columns."""
    return lift(spark.range(1)).drop("id")


def count(df: DataFrame) -> DataFrame:
    """How many rows the bag has."""
    return df.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).cast("long").alias("count"))


def retract_all(df: DataFrame) -> DataFrame:
    """Every current row as a deletion: what ends a match that must leave nothing behind."""
    own = df.drop(EPOCH) if EPOCH in df.columns else df
    return consolidate(own).withColumn(WEIGHT, -F.col(WEIGHT))


def repeated(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows in which two positions hold the same term (a variable used twice in a pattern)."""
    return df.where(c(a).eqNullSafe(c(b)))


__all__ = ["columns", "count", "extend", "nothing", "project", "repeated", "retract_all", "union", "values", "where"]
