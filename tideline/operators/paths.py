"""Property paths over an edge relation (s, p, o), non-repeating ones and, as an extension, their closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..changelog import WEIGHT, checkpoint, consolidate, lift, plus
from .group import distinct
from .joins import inner


def link(edges: DataFrame, predicate) -> DataFrame:
    return edges.where(F.col("p") == predicate).select("s", "o", WEIGHT)


def inverse(path: DataFrame) -> DataFrame:
    return path.select(F.col("o").alias("s"), F.col("s").alias("o"), WEIGHT)


def alternative(*paths: DataFrame) -> DataFrame:
    return plus(paths)


def sequence(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select("s", F.col("o").alias("__mid"), WEIGHT)
    b = second.select(F.col("s").alias("__mid"), "o", WEIGHT)
    return inner(a, b, ["__mid"]).drop("__mid")


def negated(edges: DataFrame, forward: Sequence, backward: Sequence = ()) -> DataFrame:
    """Edges whose predicate is none of these; with inverse members also the turned edges of others."""
    parts = []
    if forward or not backward:
        parts.append(edges.where(~F.col("p").isin(*forward)) if forward else edges)
    if backward:
        parts.append(inverse(edges.where(~F.col("p").isin(*backward))))
    return plus([p.select("s", "o", WEIGHT) for p in parts])


def nodes(edges: DataFrame) -> DataFrame:
    """Every node of the graph."""
    return plus([edges.select(F.col("s").alias("n"), WEIGHT), edges.select(F.col("o").alias("n"), WEIGHT)]).where(f"{WEIGHT} > 0").select("n").distinct()


def zero_or_one(path: DataFrame, edges: DataFrame) -> DataFrame:
    """The path's pairs and every node with itself, each once."""
    own = lift(nodes(edges).select(F.col("n").alias("s"), F.col("n").alias("o")))
    return distinct(plus([path.select("s", "o", WEIGHT), own]))


def one_or_more(path: DataFrame) -> DataFrame:
    """Transitive closure, by joining the newest pairs with the path until no new pair appears (an extension)."""
    step = distinct(path.select("s", "o", WEIGHT))
    known = new = checkpoint(step)
    while True:
        found = distinct(sequence(new, step)).join(known.select("s", "o"), ["s", "o"], "left_anti")
        new = checkpoint(found.select("s", "o", WEIGHT))
        if new.isEmpty():
            return known
        known = checkpoint(consolidate(plus([known, new])))


def zero_or_more(path: DataFrame, edges: DataFrame) -> DataFrame:
    return zero_or_one(one_or_more(path), edges)
