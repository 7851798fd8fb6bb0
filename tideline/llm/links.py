"""Classes of linked nodes, and links within buckets, without a task or a driver that holds a whole group.

Nodes are 64-bit numbers. A bucket is a key that several nodes share; only nodes of one bucket may be linked, and a
`verify` function says which pairs are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, release, tidy


def _mark(edges: DataFrame) -> tuple:
    """Changes when the edges do. Edges that are stars from the start are left as they are by the first round."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Edges that one task takes (16 bytes each).
TASK = 1 << 21


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of edges; the smallest ones themselves are left out."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _forests(edges: DataFrame) -> DataFrame:
    """Within each task, runs of up to TASK edges become stars around the smallest node of their components."""

    def run(it):
        held: list[pa.RecordBatch] = []
        for batch in it:
            held.append(batch)
            if sum(x.num_rows for x in held) >= TASK:
                yield made(held)
                held = []
        if held:
            yield made(held)

    def made(held):
        a, b = (np.concatenate([x.column(x.schema.get_field_index(c)).to_numpy() for x in held]) for c in "ab")
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(a, b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, class): class is the smallest node of the connected component. Nodes without edges are absent.

    Tasks first reduce their own edges to stars. What is left, where it is more than one task takes, goes through alternating
    large-star and small-star steps: each rewires edges towards the smallest known neighbour until all edges of a component
    point at its smallest node. Neighbours are never gathered: a step is a minimum per node, joined back.
    """
    edges = checkpoint(_forests(edges.where("a <> b")).distinct())
    if edges.count() <= TASK:
        edges = checkpoint(_forests(edges.coalesce(1)))
    else:
        edges = _stars(edges)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(roots.select("node", F.col("node").alias("class")))


def _stars(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b), a > b, as stars around the smallest node of each component."""
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.distinct())
        now = _mark(edges)
        if mark == now:
            return edges
        mark = now


def merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes of components(), after further links (a, b): only the classes that these join are worked on."""
    if classes is None:
        return components(links)
    for x in "ab":
        links = links.join(classes.select(F.col("node").alias(x), F.col("class").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    between = checkpoint(links.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if between.isEmpty():
        return classes
    up = checkpoint(components(between))
    moved = classes.join(up.select(F.col("node").alias("class"), F.col("class").alias("to")), "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    return checkpoint(moved.unionByName(up.join(classes.select("node"), "node", "left_anti").select("node", "class")))


def shared_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets of two or more, written once."""
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return checkpoint(members.join(keys, "key"))


#: Bytes of the members of a tile's side.
SIDE = 1 << 23


def tile_links(held: DataFrame, data: DataFrame, prepare: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]], confirm: Callable[[list[str], list[str]], np.ndarray] | None = None, side: int = SIDE) -> DataFrame:
    """Links (a, b) that join the classes within buckets: held (key, node, class, sketch, c: a struct with the class of most members or any), data (node, size in bytes, ...).

    A bucket's members, cut into parts of about `side` bytes, meet part by part in one task each, with their data: a
    member moves once a part of its bucket instead of once a pair. Members of c's class have one and the same, so they meet the others only.
    In a tile all pairs of different classes are compared, and those that a link of the tile has joined already are
    left out. prepare: rows of a tile -> (row, other rows) -> which of the others are linked; with confirm, which may be, and
    confirm tells it from the column `line`, for many pairs of one or several tiles at once.
    """
    held = held.select("key", "node", "class", "sketch", (F.col("class") == F.col("c.class")).alias("common"))
    size = F.greatest("size", F.lit(1024))
    parts = held.join(data.select("node", "size"), "node").groupBy("key").agg(*[F.ceil(F.coalesce(F.sum(F.when(own, size)), F.lit(0)) / side).cast("int").alias(m) for own, m in ((~F.col("common"), "m"), (F.col("common"), "mc"))])
    placed = held.join(parts, "key").withColumn("own", F.expr("CAST(IF(common, m + pmod(xxhash64(node, 7), mc), pmod(xxhash64(node, 7), m)) AS INT)"))
    placed = placed.where("m > 0").withColumn("other", F.explode(F.expr("sequence(0, IF(common, m, m + mc) - 1)")))
    placed = placed.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    tiles = placed.drop("m", "mc", "other", "common").join(data.drop("size"), "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def whole(it):
        """A table a tile; its rows may come in several batches."""
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in it:
            at = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "lo", "hi")]
            cuts = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in at], axis=0))[: batch.num_rows])
            for lo, hi in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                now = tuple(int(x[lo]) for x in at)
                if rest and now != last:
                    yield pa.Table.from_batches(rest)
                    rest = []
                rest.append(batch.slice(lo, hi - lo))
                last = now
        if rest:
            yield pa.Table.from_batches(rest)

    def run(it):
        wait: list[tuple] = []  # (tile, i, j, nodes, lines) of pairs to confirm
        weight = 0

        def join(label, i, j):
            new = label[i] != label[j]
            if new:
                label[label == label[j]] = label[i]
            return new

        def settled():
            pairs = [x for x in wait if x[0][x[1]] != x[0][x[2]]]
            ok = confirm([x[5] for x in pairs], [x[6] for x in pairs]) if pairs else []
            return [(a, b) for (label, i, j, a, b, _, _), yes in zip(pairs, ok) if yes and join(label, i, j)]

        def made(found):
            one, two = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

        for tile in whole(it):
            node, own = tile["node"].to_numpy(), tile["own"].to_numpy()
            lo, hi = tile["lo"][0].as_py(), tile["hi"][0].as_py()
            label = np.unique(tile["class"].to_numpy(), return_inverse=True)[1]
            if label.max() == 0:
                continue
            linked, found = prepare(tile), []
            lines = tile["line"].to_pylist() if confirm else []
            for i in np.flatnonzero(own == lo):
                others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1 if lo == hi else np.flatnonzero((own == hi) & (label != label[i]))
                if not len(others):
                    continue
                for j in others[linked(i, others)].tolist():
                    if not confirm:
                        found += [(node[i], node[j])] if join(label, i, j) else []
                        continue
                    wait.append((label, i, j, node[i], node[j], lines[i], lines[j]))
                    weight += len(lines[i]) + len(lines[j])
                    if len(wait) >= 1 << 12 or weight > 1 << 23:
                        found += settled()
                        wait, weight = [], 0
            if found:
                yield made(found)
        if wait:
            yield made(settled())

    return tiles.mapInArrow(tidy(run), "a long, b long")


def bucket_classes(members: DataFrame, verify: Callable[[DataFrame], DataFrame], alike: Callable[[Column, Column], Column], settle: Callable[[DataFrame], DataFrame], rounds: int = 4, room: float = 1000.0, classes: DataFrame | None = None) -> DataFrame | None:
    """members (key, node, sketch), each (key, node) once, of buckets of two or more (shared_buckets) -> classes (node, class) of the links within buckets, or None.

    A star a bucket and round: all members are verified against one centre, another one each round, until every bucket
    lies in one class. Members of one class need no further pair. What is left after `rounds`, or as soon as it is small
    (`room` pairs a member), is settled exactly: all pairs of different classes in a bucket whose sketches are alike (tile_links).
    So the work is linear in a large bucket of copies, and no link that the buckets hold is lost. verify gets and
    returns (a, b), a < b; settle gets members with their class and returns links. `classes` holds what is known already and is kept; the star around each bucket's smallest node is then left out.
    """
    open_ = members.select("key", "node", "sketch")
    tried: DataFrame | None = None
    for turn in range(0 if classes is None else 1, rounds + 1):
        held = open_.withColumn("class", F.col("node")) if classes is None else open_.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        order = F.struct((F.xxhash64("node", F.lit(turn)) if turn else F.col("node")).alias("order"), "node", "class", "sketch")
        stars = held.groupBy("key").agg(F.min(order).alias("c"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
        held = held.join(stars.select("key", "c", "n"), "key")
        if turn:
            held = checkpoint(held)
            left = held.agg(F.count(F.lit(1)).alias("members"), F.sum(F.when(F.col("class") != F.col("c.class"), F.col("n"))).alias("pairs")).first()
            if not left["members"]:
                break
            open_ = held.select("key", "node", "sketch")
        if turn and (turn == rounds or left["pairs"] <= room * left["members"]):
            return merged(classes, checkpoint(settle(held)))
        pairs = held.where((F.col("class") != F.col("c.class")) & alike(F.col("sketch"), F.col("c.sketch"))).select(F.col("c.node").alias("a"), F.col("node").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = checkpoint(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        classes = merged(classes, checkpoint(verify(pairs).select("a", "b")))
        release(members.sparkSession)
    return classes
