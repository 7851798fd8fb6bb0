"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words; a shingle weighs its times in the document by its IDF.
Consistent weighted sampling (the improved scheme: two Gamma(2,1) draws and a uniform one for each shingle) gives
samples that two documents share with a probability equal to their weighted Jaccard similarity. Instead of evaluating
all shingles for each of 64 samples, each of REPS repetitions throws the shingles into BINS bins and samples once a bin;
an empty bin borrows from the next one. 16 bands of 4 samples: at a similarity of 0.8 a pair shares one with
probability 0.9998. Pairs are verified by the exact weighted Jaccard similarity of their shingles, at THRESHOLD or more.

Document frequencies are counted over all documents in a table of 2**20 hashed counters: its size is the same for any
corpus, so it can be broadcast, and it resolves a frequency to about a two-thousandth of the corpus. IDF runs from 1/2
(in every document) to 1 (rare). A large group of copies raises its own shingles' frequencies, and a copy's own edits then
weigh more: the plain similarity that THRESHOLD asks for rises from 0.80 in a pair to 0.85 in a third of 3e7 documents.

Texts with the same words are one node from the start. A class is a connected component of verified pairs.

Defined cases: a document without words is the same as any other without words; null text is nobody's copy. Fewer than
five words make one shingle, so such texts are copies only if they have the same words. Rows that repeat are copies of
each other. An empty table gives an empty table; extra columns pass through keep_one. Nodes are 64-bit hashes of the
words: with n distinct texts about n * n / 2**65 pairs fall together by chance, 24 among 3e10.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import SPACE, Shelf, checkpoint, fresh, table, tidy
from .hashing import U, mix
from .links import bucket_classes, tile_links

WIDTH = 5
THRESHOLD = 0.8
REPS, BINS = 8, 8
BANDS, ROWS = 16, 4
COUNTERS = 1 << 20
BLOCKS = 256
#: Two documents at THRESHOLD differ in 6.4 of 64 sample bits on average; beyond 16 (four standard deviations) they aren't compared.
MOST_BITS = 16


def _gamma_table() -> np.ndarray:
    """The distribution function of Gamma(2,1), inverted at the middles of 65536 steps."""
    p = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        above = 1 - np.exp(-x) * (1 + x) > p
        low, high = np.where(above, low, x), np.where(above, x, high)
    return (low + high) / 2


_R = _gamma_table().astype(np.float32)
_LOG_C = np.log(_gamma_table()).astype(np.float32)


def idf(counters: np.ndarray, documents: int, hashes: np.ndarray) -> np.ndarray:
    """Between 1/2 and 1. A counter also counts other shingles; their mean number is taken off."""
    noise = counters.sum() // COUNTERS
    df = np.clip(counters[(hashes & U(COUNTERS - 1)).astype(np.int64)] - noise, 1, max(1, documents))
    return (0.5 + 0.5 * np.log(documents / df) / np.log(documents) if documents > 1 else np.ones(len(df))).astype(np.float32)


def samples(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, REPS * BINS) samples; 0 where a row has no shingle."""
    out = np.zeros((n_rows, REPS, BINS), U)
    log_w = np.log(weights)
    for k in range(REPS):
        with np.errstate(over="ignore"):
            u = mix(hashes + U(0x9E3779B97F4A7C15) * U(2 * k + 1))
        r = _R[(u & U(65535)).astype(np.int64)]
        log_c = _LOG_C[((u >> U(16)) & U(65535)).astype(np.int64)]
        beta = ((u >> U(32)) & U(65535)).astype(np.float32) * np.float32(1 / 65536) + np.float32(1 / 131072)
        t = np.floor(log_w / r + beta)
        a = log_c - r * (t - beta + 1)
        at = rows * BINS + ((u >> U(61)) % U(BINS)).astype(np.int64)
        least = np.full(n_rows * BINS, np.inf, np.float32)
        np.minimum.at(least, at, a)
        hit = np.flatnonzero(a == least[at])
        with np.errstate(over="ignore"):
            sample = mix(mix(hashes[hit]) + t[hit].astype(np.int64).astype(U)) | U(1)
        got = np.zeros(n_rows * BINS, U)
        np.maximum.at(got, at[hit], sample)
        got = got.reshape(n_rows, BINS)
        filled = got.copy()
        for step in range(1, BINS):
            empty = filled == 0
            if not empty.any():
                break
            with np.errstate(over="ignore"):
                borrowed = np.roll(got, -step, axis=1)
                filled = np.where(empty & (borrowed != 0), mix(borrowed + U(step)) | U(1), filled)
        out[:, k] = filled
    return out.reshape(n_rows, REPS * BINS)


def bands(sampled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, BANDS) keys and one 64-bit sketch: a bit of each sample. Each sample is in one band; a band's come from four repetitions."""
    s = sampled.reshape(-1, REPS, BINS)
    keys = np.empty((len(s), BANDS), U)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            acc = np.full(len(s), b + 1, U)
            for j in range(ROWS):
                acc = mix(acc) + s[:, b // BINS + 2 * j, (b + j) % BINS]
            keys[:, b] = mix(acc)
        bit = (mix(sampled) >> U(63)) << np.arange(64, dtype=U)
    return keys, np.bitwise_or.reduce(bit, axis=1)


def node_of(text: Column) -> Column:
    """A number that texts with the same words share; null for null."""
    words = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.when(text.isNotNull(), F.xxhash64(F.md5(words)))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Counters of hashed shingles and the number of documents. COUNTERS numbers come to the driver, whatever the input."""
    per = COUNTERS // BLOCKS

    def count(it):
        total, documents = np.zeros(COUNTERS, np.int64), 0
        for batch in it:
            for part in hashing.slices(batch, "text"):
                _, h, _ = hashing.shingles(_column(part, "text"), WIDTH)
                total += np.bincount((h & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                documents += part.num_rows
        if documents:
            blocks = [total[i * per : (i + 1) * per].tobytes() for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary()), pa.array([documents] + [0] * (BLOCKS - 1), pa.int64())], names=["block", "counts", "n"])

    def add(it):
        sums: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in it:
            for block, counts, m in zip(_column(batch, "block").to_pylist(), _column(batch, "counts").to_pylist(), _column(batch, "n").to_pylist()):
                own = sums.setdefault(block, np.zeros(per, np.int64))
                own += np.frombuffer(counts, np.int64)
                n[block] = n.get(block, 0) + m
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary()), pa.array(n.values(), pa.int64())], names=["block", "counts", "n"])

    kind = "block int, counts binary, n long"
    summed = texts.select("text").mapInArrow(tidy(count), kind).repartition("block").mapInArrow(tidy(add), kind).collect()
    total = np.zeros(COUNTERS, np.int64)
    for r in summed:
        total[r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(r["counts"], np.int64)
    return total, sum(r["n"] for r in summed)


def signatures(nodes: DataFrame, counters, documents: int) -> DataFrame:
    """(node, text) -> (node, keys array<long>, sketch). Texts without words have no keys."""

    def sign(it):
        for batch in it:
            for part in hashing.slices(batch, "text"):
                rows, h, times = hashing.shingles(_column(part, "text"), WIDTH)
                got = samples(rows, h, times.astype(np.float32) * idf(counters.value, documents, h), part.num_rows)
                some = np.unique(rows)
                keys, sketch = bands(got[some])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([_column(part, "node").take(pa.array(some)), lists, pa.array(sketch.view(np.int64))], names=["node", "keys", "sketch"])

    return nodes.select("node", "text").mapInArrow(tidy(sign), "node long, keys array<long>, sketch long")


def vectors(nodes: DataFrame) -> DataFrame:
    """(node, text) -> (node, h, tf): the low 32 bits of the shingles' hashes, sorted, and their times, as bytes."""

    def make(it):
        for batch in it:
            for part in hashing.slices(batch, "text"):
                rows, h, times = hashing.shingles(_column(part, "text"), WIDTH)
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                hs, tfs = [], []
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    low = h[lo:hi].astype(np.uint32)
                    order = np.argsort(low, kind="stable")
                    hs.append(low[order].tobytes())
                    tf = times[lo:hi][order]
                    tfs.append(None if (tf == 1).all() else tf.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([_column(part, "node"), pa.array(hs, pa.binary()), pa.array(tfs, pa.binary())], names=["node", "h", "tf"])

    return nodes.select("node", "text").mapInArrow(tidy(make), "node long, h binary, tf binary")


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the smaller weights over sum of the larger ones; hashes are sorted."""
    total = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64))
    if not total:
        return 1.0
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    both = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    shared = float(np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64))
    return shared / (total - shared)


def similar_rows(tile: pa.Table, counters: np.ndarray, documents: int, threshold: float):
    """(row, other rows) -> which others have a weighted Jaccard similarity to the row of at least the threshold, for rows (sketch, h, tf)."""
    sketch = tile["sketch"].to_numpy().view(U)
    hs = [np.frombuffer(x.as_buffer(), np.uint32) for x in tile["h"]]
    h = np.concatenate(hs)
    w = idf(counters, documents, h.astype(U))
    ends = np.cumsum([len(x) for x in hs])
    starts = ends - [len(x) for x in hs]
    for tf, lo, hi in zip(tile["tf"], starts, ends):
        if tf.is_valid:
            w[lo:hi] *= np.frombuffer(tf.as_buffer(), np.uint32)
    place = np.unique(h, return_inverse=True)[1]
    total = np.add.reduceat(w, starts, dtype=np.float64)
    here = np.zeros(place.max() + 1, np.float32)

    def linked(i, others):
        ok = np.bitwise_count(sketch[others] ^ sketch[i]) <= MOST_BITS
        low, high = np.minimum(total[others], total[i]), np.maximum(total[others], total[i])
        ok &= low >= threshold * high * (1 - 1e-6)  # the similarity is this quotient at most
        some = np.flatnonzero(ok)
        own = slice(starts[i], ends[i])
        here[place[own]] = w[own]
        step = max(1, (1 << 20) // max(1, len(place) // len(starts)))
        for at in range(0, len(some), step):
            part = others[some[at : at + step]]
            n = ends[part] - starts[part]
            cuts = np.cumsum(n) - n
            flat = np.arange(n.sum()) + np.repeat(starts[part] - cuts, n)
            shared = np.add.reduceat(np.minimum(here[place[flat]], w[flat]), cuts, dtype=np.float64)
            ok[some[at : at + step]] = shared / (total[part] + total[i] - shared) >= threshold
        here[place[own]] = 0
        return ok

    return linked


def similar_pairs(pairs: DataFrame, vecs: DataFrame, counters, documents: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least the threshold, with it."""
    one = vecs.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("tf").alias("tb"))
    two = vecs.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("tf").alias("ta"))

    def weigh(h, tf):
        got = np.frombuffer(h, np.uint32)
        w = idf(counters.value, documents, got.astype(U))
        return got, w if tf is None else w * np.frombuffer(tf, np.uint32).astype(np.float32)

    def compare(it):
        last, va = None, None
        for batch in it:
            a, b = _column(batch, "a").to_pylist(), _column(batch, "b").to_pylist()
            sims = []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, va = a[i], weigh(_column(batch, "ha")[i].as_py(), _column(batch, "ta")[i].as_py())
                sims.append(weighted_jaccard(*va, *weigh(_column(batch, "hb")[i].as_py(), _column(batch, "tb")[i].as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return pairs.join(one, "b").join(two, "a").select("a", "b", "ha", "ta", "hb", "tb").mapInArrow(tidy(compare), "a long, b long, sim double").where(F.col("sim") >= threshold)


def node_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame | None:
    """docs with node and text -> (node, class) of the nodes that are linked to others; None if there are no documents."""
    spark = docs.sparkSession
    live = docs.where("text IS NOT NULL").select("node", "text")
    counts, documents = document_frequencies(live)
    if not documents:
        return None
    counters = spark.sparkContext.broadcast(counts)
    signed = checkpoint(signatures(live, counters, documents).groupBy("node").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    members = signed.select(F.explode("keys").alias("key"), "node", "sketch")
    shelf = Shelf(spark)
    try:
        shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        members = checkpoint(members.join(shared, "key"))
        wanted = members.select("node").distinct()
        # One text a node: the first is taken before the shuffle, so a text with many copies moves once a task.
        texts = live.groupBy("node").agg(F.first("text").alias("text")).join(wanted, "node", "left_semi")
        vecs = shelf.put("vectors", vectors(texts).withColumn("size", F.length("h") * 3))
        classes = bucket_classes(
            members,
            lambda p: similar_pairs(p, vecs, counters, documents, threshold),
            lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= MOST_BITS,
            lambda held: tile_links(held, vecs, lambda tile: similar_rows(tile, counters.value, documents, threshold)),
        )
        return None if classes is None else checkpoint(classes)
    finally:
        shelf.clear()


def _classed(docs: DataFrame, node: str, cls: str, threshold: float) -> DataFrame:
    """docs with node and class of it; both are null for null text."""
    found = docs.withColumn(node, node_of(F.col("text")))
    classes = node_classes(found.select(F.col(node).alias("node"), "text"), threshold)
    if classes is None:
        return found.withColumn(cls, F.col(node))
    classes = classes.select(F.col("node").alias(f"{node}_"), F.col("class").alias(cls))
    return found.join(classes, F.col(node) == F.col(f"{node}_"), "left").drop(f"{node}_").withColumn(cls, F.coalesce(cls, node))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id (the smallest doc_id of the class), class_size. Null text: class_id is the document's own."""
    own = checkpoint(_classed(docs.select("doc_id", "text"), "node", "class", threshold).select("doc_id", "class"))
    classes = own.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    found = own.join(classes, "class", "left")
    return found.select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: the one with the smallest doc_id, of equals the one with the smallest hash of its text. Null texts stay."""
    names = docs.columns
    node, cls, whole = fresh([*names, "class"], "node", "cls", "whole")
    found = _classed(docs, node, cls, threshold)
    picked = found.where(F.col(cls).isNotNull()).groupBy(cls).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"))).alias(whole))
    alone = found.where(F.col(cls).isNull()).select(*[F.col(f"`{c}`") for c in names])
    return picked.select(*[F.col(f"`{whole}`.`{c}`").alias(c) for c in names]).unionByName(alone)


def op2_near_dup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))
