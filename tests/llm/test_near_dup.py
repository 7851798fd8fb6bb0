import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import hashing, links, near_dup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(ids, texts, threshold=0.8):
    """Components of weighted Jaccard similarity with the operator's IDF, counted exactly."""
    bags = [shingles(t) for t in texts]
    n = len(texts)
    df = Counter(s for b in bags for s in b)
    weight = {s: 0.5 + 0.5 * np.log(n / c) / np.log(n) for s, c in df.items()}
    by = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            by[s].append(i)
    shared = Counter()
    total = [sum(c * weight[s] for s, c in b.items()) for b in bags]
    for s, own in by.items():
        for x in range(len(own)):
            for y in range(x):
                shared[own[y], own[x]] += weight[s] * min(bags[own[x]][s], bags[own[y]][s])
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), v in shared.items():
        if v / (total[a] + total[b] - v) >= threshold:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    empty = [i for i, b in enumerate(bags) if not b]
    for i in empty[1:]:
        parent[root(i)] = root(empty[0])
    least = defaultdict(list)
    for i in range(n):
        least[root(i)].append(ids[i])
    return {ids[i]: min(least[root(i)]) for i in range(n)}


def test_table_equals_brute_force(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = {r.doc_id: r.class_id for r in near_dup.op2_near_dup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute_classes(*zip(*rows))


def test_a_hot_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(5000)}" for _ in range(300)]
    texts = []
    for i in range(400):
        own = list(base)
        for k in rng.choice(300, 3, replace=False):
            own[k] = f"x{i}_{k}"
        texts.append(" ".join(own))
    others = [" ".join(f"o{rng.integers(5000)}" for _ in range(100)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dup.dedup(df).collect()}
    assert {got[i].class_id for i in range(400)} == {0} and got[0].class_size == 400
    assert all(got[i].class_id == i for i in range(400, 500))


def test_odd_rows_and_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(5, None, "a"), (5, None, "b"), (3, "", "c"), (4, " \n", "d"), (7, long, "e"), (2, long.replace(" ", "\n"), "f"), (2, long.replace(" ", "\n"), "f"), (None, long, "g"), (8, "one two", "h"), (9, "one two three", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.class_size) for r in near_dup.dedup(df).collect())
    assert got == [(-1, 2, 4), (2, 2, 4), (2, 2, 4), (3, 3, 2), (4, 3, 2), (5, 5, 1), (5, 5, 1), (7, 2, 4), (8, 8, 1), (9, 9, 1)]
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.node for r in kept.collect()) == ["a", "b", "c", "f", "h", "i"]
    assert near_dup.dedup(df.limit(0)).collect() == [] and near_dup.keep_one(df.limit(0)).collect() == []
    assert near_dup.keep_one(df.where("text IS NULL")).count() == 2


def test_samples_agree_as_often_as_the_weights_overlap():
    rng = np.random.default_rng(3)
    n, agree, want = 300, [], []
    for _ in range(20):
        h = rng.integers(0, 1 << 52, n, dtype=np.uint64)
        h.sort()
        wa, wb = rng.uniform(0.5, 3, n).astype(np.float32), rng.uniform(0.5, 3, n).astype(np.float32)
        wb[rng.random(n) < 0.7] = 0
        wb = np.where(wb == 0, wa, wb)
        rows = np.repeat([0, 1], n)
        s = near_dup.samples(rows, np.concatenate([h, h]), np.concatenate([wa, wb]), 2)
        agree.append((s[0] == s[1]).mean())
        want.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(agree) - np.mean(want)) < 0.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0babé日", max_size=40)), max_size=12))
def test_shingles_equal_plain_python(texts):
    rows, h, times = hashing.shingles(pa.array(texts, pa.string()))
    assert list(zip(rows[:-1], h[:-1])) < list(zip(rows[1:], h[1:])) or len(rows) < 2
    named = {}
    for i, t in enumerate(texts):
        want = shingles(t)
        assert sorted(times[rows == i].tolist()) == sorted(want.values())
        # The same shingle has the same hash in any text.
        named.setdefault(frozenset(want.items()), set()).add(tuple(h[rows == i].tolist()))
    assert all(len(v) == 1 for v in named.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["class"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("side", [1 << 12, 1 << 23])
def test_tiles_find_every_link_between_classes(spark, side):
    """Members of a bucket in parts: the classes are those of all pairs, and a member's data moves once a part, not once a pair."""
    rng = np.random.default_rng(5)
    spot = {k: rng.random(60) for k in (1, 2)}
    rows = [(k, 100 * k + i, 100 * k + (0 if i < 20 else i), 0) for k in (1, 2) for i in range(60)]
    held = spark.createDataFrame(rows, "key long, node long, class long, sketch long").selectExpr("*", "struct(key * 100 AS class) AS c")
    data = spark.createDataFrame([(100 * k + i, 8, float(x)) for k in (1, 2) for i, x in enumerate(spot[k])], "node long, size int, x double")

    def prepare(tile):
        x = tile["x"].to_numpy()
        return lambda i, others: abs(x[others] - x[i]) < 0.01

    found = [(r.a, r.b) for r in links.tile_links(held, data, prepare, side=side).collect()]
    want = {(100 * k + i, 100 * k + j) for k in (1, 2) for i in range(60) for j in range(60) if i < j and (j >= 20) and abs(spot[k][i] - spot[k][j]) < 0.01}
    assert set(found) <= want

    def classes(pairs):
        group = {n: c for _, n, c, _ in rows}
        for a, b in pairs:
            group = {n: group[a] if g == group[b] else g for n, g in group.items()}
        names = {}
        return [names.setdefault(group[n], n) for n in sorted(group)]

    assert classes(found) == classes(want) and len(set(classes(want))) < 82
