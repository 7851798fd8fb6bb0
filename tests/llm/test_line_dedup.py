import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import edit_distance, line_dedup


def normal(line):
    return " ".join(re.findall(r"[a-z\u0080-\U0010ffff]+", line.lower()))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def removed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in line_dedup.removed_lines(df, **options).collect()}


def test_fuzzy_lines_of_a_hot_group(spark):
    rng = np.random.default_rng(2)
    base = " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}word" for k in range(120))
    rows = [(i, f"{base.replace('word', 'ward', 1)}\nunique line of document number {'xyz'[i % 3]} {'abcdefghijklmnopqrst'[i % 20]} {'qwertzuiop'[i // 20 % 10]}" if i % 2 else base.upper() + f" {i}!") for i in range(200)]
    got = removed(spark, rows)
    assert [k for i in range(200) for k in got[i].removed if k == 0] == [0] * 199 and got[0].removed == []


@pytest.mark.parametrize("n", [1, 3, 70, 5000])
def test_simhash_equals_counting(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.unique(np.append(0, rng.integers(0, n, 4)))
    want = []
    for lo, hi in zip(starts, [*starts[1:], n]):
        want.append(sum(int(2 * sum((int(x) >> b) & 1 for x in h[lo:hi]) > hi - lo) << b for b in range(64)))
    for step in (1, 2, 64, 1 << 15):
        assert line_dedup.simhash(h, starts, step).tolist() == want


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_close_hashes_share_a_key(blocks):
    rng = np.random.default_rng(blocks)
    a = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, line_dedup.MOST_BITS, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    found = np.zeros(60, bool)
    for c, ((width, x), (_, y)) in enumerate(zip(line_dedup.arranged(a, blocks), line_dedup.arranged(b, blocks))):
        found |= x >> np.uint64(64 - width) == y >> np.uint64(64 - width)
        assert (line_dedup.restored(x, blocks, c) == a).all()
    assert found.all()


def test_edit_distance_equals_the_table_of_distances():
    rng = np.random.default_rng(3)
    one, two = [], []
    for n in (1, 2, 5, 20, 63, 64, 65, 128, 129, 200):
        for _ in range(20):
            a = "".join(rng.choice(list("abcdeé \U0001F600"), n))
            b = list(a)
            for _ in range(int(rng.integers(0, max(1, n // 4) + 1))):
                at, op = int(rng.integers(0, len(b) + 1)), rng.integers(3)
                b[at : at + (op > 0)] = "x" if op < 2 else ""
            one.append(a)
            two.append("".join(b))
    want = [distance(a, b) <= int(0.15 * max(len(a), len(b)) + 1e-9) for a, b in zip(one, two)]
    assert edit_distance.similar(one, two, 0.85).tolist() == want and 20 < sum(want) < 180
    for blocks in (1, 2, 3):
        own = [(i, *sorted((one[i], two[i]), key=len)) for i in range(len(one)) if one[i] and two[i] and (min(len(one[i]), len(two[i])) + 63) // 64 == blocks]
        most = np.array([int(0.15 * len(b) + 1e-9) for _, _, b in own])
        assert edit_distance.within_many([a for _, a, _ in own], [b for _, _, b in own], most, blocks).tolist() == [want[i] for i, _, _ in own]
        assert [edit_distance.within(a, b, int(m)) for (_, a, b), m in zip(own, most)] == [want[i] for i, _, _ in own]


def test_long_lines_are_compared_in_characters(spark):
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"] * 12
    rows = [(0, " ".join(words)), (1, " ".join(words[:3000] + ["other"] + words[3001:])), (2, " ".join(reversed(words)))]
    got = removed(spark, rows)
    assert [got[i].removed for i in range(3)] == [[], [0], []]


def test_hot_keys_and_large_buckets_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    rows = []
    for g in range(3):
        base = [word() for _ in range(30)]
        for i in range(40):
            own = list(base)
            own[int(rng.integers(30))] = word()
            rows.append((len(rows), " ".join(own if i % 4 else base[:10] + [word() for _ in range(20)])))
    want = {k: r.removed for k, r in removed(spark, rows).items()}
    assert sum(map(len, want.values())) == 3 * 29
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    assert {k: r.removed for k, r in removed(spark, rows).items()} == want
    monkeypatch.setattr(line_dedup, "HOT", 5)
    assert {k: r.removed for k, r in removed(spark, rows).items()} == want


def test_links_of_small_buckets_stay_where_a_key_is_hot(spark, monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    base, pair = [word() for _ in range(30)], [word() for _ in range(30)]
    rows = [(i, " ".join([*base[:29], word()])) for i in range(40)] + [(50, " ".join(pair)), (51, " ".join([*pair[:29], word()]))]
    want = [*range(1, 40), 51]
    assert [k for k, r in sorted(removed(spark, rows).items()) if r.removed] == want
    monkeypatch.setattr(line_dedup, "HOT", 20)
    assert [k for k, r in sorted(removed(spark, rows).items()) if r.removed] == want


def test_equal_lines_of_any_length(spark):
    got = removed(spark, [(1, "a\nok\n\n--"), (2, "A!\nno\n\n--"), (3, "b")])
    assert [got[i].removed for i in (1, 2, 3)] == [[], [0], []]


def test_odd_rows(spark):
    line = "This is a line that is long enough to count."
    rows = [(None, line, 0, "x"), (1, None, 0, "x"), (2, "", 0, "x"), (3, f"short\n\n{line}\n{line}\nbrief", 0, "x"), (4, line, 0, "x"), (4, line, 0, "x"), (4, f"{line}\nmore", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, DK string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in out.collect())
    left = f"short\n\n{line}\nbrief"
    assert got == [(0, "", 0), (1, "", 0), (2, "", 0), (3, left, len(left)), (4, "", 0), (4, "", 0), (4, "more", 4)]
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []
    assert line_dedup.dedup_lines(df.where("text IS NULL")).count() == 1


def every_pair(spark, docs):
    """(doc, pos) removed where all pairs of lines are compared by Spark's edit distance, whatever their hashes."""
    where = defaultdict(list)
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if n := normal(line):
                where[n].append((i, k))
    names = list(where)
    x = spark.createDataFrame(list(enumerate(names)), "i long, x string").repartition(16)
    both = x.join(x.selectExpr("i AS j", "x AS y"), F.expr("i < j AND least(length(x), length(y)) >= 0.85D * greatest(length(x), length(y)) - 1"))
    links = [(r.i, r.j) for r in both.where("levenshtein(x, y, CAST(floor(0.15D * greatest(length(x), length(y)) + 1e-9D) AS INT)) >= 0").collect()]
    group = list(range(len(names)))
    for i, j in links:
        group = [group[i] if g == group[j] else g for g in group]
    groups = defaultdict(list)
    for i, n in enumerate(names):
        groups[group[i]] += where[n]
    return sorted(x for g in groups.values() for x in sorted(g)[1:])


def test_table_equals_edit_similarity_of_every_pair(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = line_dedup.op9_line_dedup(spark, "/root/testdata/sf0.001").collect()
    want = every_pair(spark, rows)
    found = sorted((r.doc_id, k) for r in got for k in r.removed)
    assert set(found) <= set(want) and len(found) >= 0.99 * len(want)
    texts = dict(rows)
    for r in got:
        lines = texts[r.doc_id].split("\n")
        assert r.n_lines == len(lines) and r.text == "\n".join(x for k, x in enumerate(lines) if k not in set(r.removed))


@pytest.mark.parametrize("n", [3, 4, 5, 8, 12, 14, 20, 34, 60])
def test_one_other_word(spark, n):
    """Lines of n random words and copies with one word replaced: all are found where the edit similarity is reached."""
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    rows = []
    for i in range(100):
        words = [word() for _ in range(n)]
        rows.append((2 * i, " ".join(words)))
        at = int(rng.integers(n))
        words[at] = words[at][:-1] + "é" if n < 8 else word()
        rows.append((2 * i + 1, " ".join(words)))
    got = removed(spark, rows)
    assert [i for i in sorted(got) if got[i].removed] == list(range(1, 200, 2))


def test_shingle_keys():
    h = np.random.default_rng(1).integers(0, 1 << 63, 60, dtype=np.uint64)
    h[30:] = h[:30]
    rows, keys = line_dedup.shingle_keys(h, np.array([0, 30, 58, 59]))
    own = [keys[rows == r] for r in range(4)]
    assert [len(set(k)) for k in own] == [line_dedup.SHINGLES] * 2 + [1, 1]
    assert set(own[0].tolist()) & set(own[1].tolist())
    # A short line shares a key with the same words in another order and one replaced, and with the line without one.
    one = line_dedup.shingle_keys(h[:5], np.array([0]))[1].tolist()
    for other in (np.append(h[1:5][::-1], h[20]), h[1:5]):
        assert set(one) & set(line_dedup.shingle_keys(other, np.array([0]))[1].tolist())


def test_counts_of_letter_pairs_rule_out_no_like_line():
    """All pairs that reach the edit similarity pass the test of a tile, at the threshold too."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdeé \U0001F600"), 100))
    lines = [base]
    for k in range(60):
        x = list(base)
        for at in rng.choice(100, k % 20, replace=False):
            x[at] = "z" if k % 2 else "" if k % 3 else x[at] * 2
        lines.append("".join(x))
    sketch = pa.array([{"sim": 0, "chars": 100, "words": 9, "shingle": True}] * len(lines), pa.struct([("sim", pa.int64()), ("chars", pa.int32()), ("words", pa.int32()), ("shingle", pa.bool_())]))
    tile = pa.table({"key": pa.array([-5] * len(lines), pa.int64()), "sketch": sketch, "line": lines, "keys": [[-5, 3]] * len(lines)})
    maybe = line_dedup.maybe_similar(tile, 0.85)
    for i in range(len(lines)):
        others = np.delete(np.arange(len(lines)), i)
        like = others[edit_distance.similar([lines[i]] * len(others), [lines[j] for j in others], 0.85)]
        assert set(like) <= set(others[maybe(i, others)])
    smaller = tile.set_column(3, "keys", pa.array([[-7, -5]] * len(lines)))  # they share a smaller bucket, where they meet
    assert not len(line_dedup.maybe_similar(smaller, 0.85)(0, np.arange(1, len(lines))))
