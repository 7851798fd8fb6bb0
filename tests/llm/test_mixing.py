import pytest

from tideline.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    """sizes: source -> words, in order. Cap and reshare until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if part[s] > 2 * sizes[s]]
        if not above:
            return {**fixed, **part}
        for s in above:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]
        if len(fixed) == len(order):
            return fixed


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, cls string, N long")


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 400, "c": 50, None: 9}, {"a": 1, "b": 1000}, {"x": 30, "y": 20, "z": 600, "zz": 5, None: 3}])
def test_targets_are_met(spark, sizes):
    rows = [(i, "w " * 1, s, "c", 1) for s, n in sizes.items() for i in range(n)]
    got = mixing.mix(docs(spark, rows)).collect()
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sizes[s]
        assert own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 1.0001
        assert all(r.taken <= 2 * r.size for r in own)


def test_cells_of_any_size_meet_the_target(spark):
    rows = [(i, "w " * (1 + i % 37), "s" if i % 3 else "t", "c", 1) for i in range(900)]
    for cell in (10, 100, 1 << 18):
        got = mixing.mix(docs(spark, rows), cell=cell).collect()
        assert len(got) == 900
        for s in "st":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 40 * (1 if cell > 1000 else 4)


def test_odd_rows(spark):
    rows = [(1, None, None, "c", 1), (None, "a b", None, "c", 1), (None, "a b", None, "c", 1), (2, "", "s", "c", 1), (3, " \n", "s", "c", 1)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 5 and sorted(r.size for r in got) == [0, 0, 0, 2, 2]
    assert {r.target for r in got if r.source == "s"} == {0.0}
    assert sum(r.taken for r in got if r.source == "s") == 0
    assert mixing.mix(docs(spark, [])).collect() == []


def test_reruns_agree_and_rows_repeat(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}", "c", 1) for i in range(300)]
    a = docs(spark, rows)
    one, two = (sorted((r.doc_id, r.taken) for r in mixing.mix(x).collect()) for x in (a, a.repartition(7)))
    assert one == two
    out = mixing.mixed(a)
    assert out.columns == a.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(t for _, t in one)
