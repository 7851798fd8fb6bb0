import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tideline import changelog as cl
from tideline.changelog import EPOCH, WEIGHT
from tideline.operators import joins, order, paths, relational
from tideline.operators.group import Agg, distinct, distinct_delta, group, group_delta, sums_delta, sums_state
from tideline.plans import algebra as A
from tideline.plans.compiler import View, changes, delta, evaluate, replay


def bag(df):
    own = [c for c in df.columns if c != WEIGHT]
    df = cl.consolidate(df) if WEIGHT in df.columns else cl.consolidate(cl.lift(df))
    return {tuple(r[c] for c in sorted(own)): r[WEIGHT] for r in df.collect()}


def rel(spark, rows, schema):
    """rows: tuples ending in a weight."""
    return spark.createDataFrame(rows, f"{schema}, {WEIGHT} long")


def random_log(seed, keys=6, values=5, epochs=4, rows=40, nulls=True):
    """Random events (k, v, weight, epoch); only rows that are there are deleted."""
    rng, live, out = random.Random(seed), [], []
    for e in range(epochs):
        for _ in range(rows):
            if live and rng.random() < 0.4:
                k, v = live.pop(rng.randrange(len(live)))
                out.append((k, v, -1, e))
            else:
                k = None if nulls and rng.random() < 0.15 else rng.randrange(keys)
                v = None if nulls and rng.random() < 0.15 else rng.randrange(values)
                live.append((k, v))
                out.append((k, v, 1, e))
    return out


PLANS = {
    "filter": lambda: A.Filter(A.Scan("a"), F.col("x") > 2),
    "union": lambda: A.Union([A.Scan("a"), A.Project(A.Scan("b"), ["k"])]),
    "inner": lambda: A.Join(A.Scan("a"), A.Scan("b")),
    "compatible": lambda: A.Join(A.Scan("a"), A.Scan("b"), "compatible"),
    "left": lambda: A.Join(A.Scan("a"), A.Scan("b"), "left"),
    "left_condition": lambda: A.Join(A.Scan("a"), A.Scan("b"), "left", None, F.col("x") < F.col("y")),
    "semi": lambda: A.Join(A.Scan("a"), A.Scan("b"), "semi"),
    "anti": lambda: A.Join(A.Scan("a"), A.Scan("b"), "anti"),
    "minus": lambda: A.Join(A.Scan("a"), A.Project(A.Scan("b"), ["k"]), "minus"),
    "minus_apart": lambda: A.Join(A.Scan("a"), A.Project(A.Scan("b"), ["y"]), "minus"),
    "cross": lambda: A.Join(A.Project(A.Scan("a"), ["x"]), A.Project(A.Scan("b"), ["y"]), "inner", []),
    "group": lambda: A.Group(A.Scan("a"), ["k"], {"n": Agg("count"), "m": Agg("count", F.col("x")), "s": Agg("sum", F.col("x")), "avg": Agg("avg", F.col("x")), "lo": Agg("min", F.col("x")), "hi": Agg("max", F.col("x")), "one": Agg("sample", F.col("x")), "all": Agg("concat", F.col("x").cast("string")), "nd": Agg("count", F.col("x"), True), "sd": Agg("sum", F.col("x"), True), "ad": Agg("avg", F.col("x"), True), "cd": Agg("concat", F.col("x").cast("string"), True, ","), "rd": Agg("count", None, True)}),
    "group_all": lambda: A.Group(A.Scan("a"), [], {"n": Agg("count"), "hi": Agg("max", F.col("x"))}),
    "group_keys_only": lambda: A.Group(A.Scan("a"), ["k"], {}),
    "distinct": lambda: A.Distinct(A.Project(A.Scan("a"), ["k"])),
    "order": lambda: A.OrderBy(A.Scan("a"), [("k", False), ("x", True)]),
    "top": lambda: A.Slice(A.Scan("a"), 5, 3, [("x", False)]),
    "nested": lambda: A.Group(A.Join(A.Distinct(A.Scan("a")), A.Join(A.Scan("b"), A.Project(A.Scan("a"), ["k"]), "left", ["k"]), keys=["k"]), ["k"], {"n": Agg("count")}),
    "having": lambda: A.Filter(A.Group(A.Join(A.Scan("a"), A.Scan("b")), ["x"], {"n": Agg("count")}), F.col("n") > 2),
    "whole": lambda: A.Whole([A.Scan("a")], lambda d: distinct(relational.project(d, ["k"]))),
}


@pytest.mark.parametrize("name", PLANS)
def test_following_changes_equals_computing_anew(spark, name):
    schema = "k int, {} int, " + f"{WEIGHT} long, {EPOCH} int"
    logs = {"a": spark.createDataFrame(random_log(1), schema.format("x")), "b": spark.createDataFrame(random_log(2, rows=25), schema.format("y"))}
    plan = PLANS[name]()
    anew = evaluate(plan, {k: cl.integrate(v) for k, v in logs.items()})
    assert bag(replay(plan, logs, 3)) == bag(anew)


def test_view_keeps_results_and_gives_net_changes(spark):
    plan = PLANS["having"]()
    logs = {"a": random_log(5), "b": random_log(6, rows=25)}
    at = lambda k, c, e: rel(spark, [(x, y, w) for x, y, w, t in logs[k] if t == e], f"k int, {c} int")
    view = View(plan, {"a": at("a", "x", 0), "b": at("b", "y", 0)})
    for e in (1, 2, 3):
        before = bag(view.result())
        change = bag(view.apply({"a": at("a", "x", e), "b": at("b", "y", e)}))
        now = bag(view.result())
        assert change == {k: now.get(k, 0) - before.get(k, 0) for k in {*now, *before} if now.get(k, 0) != before.get(k, 0)}
    want = evaluate(plan, {k: cl.consolidate(rel(spark, [r[:3] for r in v], f"k int, {c} int")) for (k, v), c in zip(logs.items(), "xy")})
    assert now == bag(want)
    assert "Filter" in view.explain() and view.names() == ["x", "n"]


def test_delete_everything_leaves_nothing(spark):
    a = rel(spark, [(1, "p", 2), (2, "q", 1)], "k int, v string")
    b = rel(spark, [(1, "r", 1)], "k int, u string")
    for kind in ("inner", "left", "semi", "anti", "compatible"):
        plan = A.Join(A.Scan("a"), A.Scan("b"), kind, ["k"])
        out = delta(plan, {"a": a, "b": b}, {"a": cl.negate(a), "b": cl.negate(b)})
        assert bag(cl.plus([evaluate(plan, {"a": a, "b": b}), out])) == {}


def test_join_multiplies_copies_and_null_keys_match_nothing(spark):
    a, b = rel(spark, [(1, "p", 2), (None, "q", 1)], "k int, v string"), rel(spark, [(1, "r", 3), (None, "s", 1)], "k int, u string")
    assert bag(joins.inner(a, b)) == {(1, "r", "p"): 6}
    assert bag(joins.left(a, b)) == {(1, "r", "p"): 6, (None, None, "q"): 1}


def test_compatible_join_takes_the_bound_value(spark):
    a, b = rel(spark, [("1", 1), (None, 1), ("3", 1)], "a string"), rel(spark, [("1", 1), (None, 2), ("3", 1)], "a string")
    assert bag(joins.compatible(a, b)) == {("1",): 1 + 2 + 1, ("3",): 1 + 2 + 1, (None,): 2}


def test_minus_keeps_excluding_while_one_match_is_left(spark):
    a, b = rel(spark, [(1, 1)], "k int"), rel(spark, [(1, 2)], "k int")
    assert bag(joins.minus_delta(a, a.limit(0), b, rel(spark, [(1, -1)], "k int"))) == {}
    assert bag(joins.minus_delta(a, a.limit(0), b, rel(spark, [(1, -2)], "k int"))) == {(1,): 1}


def test_exists_without_shared_columns(spark):
    a, b = rel(spark, [(1, 1)], "k int"), rel(spark, [(7, 1)], "z int")
    assert bag(joins.semi(a, b)) == {(1,): 1} and bag(joins.semi(a, b.limit(0))) == {}
    assert bag(joins.anti(a, b)) == {} and bag(joins.anti(a, b.limit(0))) == {(1,): 1}


def test_one_unchanged_aggregate_stays_in_the_new_row(spark):
    a = rel(spark, [("x", 1, 1), ("x", 5, 1)], "k string, v int")
    aggs = {"n": Agg("count"), "hi": Agg("max", F.col("v"))}
    got = bag(group_delta(a, rel(spark, [("x", 2, 1)], "k string, v int"), ["k"], aggs))
    assert got == {(5, "x", 2): -1, (5, "x", 3): 1}


def test_a_bad_value_clears_when_it_is_deleted(spark):
    a = rel(spark, [("x", "1", 1), ("x", "no", 1)], "k string, v string")
    number = F.col("v").try_cast("int")
    aggs = {"s": Agg("sum", F.coalesce(number, F.lit(0)), ok=number.isNotNull())}
    assert bag(group(a, ["k"], aggs)) == {("x", None): 1}
    assert bag(group_delta(a, rel(spark, [("x", "no", -1)], "k string, v string"), ["k"], aggs)) == {("x", None): -1, ("x", 1): 1}


def test_empty_input(spark):
    none = rel(spark, [], "k string, v int")
    aggs = {"n": Agg("count"), "s": Agg("sum", F.col("v")), "a": Agg("avg", F.col("v")), "m": Agg("min", F.col("v")), "c": Agg("concat", F.col("v").cast("string"))}
    assert group(none, [], aggs).drop(WEIGHT).collect()[0].asDict() == {"n": 0, "s": 0, "a": 0.0, "m": None, "c": ""}
    assert bag(group(none, ["k"], aggs)) == {}
    first = group_delta(none, rel(spark, [("x", 4, 1)], "k string, v int"), [], {"n": Agg("count")})
    assert bag(first) == {(0,): -1, (1,): 1}


def test_sums_without_old_rows(spark):
    log = random_log(9, nulls=False)
    df = lambda e: rel(spark, [r[:3] for r in log if r[3] == e], "k int, x int")
    aggs = {"n": Agg("count"), "s": Agg("sum", F.col("x")), "a": Agg("avg", F.col("x"))}
    state, out = sums_state(df(0), ["k"], aggs), [group(cl.consolidate(df(0)), ["k"], aggs)]
    for e in (1, 2, 3):
        after, change = sums_delta(state, df(e), ["k"], aggs)
        state = cl.checkpoint(state.join(after.select("k"), "k", "left_anti").unionByName(after))
        out.append(change)
    assert bag(cl.plus(out)) == bag(group(cl.consolidate(rel(spark, [r[:3] for r in log], "k int, x int")), ["k"], aggs))
    with pytest.raises(ValueError):
        sums_delta(state, df(1), ["k"], {"m": Agg("max", F.col("x"))})


def test_distinct_counts_references(spark):
    a = rel(spark, [("1", 2), ("2", 1)], "a string")
    assert bag(distinct_delta(a, rel(spark, [("1", -1), ("2", -1), ("3", 2)], "a string"))) == {("2",): -1, ("3",): 1}


def test_strict_mode_finds_deletions_of_what_is_not_there(spark):
    with pytest.raises(PySparkException, match="not there"):
        cl.validate(cl.consolidate(rel(spark, [("1", 1), ("1", -2)], "a string"))).collect()


def test_set_normalise(spark):
    log = [("q", 1, 0), ("q", 1, 1), ("q", -1, 2), ("q", -1, 3), ("r", -1, 0), ("r", 1, 4)]
    got = cl.set_normalise(spark.createDataFrame(log, f"a string, {WEIGHT} long, {EPOCH} int")).collect()
    assert sorted((r.a, r[EPOCH], r[WEIGHT]) for r in got) == [("q", 0, 1), ("q", 2, -1), ("r", 4, 1)]


def test_ranks(spark):
    df = rel(spark, [(5, 1), (1, 2), (None, 1), (11, 1), (7, 1)], "a int")
    got = sorted((r[order.RANK], r.a) for r in order.ranked(df, [("a", True)]).collect())
    assert got == [(0, None), (1, 1), (2, 1), (3, 5), (4, 7), (5, 11)]
    assert sorted((r[order.RANK], r.a) for r in order.ranked(df, [("a", False)]).collect())[0] == (0, 11)
    big = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a"))
    ranks = order.ranked(cl.lift(big.repartition(7)), [("a", True)]).collect()
    assert all(r[order.RANK] == r.a for r in ranks) and len(ranks) == 5000


def test_rank_changes_name_changed_rows_only(spark):
    old = rel(spark, [(1, 1), (2, 1), (3, 1)], "a int")
    d = rel(spark, [(2, -1), (0, 1)], "a int")
    got = order.ranked_delta(old, cl.consolidate(cl.plus([old, d])), d, [("a", True)])
    assert bag(got) == {(1, 2): -1, (0, 0): 1}


@pytest.mark.parametrize("start,length", [(0, 1), (1, 3), (0, None), (4, 10), (6, 1), (2, 0)])
def test_slices_of_bags(spark, start, length):
    df = rel(spark, [("1", 3), ("2", 3)], "a string")
    rows = ["1"] * 3 + ["2"] * 3
    want = rows[start:] if length is None else rows[start : start + length]
    assert bag(order.top(df, [("a", True)], length, start)) == {(x,): want.count(x) for x in set(want)}
    assert sum(bag(order.some(df, length, start)).values()) == len(want) == order.window_size(6, length, start)


def test_paths(spark):
    e = rel(spark, [("a", "p", "b", 1), ("b", "p", "c", 1), ("c", "q", "a", 1), ("c", "p", "a", 1)], "s string, p string, o string")
    pairs = lambda d: {k: v for k, v in ((tuple((r.s, r.o)), r[WEIGHT]) for r in cl.consolidate(d).collect())}
    p = paths.link(e, "p")
    assert pairs(paths.sequence(p, paths.inverse(p))) == {("a", "a"): 1, ("b", "b"): 1, ("c", "c"): 1}
    assert pairs(paths.negated(e, ["p"])) == {("c", "a"): 1}
    assert pairs(paths.negated(e, [], ["p"])) == {("a", "c"): 1}
    assert pairs(paths.alternative(p, paths.link(e, "q")))[("c", "a")] == 2
    assert len(pairs(paths.zero_or_one(p, e))) == 6
    assert len(pairs(paths.one_or_more(p))) == 9 and len(pairs(paths.zero_or_more(paths.link(e, "q"), e))) == 4


def test_nop_and_values(spark):
    assert bag(relational.nothing(spark)) == {(): 1}
    v = relational.values(spark, "a string, b string", [("1", None), ("1", None)])
    assert bag(v) == {("1", None): 2}
    assert bag(joins.inner(relational.nothing(spark), v, [])) == {("1", None): 2}


def test_join_with_values_moves_no_rows(spark):
    given = relational.values(spark, "k string, name string", [("F", "filled"), ("O", "open"), (None, "none")])
    orders = lambda n: cl.lift(spark.range(n).select(F.when(F.col("id") >= 0, "F").alias("k"), "id"))
    assert bag(joins.inner(orders(10), given).select("name", WEIGHT)) == {("filled",): 10}
    plan = joins.inner(orders(10**10), given)._jdf.queryExecution().executedPlan().toString()  # not run
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["order", "top", "whole", "ranked_group"])
def test_what_is_taken_anew_is_taken_once_and_equals_its_changes(spark, name, monkeypatch):
    schema = f"k int, x int, {WEIGHT} long, {EPOCH} int"
    logs = {"a": spark.createDataFrame(random_log(3), schema)}
    plan = {**PLANS, "ranked_group": lambda: A.Map(A.OrderBy(A.Group(A.Scan("a"), ["k"], {"n": Agg("count")}), [("n", False)]), lambda d: d.drop("k"))}[name]()
    step_by_step = bag(cl.plus(list(changes(plan, logs, 3).values())))
    took = []
    for f in ("ranked", "top"):
        monkeypatch.setattr(order, f, lambda *a, _f=getattr(order, f), **k: took.append(1) or _f(*a, **k))
    assert bag(replay(plan, logs, 3)) == step_by_step
    assert len(took) == (name != "whole")
