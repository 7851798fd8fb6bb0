"""The registered queries of the engine and their DuckDB SQL.

Each maintained query takes its tables as changelogs of three epochs (everything; one residue class of the key deleted; a
part of it added again), follows them change by change, and returns the final bag. The SQL states the same on the net
tables from scratch, so a match shows that following changes and computing anew agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changelog as cl
from .changelog import EPOCH, WEIGHT
from .functions import scalar as fn
from .operators import joins, order, paths, relational
from .operators.group import Agg
from .plans import algebra as A
from .plans.compiler import changes, delta, replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: table -> (key, modulus, residue, modulus of what comes back)
RECIPE = {"lineitem": ("l_orderkey", 7, 3, 21), "orders": ("o_orderkey", 5, 1, 15), "customer": ("c_custkey", 9, 4, 27), "supplier": ("s_suppkey", 6, 2, 12), "part": ("p_partkey", 8, 5, 24), "events": ("event_id", 11, 4, 33), "pages": ("page_id", 4, 1, 8)}
LAST = 2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def log(spark: SparkSession, sf_dir: str, table: str, *names: str | F.Column) -> DataFrame:
    """The table's changelog, with the columns named only."""
    key, m, r, m2 = RECIPE[table]
    rows = read(spark, sf_dir, table)
    cut = lambda df: df.select(*names) if names else df
    parts = [cl.lift(cut(rows), 1, 0), cl.lift(cut(rows.where(F.col(key) % m == r)), -1, 1), cl.lift(cut(rows.where(F.col(key) % m2 == r)), 1, 2)]
    return cl.plus(parts)


def net(table: str) -> str:
    """SQL of the table after all epochs."""
    key, m, r, m2 = RECIPE[table]
    return f"(SELECT * FROM {table} WHERE NOT ({key} % {m} = {r} AND {key} % {m2} <> {r}))"


def rows(df: DataFrame) -> DataFrame:
    """A weighted bag as plain rows, one for each copy."""
    return cl.expand(cl.consolidate(df))


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def cents(name: str):
    return F.round(F.col(name) * 100).cast("long")


LINE = ("l_orderkey", "l_linenumber", "l_returnflag")
L, O, C, S, P, E, PG = (net(t) for t in ("lineitem", "orders", "customer", "supplier", "part", "events", "pages"))


def revenue_plan() -> A.Node:
    lines = A.Project(A.Scan("lineitem"), [F.col("l_orderkey").alias("k"), cents("l_extendedprice").alias("price"), F.round(F.col("l_discount") * 100).cast("long").alias("off")])
    orders = A.Project(A.Scan("orders"), [F.col("o_orderkey").alias("k"), "o_orderpriority"])
    joined = A.Join(orders, lines, keys=["k"])
    return A.Group(joined, ["o_orderpriority"], {"revenue": Agg("sum", F.col("price") * (100 - F.col("off"))), "n": Agg("count")})


@query(f"SELECT o_orderpriority, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)))::BIGINT AS revenue, count(*) AS n FROM {O} o JOIN {L} l ON o_orderkey = l_orderkey GROUP BY 1")
def revenue_by_priority(spark, sf_dir):
    logs = {"lineitem": log(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount"), "orders": log(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")}
    return cl.expand(replay(revenue_plan(), logs, LAST))


# Stores and sources


@query(f"SELECT l_orderkey, l_linenumber, l_returnflag FROM {L}")
def store_integrate(spark, sf_dir):
    return cl.expand(cl.integrate(log(spark, sf_dir, "lineitem", *LINE)))


@query("""WITH e AS (SELECT l_returnflag, l_linestatus, l_linenumber, 0 AS t FROM lineitem UNION ALL SELECT l_returnflag, l_linestatus, l_linenumber, 1 FROM lineitem WHERE l_orderkey % 7 = 3 AND l_linenumber < 4)
SELECT l_returnflag, l_linestatus, l_linenumber FROM e GROUP BY ALL HAVING max(t) = 0""")
def store_set_semantics(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem")
    names = ["l_returnflag", "l_linestatus", "l_linenumber"]
    added = cl.lift(own.select(*names), 1, 0)
    gone = cl.lift(own.where("l_orderkey % 7 = 3 AND l_linenumber < 4").select(*names), -1, 1)
    return cl.expand(cl.integrate(cl.set_normalise(cl.plus([added, gone]))))


@query(f"SELECT count(*) AS count FROM {L} WHERE l_returnflag = 'R'")
def store_count(spark, sf_dir):
    return relational.count(log(spark, sf_dir, "lineitem", "l_returnflag").where("l_returnflag = 'R'"))


@query(f"SELECT (SELECT count(*) FROM {L} WHERE l_linenumber = 1) AS before, 0::BIGINT AS after")
def delete_stream(spark, sf_dir):
    match = cl.integrate(log(spark, sf_dir, "lineitem", *LINE).where("l_linenumber = 1"))
    left = cl.consolidate(cl.plus([match, relational.retract_all(match)]))
    return relational.count(match).withColumnRenamed("count", "before").crossJoin(relational.count(left).withColumnRenamed("count", "after"))


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM {L} WHERE l_linenumber = l_quantity")
def pattern_repeat_var(spark, sf_dir):
    plan = A.Map(A.Scan("l"), lambda d: relational.repeated(d, "l_linenumber", "l_quantity"))
    return cl.expand(replay(plan, {"l": log(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")}, LAST))


@query("SELECT n_nationkey AS s, n_name AS o, n_regionkey AS g FROM nation WHERE n_regionkey <> 0")
def graph_scope(spark, sf_dir):
    quads = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s"), F.col("n_name").alias("o"), F.expr("nullif(n_regionkey, 0)").alias("g"))
    return quads.where("g IS NOT NULL")


@query("SELECT n_nationkey AS s, n_name AS o FROM nation")
def graph_union_default(spark, sf_dir):
    quads = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s"), F.col("n_name").alias("o"), F.expr("nullif(n_regionkey, 0)").alias("g"))
    return quads.drop("g")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def source_multiset(spark, sf_dir):
    from .sources.live import members

    events = spark.createDataFrame([("F", 1, 0), ("O", 1, 0), ("P", 1, 0), ("F", 1, 1), ("P", -1, 2)], f"source_id string, {WEIGHT} long, {EPOCH} int")
    quads = cl.lift(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderstatus").alias("source_id")))
    return cl.expand(members(events, quads).drop("source_id"))


@query(f"SELECT DISTINCT regexp_extract(url, '://([^/]*)', 1) AS host FROM {PG}")
def source_distinct_refcount(spark, sf_dir):
    plan = A.Distinct(A.Project(A.Scan("pages"), [F.regexp_extract("url", "://([^/]*)", 1).alias("host")]))
    return cl.expand(replay(plan, {"pages": log(spark, sf_dir, "pages", "url")}, LAST))


@query("""SELECT o_orderkey, o_orderstatus, -1::BIGINT AS change FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 7 <> 2)
UNION ALL SELECT o_orderkey, o_orderstatus, 1::BIGINT FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 2 EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders)""")
def snapshot_diff(spark, sf_dir):
    from .sources.live import snapshot_changes

    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = old.where("o_orderkey % 7 <> 2").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END"))
    return snapshot_changes(old, new).withColumnRenamed(WEIGHT, "change")


# Filter, extend, values, exists


@query(f"SELECT l_orderkey, l_linenumber FROM {L} WHERE TRY_CAST(CASE WHEN l_linenumber = 3 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS BIGINT) > 2")
def filter_ebv_error(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 3, "x").otherwise(F.col("l_linenumber").cast("string"))
    plan = A.Project(A.Filter(A.Scan("l"), fn.cast(text, "integer") > 2), ["l_orderkey", "l_linenumber"])
    return cl.expand(replay(plan, {"l": log(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")}, LAST))


@query(f"SELECT o_orderkey, concat(o_orderstatus, '-', o_orderpriority) AS label, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level FROM {O}")
def extend_bind(spark, sf_dir):
    plan = A.Project(A.Extend(A.Scan("o"), {"label": F.concat("o_orderstatus", F.lit("-"), "o_orderpriority"), "level": fn.cast(F.substring("o_orderpriority", 1, 1), "integer")}), ["o_orderkey", "label", "level"])
    return cl.expand(replay(plan, {"o": log(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")}, LAST))


@query(f"SELECT o_orderkey, o_orderstatus, name FROM {O} JOIN (VALUES ('F', 'filled'), ('O', 'open')) v(o_orderstatus, name) USING (o_orderstatus)")
def values_join(spark, sf_dir):
    names = relational.values(spark, "o_orderstatus string, name string", [("F", "filled"), ("O", "open")])
    plan = A.Join(A.Scan("o"), A.Inline(names))
    return cl.expand(replay(plan, {"o": log(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")}, LAST))


def _order_lines(spark, sf_dir, where="l_returnflag = 'R'"):
    lines = log(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag").where(where)
    return {"o": log(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "l": lines.select("o_orderkey", "l_linenumber", WEIGHT, EPOCH)}


@query(f"SELECT o_orderkey, o_custkey FROM {O} o WHERE EXISTS (SELECT 1 FROM {L} l WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def exists_delta(spark, sf_dir):
    return cl.expand(replay(A.Join(A.Scan("o"), A.Scan("l"), "semi", ["o_orderkey"]), _order_lines(spark, sf_dir), LAST))


@query(f"SELECT o_orderkey, o_custkey FROM {O} o WHERE NOT EXISTS (SELECT 1 FROM {L} l WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def not_exists_delta(spark, sf_dir):
    return cl.expand(replay(A.Join(A.Scan("o"), A.Scan("l"), "anti", ["o_orderkey"]), _order_lines(spark, sf_dir), LAST))


# Joins


@query(f"SELECT o_orderkey, o_custkey, l_linenumber FROM {O} JOIN {L} ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def join_inner_delta(spark, sf_dir):
    return cl.expand(replay(A.Join(A.Scan("o"), A.Scan("l"), keys=["o_orderkey"]), _order_lines(spark, sf_dir), LAST))


@query(f"""WITH a AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS n FROM {S}), b AS (SELECT CASE WHEN n_regionkey = 2 THEN NULL ELSE n_nationkey END AS n, n_name FROM nation)
SELECT a.s_suppkey, coalesce(a.n, b.n) AS n, b.n_name FROM a, b WHERE a.n = b.n OR a.n IS NULL OR b.n IS NULL""")
def join_undef_compatible(spark, sf_dir):
    a = log(spark, sf_dir, "supplier", "s_suppkey", F.expr("CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END").alias("n"))
    b = cl.lift(read(spark, sf_dir, "nation").select(F.expr("CASE WHEN n_regionkey = 2 THEN NULL ELSE n_nationkey END").alias("n"), "n_name"), 1, 0)
    return cl.expand(replay(A.Join(A.Scan("a"), A.Scan("b"), "compatible"), {"a": a, "b": b}, LAST))


@query("SELECT r_name, n_name FROM region CROSS JOIN (SELECT n_name FROM nation WHERE n_nationkey < 5)")
def join_cross(spark, sf_dir):
    a = cl.lift(read(spark, sf_dir, "region").select("r_name"))
    b = cl.lift(read(spark, sf_dir, "nation").where("n_nationkey < 5").select("n_name"))
    return rows(joins.inner(a, b, []))


@query(f"SELECT c_custkey, n_name FROM {C} JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def join_bind_small_driver(spark, sf_dir):
    nations = cl.lift(read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), "n_name"), 1, 0)
    plan = A.Project(A.Join(A.Scan("n"), A.Scan("c"), keys=["k"]), ["c_custkey", "n_name"])
    return cl.expand(replay(plan, {"n": nations, "c": log(spark, sf_dir, "customer", "c_custkey", F.col("c_nationkey").alias("k"))}, LAST))


@query(f"SELECT c_custkey, o_orderkey, l_linenumber, s_suppkey FROM {C} JOIN {O} ON c_custkey = o_custkey JOIN {L} ON o_orderkey = l_orderkey JOIN {S} ON l_suppkey = s_suppkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def join_multiway(spark, sf_dir):
    logs = {
        "c": log(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'").drop("c_mktsegment"),
        "o": log(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").drop("o_orderstatus"),
        "l": log(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_suppkey").alias("s_suppkey")),
        "s": log(spark, sf_dir, "supplier", "s_suppkey"),
    }
    plan = A.Join(A.Join(A.Join(A.Scan("c"), A.Scan("o")), A.Scan("l")), A.Scan("s"))
    return cl.expand(replay(plan, logs, LAST)).select("c_custkey", "o_orderkey", "l_linenumber", "s_suppkey")


@query(f"SELECT o_orderkey, o_custkey, l_linenumber FROM {O} LEFT JOIN (SELECT * FROM {L} WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey")
def optional_delta(spark, sf_dir):
    return cl.expand(replay(A.Join(A.Scan("o"), A.Scan("l"), "left", ["o_orderkey"]), _order_lines(spark, sf_dir), LAST))


@query(f"SELECT o_orderkey, o_custkey, l_linenumber FROM {O} LEFT JOIN (SELECT * FROM {L} WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey AND l_linenumber > o_custkey % 5")
def optional_condition(spark, sf_dir):
    plan = A.Join(A.Scan("o"), A.Scan("l"), "left", ["o_orderkey"], F.expr("l_linenumber > o_custkey % 5"))
    return cl.expand(replay(plan, _order_lines(spark, sf_dir), LAST))


@query(f"SELECT c_custkey, c_nationkey FROM {C} c WHERE NOT EXISTS (SELECT 1 FROM {O} o WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def minus_delta(spark, sf_dir):
    big = log(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_totalprice").where("o_totalprice > 400000").drop("o_totalprice")
    return cl.expand(replay(A.Join(A.Scan("c"), A.Scan("o"), "minus"), {"c": log(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), "o": big}, LAST))


@query(f"WITH a AS (SELECT s_suppkey, nullif(s_nationkey % 4, 0) AS k FROM {S}), b AS (SELECT nullif(n_nationkey % 2, 0) AS k FROM nation) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k IS NOT DISTINCT FROM a.k)")
def minus_null_key(spark, sf_dir):
    a = log(spark, sf_dir, "supplier", "s_suppkey", F.expr("nullif(s_nationkey % 4, 0)").alias("k"))
    b = cl.lift(read(spark, sf_dir, "nation").select(F.expr("nullif(n_nationkey % 2, 0)").alias("k")), 1, 0)
    return cl.expand(replay(A.Join(A.Scan("a"), A.Scan("b"), "minus"), {"a": a, "b": b}, LAST))


@query(f"SELECT s_suppkey, s_name FROM {S}")
def minus_no_shared(spark, sf_dir):
    b = cl.lift(read(spark, sf_dir, "nation").select("n_name"), 1, 0)
    return cl.expand(replay(A.Join(A.Scan("a"), A.Scan("b"), "minus"), {"a": log(spark, sf_dir, "supplier", "s_suppkey", "s_name"), "b": b}, LAST))


# Grouping


def _grouped(spark, sf_dir, keys, aggs, table="lineitem", extra=(), where=None):
    rows_ = log(spark, sf_dir, table, *keys, *extra)
    if where:
        rows_ = rows_.where(where)
    return cl.expand(replay(A.Group(A.Scan("t"), list(keys), aggs), {"t": rows_}, LAST))


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {L} GROUP BY ALL")
def group_count_star(spark, sf_dir):
    return _grouped(spark, sf_dir, ("l_returnflag", "l_linestatus"), {"n": Agg("count")}, extra=("l_linenumber",))


@query(f"SELECT l_returnflag, count(nullif(l_linenumber, 3)) AS n FROM {L} GROUP BY ALL")
def group_count(spark, sf_dir):
    return _grouped(spark, sf_dir, ("l_returnflag",), {"n": Agg("count", F.expr("nullif(l_linenumber, 3)"))}, extra=("l_linenumber",))


@query(f"SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linenumber FROM {L}) d WHERE d.l_returnflag = l.l_returnflag) AS n_rows FROM {L} l GROUP BY l_returnflag")
def group_count_distinct(spark, sf_dir):
    return _grouped(spark, sf_dir, ("l_returnflag",), {"n": Agg("count", F.col("l_suppkey"), True), "n_rows": Agg("count", None, True)}, extra=("l_suppkey", "l_linenumber"))


@query(f"SELECT l_linenumber, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS total FROM {L} GROUP BY ALL")
def group_sum(spark, sf_dir):
    return _grouped(spark, sf_dir, ("l_linenumber",), {"total": Agg("sum", cents("l_extendedprice"))}, extra=("l_extendedprice",))


@query(f"SELECT l_linenumber, sum(DISTINCT CAST(l_quantity AS BIGINT))::BIGINT AS total FROM {L} GROUP BY ALL")
def group_sum_distinct(spark, sf_dir):
    return _grouped(spark, sf_dir, ("l_linenumber",), {"total": Agg("sum", F.col("l_quantity").cast("long"), True)}, extra=("l_quantity",))


@query(f"SELECT l_linenumber, sum(CAST(l_quantity AS BIGINT))::DOUBLE / count(*)::DOUBLE AS mean FROM {L} GROUP BY ALL")
def group_avg(spark, sf_dir):
    return _grouped(spark, sf_dir, ("l_linenumber",), {"mean": Agg("avg", F.col("l_quantity").cast("long"))}, extra=("l_quantity",))


@query(f"SELECT l_linenumber, sum(DISTINCT CAST(l_quantity AS BIGINT))::DOUBLE / count(DISTINCT CAST(l_quantity AS BIGINT))::DOUBLE AS mean FROM {L} GROUP BY ALL")
def group_avg_distinct(spark, sf_dir):
    return _grouped(spark, sf_dir, ("l_linenumber",), {"mean": Agg("avg", F.col("l_quantity").cast("long"), True)}, extra=("l_quantity",))


@query(f"SELECT l_returnflag, l_linenumber, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM {L} GROUP BY ALL")
def group_min_max(spark, sf_dir):
    return _grouped(spark, sf_dir, ("l_returnflag", "l_linenumber"), {"lo": Agg("min", F.col("l_extendedprice")), "hi": Agg("max", F.col("l_extendedprice"))}, extra=("l_extendedprice",))


@query(f"SELECT o_orderpriority, min(o_orderkey) AS one FROM {O} GROUP BY ALL")
def group_sample(spark, sf_dir):
    return _grouped(spark, sf_dir, ("o_orderpriority",), {"one": Agg("sample", F.col("o_orderkey"))}, "orders", ("o_orderkey",))


@query(f"SELECT s_nationkey, string_agg(s_name, ' ' ORDER BY s_name) AS names FROM {S} GROUP BY ALL")
def group_concat(spark, sf_dir):
    return _grouped(spark, sf_dir, ("s_nationkey",), {"names": Agg("concat", F.col("s_name"))}, "supplier", ("s_name",))


@query(f"SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS segments FROM {C} GROUP BY ALL")
def group_concat_distinct(spark, sf_dir):
    return _grouped(spark, sf_dir, ("c_nationkey",), {"segments": Agg("concat", F.col("c_mktsegment"), True, "; ")}, "customer", ("c_mktsegment",))


@query(f"SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds, max(o_totalprice) AS hi FROM {O} GROUP BY ALL")
def group_multi_agg(spark, sf_dir):
    return _grouped(spark, sf_dir, ("o_orderpriority",), {"n": Agg("count"), "kinds": Agg("count", F.col("o_orderstatus"), True), "hi": Agg("max", F.col("o_totalprice"))}, "orders", ("o_orderstatus", "o_totalprice"))


@query("SELECT 0::BIGINT AS n, 0::BIGINT AS total, NULL::DOUBLE AS hi")
def group_empty_input(spark, sf_dir):
    return _grouped(spark, sf_dir, (), {"n": Agg("count"), "total": Agg("sum", F.col("l_linenumber").cast("long")), "hi": Agg("max", F.col("l_quantity"))}, extra=("l_linenumber", "l_quantity"), where="l_linenumber < 0")


@query(f"SELECT l_linenumber, count(*) AS n FROM {L} WHERE l_linenumber < 0 GROUP BY ALL")
def group_empty_keyed(spark, sf_dir):
    return _grouped(spark, sf_dir, ("l_linenumber",), {"n": Agg("count")}, where="l_linenumber < 0")


@query(f"SELECT k, CASE WHEN bad THEN NULL ELSE total END AS total, n FROM (SELECT l_linenumber AS k, bool_or(l_linenumber = 2) AS bad, sum(CAST(l_quantity AS BIGINT))::BIGINT AS total, count(*) AS n FROM {L} GROUP BY 1)")
def group_bad_value(spark, sf_dir):
    text = F.when(F.col("k") == 2, "many").otherwise(F.col("l_quantity").cast("long").cast("string"))
    number = fn.cast(text, "integer")
    plan = A.Group(A.Scan("t"), ["k"], {"total": Agg("sum", F.coalesce(number, F.lit(0)), ok=number.isNotNull()), "n": Agg("count")})
    return cl.expand(replay(plan, {"t": log(spark, sf_dir, "lineitem", F.col("l_linenumber").alias("k"), "l_quantity")}, LAST))


@query("""WITH o AS (SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS hi FROM orders WHERE NOT o_orderkey % 5 = 1 GROUP BY 1), w AS (SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS hi FROM orders WHERE NOT (o_orderkey % 5 = 1 AND o_orderkey % 15 <> 1) GROUP BY 1)
SELECT *, -1::BIGINT AS change FROM (FROM o EXCEPT ALL FROM w) UNION ALL SELECT *, 1::BIGINT FROM (FROM w EXCEPT ALL FROM o)""")
def group_changelog(spark, sf_dir):
    plan = A.Group(A.Scan("o"), ["o_orderpriority"], {"n": Agg("count"), "hi": Agg("max", F.col("o_orderkey"))})
    return cl.consolidate(changes(plan, {"o": log(spark, sf_dir, "orders", "o_orderpriority", "o_orderkey")}, LAST)[2]).withColumnRenamed(WEIGHT, "change")


@query(f"SELECT o_custkey, count(*) AS n FROM {O} GROUP BY 1 HAVING count(*) > 12")
def having(spark, sf_dir):
    plan = A.Filter(A.Group(A.Scan("o"), ["o_custkey"], {"n": Agg("count")}), F.col("n") > 12)
    return cl.expand(replay(plan, {"o": log(spark, sf_dir, "orders", "o_custkey", "o_orderkey")}, LAST))


@query(f"SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM {L} GROUP BY 1")
def group_sums_state(spark, sf_dir):
    """COUNT and SUM from per-group sums alone, without reading old rows again."""
    from .operators.group import sums_delta, sums_state

    aggs = {"n": Agg("count"), "total": Agg("sum", F.col("l_linenumber").cast("long"))}
    rows_ = log(spark, sf_dir, "lineitem", "l_returnflag", "l_linenumber")
    first = cl.epoch_of(rows_, 0)
    from .operators.group import group

    state, parts = sums_state(first, ["l_returnflag"], aggs), [group(cl.consolidate(first), ["l_returnflag"], aggs)]
    for e in (1, 2):
        after, change = sums_delta(state, cl.epoch_of(rows_, e), ["l_returnflag"], aggs)
        untouched = state.join(after.select("l_returnflag"), "l_returnflag", "left_anti")
        state, parts = untouched.unionByName(after), [*parts, change]
    return rows(cl.plus(parts))


# Distinct, order, slice, union


@query(f"SELECT DISTINCT l_suppkey, l_linenumber FROM {L}")
def distinct_delta(spark, sf_dir):
    return cl.expand(replay(A.Distinct(A.Scan("l")), {"l": log(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber")}, LAST))


@query(f"SELECT DISTINCT o_custkey, o_orderstatus FROM {O}")
def reduced_delta(spark, sf_dir):
    return cl.expand(replay(A.Distinct(A.Scan("o")), {"o": log(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")}, LAST))


@query(f"SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS __rank FROM {C}")
def orderby_rank(spark, sf_dir):
    plan = A.OrderBy(A.Scan("c"), [("c_nationkey", True)])
    return cl.expand(replay(plan, {"c": log(spark, sf_dir, "customer", "c_custkey", "c_nationkey")}, LAST))


@query(f"SELECT l_orderkey, l_linenumber, k, row_number() OVER (ORDER BY k DESC NULLS LAST, l_linenumber ASC NULLS FIRST, l_orderkey) - 1 AS __rank FROM (SELECT l_orderkey, l_linenumber, nullif(l_suppkey % 7, 0) AS k FROM {L})")
def orderby_mixed_desc(spark, sf_dir):
    plan = A.OrderBy(A.Scan("l"), [("k", False), ("l_linenumber", True)])
    return cl.expand(replay(plan, {"l": log(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.expr("nullif(l_suppkey % 7, 0)").alias("k"))}, LAST))


@query(f"""WITH o AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS r FROM customer), w AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS r FROM (SELECT * FROM customer WHERE c_custkey % 9 <> 4))
SELECT c_custkey, c_nationkey, r AS __rank, -1::BIGINT AS change FROM o WHERE c_custkey % 9 = 4""")
def orderby_rank_changelog(spark, sf_dir):
    rows_ = log(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    old, d = cl.integrate(rows_, 0), cl.epoch_of(rows_, 1)
    return order.ranked_delta(old, cl.integrate(rows_, 1), d, [("c_nationkey", True)]).withColumnRenamed(WEIGHT, "change")


@query(f"SELECT least(100, greatest(0, count(*) - 7)) AS count FROM {L}")
def limit_unordered_count(spark, sf_dir):
    return relational.count(order.some(cl.integrate(log(spark, sf_dir, "lineitem", *LINE)), 100, 7))


TOP = [("o_totalprice", False), ("o_orderkey", True)]


@query(f"SELECT o_orderkey, o_totalprice FROM {O} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def topk_offset(spark, sf_dir):
    return cl.expand(replay(A.Slice(A.Scan("o"), 25, 10, TOP), {"o": log(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")}, LAST))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10), w AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10)
SELECT *, -1::BIGINT AS change FROM (FROM o EXCEPT ALL FROM w) UNION ALL SELECT *, 1::BIGINT FROM (FROM w EXCEPT ALL FROM o)""")
def topk_changelog(spark, sf_dir):
    found = changes(A.Slice(A.Scan("o"), 25, 10, TOP), {"o": log(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")}, 1)
    return cl.consolidate(found[1]).withColumnRenamed(WEIGHT, "change")


@query(f"SELECT s_suppkey AS k, s_name AS name, NULL::VARCHAR AS seg FROM {S} UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM {C}")
def union_bag(spark, sf_dir):
    plan = A.Union([A.Project(A.Scan("s"), [F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")]), A.Project(A.Scan("c"), [F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")])])
    return cl.expand(replay(plan, {"s": log(spark, sf_dir, "supplier"), "c": log(spark, sf_dir, "customer")}, LAST))


# Paths


def edges(spark, sf_dir):
    """region <-in- nation <-of- customer, as edges between names."""
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("r"), "n_regionkey").alias("o"))
    cu = log(spark, sf_dir, "customer", F.concat(F.lit("c"), "c_custkey").alias("s"), F.lit("of").alias("p"), F.concat(F.lit("n"), "c_nationkey").alias("o"))
    return cl.integrate(cl.plus([cl.lift(n, 1, 0), cu]))


_EDGES = f"(SELECT concat('n', n_nationkey) AS s, 'in' AS p, concat('r', n_regionkey) AS o FROM nation UNION ALL SELECT concat('c', c_custkey), 'of', concat('n', c_nationkey) FROM {C})"


@query(f"SELECT s, o FROM {_EDGES} WHERE p = 'in' UNION ALL SELECT s, o FROM {_EDGES} WHERE p = 'of'")
def path_alt(spark, sf_dir):
    e = edges(spark, sf_dir)
    return rows(paths.alternative(paths.link(e, "in"), paths.link(e, "of")))


@query(f"SELECT o AS s, s AS o FROM {_EDGES} WHERE p = 'of'")
def path_inv(spark, sf_dir):
    return rows(paths.inverse(paths.link(edges(spark, sf_dir), "of")))


@query(f"SELECT a.s, b.o FROM {_EDGES} a JOIN {_EDGES} b ON a.o = b.s WHERE a.p = 'of' AND b.p = 'in'")
def path_seq(spark, sf_dir):
    e = edges(spark, sf_dir)
    return rows(paths.sequence(paths.link(e, "of"), paths.link(e, "in")))


@query(f"SELECT s, o FROM {_EDGES} WHERE p <> 'in' UNION ALL SELECT o, s FROM {_EDGES} WHERE p <> 'of'")
def path_nps(spark, sf_dir):
    return rows(paths.negated(edges(spark, sf_dir), ["in"], ["of"]))


@query(f"SELECT s, o FROM {_EDGES} WHERE p = 'in' UNION SELECT n, n FROM (SELECT s AS n FROM {_EDGES} UNION SELECT o FROM {_EDGES})")
def path_zero_or_one(spark, sf_dir):
    e = edges(spark, sf_dir)
    return rows(paths.zero_or_one(paths.link(e, "in"), e))


@query(f"WITH RECURSIVE e AS (SELECT s, o FROM {_EDGES}), t AS (SELECT s, o FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s) SELECT s, o FROM t")
def path_one_or_more(spark, sf_dir):
    return rows(paths.one_or_more(edges(spark, sf_dir)))


# Functions


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, length(p_name)::INT AS n, contains(p_name, 'a') AS has, starts_with(p_name, 'P') AS st, ends_with(p_name, '1') AS en, substr(p_name, 2, 4) AS sub, CASE WHEN strpos(p_name, '#') > 0 THEN split_part(p_name, '#', 1) ELSE '' END AS bef, CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, strpos(p_type, ' ') + 1) ELSE '' END AS aft, regexp_replace(p_type, '[AEIOU]', '-', 'g') AS rep, regexp_matches(p_type, '(?i)^s') AS reg, concat(p_brand, '/', p_type) AS con, replace(replace(p_brand, '#', '%23'), ' ', '%20') AS uri FROM part")
def fn_string(spark, sf_dir):
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.lower(n).alias("low"), F.char_length(n).alias("n"), F.contains(n, F.lit("a")).alias("has"), F.startswith(n, F.lit("P")).alias("st"), F.endswith(n, F.lit("1")).alias("en"),
        fn.substr(n, 2, 4).alias("sub"), fn.strbefore(n, "#").alias("bef"), fn.strafter(t, " ").alias("aft"), fn.replace(t, "[AEIOU]", "-").alias("rep"), fn.regex(t, "^s", "i").alias("reg"), F.concat(b, F.lit("/"), t).alias("con"), fn.encode_for_uri(b).alias("uri"),
    )


@query("SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS up, floor(c_acctbal)::BIGINT AS down, floor(c_acctbal + 0.5::DOUBLE)::BIGINT AS near, -c_acctbal AS neg, c_acctbal * 2 AS twice, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey::DOUBLE / c_nationkey END AS part, coalesce(nullif(c_nationkey, 3), -1) AS co, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS sign, c_nationkey IN (1, 2, 3) AS isin FROM customer")
def fn_math(spark, sf_dir):
    b = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.abs(b).alias("a"), F.ceil(b).alias("up"), F.floor(b).alias("down"), fn.round_(b).alias("near"), (-b).alias("neg"), (b * 2).alias("twice"), fn.divide(F.col("c_custkey").cast("double"), F.col("c_nationkey")).alias("part"),
        F.coalesce(F.nullif("c_nationkey", F.lit(3)), F.lit(-1)).alias("co"), F.when(b > 0, "pos").otherwise("neg").alias("sign"), F.col("c_nationkey").isin(1, 2, 3).alias("isin"),
    )


@query("SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, (second(ts) + (microsecond(ts) % 1000000) / 1000000.0::DOUBLE)::DOUBLE AS s, 'Z' AS zone, 'PT0S' AS off FROM events")
def fn_date(spark, sf_dir):
    t = F.col("ts")
    text = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return read(spark, sf_dir, "events").select("event_id", F.year(t).alias("y"), F.month(t).alias("m"), F.day(t).alias("d"), F.hour(t).alias("h"), F.minute(t).alias("mi"), fn.seconds(t).cast("double").alias("s"), fn.tz(text).alias("zone"), fn.timezone(text).alias("off"))


@query("SELECT s_suppkey, md5(s_name) AS md5, sha1(s_name) AS sha1, sha256(s_name) AS sha256 FROM supplier")
def fn_hash(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.md5("s_name").alias("md5"), F.sha1("s_name").alias("sha1"), F.sha2("s_name", 256).alias("sha256"))


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN 'x' ELSE p_size::VARCHAR END AS BIGINT) AS i, TRY_CAST(p_retailprice::VARCHAR AS DOUBLE) AS d, CASE WHEN p_size % 2 = 0 THEN true ELSE NULL END AS b, p_size::VARCHAR AS s FROM part")
def fn_cast(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", fn.cast(F.when(size % 3 == 0, "x").otherwise(size.cast("string")), "integer").alias("i"), fn.cast(F.col("p_retailprice"), "double").alias("d"), fn.cast(F.when(size % 2 == 0, "true").otherwise("yes"), "boolean").alias("b"), fn.cast(size, "string").alias("s"))


@query("SELECT s_suppkey, concat('<http://t/', s_suppkey, '>') AS term, true AS is_iri, false AS is_lit, s_name AS lex, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, 'en' AS lang FROM supplier")
def fn_term(spark, sf_dir):
    from .functions import terms as t

    iri, lit, tagged = t.iri(F.concat(F.lit("http://t/"), "s_suppkey")), t.literal(F.col("s_suppkey").cast("string"), t.XSD + "integer"), t.literal(F.col("s_name"), lang="en")
    return read(spark, sf_dir, "supplier").select("s_suppkey", iri.alias("term"), t.is_iri(iri).alias("is_iri"), t.is_literal(iri).alias("is_lit"), t.lexical(tagged).alias("lex"), t.datatype(lit).alias("dt"), t.lang(tagged).alias("lang"))


@query(f"SELECT o_orderkey, concat('<', reverse(o_orderstatus), o_orderkey, '>') AS tag FROM {O}")
def udf_extension(spark, sf_dir):
    from .functions.extension import Registry

    reg = Registry()

    @reg.register("http://example.org/tag", "string")
    def tag(a, b):
        return "<" + a.str[::-1] + b.astype(str) + ">"

    plan = A.Project(A.Extend(A.Scan("o"), {"tag": reg.call("http://example.org/tag", F.col("o_orderstatus"), F.col("o_orderkey"))}), ["o_orderkey", "tag"])
    return cl.expand(replay(plan, {"o": log(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")}, LAST))


# SPARQL over the tables as quads


BASE = "http://tideline.example/"
PREFIX = f"PREFIX t: <{BASE}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


def quads(spark, sf_dir, *tables: tuple) -> DataFrame:
    """(table, key, columns...) as one changelog of quads; tables without a recipe don't change."""
    from .sources.formats import unpivot

    parts = []
    for table, key, *names in tables:
        rows_ = log(spark, sf_dir, table, key, *names) if table in RECIPE else cl.lift(read(spark, sf_dir, table).select(key, *names), 1, 0)
        parts += [unpivot(rows_.where(F.col(EPOCH) == e).drop(EPOCH), table, key, BASE).withColumn(EPOCH, F.lit(e)) for e in range(LAST + 1)]
    return cl.plus(parts)


def sparql(spark, log_: DataFrame, text: str, **options) -> DataFrame:
    """The maintained result of a query over a changelog of quads, as plain rows of terms."""
    from .plans.sparql import QUADS, compile_query

    compiled = compile_query(spark, PREFIX + text, **options)
    return cl.expand(replay(compiled.node, {QUADS: cl.checkpoint(log_)}, LAST))


_INT = '"^^<http://www.w3.org/2001/XMLSchema#integer>'


@query(f"""SELECT '"' || n_name || '"' AS name, '"' || count(*) || '{_INT}' AS n, '"' || max(c_custkey) || '{_INT}' AS hi FROM {C} JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 3""")
def sparql_bgp_group(spark, sf_dir):
    q = quads(spark, sf_dir, ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_nationkey"))
    return sparql(spark, q, "SELECT ?name (COUNT(*) AS ?n) (MAX(?k) AS ?hi) { ?c t:c_nationkey ?nk ; t:c_custkey ?k . ?x t:n_nationkey ?nk ; t:n_name ?name } GROUP BY ?name HAVING(COUNT(*) > 3)")


@query(f"""SELECT '"' || s_name || '"' AS name, CASE WHEN s_nationkey < 10 THEN '"' || n_name || '"' END AS nation FROM {S} LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 10 WHERE s_suppkey % 2 = 0 OR s_suppkey > 50""")
def sparql_optional_filter(spark, sf_dir):
    q = quads(spark, sf_dir, ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name", "s_nationkey"))
    return sparql(spark, q, "SELECT ?name ?nation { ?s t:s_suppkey ?k ; t:s_name ?name ; t:s_nationkey ?nk OPTIONAL { ?x t:n_nationkey ?nk ; t:n_name ?nation FILTER(?nk < 10) } FILTER(?k - 2 * FLOOR(?k / 2) = 0 || ?k > 50) }")


@query(f"""SELECT DISTINCT '"' || n_regionkey || '{_INT}' AS r FROM {S} JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT LIKE '%1%'""")
def sparql_path_distinct(spark, sf_dir):
    from .functions import terms as t

    n = quads(spark, sf_dir, ("nation", "n_nationkey", "n_name", "n_regionkey"))
    link = log(spark, sf_dir, "supplier", t.iri(F.concat(F.lit(BASE + "supplier/"), "s_suppkey")).alias("s"), F.lit(f"<{BASE}in>").alias("p"), t.iri(F.concat(F.lit(BASE + "nation/"), "s_nationkey")).alias("o"), F.lit(None).cast("string").alias("g"))
    return sparql(spark, cl.plus([n, link]), "SELECT DISTINCT ?r { ?s t:in/t:n_regionkey ?r . ?s t:in ?n MINUS { ?n t:n_name ?name FILTER(CONTAINS(?name, '1')) } }")


@query(f"""SELECT '"' || c_name || '"' AS name, '"' || lower(c_mktsegment) || '"' AS seg, '"' || (c_custkey + 1) || '{_INT}' AS k, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS __rank FROM {C} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_custkey DESC""")
def sparql_order_rank(spark, sf_dir):
    q = quads(spark, sf_dir, ("customer", "c_custkey", "c_name", "c_mktsegment"))
    return sparql(spark, q, "SELECT ?name (LCASE(?m) AS ?seg) (?c + 1 AS ?k) { ?x t:c_custkey ?c ; t:c_name ?name ; t:c_mktsegment ?m FILTER(?m IN ('BUILDING', 'MACHINERY')) } ORDER BY DESC(?c)")


@query(f"""SELECT '"' || s_name || '"' AS name, '"' || k || '"' AS k FROM (SELECT s_name, 'low' AS k FROM {S} WHERE s_nationkey < 3 UNION ALL SELECT s_name, 'high' FROM {S} s WHERE s_nationkey > 20 AND EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n_regionkey = 3)) ORDER BY s_name LIMIT 12 OFFSET 2""")
def sparql_union_exists_slice(spark, sf_dir):
    q = quads(spark, sf_dir, ("nation", "n_nationkey", "n_regionkey"), ("supplier", "s_suppkey", "s_name", "s_nationkey"))
    text = "SELECT ?name ?k { { ?s t:s_name ?name ; t:s_nationkey ?n FILTER(?n < 3) BIND('low' AS ?k) } UNION { ?s t:s_name ?name ; t:s_nationkey ?n FILTER(?n > 20) FILTER EXISTS { ?x t:n_nationkey ?n ; t:n_regionkey 3 } BIND('high' AS ?k) } } ORDER BY ?name LIMIT 12 OFFSET 2"
    return sparql(spark, q, text)


@query(f"""SELECT '"' || s_name || '"' AS name, '"' || CASE WHEN s_nationkey < 10 THEN s_nationkey ELSE s_suppkey END || '{_INT}' AS v FROM {S}""")
def sparql_optional_chain(spark, sf_dir):
    q = quads(spark, sf_dir, ("supplier", "s_suppkey", "s_name", "s_nationkey"))
    return sparql(spark, q, "SELECT ?name ?v { ?s t:s_name ?name OPTIONAL { ?s t:s_nationkey ?v FILTER(?v < 10) } OPTIONAL { ?s t:s_suppkey ?v } }")


@query(f"""SELECT '"' || s_name || '"' AS name FROM {S} s WHERE EXISTS (SELECT 1 FROM nation n WHERE n_regionkey = 3 AND n_nationkey > s.s_nationkey)""")
def sparql_exists_correlated(spark, sf_dir):
    q = quads(spark, sf_dir, ("nation", "n_nationkey", "n_regionkey"), ("supplier", "s_suppkey", "s_name", "s_nationkey"))
    return sparql(spark, q, "SELECT ?name { ?s t:s_name ?name ; t:s_nationkey ?n FILTER EXISTS { ?x t:n_regionkey 3 ; t:n_nationkey ?m FILTER(?m > ?n) } }")


@query(f"""SELECT '"' || s_name || '"' AS name FROM {S} WHERE s_nationkey >= 10 OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)""")
def sparql_exists_unbound(spark, sf_dir):
    q = quads(spark, sf_dir, ("nation", "n_nationkey", "n_regionkey"), ("supplier", "s_suppkey", "s_name", "s_nationkey"))
    return sparql(spark, q, "SELECT ?name { ?s t:s_name ?name OPTIONAL { ?s t:s_nationkey ?n FILTER(?n < 10) } FILTER EXISTS { ?x t:n_regionkey 3 ; t:n_nationkey ?n } }")


# Streams


def _stream(spark, log_: DataFrame, start: Callable) -> str:
    """The log as files, one epoch a micro-batch: an epoch's files come when the one before has been followed, and the query
    that `start` makes of a stream and a folder goes on from its checkpoint. An epoch has as many files as its rows have parts."""
    import uuid

    path = f"{cl.shared_root(spark)}/stream-{uuid.uuid4().hex}"
    for e in range(LAST + 1):
        log_.where(F.col(EPOCH) == e).drop(EPOCH).write.mode("append").parquet(f"{path}/in")
        schema = spark.read.parquet(f"{path}/in").schema
        start(spark.readStream.schema(schema).parquet(f"{path}/in"), path).awaitTermination()
    return path


def _followed(spark, node: A.Node, logs: dict[str, DataFrame]) -> DataFrame:
    from .streaming.micro import RELATION, StreamView

    shapes = {k: v.drop(WEIGHT, EPOCH).schema for k, v in logs.items()}
    if len(logs) > 1:
        logs = {k: v.withColumn(RELATION, F.lit(k)) for k, v in logs.items()}
    view = lambda path: StreamView(spark, node, shapes, f"{path}/view")
    path = _stream(spark, cl.plus(list(logs.values())), lambda stream, path: view(path).start(stream))
    return cl.expand(view(path).result())


@query(f"SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS hi FROM {O} GROUP BY 1")
def stream_group(spark, sf_dir):
    plan = A.Group(A.Scan("o"), ["o_orderpriority"], {"n": Agg("count"), "hi": Agg("max", F.col("o_orderkey"))})
    return _followed(spark, plan, {"o": log(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")})


@query(f"SELECT o_orderkey, o_custkey, l_linenumber FROM {O} JOIN {L} ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def stream_join(spark, sf_dir):
    return _followed(spark, A.Join(A.Scan("o"), A.Scan("l"), keys=["o_orderkey"]), _order_lines(spark, sf_dir))


def _keyed(spark, log_: DataFrame, make, names: list[str]) -> DataFrame:
    from .streaming.micro import ROCKSDB

    def start(stream: DataFrame, path: str):
        def step(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

        return make(stream, names).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(step).trigger(availableNow=True).start()

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        path = _stream(spark, log_, start)
    finally:
        spark.conf.set(key, before)
    return cl.expand(cl.consolidate(spark.read.parquet(f"{path}/out").drop("batch")))


@query(f"SELECT DISTINCT l_suppkey, l_linenumber FROM {L} WHERE l_returnflag = 'R'")
def stream_distinct(spark, sf_dir):
    from .streaming.micro import distinct_stream

    rows_ = log(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag").where("l_returnflag = 'R'").drop("l_returnflag")
    return _keyed(spark, rows_, distinct_stream, ["l_suppkey", "l_linenumber"])


@query(f"SELECT event_type, count(*) AS n FROM {E} GROUP BY 1")
def stream_count(spark, sf_dir):
    from .streaming.micro import count_stream

    return _keyed(spark, log(spark, sf_dir, "events", "event_type", "event_id").drop("event_id"), count_stream, ["event_type"])


def entry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue_by_priority(spark, sf_dir)


__all__ = ["QUERIES", "SQL", "delta", "entry_plan"]
