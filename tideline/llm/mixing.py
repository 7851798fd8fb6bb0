"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target number of words; each of its documents is expected to appear target / source words
times. Within a source the documents are put in a fixed order, the expected copies are summed up along it, one
offset for the whole source is added, and a document is emitted once for each whole number that its stretch of the
running sum crosses. Documents of like size are neighbours in the order, so the words taken come close to the target.

The running sum needs no task that sees a whole source: documents are ranked within small cells (source, size class,
salt), a table with one row per cell turns those ranks into ranks in the source, and the number of salts grows with
the table so that no cell exceeds about CELL documents of one class.

Defined cases: null text or a text without words has size 0 and, as no copies change the words taken, is taken 0 times
by the target of a source without words and like any other document else. A null source is a source of its own, last in
order. Rows that repeat are separate documents. An empty table gives an empty table. Extra columns pass through; helper
columns get names that don't clash, and the added columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 17
CELL = 1 << 18


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n) -> with target: share of all words by weight, capped at `most` times the source's words.

    Capping and resharing until no source is above its cap ends at target = min(cap, level * weight); sources are
    capped in the order of cap / weight, so running sums over this table, one row per source, give the level.
    """
    every = F.sum("source_size").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    along = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("weight", weight).withColumn("all_words", every.cast("double"))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("all_words") * F.lit(float(share)) - F.col("capped")) / F.col("open"))
    # The first source in the order whose cap isn't reached sets the level for itself and all after it.
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", F.col("level").alias("level")))).over(Window.partitionBy())
    t = t.withColumn("water", F.col("level")).withColumn("final", level["level"])
    return t.withColumn("target", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))).select("source", "source_size", "n", "weight", "target")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def size_class(size: Column) -> Column:
    """Number of digits and the two leading ones: classes about a tenth wide, the same in every SQL engine."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """docs with size, source_size, target, copies, taken. docs needs doc_id, text and source."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    cls, salt, key, tie, rank, salts = fresh([*docs.columns, "source", "n", "weight"], "cls", "salt", "key", "tie", "rank", "salts")
    # Sources are matched by a never-null key.
    keyed = docs.withColumn("size", n_words(F.col("text"))).withColumn(key, F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))
    keyed = keyed.withColumn(cls, size_class(F.col("size"))).withColumn(tie, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn(salt, F.conv(F.substring(tie, 1, 7), 16, 10).cast("long"))
    counted = keyed.groupBy(F.lit(1)).agg(F.count(F.lit(1)).alias("n"))
    one = counted.select(F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(cell)))).cast("long").alias(salts))
    keyed = keyed.crossJoin(F.broadcast(one)).withColumn(salt, F.pmod(F.col(salt), F.col(salts)))  # a single row
    cells = keyed.groupBy(key, cls, salt).agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sources = cells.groupBy(key).agg(F.first("source").alias("source"), F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    plan = targets(sources, weights, share, most).withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("offset", _unit(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))))
    plan = plan.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias(key), "source_size", "target", "expected", "offset")
    start = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(cls, salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.withColumn("start", start).select(key, cls, salt, "start").join(plan, key)
    starts = starts.select(F.col(key).alias("k1"), F.col(cls).alias("k2"), F.col(salt).alias("k3"), F.struct("source_size", "target", "expected", "offset", "start").alias("plan"))
    within = Window.partitionBy(key, cls, salt).orderBy("size", tie, F.xxhash64("text"))
    ranked = keyed.withColumn(rank, F.row_number().over(within)).join(starts, (F.col(key) == F.col("k1")) & (F.col(cls) == F.col("k2")) & (F.col(salt) == F.col("k3")))
    at = F.col("plan.start") + F.col(rank)
    copies = (F.floor(at * F.col("plan.expected") + F.col("plan.offset")) - F.floor((at - 1) * F.col("plan.expected") + F.col("plan.offset"))).cast("long")
    return ranked.select(*[F.col(f"`{c}`") for c in docs.columns], "size", F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as many times as it is taken."""
    names = docs.columns
    return mix(docs, **options).where("copies > 0").withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in names])


def op3_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


_SQL_PLAN = """
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
grouped AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
  sum(source_size) OVER ()::DOUBLE AS all_words, source_size * 2.0::DOUBLE AS cap FROM grouped),
lined AS (SELECT *, cap / weight AS ratio,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM weighed),
levelled AS (SELECT *, (all_words * 1.5::DOUBLE - capped) / open AS level FROM lined),
final AS (SELECT arg_min(level, ratio) AS level FROM levelled WHERE level < ratio),
plan AS (SELECT l.source, l.source_size, least(l.cap, coalesce(f.level * l.weight, l.cap)) AS target,
  ('0x' || substr(md5('17:' || coalesce('s' || l.source, 'n')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM levelled l LEFT JOIN final f ON true),
placed AS (SELECT s.*, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS cls, md5(coalesce(doc_id::VARCHAR, '')) AS tie,
  (SELECT greatest(1, ceil(count(*) / 262144.0))::BIGINT FROM sized) AS salts FROM sized s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, ('0x' || substr(tie, 1, 7))::BIGINT % salts, size, tie) AS pos FROM placed),
taken AS (SELECT r.* EXCLUDE (cls, tie, salts, pos), p.source_size, p.target, (floor(r.pos * p.e + p.shift) - floor((r.pos - 1) * p.e + p.shift))::BIGINT AS copies
  FROM ranked r JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e FROM plan) p ON r.source IS NOT DISTINCT FROM p.source)
"""


def plan_sql(docs: str) -> str:
    """Common table expressions whose last, taken, has the documents of `docs` with size, source_size, target, copies."""
    return _SQL_PLAN.format(docs=docs).strip()


OP3_SQL = f"WITH {plan_sql('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM taken"
