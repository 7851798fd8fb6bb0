"""Reading N-Triples and N-Quads, and writing results."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..changelog import WEIGHT, c, columns
from ..functions import terms as t

_TERM = r'(<<.*>>|<[^<>]*>|_:\S+|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_TERM}\s+(<[^<>]*>)\s+{_TERM}(?:\s+(<[^<>]*>|_:\S+))?\s*\.\s*(?:#.*)?$"


def read_nquads(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """N-Triples or N-Quads lines as (s, p, o, g); g is null in the default graph. A line that is no statement fails, or is
    skipped if not strict. Unicode escapes and explicit xsd:string types are normalised."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    got = lines.select("value", *[F.regexp_extract("value", _LINE, i + 1).alias(n) for i, n in enumerate("spog")])
    if strict:
        got = got.withColumn("s", F.when(F.col("s") == "", F.raise_error(F.concat(F.lit("not a statement: "), F.col("value"))).cast("string")).otherwise(F.col("s")))
    else:
        got = got.where("s <> ''")
    o = F.regexp_replace("o", rf'"\^\^<{t.XSD}string>$', '"')
    return got.select("s", "p", o.alias("o"), F.nullif("g", F.lit("")).alias("g"))


def write_nquads(quads: DataFrame, path: str) -> None:
    g = F.when(F.col("g").isNull(), "").otherwise(F.concat(F.lit(" "), "g"))
    quads.select(F.concat("s", F.lit(" "), "p", F.lit(" "), "o", g, F.lit(" ."))).write.mode("overwrite").text(path)


def unpivot(df: DataFrame, table: str, key: str, base: str = "http://tideline.example/", graph: str | None = None) -> DataFrame:
    """A table as quads: row -> column -> value, with typed literals; nulls have no quad."""
    kinds = dict(df.dtypes)
    weight = [WEIGHT] if WEIGHT in df.columns else []
    s = t.iri(F.concat(F.lit(f"{base}{table}/"), c(key).cast("string")))
    parts = []
    for name in columns(df):
        kind = kinds[name]
        if kind in ("int", "bigint", "smallint", "tinyint"):
            o = t.literal(c(name).cast("string"), t.XSD + "integer")
        elif kind in ("double", "float"):
            o = t.literal(c(name).cast("string"), t.XSD + kind)
        elif kind.startswith("decimal"):
            o = t.literal(c(name).cast("string"), t.XSD + "decimal")
        elif kind == "boolean":
            o = t.literal(c(name).cast("string"), t.XSD + "boolean")
        elif kind.startswith("timestamp"):
            o = t.literal(F.date_format(c(name), "yyyy-MM-dd'T'HH:mm:ss'Z'"), t.XSD + "dateTime")
        elif kind == "date":
            o = t.literal(c(name).cast("string"), t.XSD + "date")
        else:
            o = t.literal(c(name).cast("string"))
        parts.append(F.struct(F.lit(f"<{base}{name}>").alias("p"), o.alias("o")))
    each = df.select(s.alias("s"), F.explode(F.array(*parts)).alias("x"), *weight).where("x.o IS NOT NULL")
    return each.select("s", "x.p", "x.o", F.lit(None if graph is None else f"<{graph}>").cast("string").alias("g"), *weight)


def _term_json(term: str) -> dict:
    if term.startswith("<"):
        return {"type": "uri", "value": term[1:-1]}
    if term.startswith("_:"):
        return {"type": "bnode", "value": term[2:]}
    end = term.rindex('"')
    value, tail = json.loads('"' + term[1:end].replace("\t", "\\t") + '"'), term[end + 1 :]
    out = {"type": "literal", "value": value}
    if tail.startswith("@"):
        out["xml:lang"] = tail[1:]
    elif tail.startswith("^^"):
        out["datatype"] = tail[3:-1]
    return out


def _rows(df: DataFrame) -> Iterator[dict]:
    for r in df.toLocalIterator():
        yield r.asDict()


def to_results_json(df: DataFrame) -> str:
    """Results in the SPARQL JSON form. For results that a client reads; streams rows to the driver."""
    names = columns(df)
    return json.dumps({"head": {"vars": names}, "results": {"bindings": [{n: _term_json(r[n]) for n in names if r[n] is not None} for r in _rows(df.select(*names))]}})


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Plain values, as the SPARQL CSV form has them; tabs and full terms with sep='\\t'."""
    names = columns(df)
    shown = [c(n) if sep == "\t" else F.coalesce(t.lexical(c(n)), c(n)).alias(n) for n in names]
    df.select(*shown).write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)
