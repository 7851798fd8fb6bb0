"""Scalar functions on typed columns with the semantics of graph queries: an error is null (unbound), never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ebv(v: Column, kind: T.DataType | None = None) -> Column:
    """Effective boolean value: booleans as they are, strings if not empty, numbers if neither 0 nor NaN; null stays null."""
    if isinstance(kind, T.StringType):
        return v != ""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (v != 0) & ~F.isnan(v)
    if isinstance(kind, T.NumericType):
        return v != 0
    if kind is None or isinstance(kind, T.BooleanType):
        return v
    return F.lit(None).cast("boolean")


# Arithmetic

def divide(a: Column, b: Column) -> Column:
    """Integers give a decimal; by zero is an error."""
    return F.try_divide(a, b)


def round_(v: Column) -> Column:
    """Halves towards positive infinity."""
    return F.floor(v + F.lit(0.5))


# Strings

def encode_for_uri(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(v), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")


def strbefore(v: Column, sep: Column | str) -> Column:
    """What precedes the first separator; empty without one."""
    s = F.lit(sep) if isinstance(sep, str) else sep
    at = F.position(s, v)
    return F.when(at > 0, F.substring(v, F.lit(1), at - 1)).otherwise(F.when(at == 0, F.lit("")))


def strafter(v: Column, sep: Column | str) -> Column:
    s = F.lit(sep) if isinstance(sep, str) else sep
    at = F.position(s, v)
    return F.when(at > 0, F.substring(v, at + F.length(s), F.length(v))).otherwise(F.when(at == 0, F.lit("")))


def substr(v: Column, start: int, length: int | None = None) -> Column:
    """From 1. A start before the first character shortens the result."""
    end = None if length is None else start + length
    first = max(1, start)
    n = F.length(v) if end is None else F.lit(max(0, end - first))
    return F.substring(v, F.lit(first), n)


def regex(v: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(v, F.lit(_flagged(pattern, flags)))


def replace(v: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(v, _flagged(pattern, flags), by)


def _flagged(pattern: str, flags: str) -> str:
    if "q" in flags:
        pattern, flags = "\\Q" + pattern + "\\E", flags.replace("q", "")
    return f"(?{flags}){pattern}" if flags else pattern


def lang_matches(lang: Column, wanted: str) -> Column:
    """A language range: * for any, else the tag itself or a longer one."""
    if wanted == "*":
        return F.length(lang) > 0
    low = F.lower(lang)
    return (low == wanted.lower()) | low.startswith(wanted.lower() + "-")


# Date and time

def instant(v: Column) -> Column:
    """A date or dateTime string as a point in time; without a zone it is in UTC."""
    return F.try_to_timestamp(F.regexp_replace(v, r"^(-?\d{4}-\d\d-\d\d)(Z|[+-]\d\d:\d\d)$", "$1T00:00:00$2"))


def tz(v: Column) -> Column:
    """The zone as written; empty without one."""
    return F.when(v.isNotNull(), F.regexp_extract(v, r"(Z|[+-]\d\d:\d\d)$", 1))


def timezone(v: Column) -> Column:
    """The zone as a day-time duration; null without one."""
    z = tz(v)
    sign, h, m = F.substring(z, 1, 1), F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    body = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    some = F.when((h == 0) & (m == 0), "PT0S").otherwise(F.concat(F.when(sign == "-", "-PT").otherwise("PT"), body))
    return F.when(z == "Z", "PT0S").when(z != "", some)


def seconds(v: Column) -> Column:
    return F.extract(F.lit("SECOND"), v)


# Casts: what can't be cast is null

def cast(v: Column, to: str) -> Column:
    """to: boolean, date, dateTime, decimal, double, float, integer, string, dayTimeDuration, yearMonthDuration, duration or time."""
    s = F.trim(v.cast("string"))
    if to == "boolean":
        low = s
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
    if to == "integer":
        whole = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))
        return F.coalesce(whole, F.when(s.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double").try_cast("bigint")))
    if to == "decimal":
        return F.when(s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("decimal(38,18)"))
    if to in ("double", "float"):
        number = F.when(s == "INF", "Infinity").when(s == "-INF", "-Infinity").when(s.rlike(r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|NaN)$"), s)
        return number.try_cast(to)
    if to == "string":
        return v.cast("string")
    if to == "date":
        return F.when(s.rlike(r"^-?\d{4}-\d\d-\d\d"), F.substring(s, 1, 10)).try_cast("date")
    if to == "dateTime":
        return instant(s)
    if to == "time":
        return F.when(s.rlike(r"^\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"), s)
    if to == "dayTimeDuration":
        return F.when(s.rlike(r"^-?P(?=\d|T\d)(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"), s)
    if to == "yearMonthDuration":
        return F.when(s.rlike(r"^-?P(?=\d)(\d+Y)?(\d+M)?$"), s)
    if to == "duration":
        return F.when(s.rlike(r"^-?P(?=\d|T\d)(\d+Y)?(\d+M)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"), s)
    raise ValueError(f"no cast to {to}")


def uuid_iri() -> Column:
    return F.concat(F.lit("urn:uuid:"), F.uuid())
