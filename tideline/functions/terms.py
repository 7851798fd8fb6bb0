"""RDF terms as canonical N-Triples strings.

<iri>, _:label, "lexical", "lexical"@tag, "lexical"^^<datatype>, and << s p o >> for a quoted triple. Strings of type
xsd:string have no suffix. Two terms are the same if their strings are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
INTEGERS = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")
NUMERIC = (*INTEGERS, "decimal", "float", "double")
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def quote(v: Column) -> Column:
    for raw, esc in _ESCAPES:
        v = F.replace(v, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), v, F.lit('"'))


def quote_text(v: str) -> str:
    for raw, esc in _ESCAPES:
        v = v.replace(raw, esc)
    return f'"{v}"'


def iri(v: Column) -> Column:
    return F.concat(F.lit("<"), v, F.lit(">"))


def literal(v: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    suffix = f"@{lang}" if lang else "" if datatype in (None, XSD + "string") else f"^^<{datatype}>"
    return F.concat(quote(v), F.lit(suffix))


def is_iri(t: Column) -> Column:
    return t.startswith("<") & ~t.startswith("<<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def is_triple(t: Column) -> Column:
    return t.startswith("<<")


def _unescape(v: Column) -> Column:
    """Escaped backslashes are set aside under a character that no text has."""
    v = F.replace(v, F.lit("\\\\"), F.lit("\ue000"))
    for raw, esc in _ESCAPES[1:]:
        v = F.replace(v, F.lit(esc), F.lit(raw))
    return F.replace(v, F.lit("\ue000"), F.lit("\\"))


def lexical(t: Column) -> Column:
    """STR: the IRI or the literal's text; null for blank nodes and triples."""
    return F.when(is_literal(t), _unescape(F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*+)"', 1))).when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2))


def simple(t: Column) -> Column:
    """The text of a literal that has no escapes, as those of numbers and dates."""
    return F.regexp_extract(t, '^"([^"]*)"', 1)


def is_string(t: Column) -> Column:
    """A plain or a language-tagged string."""
    return t.rlike(r'(?s)^".*"(@[A-Za-z0-9-]+)?$')


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, r'"@([A-Za-z0-9-]+)$', 1))


def datatype(t: Column) -> Column:
    explicit = F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1)
    return F.when(is_literal(t), F.when(explicit != "", explicit).when(lang(t) != "", RDF + "langString").otherwise(XSD + "string"))


_DECIMAL = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
_NUMBER = rf'^"(?:[+-]?\d+"\^\^<{XSD}(?:{"|".join(INTEGERS)})>|{_DECIMAL}"\^\^<{XSD}decimal>|(?:{_DECIMAL}(?:[eE][+-]?\d+)?|-?INF|NaN)"\^\^<{XSD}(?:float|double)>)$'


def is_numeric(t: Column) -> Column:
    return F.coalesce(t.rlike(_NUMBER), F.lit(False))


def number(t: Column) -> Column:
    """Value of a numeric literal as a double; null for any other term and for ill-formed ones."""
    return F.when(t.rlike(_NUMBER), simple(t).try_cast("double"))


def number_rank(t: Column) -> Column:
    """0 integer, 1 decimal, 2 float, 3 double; null for what is no number."""
    kinds = F.when(t.endswith("#decimal>"), 1).when(t.endswith("#float>"), 2).when(t.endswith("#double>"), 3).otherwise(0)
    return F.when(t.rlike(_NUMBER), kinds)


def is_time(t: Column) -> Column:
    return t.endswith(f"^^<{XSD}dateTime>") | t.endswith(f"^^<{XSD}date>")


def time(t: Column) -> Column:
    """A dateTime or date as a point in time."""
    from .scalar import instant

    return F.when(is_time(t), instant(simple(t)))


def order_keys(t: Column) -> list[Column]:
    """Sort keys: unbound, blank node, IRI, literal; of literals numbers by value, then times by instant, then the rest by text."""
    literal = F.when(t.rlike(_NUMBER), 3).when(is_time(t), 4).otherwise(5)
    kind = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).when(is_literal(t), literal).otherwise(6)
    return [kind, number(t), time(t), lexical(t), t]


def triple(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" >>"))


_TERM = r'(<<.*>>|<[^<>]*>|_:\S+|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_TRIPLE = f"^<< {_TERM} {_TERM} {_TERM} >>$"


def subject(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, _TRIPLE, 1), F.lit(""))


def predicate(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, _TRIPLE, 2), F.lit(""))


def object_(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, _TRIPLE, 3), F.lit(""))
