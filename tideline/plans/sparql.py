"""SPARQL SELECT text to algebra over a quad relation (s, p, o, g) of canonical terms.

Covers basic patterns with property paths and quoted triples, GRAPH, OPTIONAL, UNION, MINUS, FILTER with EXISTS and NOT
EXISTS, BIND, VALUES, subqueries, grouping with the eight aggregates and HAVING, DISTINCT, REDUCED, ORDER BY,
LIMIT/OFFSET, FROM and FROM NAMED. Other forms raise NotImplementedError.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..changelog import META, WEIGHT, c, columns, lift
from ..functions import scalar as fn
from ..functions import terms as t
from ..operators import order as o
from ..operators import paths
from ..operators.group import Agg
from ..operators.relational import values
from . import algebra as A

QUADS = "quads"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<quoted><<|>>)
    |(?P<string>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<var>[?$][A-Za-z0-9_\u00b7-\uffff]+)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<bnode>_:[A-Za-z0-9_][\w.-]*)
    |(?P<pname>(?:[A-Za-z\u00b7-\uffff][\w.-]*)?:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+*/|^?-])""",
    re.X,
)


class SyntaxProblem(ValueError):
    """The text is no query of this language."""


def tokenise(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


# Parsed form


@dataclass
class Var:
    name: str


@dataclass
class Term:
    text: str


@dataclass
class Quoted:
    s: object
    p: object
    o: object


@dataclass
class Path:
    kind: str  # link, inv, alt, seq, nps, opt, star, plus
    parts: list


@dataclass
class Op:
    """An expression: an operator or function and its arguments."""

    name: str
    args: list
    distinct: bool = False
    separator: str = " "


@dataclass
class Select:
    items: list  # Var or (expression, Var)
    star: bool
    modifier: str
    where: list
    default: list
    named: list
    group: list
    having: list
    order: list
    limit: int | None
    offset: int
    values: tuple | None


AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")


class Parser:
    def __init__(self, text: str, base: str = ""):
        self.tokens, self.at, self.prefixes, self.base, self.fresh = tokenise(text), 0, {}, base, 0

    # Tokens

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        got = self.peek()
        self.at += 1
        return got

    def is_word(self, *words: str, k: int = 0) -> bool:
        kind, v = self.peek(k)
        return kind == "word" and v.upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def sym(self, s: str) -> bool:
        if self.peek()[0] in ("op", "quoted") and self.peek()[1] == s:
            self.at += 1
            return True
        return False

    def need(self, s: str) -> None:
        if not (self.sym(s) or self.word(s)):
            raise SyntaxProblem(f"{s!r} expected before {self.peek()[1]!r}")

    # Terms

    def iri(self) -> str:
        kind, v = self.next()
        if kind == "iri":
            v = v[1:-1]
            return f"<{v if re.match('[A-Za-z][A-Za-z0-9+.-]*:', v) else self.base + v}>"
        if kind == "pname":
            prefix, local = v.split(":", 1)
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"prefix {prefix!r} is not declared")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        raise SyntaxProblem(f"an IRI expected, not {v!r}")

    def term(self):
        """A variable, an IRI, a literal, a blank node or a quoted triple."""
        kind, v = self.peek()
        if kind == "var":
            self.at += 1
            return Var(v[1:])
        if kind == "string":
            self.at += 1
            raw = v[3:-3] if v[:3] in ('"""', "'''") else v[1:-1]
            raw = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[1]) or (chr(int(m[1][1:], 16)) if len(m[1]) > 1 else m[1]), raw, flags=re.S)
            text = t.quote_text(raw)
            if self.peek()[0] == "lang":
                return Term(text + self.next()[1].lower())
            if self.sym("^^"):
                dt = self.iri()
                return Term(text if dt == f"<{t.XSD}string>" else f"{text}^^{dt}")
            return Term(text)
        sign = "-" if (kind, v) == ("op", "-") else "+" if (kind, v) == ("op", "+") else ""
        if kind == "number" or (sign and self.peek(1)[0] == "number"):
            if sign:
                self.at += 1
            v = self.next()[1]
            dt = "double" if "e" in v.lower() else "decimal" if "." in v else "integer"
            return Term(f'"{"-" if sign == "-" else ""}{v}"^^<{t.XSD}{dt}>')
        if kind == "word" and v.lower() in ("true", "false"):
            self.at += 1
            return Term(f'"{v.lower()}"^^<{t.XSD}boolean>')
        if kind == "word" and v == "a":
            self.at += 1
            return Term(f"<{t.RDF}type>")
        if kind == "bnode":
            self.at += 1
            return Var(f"__b_{v[2:]}")
        if kind == "quoted" and v == "<<":
            self.at += 1
            s, p, obj = self.term(), self.term(), self.term()
            self.need(">>")
            return Quoted(s, p, obj)
        return Term(self.iri())

    def blank(self) -> Var:
        self.fresh += 1
        return Var(f"__b_anon{self.fresh}")

    # Patterns

    def query(self) -> Select:
        while True:
            if self.word("PREFIX"):
                name = self.next()[1].rstrip(":")
                self.prefixes[name] = self.iri()[1:-1]
            elif self.word("BASE"):
                self.base = self.iri()[1:-1]
            else:
                break
        for form in ("ASK", "CONSTRUCT", "DESCRIBE", "INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD", "WITH"):
            if self.is_word(form):
                raise NotImplementedError(f"{form} is not supported; only SELECT is")
        out = self.select()
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"unexpected {self.peek()[1]!r}")
        return out

    def select(self) -> Select:
        self.need("SELECT")
        modifier = "DISTINCT" if self.word("DISTINCT") else "REDUCED" if self.word("REDUCED") else ""
        items, star = [], self.sym("*")
        while not star:
            if self.peek()[0] == "var":
                items.append(Var(self.next()[1][1:]))
            elif self.sym("("):
                e = self.expression()
                self.need("AS")
                items.append((e, self.term()))
                self.need(")")
            else:
                break
        if not star and not items:
            raise SyntaxProblem("nothing is selected")
        default, named = [], []
        while self.word("FROM"):
            (named if self.word("NAMED") else default).append(self.iri())
        self.word("WHERE")
        where = self.group()
        group, having, order, limit, offset, values = [], [], [], None, 0, None
        if self.word("GROUP"):
            self.need("BY")
            while True:
                if self.sym("("):
                    e = self.expression()
                    v = self.term() if self.word("AS") else None
                    self.need(")")
                    group.append((e, v))
                elif self.peek()[0] == "var":
                    group.append((Var(self.next()[1][1:]), None))
                elif self.peek()[0] in ("word", "pname", "iri") and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    group.append((self.primary(), None))
                else:
                    break
        if self.word("HAVING"):
            while self.peek()[1] == "(" or (self.peek()[0] == "word" and not self.is_word("ORDER", "LIMIT", "OFFSET", "VALUES")):
                having.append(self.primary())
        if self.word("ORDER"):
            self.need("BY")
            while True:
                if self.is_word("ASC", "DESC"):
                    up = self.next()[1].upper() == "ASC"
                    order.append((self.primary(), up))
                elif self.peek()[0] == "var" or self.peek()[1] == "(" or (self.peek()[0] in ("word", "iri", "pname") and not self.is_word("LIMIT", "OFFSET", "VALUES")):
                    order.append((self.primary(), True))
                else:
                    break
        for _ in range(2):
            if self.word("LIMIT"):
                limit = int(self.next()[1])
            elif self.word("OFFSET"):
                offset = int(self.next()[1])
        if self.word("VALUES"):
            values = self.data()
        return Select(items, star, modifier, where, default, named, group, having, order, limit, offset, values)

    def group(self) -> list:
        self.need("{")
        out: list = []
        if self.is_word("SELECT"):
            out.append(("select", self.select()))
            self.need("}")
            return out
        while not self.sym("}"):
            if self.sym("."):
                continue
            if self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("MINUS"):
                out.append(("minus", self.group()))
            elif self.word("GRAPH"):
                out.append(("graph", self.term(), self.group()))
            elif self.word("SERVICE"):
                raise NotImplementedError("SERVICE is not supported")
            elif self.word("FILTER"):
                if self.is_word("EXISTS") or (self.is_word("NOT") and self.is_word("EXISTS", k=1)):
                    kind = "anti" if self.word("NOT") else "semi"
                    self.need("EXISTS")
                    out.append((kind, self.group()))
                else:
                    out.append(("filter", self.primary()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out.append(("bind", e, self.term().name))
                self.need(")")
            elif self.word("VALUES"):
                out.append(("values", *self.data()))
            elif self.peek()[1] == "{":
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                out.append(("union", parts))
            else:
                self.triples(out)
        return out

    def data(self) -> tuple[list[str], list[list]]:
        names, rows = [], []
        many = self.sym("(")
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        while not self.sym("}"):
            wrapped, row = self.sym("("), []
            for _ in names:
                row.append(None if self.word("UNDEF") else self.term().text)
            if wrapped:
                self.need(")")
            rows.append(row)
        return names, rows

    def node(self, out: list):
        """A term, a property list in brackets or a collection."""
        if self.sym("["):
            v = self.blank()
            if not self.sym("]"):
                self.properties(v, out)
                self.need("]")
            return v
        if self.sym("("):
            items = []
            while not self.sym(")"):
                items.append(self.node(out))
            head = Term(f"<{t.RDF}nil>")
            for x in reversed(items):
                v = self.blank()
                out += [("triple", v, Path("link", [f"<{t.RDF}first>"]), x), ("triple", v, Path("link", [f"<{t.RDF}rest>"]), head)]
                head = v
            return head
        return self.term()

    def triples(self, out: list) -> None:
        bracket = self.peek()[1] == "["
        s = self.node(out)
        if bracket and self.peek()[1] in (".", "}"):
            return
        self.properties(s, out)

    def properties(self, s, out: list) -> None:
        while True:
            p = Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                obj = self.node(out)
                out.append(("triple", s, p, obj))
                if not self.sym(","):
                    break
            again = False
            while self.sym(";"):
                again = True
            if not again or self.peek()[1] in (".", "}", "]"):
                return

    def path(self) -> Path:
        parts = [self.path_sequence()]
        while self.sym("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alt", parts)

    def path_sequence(self) -> Path:
        parts = [self.path_step()]
        while self.sym("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", parts)

    def path_step(self) -> Path:
        inverse = self.sym("^")
        if self.sym("("):
            p = self.path()
            self.need(")")
        elif self.sym("!"):
            many, forward, backward = self.sym("("), [], []
            while True:
                back = self.sym("^")
                (backward if back else forward).append(self.term().text)
                if not (many and self.sym("|")):
                    break
            if many:
                self.need(")")
            p = Path("nps", [forward, backward])
        else:
            p = Path("link", [self.term().text])
        for s, kind in (("?", "opt"), ("*", "star"), ("+", "plus")):
            if self.sym(s):
                p = Path(kind, [p])
        return Path("inv", [p]) if inverse else p

    # Expressions

    def expression(self):
        left = self.conjunction()
        while self.sym("||"):
            left = Op("||", [left, self.conjunction()])
        return left

    def conjunction(self):
        left = self.relation()
        while self.sym("&&"):
            left = Op("&&", [left, self.relation()])
        return left

    def relation(self):
        left = self.sum()
        for s in ("=", "!=", "<=", ">=", "<", ">"):
            if self.sym(s):
                return Op(s, [left, self.sum()])
        if self.is_word("IN") or (self.is_word("NOT") and self.is_word("IN", k=1)):
            name = "NOT IN" if self.word("NOT") else "IN"
            self.need("IN")
            return Op(name, [left, *self.arguments()])
        return left

    def sum(self):
        left = self.product()
        while self.peek()[1] in ("+", "-") and self.peek()[0] == "op":
            left = Op(self.next()[1], [left, self.product()])
        return left

    def product(self):
        left = self.unary()
        while self.peek()[1] in ("*", "/") and self.peek()[0] == "op":
            left = Op(self.next()[1], [left, self.unary()])
        return left

    def unary(self):
        if self.sym("!"):
            return Op("!", [self.unary()])
        if self.peek()[1] in ("-", "+") and self.peek()[0] == "op":
            sign = self.next()[1]
            return Op("neg" if sign == "-" else "pos", [self.unary()])
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.sym(")"):
            out.append(self.expression())
            self.sym(",")
        return out

    def primary(self):
        if self.sym("("):
            e = self.expression()
            self.need(")")
            return e
        kind, v = self.peek()
        if kind == "word" and v.upper() in AGGREGATES:
            self.at += 1
            self.need("(")
            distinct = self.word("DISTINCT")
            arg = [] if self.sym("*") else [self.expression()]
            sep = " "
            if self.sym(";"):
                self.need("SEPARATOR")
                self.need("=")
                sep = self.next()[1][1:-1]
            self.need(")")
            return Op(v.upper(), arg, distinct, sep)
        if kind == "word" and v.upper() in ("EXISTS", "NOT"):
            raise NotImplementedError("EXISTS inside an expression is not supported")
        if kind == "word" and v.lower() not in ("true", "false"):
            self.at += 1
            return Op(v.upper(), self.arguments())
        if kind in ("iri", "pname") and self.peek(1)[1] == "(":
            name = self.iri()
            return Op(name, self.arguments())
        return self.term()


# Expressions to columns


@dataclass
class Val:
    """An expression's value: a term column, or a typed column that becomes one when it is bound."""

    kind: str  # term, bool, num, str
    col: Column
    rank: Column | None = None  # of numbers: 0 integer, 1 decimal, 2 float, 3 double

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        if self.kind == "bool":
            return t.literal(self.col.cast("string"), t.XSD + "boolean")
        if self.kind == "str":
            return t.quote(self.col)
        whole = F.format_string("%.0f", self.col)
        dec = F.regexp_replace(self.col.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
        text = F.when(self.rank == 0, whole).when(self.rank == 1, F.when(self.col == F.floor(self.col), whole).otherwise(dec)).otherwise(self.col.cast("string"))
        return F.when(self.col.isNotNull(), F.concat(F.lit('"'), text, F.element_at(F.array(*[F.lit(f'"^^<{t.XSD}{d}>') for d in ("integer", "decimal", "float", "double")]), self.rank + 1)))

    def number(self) -> tuple[Column, Column]:
        if self.kind == "num":
            return self.col, self.rank
        if self.kind != "term":
            return F.lit(None).cast("double"), F.lit(None).cast("int")
        return t.number(self.col), t.number_rank(self.col)

    def text(self) -> Column:
        """The lexical form (STR)."""
        return self.col if self.kind == "str" else t.lexical(self.term())

    def string(self) -> Column:
        """The text of a string literal; null for other terms."""
        if self.kind == "str":
            return self.col
        if self.kind != "term":
            return F.lit(None).cast("string")
        return F.when(t.is_string(self.col), t.lexical(self.col))

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "str":
            return self.col != ""
        n, _ = self.number()
        truth = (n != 0) & ~F.isnan(n)
        if self.kind == "num":
            return truth
        return F.when(t.is_string(self.col), ~self.col.startswith('""')).when(self.col.endswith(f"^^<{t.XSD}boolean>"), fn.cast(t.simple(self.col), "boolean")).otherwise(truth)

    def time(self) -> Column | None:
        return t.time(self.col) if self.kind == "term" else None


def _constant(e, kind: str) -> bool:
    """Whether an expression is a constant of the kind: number, string, time or other."""
    if not isinstance(e, Term) or not e.text.startswith('"'):
        return False
    number = re.search(rf"\^\^<{t.XSD}(?:{'|'.join(t.NUMERIC)})>$", e.text)
    return {"number": bool(number), "string": not e.text.endswith(">")}[kind]


def compare(op: str, a: Val, b: Val, ea=None, eb=None) -> Column:
    """Numbers by value, times by instant, strings and booleans by order; other terms only for equality, else an error.
    A constant on one side (ea, eb: the expressions) leaves only the comparison of its kind."""
    both = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
    equality = op in ("=", "!=")
    if a.kind == "bool" and b.kind == "bool":
        return both(a.col, b.col)
    numeric = a.kind == "num" or b.kind == "num" or _constant(ea, "number") or _constant(eb, "number")
    textual = a.kind == "str" or b.kind == "str" or _constant(ea, "string") or _constant(eb, "string")
    if textual and equality:
        return both(a.term(), b.term())
    if textual:
        return both(a.string(), b.string())
    x, y = a.number()[0], b.number()[0]
    if numeric:
        return F.when(x.isNotNull() & y.isNotNull(), both(x, y)).otherwise(both(a.term(), b.term())) if equality else both(x, y)
    out = F.coalesce(both(x, y), both(a.time(), b.time()) if a.kind == b.kind == "term" else F.lit(None).cast("boolean"))
    return F.coalesce(out, both(a.term(), b.term()) if equality else both(a.string(), b.string()))


class Expressions:
    """Compiles expressions against the columns of a row."""

    def __init__(self, names: Sequence[str], extensions=None, aggregates: dict | None = None):
        self.names, self.extensions, self.aggregates = set(names), extensions, aggregates

    def value(self, e) -> Val:
        if isinstance(e, Var):
            return Val("term", c(e.name) if e.name in self.names else F.lit(None).cast("string"))
        if isinstance(e, Term):
            return Val("term", F.lit(e.text))
        if isinstance(e, Quoted):
            return Val("term", t.triple(*[self.value(x).term() for x in (e.s, e.p, e.o)]))
        if e.name in AGGREGATES:
            if self.aggregates is None:
                raise SyntaxProblem(f"{e.name} outside of grouping")
            return Val("term", c(self.aggregates[id(e)]))
        return self.call(e.name, e.args)

    def call(self, name: str, args: list) -> Val:  # noqa: C901
        if name in ("||", "&&"):
            a, b = (self.value(x).truth() for x in args)
            return Val("bool", a | b if name == "||" else a & b)
        if name == "!":
            return Val("bool", ~self.value(args[0]).truth())
        if name in ("=", "!=", "<", "<=", ">", ">="):
            return Val("bool", compare(name, *[self.value(x) for x in args], *args))
        if name in ("IN", "NOT IN"):
            first, hit = self.value(args[0]), F.lit(False)
            for x in args[1:]:
                hit = hit | compare("=", first, self.value(x), args[0], x)
            return Val("bool", hit if name == "IN" else ~hit)
        if name in ("+", "-", "*", "/"):
            (x, r), (y, q) = (self.value(a).number() for a in args)
            out = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[name]
            rank = F.greatest(r, q, F.lit(1)) if name == "/" else F.greatest(r, q)
            return Val("num", out, F.when(r.isNotNull() & q.isNotNull(), rank))
        if name in ("neg", "pos"):
            x, r = self.value(args[0]).number()
            return Val("num", -x if name == "neg" else x, r)
        if name == "BOUND":
            return Val("bool", self.value(args[0]).term().isNotNull())
        if name == "COALESCE":
            return Val("term", F.coalesce(*[self.value(a).term() for a in args]))
        if name == "IF":
            test = self.value(args[0]).truth()
            return Val("term", F.when(test, self.value(args[1]).term()).when(~test, self.value(args[2]).term()))
        if name == "CONCAT":
            return Val("str", F.concat(*[self.value(a).string() for a in args]) if args else F.lit(""))
        if name in ("NOW", "RAND", "UUID", "STRUUID", "BNODE") and not args:
            return {
                "NOW": lambda: Val("term", t.literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), t.XSD + "dateTime")),
                "RAND": lambda: Val("num", F.rand(), F.lit(3)),
                "UUID": lambda: Val("term", t.iri(fn.uuid_iri())),
                "STRUUID": lambda: Val("str", F.uuid()),
                "BNODE": lambda: Val("term", F.concat(F.lit("_:u"), F.replace(F.uuid(), F.lit("-"), F.lit("")))),
            }[name]()
        v = [self.value(a) for a in args]
        if name.startswith("<"):
            return self.cast(name[1:-1], v)
        simple: dict[str, Callable[[], Val]] = {
            "STR": lambda: Val("str", v[0].text()),
            "LANG": lambda: Val("str", t.lang(v[0].term())),
            "DATATYPE": lambda: Val("term", t.iri(t.datatype(v[0].term()))),
            "IRI": lambda: Val("term", t.iri(v[0].text())),
            "URI": lambda: Val("term", t.iri(v[0].text())),
            "BNODE": lambda: Val("term", F.concat(F.lit("_:"), F.md5(v[0].string()))),
            "ISIRI": lambda: Val("bool", t.is_iri(v[0].term())),
            "ISURI": lambda: Val("bool", t.is_iri(v[0].term())),
            "ISBLANK": lambda: Val("bool", t.is_blank(v[0].term())),
            "ISLITERAL": lambda: Val("bool", t.is_literal(v[0].term())),
            "ISNUMERIC": lambda: Val("bool", t.is_numeric(v[0].term())),
            "ISTRIPLE": lambda: Val("bool", t.is_triple(v[0].term())),
            "SAMETERM": lambda: Val("bool", v[0].term() == v[1].term()),
            "SUBJECT": lambda: Val("term", t.subject(v[0].term())),
            "PREDICATE": lambda: Val("term", t.predicate(v[0].term())),
            "OBJECT": lambda: Val("term", t.object_(v[0].term())),
            "TRIPLE": lambda: Val("term", t.triple(v[0].term(), v[1].term(), v[2].term())),
            "STRDT": lambda: Val("term", F.concat(t.quote(v[0].string()), F.lit("^^"), v[1].term())),
            "STRLANG": lambda: Val("term", F.concat(t.quote(v[0].string()), F.lit("@"), F.lower(v[1].string()))),
            "STRLEN": lambda: Val("num", F.char_length(v[0].string()).cast("double"), F.lit(0)),
            "UCASE": lambda: self.like(v[0], F.upper(v[0].string())),
            "LCASE": lambda: self.like(v[0], F.lower(v[0].string())),
            "CONTAINS": lambda: Val("bool", F.contains(v[0].string(), v[1].string())),
            "STRSTARTS": lambda: Val("bool", F.startswith(v[0].string(), v[1].string())),
            "STRENDS": lambda: Val("bool", F.endswith(v[0].string(), v[1].string())),
            "STRBEFORE": lambda: Val("str", fn.strbefore(v[0].string(), v[1].string())),
            "STRAFTER": lambda: Val("str", fn.strafter(v[0].string(), v[1].string())),
            "SUBSTR": lambda: self.like(v[0], fn.substr(v[0].string(), self.whole(args[1]), self.whole(args[2]) if len(args) > 2 else None)),
            "REGEX": lambda: Val("bool", fn.regex(v[0].string(), self.plain(args[1]), self.plain(args[2]) if len(args) > 2 else "")),
            "REPLACE": lambda: self.like(v[0], fn.replace(v[0].string(), self.plain(args[1]), self.plain(args[2]), self.plain(args[3]) if len(args) > 3 else "")),
            "ENCODE_FOR_URI": lambda: Val("str", fn.encode_for_uri(v[0].string())),
            "LANGMATCHES": lambda: Val("bool", fn.lang_matches(v[0].string(), self.plain(args[1]))),
            "ABS": lambda: Val("num", F.abs(v[0].number()[0]), v[0].number()[1]),
            "CEIL": lambda: Val("num", F.ceil(v[0].number()[0]).cast("double"), v[0].number()[1]),
            "FLOOR": lambda: Val("num", F.floor(v[0].number()[0]).cast("double"), v[0].number()[1]),
            "ROUND": lambda: Val("num", fn.round_(v[0].number()[0]).cast("double"), v[0].number()[1]),
            "YEAR": lambda: self.part(v[0], F.year),
            "MONTH": lambda: self.part(v[0], F.month),
            "DAY": lambda: self.part(v[0], F.dayofmonth),
            "HOURS": lambda: self.part(v[0], F.hour),
            "MINUTES": lambda: self.part(v[0], F.minute),
            "SECONDS": lambda: Val("num", fn.seconds(self.local(v[0])).cast("double"), F.lit(1)),
            "TZ": lambda: Val("str", fn.tz(t.lexical(v[0].term()))),
            "TIMEZONE": lambda: Val("term", t.literal(fn.timezone(t.lexical(v[0].term())), t.XSD + "dayTimeDuration")),
            "MD5": lambda: Val("str", F.md5(v[0].string())),
            "SHA1": lambda: Val("str", F.sha1(v[0].string())),
            **{f"SHA{n}": (lambda n=n: Val("str", F.sha2(v[0].string(), n))) for n in (256, 384, 512)},
        }
        if name not in simple:
            raise NotImplementedError(f"function {name} is not supported")
        return simple[name]()

    def local(self, v: Val) -> Column:
        """A dateTime's own clock, without its zone."""
        return F.try_to_timestamp(F.regexp_replace(t.lexical(v.term()), r"(Z|[+-]\d\d:\d\d)$", ""))

    def part(self, v: Val, f) -> Val:
        return Val("num", f(self.local(v)).cast("double"), F.lit(0))

    def like(self, v: Val, text: Column) -> Val:
        """A string with the language of the one it is made from."""
        if v.kind == "str":
            return Val("str", text)
        tag = t.lang(v.term())
        return Val("term", F.concat(t.quote(text), F.when(tag != "", F.concat(F.lit("@"), tag)).otherwise("")))

    def plain(self, e) -> str:
        if not isinstance(e, Term) or not e.text.startswith('"'):
            raise NotImplementedError("patterns and flags must be constant strings")
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), e.text[1 : e.text.rindex('"')])

    def whole(self, e) -> int:
        if isinstance(e, Op) and e.name in ("neg", "pos"):
            return -self.whole(e.args[0]) if e.name == "neg" else self.whole(e.args[0])
        return int(float(self.plain(e)))

    def cast(self, iri: str, v: list[Val]) -> Val:
        if iri.startswith(t.XSD):
            to = iri[len(t.XSD) :]
            text = v[0].text()
            if to in ("integer", "decimal", "float", "double"):
                flag = v[0].truth() if v[0].kind == "bool" else F.when(t.datatype(v[0].term()) == t.XSD + "boolean", v[0].truth())
                return Val("num", F.coalesce(flag.cast("double"), fn.cast(text, to).cast("double")), F.lit(("integer", "decimal", "float", "double").index(to)))
            if to == "boolean":
                n = v[0].number()[0]
                return Val("bool", F.coalesce(F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)), fn.cast(text, "boolean")))
            if to == "string":
                return Val("str", text)
            good = fn.cast(text, to)
            return Val("term", F.when(good.isNotNull(), t.literal(F.substring(text, 1, 10) if to == "date" else text, iri)))
        if self.extensions is not None:
            return Val("term", self.extensions.call(iri, *[x.term() for x in v]))
        raise NotImplementedError(f"no extension function {iri}")


# Patterns to algebra


@dataclass
class Compiled:
    node: A.Node
    names: list[str]
    maybe: set[str] = field(default_factory=set)  # may be unbound


class Compiler:
    def __init__(self, spark: SparkSession, union_default: bool = False, extensions=None, closures: bool = False):
        self.spark, self.union_default, self.extensions, self.closures = spark, union_default, extensions, closures
        self.default: list[str] = []
        self.named: list[str] = []

    # Scans

    def scoped(self, graph) -> tuple[A.Node, str | None]:
        """Quads of the graph asked for, and the variable that g binds."""
        union, default, named = self.union_default, list(self.default), list(self.named)

        def step(df: DataFrame) -> DataFrame:
            if graph is None:
                if default:
                    return df.where(F.col("g").isin(*default))
                return df if union else df.where("g IS NULL")
            df = df.where("g IS NOT NULL")
            if named:
                df = df.where(F.col("g").isin(*named))
            return df if isinstance(graph, Var) else df.where(F.col("g") == graph.text)

        return A.Map(A.Scan(QUADS), step, f"graph {graph}"), graph.name if isinstance(graph, Var) else None

    def triple(self, s, p, obj, graph) -> Compiled:
        base, g = self.scoped(graph)
        if isinstance(p, Path) and p.kind != "link":
            if g is not None:
                raise NotImplementedError("a path inside GRAPH with a variable is not supported")
            ends = [x.text for x in (s, obj) if isinstance(x, Term)]
            node, positions = self.path(p, base, ends), (("s", s), ("o", obj))
        else:
            node, positions = base, (("s", s), ("p", Term(p.parts[0]) if isinstance(p, Path) else p), ("o", obj))
        if g is not None:
            positions = (*positions, ("g", Var(g)))
        names = list(dict.fromkeys(n for _, x in positions for n in _variables(x)))

        def step(df: DataFrame) -> DataFrame:
            bound: dict[str, Column] = {}
            tests: list[Column] = []

            def bind(x, col: Column) -> None:
                if isinstance(x, Term):
                    tests.append(col == x.text)
                elif isinstance(x, Var):
                    if x.name in bound:
                        tests.append(bound[x.name] == col)
                    else:
                        bound[x.name] = col
                else:
                    tests.append(t.is_triple(col))
                    for part, get in ((x.s, t.subject), (x.p, t.predicate), (x.o, t.object_)):
                        bind(part, get(col))

            for name, x in positions:
                bind(x, F.col(name))
            for test in tests:
                df = df.where(test)
            return df.select(*[bound[n].alias(n) for n in names], *[m for m in META if m in df.columns])

        return Compiled(A.Map(node, step, f"{s} {p} {obj}"), names)

    def path(self, p: Path, base: A.Node, ends: list[str]) -> A.Node:
        """A node of (s, o)."""
        match p.kind:
            case "link":
                return A.Map(base, lambda d: paths.link(d, p.parts[0]), f"link {p.parts[0]}")
            case "inv":
                return A.Map(self.path(p.parts[0], base, ends), paths.inverse, "inverse")
            case "alt":
                return A.Union([self.path(x, base, ends) for x in p.parts])
            case "seq":
                out = self.path(p.parts[0], base, ends)
                for x in p.parts[1:]:
                    first = A.Map(out, lambda d: d.withColumnRenamed("o", "__mid"), "first")
                    second = A.Map(self.path(x, base, ends), lambda d: d.withColumnRenamed("s", "__mid"), "second")
                    out = A.Map(A.Join(first, second, keys=["__mid"]), lambda d: d.select("s", "o", WEIGHT), "sequence")
                return out
            case "nps":
                return A.Map(base, lambda d: paths.negated(d, *p.parts), f"not {p.parts}")
            case "opt":
                # A constant end is reached by no step even if it is no node of the graph.
                given = values(self.spark, "s string, o string", [(x, x) for x in ends])
                return A.Whole([self.path(p.parts[0], base, ends), base], lambda a, q: paths.distinct(paths.plus([paths.zero_or_one(a, q), given])), "zero or one")
            case "star" | "plus" if self.closures:
                inner = self.path(p.parts[0], base, ends)
                if p.kind == "plus":
                    return A.Whole([inner], paths.one_or_more, "one or more")
                return A.Whole([inner, base], paths.zero_or_more, "zero or more")
        raise NotImplementedError("repeating paths are not supported; Compiler(closures=True) has them as an extension")

    # Groups

    def join(self, a: Compiled | None, b: Compiled) -> Compiled:
        if a is None:
            return b
        both = [n for n in a.names if n in b.names]
        loose = [n for n in both if n in a.maybe or n in b.maybe]
        names = [*a.names, *[n for n in b.names if n not in a.names]]
        maybe = {n for n in a.maybe | b.maybe if (n not in a.names or n in a.maybe) and (n not in b.names or n in b.maybe)}
        return Compiled(A.Join(a.node, b.node, "compatible" if loose else "inner", both, loose=loose or None), names, maybe)

    def unit(self) -> Compiled:
        return Compiled(A.Inline(lift(self.spark.range(1)).drop("id")), [])

    def inline(self, names: list[str], rows: list[list]) -> Compiled:
        df = values(self.spark, ", ".join(f"`{n}` string" for n in names), [tuple(r) for r in rows])
        return Compiled(A.Inline(df), names, {n for i, n in enumerate(names) if any(r[i] is None for r in rows)})

    def group(self, items: list, graph=None) -> Compiled:
        out: Compiled | None = None
        filters = [x for x in items if x[0] in ("filter", "semi", "anti")]
        rest = [x for x in items if x[0] not in ("filter", "semi", "anti")]
        while rest:
            # Of a run of triples, the next one is one that shares a variable with what there is.
            at = 0
            if rest[0][0] == "triple" and out is not None:
                run = next((i for i, x in enumerate(rest) if x[0] != "triple"), len(rest))
                at = next((i for i in range(run) if set(_variables(rest[i][1]) + _variables(rest[i][2]) + _variables(rest[i][3])) & set(out.names)), 0)
            out = self.step(out, rest.pop(at), graph)
        out = out or self.unit()
        for f in filters:
            if f[0] == "filter":
                out = Compiled(A.Filter(out.node, Expressions(out.names, self.extensions).value(f[1]).truth()), out.names, out.maybe)
            else:
                # A filter of the pattern that names a variable of the outer row only is about both rows.
                own = [x for x in f[1] if x[0] != "filter"]
                inner = self.group(own, graph)
                lifted = [x for x in f[1] if x[0] == "filter" and set(_named(x[1])) & set(out.names) - set(inner.names)]
                rest = [x for x in f[1] if x not in lifted]
                inner = self.group(rest, graph) if len(rest) > len(own) else inner
                names = [*out.names, *[n for n in inner.names if n not in out.names]]
                test = None
                for x in lifted:
                    one = F.coalesce(Expressions(names, self.extensions).value(x[1]).truth(), F.lit(False))
                    test = one if test is None else test & one
                shared = [n for n in out.names if n in inner.names]
                loose = [n for n in shared if n in out.maybe or n in inner.maybe]
                out = Compiled(A.Join(out.node, inner.node, f[0], shared, test, loose or None), out.names, out.maybe)
        return out

    def step(self, out: Compiled | None, item: tuple, graph) -> Compiled:
        match item:
            case ("triple", s, p, obj):
                return self.join(out, self.triple(s, p, obj, graph))
            case ("graph", g, inner):
                return self.join(out, self.group(inner, g))
            case ("union", parts):
                got = [self.group(x, graph) for x in parts]
                if len(got) == 1:
                    return self.join(out, got[0])
                names = list(dict.fromkeys(n for x in got for n in x.names))
                maybe = {n for n in names if any(n not in x.names or n in x.maybe for x in got)}
                return self.join(out, Compiled(A.Union([x.node for x in got]), names, maybe))
            case ("select", q):
                return self.join(out, self.select(q, sub=True))
            case ("values", names, rows):
                return self.join(out, self.inline(names, rows))
            case ("bind", e, name):
                out = out or self.unit()
                if name in out.names:
                    raise SyntaxProblem(f"?{name} is bound already")
                col = Expressions(out.names, self.extensions).value(e).term()
                return Compiled(A.Extend(out.node, {name: col}), [*out.names, name], out.maybe | {name})
            case ("optional", inner):
                out = out or self.unit()
                own = [x for x in inner if x[0] != "filter"]
                right = self.group(own, graph)
                names = [*out.names, *[n for n in right.names if n not in out.names]]
                cond = None
                for f in inner:
                    if f[0] == "filter":
                        test = F.coalesce(Expressions(names, self.extensions).value(f[1]).truth(), F.lit(False))
                        cond = test if cond is None else cond & test
                shared = [n for n in out.names if n in right.names]
                loose = [n for n in shared if n in out.maybe or n in right.maybe]
                return Compiled(A.Join(out.node, right.node, "left", shared, cond, loose or None), names, out.maybe | {n for n in right.names if n not in out.names})
            case ("minus", inner):
                out = out or self.unit()
                right = self.group(inner, graph)
                return Compiled(A.Join(out.node, right.node, "minus"), out.names, out.maybe) if set(out.names) & set(right.names) else out
        raise NotImplementedError(item[0])

    # Solution modifiers

    def select(self, q: Select, sub: bool = False) -> Compiled:
        if not sub:
            self.default, self.named = q.default, q.named
        out = self.group(q.where)
        if q.values:
            out = self.join(out, self.inline(*q.values))
        grouping = bool(q.group) or any(_aggregates(x) for x in [*[i[0] for i in q.items if isinstance(i, tuple)], *q.having, *[e for e, _ in q.order]])
        found: dict | None = None
        if grouping:
            out, found = self.grouped(out, q)
        names = list(out.names)
        for item in q.items:
            if isinstance(item, tuple):
                e, v = item
                if v.name in out.names:
                    raise SyntaxProblem(f"?{v.name} is bound already")
                col = Expressions(names, self.extensions, found).value(e).term()
                out = Compiled(A.Extend(out.node, {v.name: col}), [*out.names, v.name], out.maybe | {v.name})
                names.append(v.name)
        shown = [n for n in names if not n.startswith("__")] if q.star else [i.name if isinstance(i, Var) else i[1].name for i in q.items]
        by = []
        for e, up in q.order:
            term = Expressions(names, self.extensions, found).value(e).term()
            by += [(k, up) for k in t.order_keys(term)]
        missing = [n for n in shown if n not in names]

        def project(df: DataFrame) -> DataFrame:
            df = df.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else df
            extra = [o.RANK] if o.RANK in df.columns else []
            return df.select(*[c(n) for n in shown], *extra, *[m for m in META if m in df.columns])

        node = out.node
        sliced = q.limit is not None or q.offset
        if q.modifier:
            node = A.Distinct(A.Map(node, project, f"project {shown}"))
            by = [(k, up) for k, up in by]
        if sliced:
            node = A.Slice(node, q.limit, q.offset, by or None)
        elif by and not sub:
            node = A.OrderBy(node, by)
        if not q.modifier:
            node = A.Map(node, project, f"project {shown}")
        return Compiled(node, shown, {n for n in shown if n in out.maybe or n in missing})

    def grouped(self, out: Compiled, q: Select) -> tuple[Compiled, dict]:
        ex = Expressions(out.names, self.extensions)
        keys, new = [], {}
        for i, (e, v) in enumerate(q.group):
            name = e.name if isinstance(e, Var) and v is None else v.name if v else f"__key{i}"
            if not (isinstance(e, Var) and v is None):
                new[name] = ex.value(e).term()
            elif name not in out.names:
                new[name] = F.lit(None).cast("string")
            keys.append(name)
        calls = [a for x in [*[i[0] for i in q.items if isinstance(i, tuple)], *q.having, *[e for e, _ in q.order]] for a in _aggregates(x)]
        hidden: dict[str, Column] = dict(new)
        aggs: dict[str, Agg] = {}
        final: dict[str, Column] = {}
        found: dict[int, str] = {}
        for i, a in enumerate(calls):
            name = f"__agg{i}"
            found[id(a)] = name
            if a.name == "COUNT" and not a.args:
                aggs[name] = Agg("count", None, a.distinct)
                final[name] = t.literal(c(name).cast("string"), t.XSD + "integer")
                continue
            v = ex.value(a.args[0])
            hidden[f"{name}_t"] = v.term()
            if a.name == "COUNT":
                aggs[name] = Agg("count", c(f"{name}_t"), a.distinct)
                final[name] = t.literal(c(name).cast("string"), t.XSD + "integer")
            elif a.name in ("SUM", "AVG"):
                n, rank = v.number()
                hidden |= {f"{name}_n": n, f"{name}_r": rank, f"{name}_bad": F.when(v.term().isNotNull() & n.isNull(), 1)}
                aggs |= {name: Agg(a.name.lower(), c(f"{name}_n"), a.distinct), f"{name}_k": Agg("max", c(f"{name}_r")), f"{name}_b": Agg("max", c(f"{name}_bad"))}
                rank = F.coalesce(c(f"{name}_k"), F.lit(0))
                rank = F.when((rank == 0) & c(f"{name}_k").isNotNull(), 1).otherwise(rank) if a.name == "AVG" else rank
                final[name] = F.when(c(f"{name}_b").isNull(), Val("num", c(name).cast("double"), rank).term())
            elif a.name in ("MIN", "MAX"):
                hidden[f"{name}_o"] = F.when(v.term().isNotNull(), F.struct(*[k.alias(f"k{j}") for j, k in enumerate(t.order_keys(v.term()))]))
                hidden[f"{name}_bad"] = F.when(v.term().isNotNull() & ~t.is_literal(v.term()), 1)
                aggs |= {name: Agg(a.name.lower(), c(f"{name}_o")), f"{name}_b": Agg("max", c(f"{name}_bad"))}
                final[name] = F.when(c(f"{name}_b").isNull(), c(name)["k4"])
            elif a.name == "SAMPLE":
                aggs[name] = Agg("sample", c(f"{name}_t"))
                final[name] = c(name)
            else:
                hidden[f"{name}_s"] = v.text()
                hidden[f"{name}_l"] = F.coalesce(t.lang(v.term()), F.lit(""))
                aggs |= {name: Agg("concat", c(f"{name}_s"), a.distinct, a.separator), f"{name}_lo": Agg("min", c(f"{name}_l")), f"{name}_hi": Agg("max", c(f"{name}_l"))}
                one = (c(f"{name}_lo") == c(f"{name}_hi")) & (c(f"{name}_lo") != "")
                final[name] = F.concat(t.quote(c(name)), F.when(one, F.concat(F.lit("@"), c(f"{name}_lo"))).otherwise(""))
        if any(a.name == "COUNT" and not a.args and a.distinct for a in calls) and hidden:
            # Whole rows are counted before helper columns are added, else those would count too.
            hidden = {k: v for k, v in hidden.items()}
        node = A.Extend(out.node, hidden) if hidden else out.node
        node = A.Group(node, keys, aggs)
        names = [*keys, *final]

        def finish(df: DataFrame) -> DataFrame:
            return df.select(*[c(k) for k in keys], *[v.alias(k) for k, v in final.items()], *[m for m in META if m in df.columns])

        node = A.Map(node, finish, "aggregates to terms")
        for h in q.having:
            node = A.Filter(node, Expressions(names, self.extensions, found).value(h).truth())
        maybe = {n for n in names}
        return Compiled(node, names, maybe), found


def _variables(x) -> list[str]:
    if isinstance(x, Var):
        return [x.name]
    if isinstance(x, Quoted):
        return [n for y in (x.s, x.p, x.o) for n in _variables(y)]
    return []


def _named(e) -> list[str]:
    """Variables of an expression."""
    if isinstance(e, (list, tuple)):
        return [n for x in e for n in _named(x)]
    return _variables(e) or (_named(e.args) if isinstance(e, Op) else [])


def _aggregates(e) -> list[Op]:
    if not isinstance(e, Op):
        return []
    return [e] if e.name in AGGREGATES else [a for x in e.args for a in _aggregates(x)]


def compile_query(spark: SparkSession, text: str, *, base: str = "", union_default: bool = False, extensions=None, closures: bool = False, initial: Mapping[str, str] | None = None) -> Compiled:
    """Text to algebra over the relation QUADS. initial: terms that variables are bound to beforehand."""
    q = Parser(text, base).query()
    if initial:
        q.where = [("values", list(initial), [list(initial.values())]), *q.where]
    return Compiler(spark, union_default, extensions, closures).select(q)


__all__ = ["QUADS", "Compiled", "Compiler", "Parser", "SyntaxProblem", "columns", "compile_query"]
