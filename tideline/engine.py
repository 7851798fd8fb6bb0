"""The query engine: SPARQL text over live sources, to results that follow the sources' changes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .changelog import WEIGHT, consolidate, expand, lift, plus
from .functions.extension import Registry
from .plans.compiler import View, evaluate
from .plans.sparql import QUADS, Parser, compile_query
from .sources.formats import read_nquads
from .sources.live import Deferred, Document, Polling, Store, choose, federated, skolemise

#: deferred: documents are looked at only when poll() is called, not by the clock. pollingPeriod: seconds. lenient: lines
#: of a file that are no statements are skipped.
OPTIONS = ("initialBindings", "unionDefaultGraph", "baseIRI", "lenient", "extensionFunctions", "pollingPeriod", "deferred", "closures")


class Results:
    """Bindings of a query. changes() is the changelog since the start or since the last call; rows() the current bag."""

    def __init__(self, view: View, names: list[str], maybe: set[str], engine: QueryEngine, sources: list, context: Mapping):
        self.view, self.names, self.maybe, self._sources = view, names, maybe, sources
        period, deferred = context.get("pollingPeriod", 10.0), context.get("deferred", False)
        self.watchers = [choose([(Polling(s, period=period), True), (Deferred(s), deferred)]) for s in sources if isinstance(s, Document)]
        self._pending = [view.result()]
        self._stores: list[tuple[Store, Any]] = []
        self._engine = engine
        self.closed = False
        # Of several sources each has its own blank nodes, at the start and in changes.
        self._keys = {id(s): f"s{i}" for i, s in enumerate(sources)} if len(sources) > 1 else {}
        for s in sources:
            if isinstance(s, Store):
                s.listeners.append(f := partial(self._on_change, s))
                self._stores.append((s, f))

    def _own(self, change: DataFrame, source) -> DataFrame:
        return skolemise(change, self._keys[id(source)]) if id(source) in self._keys else change

    def _on_change(self, source, change: DataFrame) -> None:
        if not self.closed:
            self._pending.append(self.view.apply({QUADS: self._own(change, source)}))

    def push(self, change: DataFrame, source=None) -> DataFrame:
        """Take a change that a watcher found in a source; the net change of the results."""
        out = self.view.apply({QUADS: self._own(change, source)})
        self._pending.append(out)
        return out

    def poll(self) -> DataFrame:
        """Let the watchers of documents look; the net change of the results."""
        found = []
        for w in self.watchers:
            change = w.trigger_update() if isinstance(w, Deferred) else w.poll()
            if change is not None:
                found.append(self.push(lift(change) if WEIGHT not in change.columns else change, w.document))
        return consolidate(plus(found)) if found else self.view.result().limit(0)

    def metadata(self) -> dict:
        """How many rows there are now, and which variables may be unbound."""
        n = self.view.result().agg({WEIGHT: "sum"}).first()[0] or 0
        return {"cardinality": {"type": "exact", "value": n}, "variables": [{"variable": v, "canBeUndef": v in self.maybe} for v in self.names]}

    def changes(self) -> DataFrame:
        held, self._pending = self._pending or [self.view.result().limit(0)], []
        return consolidate(plus(held))

    def rows(self) -> DataFrame:
        return expand(self.view.result())

    def close(self) -> None:
        self.closed = True
        for s, f in self._stores:
            if f in s.listeners:
                s.listeners.remove(f)
        for s in self._sources:
            if isinstance(s, Document):
                s.close()

    def retract(self) -> DataFrame:
        """End, with every current row as a deletion."""
        from .operators.relational import retract_all

        self.close()
        return retract_all(self.view.result())


class QueryEngine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _quads(self, source, lenient: bool = False) -> DataFrame:
        """A weighted quad relation of a store, a document, a DataFrame of quads or a path of N-Triples or N-Quads."""
        if isinstance(source, Store):
            return source.state
        if isinstance(source, Document):
            if source.now is None:
                source.refresh()
            source.open()
            return lift(source.now)
        if isinstance(source, DataFrame):
            return source if WEIGHT in source.columns else lift(source)
        if isinstance(source, str):
            return lift(read_nquads(self.spark, source, strict=not lenient))
        raise NotImplementedError(f"{type(source).__name__} is no source")

    def _registry(self, functions) -> Registry | None:
        if functions is None or isinstance(functions, Registry):
            return functions
        out = Registry()
        for iri, f in functions.items():
            out.register(iri, "string")(f)
        return out

    def query(self, text: str, sources: Iterable, **context) -> Results:
        """A maintained SELECT query. See OPTIONS for the context."""
        unknown = set(context) - set(OPTIONS)
        if unknown:
            raise TypeError(f"unknown options {sorted(unknown)}")
        sources = list(sources)
        if not sources:
            raise ValueError("a query needs a source")
        compiled = self._compile(text, context)
        given = [self._quads(s, context.get("lenient", False)) for s in sources]
        quads = given[0] if len(given) == 1 else federated({f"s{i}": q for i, q in enumerate(given)})
        return Results(View(compiled.node, {QUADS: quads}), compiled.names, compiled.maybe, self, sources, context)

    def _compile(self, text: str, context: Mapping):
        return compile_query(
            self.spark, text, base=context.get("baseIRI", ""), union_default=context.get("unionDefaultGraph", False), extensions=self._registry(context.get("extensionFunctions")),
            closures=context.get("closures", False), initial=context.get("initialBindings"),
        )

    def once(self, text: str, quads: DataFrame, **context) -> DataFrame:
        """The current result as plain rows, nothing kept."""
        compiled = self._compile(text, context)
        return expand(consolidate(evaluate(compiled.node, {QUADS: quads if WEIGHT in quads.columns else lift(quads)})))

    def explain(self, text: str, mode: str = "logical", quads: DataFrame | None = None, **context) -> str:
        """mode: parsed, logical or physical (that needs quads)."""
        if mode == "parsed":
            return repr(Parser(text, context.get("baseIRI", "")).query())
        if mode == "logical":
            return self._compile(text, context).node.show()
        if mode == "physical":
            plan = self.once(text, quads, **context)
            return plan._jdf.queryExecution().toString()
        raise ValueError(f"no mode {mode}")
