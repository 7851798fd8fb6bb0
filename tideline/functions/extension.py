"""Extension functions: named by an IRI, written over pandas Series, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Registry:
    """IRI -> function. `creator` is asked for names that aren't registered."""

    def __init__(self, creator: Callable[[str], tuple[Callable, str] | None] | None = None):
        self._known: dict[str, Callable[..., Column]] = {}
        self._creator = creator

    def register(self, iri: str, returns: str):
        """Decorator for a function of Series to a Series."""

        def add(f: Callable):
            import pandas as pd

            def batch(*args: pd.Series) -> pd.Series:
                return f(*args)

            batch.__annotations__ = {"args": pd.Series, "return": pd.Series}
            self._known[iri] = F.pandas_udf(batch, returns)
            return f

        return add

    def aggregate(self, iri: str, returns: str):
        """Decorator for a function of Series to one value: a user-defined aggregate over plain rows."""

        def add(f: Callable):
            from pyspark.sql.pandas.functions import PandasUDFType

            self._known[iri] = F.pandas_udf(f, returns, PandasUDFType.GROUPED_AGG)
            return f

        return add

    def call(self, iri: str, *args: Column) -> Column:
        if iri not in self._known and self._creator is not None and (made := self._creator(iri)) is not None:
            self.register(iri, made[1])(made[0])
        if iri not in self._known:
            raise NotImplementedError(f"no extension function {iri}")
        return self._known[iri](*args)

    def __contains__(self, iri: str) -> bool:
        return iri in self._known
