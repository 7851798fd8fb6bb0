"""The algebra of queries: trees of these nodes over named base relations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..operators.group import Agg


class Node:
    """Base of all nodes. show() prints the tree."""

    def children(self) -> list[Node]:
        return [v for v in vars(self).values() if isinstance(v, Node)] + [x for v in vars(self).values() if isinstance(v, (list, tuple)) for x in v if isinstance(x, Node)]

    def show(self, depth: int = 0) -> str:
        said = []
        for k, v in vars(self).items():
            if isinstance(v, Node) or (isinstance(v, (list, tuple)) and v and isinstance(v[0], Node)) or callable(v):
                continue
            said.append(f"{k}={v}")
        return "\n".join(["  " * depth + f"{type(self).__name__}({', '.join(said)})", *[x.show(depth + 1) for x in self.children()]])


@dataclass
class Scan(Node):
    """A base relation by name."""

    name: str


@dataclass
class Inline(Node):
    """Rows given with the query (VALUES); never change."""

    rows: DataFrame


@dataclass
class Map(Node):
    """Any row-wise step: filter, extend, project, rename. `step` takes and returns a weighted DataFrame."""

    child: Node
    step: Callable[[DataFrame], DataFrame]
    label: str = ""


@dataclass
class Filter(Node):
    child: Node
    predicate: Column


@dataclass
class Extend(Node):
    child: Node
    new: dict[str, Column]


@dataclass
class Project(Node):
    child: Node
    names: Sequence[str | Column]


@dataclass
class Union(Node):
    parts: Sequence[Node]


@dataclass
class Join(Node):
    """kind: inner, left, semi, anti, minus, compatible. keys: None for the shared columns; loose: those of them that can be unbound
    and then fit anything (left, semi, anti, compatible)."""

    left: Node
    right: Node
    kind: str = "inner"
    keys: Sequence[str] | None = None
    condition: Column | None = None
    loose: Sequence[str] | None = None


@dataclass
class Group(Node):
    child: Node
    keys: Sequence[str]
    aggs: dict[str, Agg] = field(default_factory=dict)


@dataclass
class Distinct(Node):
    child: Node


@dataclass
class OrderBy(Node):
    """Adds each row's rank. by: (key, ascending) pairs."""

    child: Node
    by: Sequence[tuple]
    name: str = "__rank"


@dataclass
class Slice(Node):
    """Rows start .. start + length; by an order if `by` is given, else any."""

    child: Node
    length: int | None
    start: int = 0
    by: Sequence[tuple] | None = None


@dataclass
class Whole(Node):
    """Any operator on whole bags that has no rule of its own for changes: new result minus old result."""

    parts: Sequence[Node]
    op: Callable[..., DataFrame]
    label: str = ""
