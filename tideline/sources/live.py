"""Live sources: stores of quads, snapshots that are compared, changing sets of sources, and what watches them."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..changelog import EPOCH, WEIGHT, c, checkpoint, columns, consolidate, integrate, lift, minus, plus, set_normalise

QUAD = "s string, p string, o string, g string"
SEQ = "__seq"


def snapshot_changes(old: DataFrame, new: DataFrame, as_set: bool = False) -> DataFrame:
    """What makes the old version of a document the new one: rows with weights. As sets if asked, else as bags."""
    if as_set:
        old, new = old.distinct(), new.distinct()
    return minus(lift(new), lift(old))


def members(events: DataFrame, quads: DataFrame, key: str = "source_id") -> DataFrame:
    """The bag union over a changing multiset of sources. A source counts as often as it is in the set; taking one out
    that isn't in fails when the query runs."""
    held = consolidate(events.select(c(key), WEIGHT))
    bad = F.raise_error(F.concat(F.lit("source deleted but never added: "), F.col(key)))
    held = held.withColumn(WEIGHT, F.when(F.col(WEIGHT) < 0, bad.cast("long")).otherwise(F.col(WEIGHT)))
    held = held.select(c(key).alias("__src"), F.col(WEIGHT).alias("__times"))
    out = quads.join(held, c(key) == F.col("__src"))
    return out.select(*[c(x) for x in columns(quads)], (F.col(WEIGHT) * F.col("__times")).alias(WEIGHT))


def source_events(events: DataFrame) -> DataFrame:
    """Events whose polarity may be missing: a bare source is an addition."""
    return events.withColumn(WEIGHT, F.when(F.coalesce(F.col("is_addition"), F.lit(True)), 1).otherwise(-1).cast("long")).drop("is_addition")


def sources_from_results(df: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """Every IRI in the chosen variables of each result row, as a source event with the row's weight."""
    from ..functions import terms as t

    names = list(variables) if variables else columns(df)
    each = df.select(F.explode(F.array(*[c(n) for n in names])).alias("term"), WEIGHT)
    return each.where(t.is_iri(F.col("term"))).select(t.lexical(F.col("term")).alias("source_id"), WEIGHT)


def distinct_sources(events: DataFrame, ignore_deletions: bool = False) -> DataFrame:
    """Reference counts per URL without fragment: a URL is a source once, from its first addition to its last deletion.
    What is no URL is never merged."""
    kept = events.where(f"{WEIGHT} > 0") if ignore_deletions else events
    url = F.col("source_id").rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    key = F.when(url, F.regexp_replace("source_id", "#.*$", "")).otherwise(F.col("source_id"))
    net = consolidate(kept.select(key.alias("source_id"), url.alias("__url"), WEIGHT))
    return net.where(f"{WEIGHT} > 0").withColumn(WEIGHT, F.when(F.col("__url"), 1).otherwise(F.col(WEIGHT)).cast("long")).drop("__url")


class StoreEnded(RuntimeError):
    """The store has ended and takes no more changes."""


class Store:
    """A mutable set of quads, kept as a changelog in rounds.

    add() and remove() take DataFrames or lists of quads and form one round each; what is present isn't added again and
    what is absent isn't removed. halt() holds rounds back until resume(), which lets them in in order.
    """

    def __init__(self, spark: SparkSession, schema: str = QUAD):
        self.spark, self.schema = spark, schema
        self.state = lift(spark.createDataFrame([], schema))
        self.rounds: list[DataFrame] = []
        self._held: list[DataFrame] | None = None
        self.ended = False
        self.listeners: list[Callable[[DataFrame], None]] = []

    def _frame(self, rows: DataFrame | Iterable[tuple]) -> DataFrame:
        return rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), self.schema)

    def add(self, rows: DataFrame | Iterable[tuple]) -> None:
        df = self._frame(rows)
        self.change(df if WEIGHT in df.columns else lift(df))

    def remove(self, rows: DataFrame | Iterable[tuple]) -> None:
        df = self._frame(rows)
        self.change(df if WEIGHT in df.columns else lift(df, -1))

    load = add

    def change(self, events: DataFrame) -> None:
        """Additions and deletions in one round; SEQ, where there is one, orders the events of a quad."""
        if self.ended:
            raise StoreEnded("the store has ended")
        if self._held is not None:
            self._held.append(events)
            return
        seq = SEQ if SEQ in events.columns else None
        now = events.withColumn(EPOCH, F.lit(1)) if seq is None else events.withColumnRenamed(SEQ, EPOCH).withColumn(EPOCH, F.col(EPOCH) + 1)
        if seq is None:  # one event a quad and round: its net sign
            now = consolidate(now.drop(EPOCH)).withColumn(EPOCH, F.lit(1))
        hist = plus([self.state.withColumn(EPOCH, F.lit(0)), now.select(*columns(self.state), WEIGHT, EPOCH)])
        kept = set_normalise(hist).where(F.col(EPOCH) > 0).drop(EPOCH)
        effect = checkpoint(consolidate(kept))
        self.rounds.append(effect)
        self.state = checkpoint(consolidate(plus([self.state, effect])))
        for f in self.listeners:
            f(effect)

    def halt(self) -> None:
        if self._held is None:
            self._held = []

    def resume(self) -> None:
        held, self._held = self._held or [], None
        for events in held:
            self.change(events)

    def end(self) -> None:
        self.ended = True

    def has_ended(self) -> bool:
        return self.ended

    def copy(self) -> Store:
        out = Store(self.spark, self.schema)
        out.state = self.state
        return out

    def log(self) -> DataFrame:
        """All rounds, from 0."""
        if not self.rounds:
            return self.state.withColumn(EPOCH, F.lit(0))
        return plus([r.withColumn(EPOCH, F.lit(i)) for i, r in enumerate(self.rounds)])

    def match(self, s=None, p=None, o=None, g=None, upto: int | None = None) -> DataFrame:
        """Quads by their terms; None is a wildcard."""
        out = self.state if upto is None else integrate(self.log(), upto)
        for name, term in zip("spog", (s, p, o, g)):
            if term is not None:
                out = out.where(F.col(name).eqNullSafe(F.lit(term)))
        return out

    def count(self, s=None, p=None, o=None, g=None) -> int:
        return self.match(s, p, o, g).agg(F.coalesce(F.sum(WEIGHT), F.lit(0))).first()[0]


class Status(Enum):
    INITIALIZING, RUNNING, IDLE, STOPPED = "initializing", "running", "idle", "stopped"


class Document:
    """A file, folder or anything a loader reads, with its last version; refresh() gives the change since.

    A load that fails, or that returns None, means that the document is gone: all its quads are retracted.
    """

    def __init__(self, load: Callable[[], DataFrame | None], etag: Callable[[], str | None] = lambda: None, as_set: bool = True):
        self.load, self.etag, self.as_set = load, etag, as_set
        self.now: DataFrame | None = None
        self.tag: str | None = None
        self.status, self.readers = Status.INITIALIZING, 0
        self.events: list[str] = []

    def refresh(self, gone: bool = False) -> DataFrame | None:
        """The change, or None where there never was a version."""
        try:
            new = None if gone else self.load()
        except Exception:  # noqa: BLE001  whatever keeps a document from being read
            new = None
        shape = new if new is not None else self.now
        if shape is None:
            return None
        empty = shape.limit(0)
        new = checkpoint(new if new is not None else empty)
        out = checkpoint(snapshot_changes(self.now if self.now is not None else empty, new, self.as_set))
        self.now, self.tag = new, self.etag()
        self.events.append("modified" if not out.isEmpty() else "up-to-date")
        return out

    def open(self) -> None:
        self.readers += 1
        self.status = Status.RUNNING

    def close(self) -> None:
        self.readers = max(0, self.readers - 1)
        if not self.readers:
            self.status = Status.IDLE


@dataclass
class Polling:
    """Looks at the document's tag once a period: max-age if it states one, else the option, else ten seconds. The stated
    age shortens the first wait."""

    document: Document
    period: float = 10.0
    max_age: float | None = None
    age: float = 0.0
    clock: Callable[[], float] = time.monotonic
    priority: int = 5
    _next: float | None = field(default=None, init=False)

    def interval(self) -> float:
        return self.period if self.max_age is None else self.max_age

    def poll(self) -> DataFrame | None:
        """The change, if a check is due and the document differs; only while somebody reads it."""
        now = self.clock()
        if self._next is None:
            self._next = now + max(0.0, self.interval() - self.age)
        if self.document.status is not Status.RUNNING or now < self._next:
            return None
        self._next = now + self.interval()
        try:
            tag = self.document.etag()
        except Exception:  # noqa: BLE001  an unreachable document counts as deleted
            return self.document.refresh(gone=True)
        return None if tag is not None and tag == self.document.tag else self.document.refresh()


@dataclass
class Deferred:
    """Looks only when told to."""

    document: Document
    priority: int = 15

    def trigger_update(self) -> DataFrame | None:
        tag = self.document.etag()
        if self.document.status is not Status.RUNNING or (tag is not None and tag == self.document.tag):
            return None
        return self.document.refresh()


@dataclass
class Notified:
    """Takes messages of a notification channel: Delete retracts, anything else updates, and so does opening."""

    document: Document
    priority: int = 10

    def opened(self) -> DataFrame | None:
        return self.document.refresh()

    def message(self, kind: str) -> DataFrame | None:
        return self.document.refresh(gone=kind == "Delete")


def choose(candidates: Iterable[tuple[object, bool]]):
    """Of the watchers whose test passes, the one of highest priority."""
    fit = [w for w, passes in candidates if passes]
    if not fit:
        raise NotImplementedError("no watcher fits the source")
    return max(fit, key=lambda w: w.priority)


class SourceSet:
    """A set of sources fed by hand and by query results, with reference counts and a cooldown for deletions.

    events() gives the source changelog so far; a deletion takes effect only `cooldown` seconds later, and not if the
    source comes back meanwhile.
    """

    def __init__(self, spark: SparkSession, seeds: Iterable[str] = (), distinct: bool = True, ignore_deletions: bool = False, cooldown: float = 0.0, lenient: bool = False, clock: Callable[[], float] = time.monotonic):
        self.spark, self.distinct, self.ignore, self.cooldown, self.lenient, self.clock = spark, distinct, ignore_deletions, cooldown, lenient, clock
        self.counts: dict[str, int] = {}
        self.waiting: list[tuple[float, str]] = []
        self.out: list[tuple[str, int]] = []
        for s in seeds:
            self.add(s)

    def _key(self, source: str) -> str:
        is_url = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", source) is not None
        return source.split("#", 1)[0] if self.distinct and is_url else source

    def add(self, source: str) -> None:
        key = self._key(source)
        for i, (_, k) in enumerate(self.waiting):
            if k == key:  # it never left
                del self.waiting[i]
                return
        n = self.counts.get(key, 0)
        self.counts[key] = n + 1
        if n == 0 or not self.distinct or "://" not in key:
            self.out.append((key, 1))

    def remove(self, source: str) -> None:
        if self.ignore:
            return
        key = self._key(source)
        if not self.counts.get(key):
            if self.lenient:
                return
            raise ValueError(f"source deleted but never added: {source}")
        self.waiting.append((self.clock() + self.cooldown, key))
        self.tick()

    def tick(self) -> None:
        """Let deletions whose cooldown is over take effect."""
        now = self.clock()
        due = [k for t, k in self.waiting if t <= now]
        self.waiting = [(t, k) for t, k in self.waiting if t > now]
        for key in due:
            self.counts[key] -= 1
            if not self.counts[key] or not self.distinct or "://" not in key:
                self.out.append((key, -1))

    def events(self) -> DataFrame:
        self.tick()
        return self.spark.createDataFrame(self.out, f"source_id string, {WEIGHT} long")


def skolemise(quads: DataFrame, source_id: str) -> DataFrame:
    """Blank nodes of one source made distinct from those of any other: terms that are blank nodes, in quoted triples too."""
    from ..functions import terms as t

    name = uuid.uuid5(uuid.NAMESPACE_URL, source_id).hex

    def own(term, depth: int = 2):
        new = F.when(t.is_blank(term), F.concat(F.lit(f"_:{name}x"), F.substring(term, 3, 1 << 30))).otherwise(term)
        if not depth:
            return new
        return F.when(t.is_triple(term), t.triple(own(t.subject(term), depth - 1), t.predicate(term), own(t.object_(term), depth - 1))).otherwise(new)

    return quads.withColumns({x: own(c(x)) if x in "so" else own(c(x), 0) for x in ("s", "o", "g") if x in quads.columns})


def federated(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources as one, each evaluated in full."""
    return plus([skolemise(df, k) for k, df in sources.items()])
