"""The same rules on streams: one micro-batch is one round of changes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..changelog import EPOCH, WEIGHT, consolidate, plus, shared_root
from ..plans.algebra import Node
from ..plans.compiler import delta, evaluate

#: Names the base relation of a row in a stream that carries several.
RELATION = "__relation"
#: Weight and order of events as the processors see them: names that begin with an underscore don't reach pandas.
CHANGE, ORDER, KEY = "w_change", "w_order", "w_key"


class StreamView:
    """A maintained query fed by micro-batches.

    State lies in Parquet tables named by batch: batch n reads what n - 1 left and writes its own, then the change of the
    result. A batch that runs again overwrites the same tables, so results are exactly once.
    """

    def __init__(self, spark: SparkSession, node: Node, schemas: Mapping[str, StructType], path: str | None = None):
        self.spark, self.node, self.schemas = spark, node, dict(schemas)
        self.path = path or f"{shared_root(spark)}/view-{uuid.uuid4().hex}"

    def _at(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch}"

    def _exists(self, at: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at + "/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _state(self, name: str, batch: int) -> DataFrame:
        at = self._at(f"state-{name}", batch)
        if batch < 0 or not self._exists(at):
            return self.spark.createDataFrame([], self.schemas[name]).withColumn(WEIGHT, F.lit(0).cast("long"))
        return self.spark.read.parquet(at)

    def on_batch(self, changes: Mapping[str, DataFrame], batch: int) -> None:
        old = {k: self._state(k, batch - 1) for k in self.schemas}
        change = {}
        for k, v in changes.items():  # once: the state and the result's change read it
            consolidate(v).write.mode("overwrite").parquet(self._at(f"change-{k}", batch))
            change[k] = self.spark.read.parquet(self._at(f"change-{k}", batch))
        for k in self.schemas:
            new = consolidate(plus([old[k], change[k]])) if k in change else old[k]
            new.write.mode("overwrite").parquet(self._at(f"state-{k}", batch))
        if batch == 0:
            out = evaluate(self.node, {k: self._state(k, 0) for k in self.schemas})
        else:
            out = delta(self.node, old, change)
            if out is None:
                out = evaluate(self.node, old).limit(0)
        consolidate(out).write.mode("overwrite").parquet(self._at("changes", batch))

    def start(self, stream: DataFrame, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
        """stream: the relation's rows with WEIGHT, or with RELATION too and the columns of all relations."""

        def step(df: DataFrame, batch: int) -> None:
            if RELATION in df.columns:
                parts = {k: df.where(F.col(RELATION) == k).select(*s.names, WEIGHT) for k, s in self.schemas.items()}
            else:
                (name, s), = self.schemas.items()
                parts = {name: df.select(*s.names, WEIGHT)}
            self.on_batch(parts, batch)

        writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or f"{self.path}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()

    def changes(self) -> DataFrame:
        """The changelog of the result; EPOCH is the batch."""
        return self.spark.read.parquet(f"{self.path}/changes").withColumnRenamed("batch", EPOCH)

    def result(self) -> DataFrame:
        return consolidate(self.changes().drop(EPOCH))


class _Counts(StatefulProcessor):
    """One number a key; emits when what the key shows changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")

    def _before(self) -> int:
        got = self.n.get() if self.n.exists() else None
        return got[0] if got else 0

    def _after(self, n: int) -> None:
        if n:
            self.n.update((n,))
        else:
            self.n.clear()

    def close(self) -> None:
        pass


#: JSON keeps the microseconds of timestamps.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Keys of a DISTINCT share this many states; a call of the processor costs about the same for one key and for hundreds.
BUCKETS, BUCKET = 4096, "w_bucket"


class DistinctProcessor(StatefulProcessor):
    """DISTINCT by reference counts: +1 when a row comes, -1 when its last copy goes. Called once a bucket of keys, whose
    counts are one value: the keys' JSON texts and their counts as parallel arrays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "keys array<string>, counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = self.state.get()
        held = dict(zip(got[0], got[1])) if got else {}
        came: dict[str, int] = {}
        for r in rows:
            for k, n in zip(r[KEY], r[CHANGE]):
                came[k] = came.get(k, 0) + int(n)
        out = []
        for k, n in came.items():
            before = held.get(k, 0)
            now = before + n
            if now:
                held[k] = now
            else:
                held.pop(k, None)
            if (now > 0) != (before > 0):
                out.append((k, 1 if now > 0 else -1))
        if held:
            self.state.update((list(held), list(held.values())))
        else:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=[KEY, CHANGE])

    def close(self) -> None:
        pass


class SetProcessor(_Counts):
    """A set's members: in a batch the last event of a quad decides; repeated additions and absent deletions emit nothing."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, every = self._before(), pd.concat(list(rows))
        if ORDER in every.columns:
            every = every.sort_values(ORDER, kind="stable")
        now = int(every[CHANGE].iloc[-1] > 0)
        self._after(now)
        if now != before:
            yield pd.DataFrame([(*key, now - before)], columns=[*self.names, CHANGE])


class GroupCountProcessor(_Counts):
    """COUNT per group: the old row retracted, the new one added; a group that empties goes."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._before()
        now = before + int(sum(r[CHANGE].sum() for r in rows))
        self._after(now)
        out = ([(*key, before, -1)] if before > 0 else []) + ([(*key, now, 1)] if now > 0 else [])
        if now != before and out:
            yield pd.DataFrame(out, columns=[*self.names, "n", CHANGE])


def keyed(stream: DataFrame, names: list[str], processor: type[_Counts], extra: str = "") -> DataFrame:
    """A stream of changes through a keyed processor, with state in the configured state store (RocksDB)."""
    made = processor()
    made.names = names
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields if f.name in names]
    fields = sorted(fields, key=lambda x: names.index(x.split("`")[1]))
    schema = ", ".join([*fields, *([extra] if extra else []), f"{CHANGE} long"])
    given = stream.withColumnsRenamed({WEIGHT: CHANGE, "__seq": ORDER})
    out = given.groupBy(*names).transformWithStateInPandas(made, outputStructType=schema, outputMode="Update", timeMode="None")
    return out.withColumnRenamed(CHANGE, WEIGHT)


def summed(stream: DataFrame) -> DataFrame:
    """Partial sums of CHANGE by the other columns, within what a task reads at once; without state."""
    own = [x for x in stream.columns if x != CHANGE]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(own).aggregate([(CHANGE, "sum")])
            yield from t.rename_columns([*own, CHANGE]).select(b.schema.names).cast(b.schema).to_batches()

    return stream.mapInArrow(add, stream.schema)


def distinct_stream(stream: DataFrame, names: list[str]) -> DataFrame:
    """Keys go through the processor as JSON texts, which keep nulls and are the same for the same values."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for n in names for f in stream.schema.fields if f.name == n)
    real = {f.name for f in stream.schema.fields if f.dataType.typeName() in ("float", "double")}
    # 0.0 is added for -0.0, which equals 0.0.
    each = [(F.col(f"`{n}`") + F.lit(0.0).cast(stream.schema[n].dataType)).alias(n) if n in real else F.col(f"`{n}`") for n in names]
    key = F.to_json(F.struct(*each), {"ignoreNullFields": "false", **EXACT})
    given = summed(stream.select(key.alias(KEY), F.col(WEIGHT).alias(CHANGE)))
    given = given.withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int"))
    out = given.groupBy(BUCKET).transformWithStateInPandas(DistinctProcessor(), outputStructType=f"{KEY} string, {CHANGE} long", outputMode="Update", timeMode="None")
    return out.select(F.from_json(KEY, fields, EXACT).alias("k"), F.col(CHANGE).alias(WEIGHT)).select("k.*", WEIGHT)


def set_stream(stream: DataFrame, names: list[str]) -> DataFrame:
    return keyed(stream, names, SetProcessor)


def count_stream(stream: DataFrame, names: list[str]) -> DataFrame:
    return keyed(stream, names, GroupCountProcessor, "n long")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
