"""What the operators of this subpackage share: reading tables, durable intermediate tables, word counting."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, only where that is unset, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"tideline-{uuid.uuid4().hex}"))
            current = spark.sparkContext.getCheckpointDir()
        root = current
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and cut its lineage; Spark's cleaner removes the files when nobody refers to them."""
    spark = df.sparkSession
    shared_root(spark)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files and checkpoints that nobody refers to, instead of whenever the driver collects its garbage."""
    for _ in range(2):  # the first round frees what holds the second's
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: MB of its own that a worker may keep between tasks before it gives back what is free.
RESTING = 160


def tidy(run):
    """run of a mapInArrow, after which the worker, which lives on beside later stages, gives free memory back to the system."""

    def tidied(it):
        try:
            yield from run(it)
        finally:
            give_back()

    return tidied


def own_mb() -> float:
    with open("/proc/self/statm") as f:
        resident, shared = map(int, f.read().split()[1:3])
    return (resident - shared) * os.sysconf("SC_PAGE_SIZE") / (1 << 20)


def give_back(resting: float = RESTING) -> None:
    import ctypes

    import pyarrow as pa

    try:
        if own_mb() > resting:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another system or C library
        pass


class Shelf:
    """Parquet tables in the shared folder that live until clear(). For intermediate rows too wide for checkpoint()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_root(spark)}/shelf-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def clear(self) -> None:
        self._delete(self.path)

    def _delete(self, at: str) -> None:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(at)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the input's, whatever their case."""
    used, found = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        found.append(name)
    return found
