"""A training corpus from raw documents: quality rules, line deduplication, near-deduplication, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

1. quality: documents that the rules reject go; failing lines of the others are removed.
2. line_dedup: of each group of like lines in the corpus one occurrence stays.
3. near_dup: of each class of near-copies one document stays.
4. mix: documents appear as often as their source's target weight asks.
5. tokens: SentencePiece ids of the whole text, next to the document's columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import line_dedup, mixing, near_dup, quality, sentencepiece_codec
from tideline.llm.common import shared_root


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, keep=tuple(docs.columns))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: Fuzzy lines and near-copies are components of a similarity graph, and ids come from a tokenizer: no SQL. The stages are
#: tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written is removed as soon as the next one is written."""
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return docs
        at = f"{root}/{k}"
        docs.write.parquet(at)
        docs = spark.read.schema(docs.schema).parquet(at)
        if k:
            gone = place(f"{root}/{k - 1}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
