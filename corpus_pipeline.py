"""Documents to tokens: quality, near copies, repeated passages, source mix, encoding.

Each stage is (name, function) of (spark, docs, sf_dir); what a stage returns is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import bpe, mixing, quality, simhash, substring
from timberline.llm.common import checkpoint_folder, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.stage(docs, table(spark, sf_dir, "labels"))


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.stage(docs)


def _repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.stage(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = bpe.bpe_round_trip(docs, bpe.default_vocabulary())
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", _quality), ("near_copies", _near_copies), ("repeated_passages", _repeated_passages), ("mix", _mix), ("encode", _encode)]

#: SQL can't express the classifier, the near copies, the rounding or the merges; tests/llm compares each stage of a run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``; between them Parquet in a new folder of the shared checkpoint folder,
    which the result reads when it is computed; whoever empties the checkpoint folder removes it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
