"""Session helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows by leaf that go to every worker; where there are more, a join spreads the cases.
LEAF_ROWS = 100_000


def local(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir (a new local one where none is named)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="timberline-"))
    return df.checkpoint()


def by_case(df: DataFrame) -> DataFrame:
    """``df``, which has rows for each case, for a join by case: both sides are shuffled. The size of compressed files, by which Spark
    chooses, can call it small enough to come to the driver."""
    return df.hint("merge")


def by_leaf(rows: DataFrame) -> DataFrame:
    """``rows``, at most one for each leaf of a tree, for a join with cases by their leaves: they go to every worker while they are
    few, because then all cases of a leaf may be too many for one task."""
    return F.broadcast(rows) if rows.count() <= LEAF_ROWS else rows


@contextmanager
def plain_planning(spark: SparkSession) -> Iterator[None]:
    """Without the planner's inference of constraints, whose time explodes with long conditional expressions."""
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
