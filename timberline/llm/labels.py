"""Labelled rows for the classifiers: which may be learned from, and one label for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the label is for measuring only: crc32 of doc_id as text is a multiple of 5. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, y (0 or 1): the labels ``name`` that may be learned from. Null labels and ids are left out; of several
    labels of one document the largest counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("y"))
    return own.filter("doc_id is not null and y is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
