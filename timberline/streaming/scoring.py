"""Scoring of a stream: a tree is a stateless projection, so any streaming DataFrame of wide rows can be scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.score import score_sql


def score_stream(stream: DataFrame, nodes: list[dict], trees: list[int]) -> DataFrame:
    """``stream`` with ``votes``: the prediction of each tree (null: no vote). ``nodes`` are model rows as dicts."""
    return stream.withColumn("votes", F.array(*[F.expr(score_sql(nodes, t)) for t in trees]))
