"""Sums of weights over all points that lie below and left of a query point, in one task or over ranges of both axes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def dominance(x: np.ndarray, y: np.ndarray, w: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the sums of ``w`` (points x weights) over the points with x <= qx and y <= qy.

    A wavelet matrix over the ranks of ``y`` in the order of ``x``: a bit at a time the points part into those with 0 and 1, and a query
    adds those with 0 where its own bit is 1.
    """
    out = np.zeros((len(qx), w.shape[1]))
    if not len(x):
        return out
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(y), np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(len(y))
    hi, bound = np.searchsorted(x[order], qx, side="right"), np.searchsorted(np.sort(y), qy, side="right")
    lo = np.zeros_like(hi)
    rank, w = rank[order], w[order]
    for bit in reversed(range(int(len(y)).bit_length())):
        ones = (rank >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        upto = np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(np.where(ones[:, None], 0.0, w), axis=0)])
        right = (bound >> bit) & 1 == 1
        out[right] += upto[hi[right]] - upto[lo[right]]
        lo, hi = (np.where(right, zeros[-1] + at - zeros[at], zeros[at]) for at in (lo, hi))
        turn = np.concatenate([np.flatnonzero(~ones), np.flatnonzero(ones)])
        rank, w = rank[turn], w[turn]
    return out


def _local(x: str, y: str, weights: Sequence[str], names: Sequence[str]):
    """Adds ``names`` to the queries of each group, by the points of the group; points give no rows."""

    def run(t: pa.Table) -> pa.Table:
        col = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        asks = col("asks").astype(bool)
        w = np.column_stack([col(c) for c in weights])[~asks]
        found = dominance(col(x)[~asks], col(y)[~asks], w, col(x)[asks], col(y)[asks])
        return pa.table([t.column("at").filter(pa.array(asks)), *[pa.array(found[:, i]) for i in range(len(names))]], names=["at", *names])

    return run


def dominated(points: DataFrame, queries: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """``queries`` (keys, x, y, ...) with _d_* of each weight: its sum over ``points`` (keys, x, y, weights) with x and y not above the query's.

    Points and queries are laid out by ranges of x, then by ranges of y. A query gets what lies in ranges before its own on both axes from a
    table of cells, and the rest from the points of its own range of x, and of y. No task has more than ranges.
    """
    own = [F.col(k) for k in keys]
    asked = cut(queries.withColumn("at", F.monotonically_increasing_id()))
    ask = asked.select(*own, "x", "y", F.lit(True).alias("asks"), "at", *[F.lit(0.0).alias(w) for w in weights])
    tell = points.select(*own, "x", "y", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("at"), *[F.col(w).cast("double").alias(w) for w in weights])
    # a query comes behind the points that it equals, and points that are equal on one axis may be in several ranges
    other = lambda c: F.when(F.col("asks"), F.lit(float("inf"))).otherwise(F.col(c))
    first = cut(tell.unionByName(ask).withColumn("_o", other("y")).repartitionByRange(*own, "x", "_o").withColumn("_p", F.spark_partition_id()))
    both = cut(first.withColumn("_o", other("x")).repartitionByRange(*own, "y", "_o").withColumn("_q", F.spark_partition_id()))
    found = lambda p: [f"_{p}_{w}" for w in weights]
    types = dict(both.dtypes)
    schema = lambda p: "at long, " + ", ".join(f"`{c}` double" for c in found(p))
    # of the same range of x all points, of the same range of y those in ranges of x before it
    in_x = both.groupBy(*own, "_p").applyInArrow(_local("x", "y", weights, found("x")), schema("x"))
    before = both.withColumn("_before", F.when(F.col("asks"), F.col("_p") - 1).otherwise(F.col("_p")).cast("double"))
    in_y = before.groupBy(*own, "_q").applyInArrow(_local("_before", "y", weights, found("y")), schema("y"))
    # whole cells: sums over all ranges before on both axes, one row for each key and cell that occurs
    cells = both.groupBy(*own, "_p", "_q").agg(*[F.sum(w).alias(w) for w in weights])
    cells = cells.select(*own, F.col("_p").cast("double").alias("x"), F.col("_q").cast("double").alias("y"), *weights)
    corners = both.filter("asks").select(*own, "_p", "_q").distinct()

    def below(c: pa.Table, q: pa.Table) -> pa.Table:
        col = lambda t, name: t.column(name).to_numpy(zero_copy_only=False).astype(float)
        w = np.column_stack([col(c, name) for name in weights]) if c.num_rows else np.zeros((0, len(weights)))
        sums = dominance(col(c, "x"), col(c, "y"), w, col(q, "_p") - 1, col(q, "_q") - 1)
        return pa.table([*[q.column(k) for k in keys], q.column("_p"), q.column("_q"), *[pa.array(sums[:, i]) for i in range(len(weights))]], names=[*keys, "_p", "_q", *found("c")])

    corner = cells.groupBy(*own).cogroup(corners.groupBy(*own))
    at_corner = corner.applyInArrow(below, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "_p int, _q int", *[f"`{c}` double" for c in found("c")]]))
    meets = ["_p", "_q"]
    where = both.filter("asks").select("at", *own, *meets)
    joined = where.join(at_corner.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_cp"), F.col("_q").alias("_cq"), *found("c")), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], (F.col("_p") == F.col("_cp")) & (F.col("_q") == F.col("_cq"))))
    total = joined.select("at", *found("c")).join(in_x, "at").join(in_y, "at")
    return asked.join(total.select("at", *[(F.col(f"_c_{w}") + F.col(f"_x_{w}") + F.col(f"_y_{w}")).alias(f"_d_{w}") for w in weights]), "at").drop("at")
