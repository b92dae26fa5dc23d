"""Leaves of wide rows by arrays of the model, in blocks of trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import score
from ..operators.transform import to_cells

#: Nodes of a block of trees that goes to every worker.
MODEL_NODES = 1_000_000
#: The struct of the features of rows that carry them beside other columns.
WIDE = "_tl_wide"
_LEAVES = "tree int, case_id long, path string, pred string, weight double"


class Model:
    """Trees as arrays: each node's feature (-1: leaf), threshold or set of categories, and children (-1: none) for L, R and M."""

    def __init__(self, nodes: pa.Table, features: Sequence[str]):
        place = {f: i for i, f in enumerate(features)}
        tree, path, feature = (nodes.column(c).to_pylist() for c in ("tree", "path", "feature"))
        at = {(t, p): i for i, (t, p) in enumerate(zip(tree, path, strict=True))}
        self.trees = sorted(set(tree))
        self.roots = [at.get((t, "*"), -1) for t in self.trees]
        self.path, self.pred = path, nodes.column("pred").to_pylist()
        self.weight = nodes.column("weight").to_numpy(zero_copy_only=False)
        self.threshold = np.array([np.nan if x is None else x for x in nodes.column("threshold").to_pylist()], float)
        self.left = {i: frozenset(x) for i, x in enumerate(nodes.column("left").to_pylist()) if x is not None}
        self.feature = np.array([-1 if f is None else place[f] for f in feature], np.int64)
        self.child = np.array([[at.get((t, p + s), -1) for s in "LRM"] for t, p in zip(tree, path, strict=True)], np.int64).reshape(-1, 3)

    def leaves(self, root: int, numbers: dict[int, np.ndarray], texts: dict[int, np.ndarray], n: int) -> np.ndarray:
        """The leaf of each of ``n`` cases from ``root`` on, -1 where a missing value has no way on."""
        at, live = np.full(n, root, np.int64), np.arange(n)
        while len(live) and root >= 0:
            here = at[live]
            inner = self.feature[here] >= 0
            live, here = live[inner], here[inner]
            side = np.full(len(live), 2, np.int64)
            f = self.feature[here]
            for k in np.unique(f):
                rows = np.flatnonzero(f == k)
                if k in numbers:
                    x = numbers[k][live[rows]]
                    side[rows] = np.where(np.isnan(x), 2, np.where(x <= self.threshold[here[rows]], 0, 1))
                else:
                    for node in np.unique(here[rows]):
                        own = rows[here[rows] == node]
                        side[own] = [2 if v is None else 0 if v in self.left[node] else 1 for v in texts[k][live[own]]]
            at[live] = self.child[here, side]
            live = live[at[live] >= 0]
        return at


def _blocks(sizes: list[tuple[int, int]]) -> tuple[list[list[int]], list[int]]:
    """Blocks of trees with MODEL_NODES nodes together at most, and the trees that are larger, of (tree, nodes)."""
    blocks, now, filled = [], [], 0
    for tree, n in sorted(x for x in sizes if x[1] <= MODEL_NODES):
        if now and filled + n > MODEL_NODES:
            blocks.append(now)
            now, filled = [], 0
        now.append(tree)
        filled += n
    return [*blocks, now] if now else blocks, [t for t, n in sizes if n > MODEL_NODES]


def score_leaves(wide: DataFrame, nodes: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """tree, case_id, path, pred, weight of each case's leaf in each tree, of ``wide`` (case_id, features).

    A model goes to the workers in blocks of trees, and the cases pass each block; only a tree above MODEL_NODES is joined.
    """
    model = nodes.select("tree", "path", "feature", "threshold", "left", "pred", "weight")
    # one row for each tree
    blocks, large = _blocks([(r["tree"], r["n"]) for r in model.groupBy("tree").agg(F.count("*").alias("n")).collect()])
    parts = [_by_arrays(wide, model.filter(F.col("tree").isin(b)) if len(blocks) > 1 or large else model, numeric, categorical) for b in blocks]
    if large:
        parts.append(score.leaves(to_cells(wide, "case_id", numeric, categorical), wide.select("case_id"), model.filter(F.col("tree").isin(large))))
    if not parts:
        return wide.sparkSession.createDataFrame([], _LEAVES)
    return reduce(DataFrame.unionByName, parts)


def _columns(numeric: Sequence[str], categorical: Sequence[str], of=lambda c: F.col(f"`{c}`")) -> list[Column]:
    return [F.nullif(of(c).cast("double"), F.lit(float("nan"))).alias(f"_x{i}") for i, c in enumerate(numeric)] + [of(c).cast("string").alias(f"_c{i}") for i, c in enumerate(categorical)]


def _values(b: pa.RecordBatch, numeric: int, categorical: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Numbers and texts of the features, which stand behind a batch's first column."""
    numbers = {i: b.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(numeric)}
    return numbers, {numeric + i: np.array(b.column(1 + numeric + i).to_pylist(), dtype=object) for i in range(categorical)}


def with_leaf(rows: DataFrame, nodes: DataFrame, numeric: Sequence[str], categorical: Sequence[str], what: str = "pred") -> DataFrame:
    """``rows`` (case_id, WIDE and more) with pred or path (``what``) of its leaf in the one tree of ``nodes``, null where a missing value has no way on.

    Rows stay where they are; only for a tree above MODEL_NODES are they joined with their leaves.
    """
    if nodes.count() > MODEL_NODES:
        at = score_leaves(rows.select("case_id", f"{WIDE}.*"), nodes, numeric, categorical).select("case_id", what)
        return rows.join(at.hint("merge"), "case_id", "left")
    model = nodes.select("tree", "path", "feature", "threshold", "left", "pred", "weight")
    shared = rows.sparkSession.sparkContext.broadcast(Model(model.toArrow(), [*numeric, *categorical]))
    n_numeric, n_categorical = len(numeric), len(categorical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            at = own.leaves(own.roots[0], *_values(b, n_numeric, n_categorical), b.num_rows)
            found, place = np.unique(at, return_inverse=True)
            values = getattr(own, what)
            given = pa.array([values[i] if i >= 0 else None for i in found.tolist()], pa.string()).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([b.column(0), given], names=["row", what])

    given = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *_columns(numeric, categorical, lambda c: F.col(WIDE).getField(c)))
    scored = given.mapInArrow(run, StructType([given.schema["row"], StructField(what, StringType())]))
    return scored.select("row.*", what)


def _by_arrays(wide: DataFrame, model: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    # at most MODEL_NODES rows
    shared = wide.sparkSession.sparkContext.broadcast(Model(model.toArrow(), [*numeric, *categorical]))
    columns = _columns(numeric, categorical)
    first = len(numeric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            n = b.num_rows
            numbers, texts = _values(b, first, len(categorical))
            for tree, root in zip(own.trees, own.roots, strict=True):
                at = own.leaves(root, numbers, texts, n)
                there = np.flatnonzero(at >= 0)
                found, place = np.unique(at[there], return_inverse=True)
                name = lambda values: pa.array([values[i] for i in found.tolist()], pa.string()).take(pa.array(place))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), tree, np.int32)), b.column(0).take(pa.array(there)), name(own.path), name(own.pred), pa.array(own.weight[at[there]])], names=["tree", "case_id", "path", "pred", "weight"])

    return wide.select("case_id", *columns).mapInArrow(run, _LEAVES)
