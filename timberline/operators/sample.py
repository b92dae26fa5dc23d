"""Bags, out-of-bag sets, balanced bags, folds. Draws are hashes of draw number and tree, so every run deals alike."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.rng import RANGE, hash_numbers, hash_sql, hashed


def _trees(n_trees: int) -> Column:
    """A column that repeats a row for each tree."""
    return F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))


def _draws(spark: SparkSession, draws: int, n_trees: int) -> DataFrame:
    return spark.range(draws).withColumn("tree", _trees(n_trees))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """An inner join on ``names`` for which nulls are equal."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in names})
    test = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names])
    return left.join(other, test).drop(*[f"_r_{c}" for c in names])


def placed(cases: DataFrame) -> DataFrame:
    """case_id, rank in the order of ids; ids that are 0, 1, ... are their own ranks."""
    low, high, n, different = cases.agg(F.min("case_id"), F.max("case_id"), F.count("*"), F.count_distinct("case_id")).first()
    if low == 0 and high == n - 1 and n == different:
        return cases.select("case_id", F.col("case_id").cast("long").alias("rank"))
    return ranked(cases.select("case_id"), ["case_id"])


def bootstrap(cases: DataFrame, n_trees: int, seed: int, draws: int | None = None) -> DataFrame:
    """tree, case_id, mult: draws with replacement; ``draws`` defaults to the number of cases."""
    n = cases.count()
    drawn = _draws(cases.sparkSession, n if draws is None else draws, n_trees)
    drawn = drawn.withColumn("rank", hashed("id", "tree", seed) % n).groupBy("tree", "rank").agg(F.count("*").alias("mult"))
    return drawn.join(placed(cases), "rank").select("tree", "case_id", "mult")


#: Shares of a Poisson(1) number up to 0, 1, ...: a case whose hash lies above k of them is in the bag k times.
POISSON = tuple(float(x) for x in np.cumsum([0.36787944117144233 / math.factorial(k) for k in range(8)]))


def poisson_bag(cases: DataFrame, n_trees: int, seed: int) -> DataFrame:
    """A bootstrap without ranks or joins, for very large tables: each case is in each bag a Poisson(1) number of times."""
    u = hashed("case_id", "tree", seed) / float(RANGE)
    cut = reduce(Column.__add__, [(u >= x).cast("int") for x in POISSON])
    rows = cases.select("case_id").withColumn("tree", _trees(n_trees))
    return rows.withColumn("mult", cut.cast("long")).filter("mult > 0").select("tree", "case_id", "mult")


def whole(cases: DataFrame, n_trees: int) -> DataFrame:
    """tree, case_id, mult = 1 of all cases: no bag at all."""
    return cases.select("case_id").withColumn("tree", _trees(n_trees)).select("tree", "case_id", F.lit(1).cast("long").alias("mult"))


def subsample(cases: DataFrame, n_trees: int, seed: int, draws: int) -> DataFrame:
    """tree, case_id, mult = 1: the first ``draws`` cases in hashed order, for each tree."""
    rows = cases.select("case_id").withColumn("tree", _trees(n_trees))
    first = ranked(rows, [hashed("case_id", "tree", seed), "case_id"], ["tree"]).filter(F.col("rank") < draws)
    return first.select("tree", "case_id", F.lit(1).cast("long").alias("mult"))


def out_of_bag(cases: DataFrame, bag: DataFrame, n_trees: int) -> DataFrame:
    """tree, case_id of the cases that a tree's bag doesn't have."""
    rows = cases.select("case_id").withColumn("tree", _trees(n_trees))
    return rows.join(bag.select("tree", "case_id"), ["tree", "case_id"], "left_anti").select("tree", "case_id")


def _class_codes(sizes: DataFrame, cls: str, within: str | None = None) -> DataFrame:
    """``sizes`` (a row for each class) with code: 0, 1, ... in order of the class."""
    part = Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))
    return sizes.withColumn("code", F.row_number().over(part.orderBy(cls)).cast("long") - 1)


def balanced_bag(cases: DataFrame, cls: str, n_trees: int, seed: int, draws: int) -> DataFrame:
    """tree, case_id, mult: a class is drawn with equal chances, then one of its cases. Empty classes don't exist."""
    known = ranked(cases.filter(F.col(cls).isNotNull()).select("case_id", cls), ["case_id"], [cls])
    sizes = _class_codes(known.groupBy(cls).agg(F.count("*").alias("size")), cls)
    k = sizes.count()
    drawn = _draws(cases.sparkSession, draws, n_trees).withColumn("code", hashed("id", "tree", seed) % k)
    drawn = drawn.join(sizes, "code").withColumn("rank", hashed("id", "tree", seed + 1) % F.col("size"))
    return drawn.groupBy("tree", cls, "rank").agg(F.count("*").alias("mult")).join(known, [cls, "rank"]).select("tree", "case_id", "mult")


def secondary_balanced_bag(cases: DataFrame, by: str, cls: str, n_trees: int, seed: int, draws: int) -> DataFrame:
    """tree, case_id, mult: a class of ``by`` by its frequency, then a class of ``cls`` in it evenly, then a case."""
    known = ranked(cases.filter(F.col(by).isNotNull() & F.col(cls).isNotNull()).select("case_id", by, cls), ["case_id"], [by, cls])
    cells = _class_codes(known.groupBy(by, cls).agg(F.count("*").alias("size")), cls, by)
    groups = cells.groupBy(by).agg(F.count("*").alias("k"))
    # a drawn place in the order of ``by`` has a class of it by frequency
    places = ranked(known.select(by), [by], name="u")
    total = known.count()
    drawn = _draws(cases.sparkSession, draws, n_trees).withColumn("u", hashed("id", "tree", seed) % total).join(places, "u").join(groups, by)
    drawn = drawn.withColumn("code", hashed("id", "tree", seed + 1) % F.col("k")).join(cells, [by, "code"]).withColumn("rank", hashed("id", "tree", seed + 2) % F.col("size"))
    return drawn.groupBy("tree", by, cls, "rank").agg(F.count("*").alias("mult")).join(known, [by, cls, "rank"]).select("tree", "case_id", "mult")


def kfold(cases: DataFrame, folds: int, seed: int, within: str | None = None) -> DataFrame:
    """case_id, fold: equal folds in hashed order, of each class of ``within`` if given; cases that don't fill a fold are left out."""
    names = [within] if within else []
    placed = ranked(cases.select("case_id", *names), [hashed("case_id", "0", seed), "case_id"], names)
    size = F.floor(F.count("*") / folds).alias("_size")
    sized = _same(placed, placed.groupBy(within).agg(size), names) if within else placed.join(placed.agg(size))
    full = sized.filter((F.col("_size") > 0) & (F.col("rank") < F.col("_size") * folds))
    return full.select("case_id", F.floor(F.col("rank") / F.col("_size")).cast("int").alias("fold"))


def fold_parts(df: DataFrame, case_id: str, folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` to train on and to test with for one of ``folds`` (case_id, fold)."""
    dealt = df.join(folds.withColumnRenamed("case_id", "_fold_of"), F.col(case_id) == F.col("_fold_of")).drop("_fold_of")
    return dealt.filter(F.col("fold") != fold).drop("fold"), dealt.filter(F.col("fold") == fold).drop("fold")


@dataclass(frozen=True)
class Bag:
    """How the cases of each tree are drawn; any object with ``frame`` can take its place.

    kind: bootstrap, poisson, none, subsample, balanced (evenly over the classes of ``by[0]``) or secondary (over those of ``by[0]`` by
    their frequency, in each evenly over those of ``by[1]``). ``draws`` defaults to the number of cases.
    """

    kind: str = "bootstrap"
    seed: int = 1
    draws: int | None = None
    by: tuple[str, ...] = ()

    def frame(self, cases: DataFrame, n_trees: int, first: int = 0) -> DataFrame:
        """tree, case_id, mult of ``n_trees`` trees from number ``first`` on; ``cases`` has case_id and the columns ``by``."""
        seed, draws = self.seed + first, self.draws
        if self.kind in ("subsample", "balanced", "secondary") and draws is None:
            draws = cases.count()
        bag = {
            "bootstrap": lambda: bootstrap(cases, n_trees, seed, draws), "poisson": lambda: poisson_bag(cases, n_trees, seed), "none": lambda: whole(cases, n_trees),
            "subsample": lambda: subsample(cases, n_trees, seed, draws), "balanced": lambda: balanced_bag(cases, self.by[0], n_trees, seed, draws),
            "secondary": lambda: secondary_balanced_bag(cases, self.by[0], self.by[1], n_trees, seed, draws),
        }[self.kind]()
        return bag.withColumn("tree", (F.col("tree") + first).cast("int"))

    def per_case(self, cases: DataFrame, n_trees: int, first: int = 0) -> DataFrame:
        """The same with one row for each case: case_id, bag (tree, mult)."""
        own = self.of_case(n_trees, first)
        if own is not None:
            return cases.select("case_id", own.alias("bag"))
        if self.kind == "bootstrap":
            n = cases.count()
            drawn = _bootstrap_bags(cases.sparkSession, n, n if self.draws is None else self.draws, n_trees, self.seed + first, first)
            return drawn.join(placed(cases), "rank").select("case_id", "bag")
        return _grouped(self.frame(cases, n_trees, first))

    def of_case(self, n_trees: int, first: int = 0) -> Column | None:
        """``bag`` as an expression of case_id alone, for the kinds that draw each case for itself; None for the others."""
        seed = self.seed + first
        if self.kind == "none":
            return F.expr(f"transform(sequence(0, {n_trees - 1}), t -> named_struct('tree', cast(t + {first} as int), 'mult', 1L))")
        if self.kind == "poisson":
            u = f"{hash_sql('case_id', 't', seed)} / {float(RANGE)!r}D"
            often = f"aggregate(array({', '.join(f'{x!r}D' for x in POISSON)}), 0L, (n, x) -> n + if(u >= x, 1L, 0L))"
            made = f"transform(transform(sequence(0, {n_trees - 1}), t -> named_struct('t', t, 'u', {u})), d -> named_struct('tree', cast(d.t + {first} as int), 'mult', {often.replace('u >=', 'd.u >=')}))"
            return F.expr(f"filter({made}, d -> d.mult > 0)")
        return None


#: Places of a bootstrap whose draws one task counts.
_PLACES = 1 << 15


def _bootstrap_bags(spark: SparkSession, n: int, draws: int, n_trees: int, seed: int, first: int) -> DataFrame:
    """rank, bag of the places that any tree draws. Draws travel packed, by ranges of places."""
    width = np.uint32 if n_trees * _PLACES < 1 << 32 else np.uint64

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            rank = np.concatenate([hash_numbers(ids, t, seed) % n for t in range(n_trees)])
            tree = np.repeat(np.arange(n_trees), len(ids))
            order = np.argsort(rank // _PLACES, kind="stable")
            part, cell = (rank // _PLACES)[order], ((rank % _PLACES) * n_trees + tree)[order].astype(width)
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(part[heads]), pa.array([x.tobytes() for x in np.split(cell, heads[1:])], pa.binary())], names=["part", "cells"])

    def count(t: pa.Table) -> pa.Table:
        cells = np.frombuffer(b"".join(t.column("cells").to_pylist()), width)
        cell, mult = np.unique(cells, return_counts=True)
        place, tree = cell.astype(np.int64) // n_trees, cell.astype(np.int64) % n_trees
        heads = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        drawn = pa.StructArray.from_arrays([pa.array((tree + first).astype(np.int32)), pa.array(mult.astype(np.int64))], names=["tree", "mult"])
        bags = pa.ListArray.from_arrays(pa.array(np.append(heads, len(place)).astype(np.int32)), drawn)
        return pa.table([pa.array(place[heads] + t.column("part")[0].as_py() * _PLACES), bags], names=["rank", "bag"])

    return spark.range(draws).mapInArrow(deal, "part long, cells binary").groupBy("part").applyInArrow(count, "rank long, bag array<struct<tree:int,mult:long>>")


def _grouped(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("case_id").agg(F.collect_list(F.struct(F.col("tree").cast("int").alias("tree"), F.col("mult").cast("long").alias("mult"))).alias("bag"))


def per_case(bag: Bag, cases: DataFrame, n_trees: int, first: int = 0) -> DataFrame:
    """case_id, bag of any object with ``frame``."""
    if hasattr(bag, "per_case"):
        return bag.per_case(cases, n_trees, first)
    return _grouped(bag.frame(cases, n_trees, first))
