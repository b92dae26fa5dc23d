"""Operators whose groups may be larger than a task: the same as brute force however the ranges fall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from timberline.functions.dominance import dominance, dominated
from timberline.operators import score, splits, targets
from timberline.plans.forest import Forest
from timberline.plans.grow import Growth
from timberline.session import by_leaf


@pytest.fixture
def many_ranges(spark):
    """Seven ranges, none of them put together again."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def test_dominance_of_arrays():
    rng = np.random.default_rng(8)
    for n, q in ((0, 3), (1, 4), (2, 5), (300, 200)):
        x, y, w = rng.integers(0, 20, n).astype(float), rng.integers(0, 9, n).astype(float), rng.random((n, 2))
        qx, qy = rng.integers(-1, 21, q).astype(float), rng.random(q) * 11 - 1
        want = [w[(x <= a) & (y <= b)].sum(axis=0) for a, b in zip(qx, qy, strict=True)]
        assert np.allclose(dominance(x, y, w, qx, qy), want)


def test_dominance_over_ranges(many_ranges):
    rng = np.random.default_rng(9)
    points = [("ab"[i % 2] if i % 5 else None, float(rng.integers(0, 6)), float(rng.integers(0, 30)), float(rng.integers(1, 4))) for i in range(600)]
    asked = [("abc"[i % 3] if i % 4 else None, float(rng.integers(-1, 7)), float(rng.random() * 32 - 1), i) for i in range(90)]
    got = dominated(many_ranges.createDataFrame(points, "k string, x double, y double, w double"), many_ranges.createDataFrame(asked, "k string, x double, y double, i int"), ["k"], ["w"])
    want = {i: sum(p[3] for p in points if p[0] == k and p[1] <= x and p[2] <= y) for k, x, y, i in asked}
    assert {r["i"]: r["_d_w"] for r in got.collect()} == want


def deviation(y):
    return float(np.abs(np.array(y) - np.mean(y)).mean()) if len(y) else 0.0


def brute(rows, impurity, leaf):
    """(threshold, n_left, decrease) of the best cut; rows: (x or None, rest)."""
    whole, lost = impurity(rows), [r for r in rows if r[0] is None]
    values, best = sorted({r[0] for r in rows if r[0] is not None}), (1e-7, None)
    for a, b in zip(values, values[1:], strict=False):
        l, r = [x for x in rows if x[0] is not None and x[0] <= a], [x for x in rows if x[0] is not None and x[0] > a]
        if len(l) >= leaf and len(r) > leaf:
            gain = whole - (len(l) * impurity(l) + len(r) * impurity(r) + (len(lost) * impurity(lost) if lost else 0)) / len(rows)
            if round(gain, 9) > round(best[0], 9):
                best = (gain, ((a + b) / 2, len(l)))
    return best[1], best[0]


def test_absolute_split_of_groups(many_ranges):
    rng = np.random.default_rng(10)
    rows = [(g, None if rng.random() < 0.1 else float(rng.integers(0, 15)), float(rng.integers(0, 50))) for g in ("a", "b", None) for _ in range(150)]
    df = many_ranges.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in splits.absolute_split(df, ["g"], "x", "y", 3).collect()}
    for g in ("a", "b", None):
        at, gain = brute([(x, y) for k, x, y in rows if k == g], lambda part: deviation([p[1] for p in part]), 3)
        assert (got[g]["threshold"], got[g]["n_left"]) == at and math.isclose(got[g]["decrease"], gain, abs_tol=1e-9)


@pytest.mark.parametrize("goal", [targets.Density(), targets.Transduction(classes=("n", "y"), alpha=5.0)])
def test_region_split(many_ranges, goal):
    rng = np.random.default_rng(12)
    rows = [(g, None if rng.random() < 0.1 else float(rng.integers(0, 12)), float(rng.integers(0, 9)) if rng.random() < 0.9 else None, "abc"[int(rng.integers(0, 3))] if rng.random() < 0.9 else None, "ny"[int(rng.random() < 0.4)]) for g in (1, 2) for _ in range(80)]
    df = many_ranges.createDataFrame(rows, "g int, x double, z double, c string, y string")
    total = len(rows)

    def impurity(part):
        spans = [max(v) - min(v) for i in (0, 1) if (v := [p[i] for p in part if p[i] is not None])] + [len({p[2] for p in part if p[2] is not None})]
        volume, n = math.prod(s for s in spans if s > 0), len(part)
        if isinstance(goal, targets.Density):
            return (n / total) ** 2 / volume
        return 1 - sum((sum(p[3] == c for p in part) / n) ** 2 for c in "ny") + 5.0 * volume / n**2

    got = {r["g"]: r for r in splits.region_split(df, ["g"], "x", ["x", "z"], ["c"], goal, total, 4).collect()}
    for g in (1, 2):
        at, gain = brute([r[1:] for r in rows if r[0] == g], impurity, 4)
        if at is None:
            assert g not in got
        else:
            assert (got[g]["threshold"], got[g]["n_left"]) == at and math.isclose(got[g]["decrease"], gain, abs_tol=1e-9)


def test_prefix_sums_by_windows_and_by_ranges_agree(many_ranges):
    rng = np.random.default_rng(13)
    rows = [(int(rng.integers(0, 3)), None if rng.random() < 0.1 else float(rng.integers(0, 40)), "ab"[int(rng.integers(0, 2))]) for _ in range(500)]
    df = many_ranges.createDataFrame(rows, "g int, x double, y string")
    goal = targets.Gini(classes=("a", "b"))
    hist = splits.histogram(df, ["g"], "x", goal)
    text = lambda scan: sorted((r["g"], r["threshold"], r["n_left"], r["n_right"], round(r["decrease"], 12)) for r in splits.num_cuts(hist, ["g"], goal, 2, scan=scan).collect())
    assert text(True) == text(False) and len(text(True)) > 90


def test_tables_by_case_are_not_broadcast(spark):
    """However small the files are, rows for each case stay with the executors; the few rows by leaf go to all of them."""
    actual = spark.createDataFrame([(i, float(i % 5)) for i in range(40)], "case_id long, actual double")
    pred = actual.select("case_id", (actual.actual + 1).alias("pred"))
    for errors in (score.regression_errors(pred, actual), score.balanced_error(pred, actual), score.accuracy(pred, actual)):
        assert "BroadcastHashJoin" not in errors._jdf.queryExecution().executedPlan().toString()
    got = score.regression_errors(pred.filter("case_id > 0"), actual).first()
    assert math.isclose(got["mse"], 39 / 40)


def test_rows_by_leaf_go_to_every_worker(spark):
    at = spark.createDataFrame([(i, "*L" if i % 9 else "*R") for i in range(40)], "case_id long, path string")
    value = spark.createDataFrame([("*L", 1.0), ("*R", 2.0)], "path string, value double")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = at.join(by_leaf(value), "path")
        assert "BroadcastHashJoin" in both._jdf.queryExecution().executedPlan().toString()
        assert both.groupBy().sum("value").first()[0] == 45.0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_branch_counts_meet_the_model_once_for_each_leaf(spark):
    """The cases of a leaf aren't brought together, and no case is multiplied by the nodes on its way."""
    nodes = spark.createDataFrame([(0, "*", "a"), (0, "*L", "b"), (0, "*LL", "a"), (0, "*R", None), (0, "*LR", None), (0, "*LLL", None), (0, "*LLR", None)], "tree int, path string, feature string")
    at = spark.createDataFrame([(0, i, ("*R", "*LR", "*LLL")[i % 3]) for i in range(30)], "tree int, case_id long, path string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        counts = score.branch_counts(at, nodes)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "sequence(1" not in plan
        got = {(r["case_id"], r["feature"]): r["n"] for r in counts.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    want = {}
    for i in range(30):
        want |= [{(i, "a"): 1}, {(i, "a"): 1, (i, "b"): 1}, {(i, "a"): 2, (i, "b"): 1}][i % 3]
    assert got == want


@pytest.mark.parametrize("number", [True, False])
def test_rounds_of_gradient_boosting_join_no_cases(spark, monkeypatch, number):
    """Cases carry their features: no plan of the growth joins by case, and rows that share an id stay as many."""
    rows = [(i // 2, float(i % 10) if i % 7 else None, float(i % 10 > 4) + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, z double").withColumn("z", F.col("z") if number else F.when(F.col("z") > 1, "y").otherwise("n"))
    joins, checkpoint = [], DataFrame.checkpoint

    def watched(self, *args, **more):
        plan = self._jdf.queryExecution().optimizedPlan().toString()
        joins.extend(line for line in plan.splitlines() if "Join" in line and "case_id" in line)
        return checkpoint(self, *args, **more)

    monkeypatch.setattr(DataFrame, "checkpoint", watched)
    fitted = Forest("z", "id", ["a"], n_trees=2, how=Growth(max_depth=1, split_missing=True), boost="gbt", bag="none").fit(df)
    assert not joins
    assert {r["n"] for r in fitted.nodes.filter("path = '*'").collect()} == {200}
    # the first tree's leaves by hand
    y = np.array([float(z) if number else float(z == "y") for z in (r["z"] for r in df.orderBy("id", "a").collect())])
    a = np.array([np.nan if r["a"] is None else r["a"] for r in df.orderBy("id", "a").collect()])
    first = {r["path"]: float(r["pred"]) for r in fitted.nodes.filter("tree = 0 and feature is null").collect()}
    cut_at = fitted.nodes.filter("tree = 0 and path = '*'").first()["threshold"]
    for path, own in (("*L", a <= cut_at), ("*R", a > cut_at), ("*M", np.isnan(a))):
        step = (y[own] - y.mean()).mean() if number else (y[own] - y.mean()).sum() / (own.sum() * y.mean() * (1 - y.mean()))
        assert math.isclose(first[path], step, rel_tol=1e-9, abs_tol=1e-12)


def test_small_nodes_that_most_batches_have_no_case_of(spark):
    """A split node's small child is finished though only the last batches hold its cases."""
    df = spark.range(200).select(F.col("id"), F.when(F.col("id") < 195, 1.0).otherwise(0.0).alias("a"), F.when(F.col("id") < 195, F.col("id") % 3).otherwise(50).cast("double").alias("z"))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        how = Growth(max_depth=2, local_bytes=20 * 400)
        nodes = Forest("z", "id", ["a"], n_trees=1, how=how, boost="gbt", bag="none").fit(df).nodes
        assert {(r["path"], r["n"]) for r in nodes.collect()} == {("*", 200), ("*L", 5), ("*R", 195)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
