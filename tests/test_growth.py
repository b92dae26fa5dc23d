"""Trees grown in memory, level by level, and by both are the same; forests reach the accuracy that is asked of them."""

import math
import tracemalloc
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions.rng import hash_numbers
from timberline.operators import sample, score, targets
from timberline.plans import cases, local
from timberline.plans.forest import Forest
from timberline.plans.grow import Growth, grow, row_bytes
from timberline.plans.scoring import score_leaves


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c, d = float(rng.integers(0, 30)), float(rng.normal()), "rgb"[rng.integers(0, 3)], f"k{rng.integers(0, 12)}"
        y = "yes" if (a > 12) != (c == "r") else ("no" if d < "k5" else "may")
        rows.append((i, None if rng.random() < 0.1 else a, b, None if rng.random() < 0.1 else c, d, y, a + 2 * b))
    return spark.createDataFrame(rows, "case_id long, a double, b double, c string, d string, y string, z double")


def found(nodes):
    text = lambda x: None if x is None else round(x, 7)
    return sorted((r["tree"], r["path"], r["feature"] or "", text(r["threshold"]), tuple(r["left"] or ()), r["pred"] if r["pred"] is None or len(r["pred"]) < 4 else round(float(r["pred"]), 6), r["n"], text(r["decrease"])) for r in nodes.collect())


@pytest.mark.parametrize("kind, more", [("classes", {"m_try": 2}), ("classes", {"m_try": 1, "force": True, "max_depth": 2}), ("number", {"leaf": 5, "split_missing": True, "max_depth": 2}), ("classes", {"random_cuts": True, "max_depth": 2})])
def test_growth_in_place_and_by_levels_agree(spark, more, kind):
    df = table(spark)
    goal = targets.Gini(classes=("may", "no", "yes")) if kind == "classes" else targets.Sse(shift=12.0)
    ys = df.select("case_id", F.col("y" if kind == "classes" else "z").alias("y"))
    numeric = ["b"] if more.get("random_cuts") else ["a", "b"]
    categorical = [] if more.get("random_cuts") else ["c", "d"]
    how = Growth(max_depth=more.get("max_depth", 3), seed=5, **{k: v for k, v in more.items() if k != "max_depth"})
    results = [found(grow(df, ys, sample.Bag("bootstrap", 7), 2, goal, numeric, categorical, h)) for h in (how, replace(how, local_bytes=20_000), replace(how, local_bytes=0))]
    assert len(results[0]) > 4
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("bag", ["bootstrap", "poisson", "none", sample.Bag("subsample", 3, 50), sample.Bag("balanced", 3, 80), sample.Bag("secondary", 3, 80, ("c", "y"))])
def test_bags_in_training(spark, bag):
    df = table(spark, 200)
    f = Forest("y", "case_id", ["a", "b"], ["c", "d"], n_trees=2, how=Growth(max_depth=2), bag=bag).fit(df)
    roots = {r["tree"]: r["n"] for r in f.nodes.filter("path = '*'").collect()}
    drawn = {r["tree"]: r["n"] for r in f.bags.groupBy("tree").agg(F.sum("mult").alias("n")).collect()}
    assert roots == drawn and set(drawn) == {0, 1}


def test_array_scoring_equals_joins(spark):
    from timberline.operators.transform import to_cells

    df = table(spark, 150)
    for split in (False, True):
        f = Forest("y", "case_id", ["a", "b"], ["c", "d"], n_trees=2, how=Growth(max_depth=3, split_missing=split)).fit(df)
        wide = f._wide(df)
        text = lambda x: sorted(map(tuple, x.collect()))
        assert text(score_leaves(wide, f.nodes, f.numeric, f.categorical)) == text(score.leaves(to_cells(df, "case_id", f.numeric, f.categorical), wide, f.nodes))


def flowers(n=150):
    """Three kinds of four measures each, two of them overlapping."""
    rng = np.random.default_rng(11)
    centres, spread = ((5.0, 3.4, 1.5, 0.2), (5.9, 2.8, 4.3, 1.3), (6.6, 3.0, 5.5, 2.0)), (0.4, 0.3, 0.35, 0.2)
    return [(i, *(float(rng.normal(m, s)) for m, s in zip(centres[i % 3], spread, strict=True)), f"k{i % 3}") for i in range(n)]


FLOWERS = "id long, sl double, sw double, pl double, pw double, kind string"


@pytest.mark.parametrize("missing, bound, trees", [(0.0, 0.05, 10), (0.05, 0.10, 20)])
def test_balanced_error_of_three_classes(spark, missing, bound, trees):
    rng = np.random.default_rng(5)
    rows = [(r[0], *(None if rng.random() < missing else x for x in r[1:5]), r[5]) for r in flowers()]
    df = spark.createDataFrame(rows, FLOWERS)
    f = Forest("kind", "id", ["sl", "sw", "pl", "pw"], n_trees=trees, how=Growth(m_try=3)).fit(df)
    assert score.balanced_error(f.predict(df), df.select(F.col("id").alias("case_id"), F.col("kind").alias("actual"))).first()[0] <= bound


def test_two_classes_boosted(spark):
    df = spark.createDataFrame(flowers(), FLOWERS).withColumn("y", F.when(F.col("kind") == "k0", "1").otherwise("0"))
    f = Forest("y", "id", ["sl", "sw", "pl", "pw"], n_trees=20, how=Growth(max_depth=2, leaf=3), boost="gbt", rate=0.3, bag="none").fit(df)
    assert score.regression_errors(f.predict(df), df.select(F.col("id").alias("case_id"), F.col("y").cast("double").alias("actual"))).first()["mse"] <= 0.05


def test_regression_and_importance(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *(float(x) for x in rng.random(6))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, f double").withColumn("y", 10 * F.col("a") + 5 * F.sin(6 * F.col("b")) + F.col("c"))
    f = Forest("y", "id", list("abcdef"), n_trees=20, how=Growth(m_try=4)).fit(df)
    assert score.regression_errors(f.predict(df), df.select(F.col("id").alias("case_id"), F.col("y").alias("actual"))).first()["r2"] >= 0.95
    order = [r["feature"] for r in f.importance().orderBy(F.desc("per_tree")).collect()]
    assert set(order[:2]) == {"a", "b"}


def test_defaults(spark):
    f = Forest("y", "case_id", ["a", "b"], ["c", "d", "e"])
    assert f._growth(False, 0).m_try == 3 and f._growth(False, 0).leaf == 1 and f._growth(True, 0).leaf == 4
    assert replace(f, boost="gbt")._growth(True, 90).leaf == 30


def test_share_of_different_cases_in_large_bags():
    for n in (1_000_000, 5_000_000):
        assert math.isclose(len(np.unique(hash_numbers(np.arange(n), 0, 3) % n)) / n, 1 - math.exp(-1), abs_tol=0.002)


def test_deviations_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (7, 1500):
        y, m, v = rng.integers(0, 40, n).astype(float), rng.integers(1, 4, n).astype(float), rng.random(n)
        got = targets.deviations(y, m, v)
        for i in (0, n // 2, n - 1):
            mean = (m[: i + 1] * y[: i + 1]).sum() / m[: i + 1].sum()
            assert math.isclose(got[i], (v[: i + 1] * np.abs(y[: i + 1] - mean)).sum(), abs_tol=1e-8)


def test_targets_of_cases(spark):
    from timberline.operators import splits

    df = table(spark, 120).na.drop()
    wide = df.select("case_id", "a", "b")
    grown = lambda y, goal, **how: {r["path"]: r for r in grow(wide, df.select("case_id", F.expr(y).alias("y")), sample.Bag("none"), 1, goal, ["a", "b"], [], Growth(max_depth=1, leaf=5, **how)).collect()}
    root = grown("z", targets.Absolute())["*"]
    best = max((splits.absolute_split(df, (), c, "z", 5).withColumn("f", F.lit(c)).first() for c in "ab"), key=lambda r: r["decrease"])
    assert (root["feature"], root["threshold"]) == (best["f"], best["threshold"]) and math.isclose(root["decrease"], best["decrease"], abs_tol=1e-9)
    rows = [(r["a"], r["b"]) for r in df.collect()]
    n = len(rows)
    spans = lambda part: math.prod(s for s in (max(x) - min(x) for x in zip(*part, strict=True)) if s > 0)
    density = lambda part: (len(part) / n) ** 2 / spans(part)
    root = grown("1", targets.Density())
    if (f := root["*"]["feature"]) is not None:
        k = "ab".index(f)
        l, r = [x for x in rows if x[k] <= root["*"]["threshold"]], [x for x in rows if x[k] > root["*"]["threshold"]]
        assert math.isclose(root["*"]["decrease"], density(rows) - (len(l) * density(l) + len(r) * density(r)) / n, abs_tol=1e-9)
    assert math.isclose(root["*"]["impurity"], density(rows), rel_tol=1e-9)
    goal = targets.Transduction(classes=("?", "no", "yes"), alpha=0.5)
    root = grown("if(case_id % 3 = 0, '?', if(y = 'may', 'no', y))", goal)["*"]
    own = [("?" if r["case_id"] % 3 == 0 else "no" if r["y"] == "may" else r["y"], r["a"], r["b"]) for r in df.collect()]
    trans = lambda part: 1 - sum((sum(x[0] == c for x in part) / len(part)) ** 2 for c in ("?", "no", "yes")) + 0.5 * spans([x[1:] for x in part]) / len(part) ** 2
    assert math.isclose(root["impurity"], trans(own), rel_tol=1e-9) and root["pred"] in ("1", "2")


def test_boosted_numbers(spark):
    df = spark.createDataFrame([(i, float(i), float((i // 20) ** 2)) for i in range(100)], "id long, a double, y double")
    f = Forest("y", "id", ["a"], n_trees=3, how=Growth(max_depth=2), boost="ada", bag="none").fit(df)
    assert {r["weight"] > 0 for r in f.nodes.collect()} == {True}
    assert score.regression_errors(f.predict(df), df.select(F.col("id").alias("case_id"), F.col("y").alias("actual"))).first()["r2"] > 0.8


def packed_parts(x, klass, w, classes, size):
    """Parts of one node, in the order in which its task gets them."""
    out = []
    for lo in range(0, len(w), size):
        own = slice(lo, lo + size)
        stats = np.zeros((len(w[own]), classes + 1))
        stats[:, 0] = stats[np.arange(len(stats)), klass[own] + 1] = 1
        b = cases.Batch([v[own] for v in x], {}, stats, np.arange(len(stats)), np.zeros(len(stats), np.int64), w[own])
        out += [(block, lo, part) for block, part in enumerate(cases.pack(cases.packed(b), b.row, b.w))]
    return [(block, part) for block, _, part in sorted(out)]


def grown(parts, names, classes):
    grower, rows = local.grower(*cases.unpack(parts, names, len(names)), targets.Gini(classes=tuple(map(str, range(classes)))), Growth(max_depth=3, m_try=8), set(), 1.0)
    return grower.grow(0, "*", rows)


def test_a_node_takes_no_more_memory_than_is_reckoned(monkeypatch):
    """With different values in every case, in double precision."""
    monkeypatch.setattr(local, "CELLS", 1 << 10)
    rng, n, classes = np.random.default_rng(4), 60_000, 10
    names = [f"x{i}" for i in range(20)]
    parts = packed_parts([rng.random(n) for _ in names], rng.integers(0, classes, n), rng.integers(1, 4, n).astype(float), classes, 5_000)
    # decoded as they arrive
    stream = (parts.pop(0) for _ in range(len(parts)))
    tracemalloc.start()
    try:
        assert len(grown(stream, names, classes)) > 1
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak <= n * row_bytes(len(names), classes + 1)


def test_packed_values_are_exact(monkeypatch):
    """Values that single precision holds, and in some parts values that it doesn't hold; few and many different ones; missing ones."""
    rng, n = np.random.default_rng(6), 1_300
    single = rng.random(n).astype(np.float32).astype(float)
    mixed = np.where(np.arange(n) < 500, single, rng.random(n))
    near = np.where(np.arange(n) % 2, 0.1, float(np.float32(0.1)))
    large = np.where(np.arange(n) < 700, 1e300, single)
    gaps = np.where(rng.random(n) < 0.2, np.nan, single)
    x = [single, mixed, near, large, gaps, np.full(n, np.nan), rng.integers(0, 9, n).astype(float), rng.integers(0, 999, n) / 7, *[rng.random(n) for _ in range(9)]]
    klass, w, names = rng.integers(0, 3, n), rng.integers(1, 400, n).astype(float), [f"x{i}" for i in range(17)]
    parts = packed_parts(x, klass, w, 3, 400)
    assert len(parts) == 4 * 3
    columns, stats, mult = cases.unpack(parts, names, 17)
    for c, want in zip(columns, x, strict=True):
        assert np.array_equal(c.codes < 0, np.isnan(want)) and np.array_equal(c.numbers(c.codes[c.codes >= 0]), want[~np.isnan(want)])
    assert columns[0].values.dtype == np.float32 and columns[1].values.dtype == np.float64
    assert np.array_equal(mult, w) and np.array_equal(np.argmax(stats[:, 1:], axis=1), klass)
    whole = grown(parts, names, 3)
    monkeypatch.setattr(local, "CELLS", 7)
    assert grown(parts, names, 3) == whole and len(whole) > 5
