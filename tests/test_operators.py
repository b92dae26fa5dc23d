"""Hand-made cases: thresholds, category sets, missing values, file round trips, growth and accuracy on separable data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import sample, score, splits, targets, transform
from timberline.plans.forest import Forest
from timberline.plans.grow import Growth
from timberline.sources import formats
from timberline.streaming.scoring import score_stream


def brute(values, ys, classes, leaf):
    gini = lambda part: 1 - sum((part.count(c) / len(part)) ** 2 for c in classes) if part else 0.0
    seen = sorted((v, y) for v, y in zip(values, ys, strict=True) if v is not None)
    lost = [y for v, y in zip(values, ys, strict=True) if v is None]
    best, n = None, len(ys)
    for i in range(leaf, len(seen) - leaf):
        if seen[i][0] - seen[i - 1][0] > 1e-7:
            l, r = [y for _, y in seen[:i]], [y for _, y in seen[i:]]
            gain = gini(ys) - (len(l) * gini(l) + len(r) * gini(r) + len(lost) * gini(lost)) / n
            if best is None or gain > best[0] + 1e-9:
                best = (gain, (seen[i - 1][0] + seen[i][0]) / 2, len(l), len(r))
    return best


@pytest.mark.parametrize("leaf", [1, 3])
def test_numeric_split_against_brute_force(spark, leaf):
    rng = np.random.default_rng(leaf)
    values = [None if x < 0.1 else float(round(x * 20)) for x in rng.random(50)]
    ys = [str(int(x * 3)) for x in rng.random(50)]
    df = spark.createDataFrame(list(zip(values, ys, strict=True)), "v double, y string")
    got = splits.best_num_split(df, (), "v", targets.Gini(classes=("0", "1", "2")), leaf).first()
    want = brute(values, ys, ("0", "1", "2"), leaf)
    assert (got["threshold"], got["n_left"], got["n_right"]) == want[1:] and math.isclose(got["decrease"], want[0], abs_tol=1e-12)


def test_threshold_is_the_midpoint(spark):
    df = spark.createDataFrame([(0.1, "a"), (10.1, "b"), (10.2, "b")], "v double, y string")
    assert math.isclose(splits.best_num_split(df, (), "v", targets.Gini(classes=("a", "b"))).first()["threshold"], 5.1)


def test_two_rows_do_not_split_numerically(spark):
    df = spark.createDataFrame([(0.0, "a"), (1.0, "b")], "v double, y string")
    assert splits.best_num_split(df, (), "v", targets.Gini(classes=("a", "b"))).count() == 0
    assert splits.best_num_split(df, (), "v", targets.Gini(classes=("a", "b")), strict_right=False).count() == 1


def test_greedy_and_exhaustive_agree_on_a_clean_division(spark):
    df = spark.createDataFrame([(c, "x" if c in "bd" else "z") for c in "abcdef" * 3], "v string, y string")
    goal = targets.Gini(classes=("x", "z"))
    assert splits.best_cat_split(df, (), "v", goal).first()["left"] in (["b", "d"], ["a", "c", "e", "f"])
    assert splits.greedy_cat_split(df, (), "v", goal).first()["decrease"] == pytest.approx(splits.best_cat_split(df, (), "v", goal).first()["decrease"])


def test_forest_learns_and_votes(spark):
    rows = [(i, float(i % 40), "red" if i % 3 else "blue", "yes" if (i % 40 > 20) == bool(i % 3) else "no") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, c string, label string")
    f = Forest("label", "id", ["a"], ["c"], n_trees=3, how=Growth(max_depth=4)).fit(df)
    actual = df.select(F.col("id").alias("case_id"), F.col("label").alias("actual"))
    assert score.balanced_error(f.predict(df), actual).first()[0] <= 0.05
    assert {r["feature"] for r in f.importance().collect()} == {"a", "c"}
    assert f.oob(df).count() > 150
    assert all(math.isclose(r["yes"] + r["no"], 1) for r in f.predict_proba(df).collect())


def test_gradient_boosting_lowers_the_error(spark):
    df = spark.createDataFrame([(i, float(i), float((i // 25) ** 2)) for i in range(100)], "id long, a double, y double")
    actual = df.select(F.col("id").alias("case_id"), F.col("y").alias("actual"))
    r2 = [score.regression_errors(Forest("y", "id", ["a"], n_trees=n, how=Growth(max_depth=2), boost="gbt", rate=0.5, bag="none").fit(df).predict(df), actual).first()["r2"] for n in (1, 3)]
    assert r2[0] > 0.5 and r2[1] > 0.9


def test_missing_values_vote_only_with_a_branch(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 10), "p" if i % 10 > 4 else "q") for i in range(100)], "id long, a double, label string")
    plain = Forest("label", "id", ["a"], n_trees=1, bag="none", how=Growth(max_depth=2)).fit(df)
    split = Forest("label", "id", ["a"], n_trees=1, bag="none", how=Growth(max_depth=2, split_missing=True)).fit(df)
    assert plain.predict(df).count() == 80 and split.predict(df).count() == 100


@pytest.mark.parametrize("how", [{"vet": True}, {"unseen": True}, {"random_cuts": True}])
def test_growth_with_other_measures(spark, how):
    rng = np.random.default_rng(7)
    rows = [(i, float(i % 40), float(x), "yes" if i % 40 > 20 else "no") for i, x in enumerate(rng.random(200))]
    df = spark.createDataFrame(rows, "id long, a double, noise double, label string")
    f = Forest("label", "id", ["a", "noise"], n_trees=1, how=Growth(max_depth=2, leaf=3, **how)).fit(df)
    root = f.nodes.filter("path = '*'").first()
    assert root["feature"] == "a" and root["decrease"] > 0
    if "random_cuts" not in how:
        assert 20 <= root["threshold"] <= 21
    if "unseen" in how:
        # the same by hand: the decrease of the root's cut on the cases that the bag lacks
        bag = {r["case_id"] for r in f.bags.collect()}
        out = [(a, y) for i, a, _, y in rows if i not in bag]
        gini = lambda p: 1 - sum((sum(y == c for _, y in p) / len(p)) ** 2 for c in ("yes", "no"))
        l, r = [x for x in out if x[0] <= root["threshold"]], [x for x in out if x[0] > root["threshold"]]
        assert math.isclose(root["decrease"], gini(out) - (len(l) * gini(l) + len(r) * gini(r)) / len(out), abs_tol=1e-9)


def test_targets_dealt_anew_stay_in_their_node(spark):
    from timberline.plans.grow import _Growing

    wide = spark.range(100).selectExpr("id as case_id", "cast(id as double) as a").repartition(5)
    ys = spark.range(100).selectExpr("id as case_id", "cast(id as double) as y")
    growing = _Growing(wide, ys, sample.Bag("none"), 1, targets.Sse(), targets.Sse(), ["a"], [], Growth(vet=True), 0)
    left, right = growing.top.split(0, 0, 59.5, None, False)
    got = growing.dealt_anew([left, right], 3).selectExpr("case_id", "bag[0].tree as node", "_s1 as y", "_x0 as a").collect()
    assert sorted(r["case_id"] for r in got) == sorted(r["y"] for r in got) == list(range(100))
    assert all((r["y"] < 60) == (r["node"] == left) == (r["case_id"] < 60) and r["a"] == r["case_id"] for r in got) and sum(r["y"] != r["case_id"] for r in got) > 50


def test_folds_and_bags(spark):
    cases = spark.range(100).select(F.col("id").alias("case_id"), (F.col("id") % 10 == 0).cast("string").alias("c"))
    assert sorted(r["count"] for r in sample.kfold(cases, 7, 1).groupBy("fold").count().collect()) == [14] * 7
    bag = sample.balanced_bag(cases, "c", 1, 5, 400).join(cases, "case_id").groupBy("c").agg(F.sum("mult").alias("n"))
    assert all(150 < r["n"] < 250 for r in bag.collect())
    assert 40 < sample.poisson_bag(cases, 1, 3).count() < 85


def test_transform_edges(spark):
    df = spark.createDataFrame([("NaN", "?"), (" 1.5", "x"), ("q", "NULL"), (None, "")], "n string, c string")
    assert [tuple(r) for r in df.select(transform.parse_num("n"), transform.parse_cat("c")).collect()] == [(None, None), (1.5, "x"), (None, None), (None, None)]
    assert transform.int_or_fraction("0.25", 10) == 3 and transform.int_or_fraction("0x10", 3) == 16 and transform.int_or_fraction("z", 3) == 0
    assert transform.keep_features(["a", "t", "bc"], "t", block="b|t") == ["a", "t"]


def test_file_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("1", 1.5, "u"), ("2", None, "v"), ("3", 0.0, None)], "`case` string, `N:a` double, `C:b` string")
    for by_feature in (False, True):
        path = tmp_path / f"m{by_feature}.afm"
        path.write_text("\n".join(r["line"] for r in formats.afm_lines(df, "case", by_feature).orderBy("at").collect()) + "\n")
        assert sorted(map(tuple, formats.load(spark, str(path)).select("case", "`N:a`", "`C:b`").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    path = tmp_path / "m.arff"
    path.write_text("\n".join(r["line"] for r in formats.arff_lines(df.drop("case"), "r").orderBy("part").collect()) + "\n")
    assert sorted(map(tuple, formats.load(spark, str(path)).collect()), key=str) == sorted(map(tuple, df.drop("case").collect()), key=str)
    path = tmp_path / "m.libsvm"
    path.write_text("1 1:2.5 3:4\n2\n")
    assert [tuple(r)[1:] for r in formats.load(spark, str(path)).orderBy("case_id", "feature").collect()] == [("1", "1", 2.5), ("1", "3", 4.0), ("2", None, None)]


def test_model_round_trip(spark, tmp_path):
    from timberline.catalogue import TREES, _model

    path = tmp_path / "m.sf"
    path.write_text("\n".join(r["line"] for r in formats.sf_lines(_model(spark), "status", 0.5).orderBy("tree", "at").collect()) + "\n")
    back = formats.read_sf(spark, str(path))
    assert {(r["tree"], r["path"], r["feature"], r["threshold"], tuple(r["left"] or ()), r["pred"], r["weight"]) for r in back.collect()} == {(t["tree"], t["path"], t["feature"], t["threshold"], tuple(t["left"] or ()), t["pred"], t["weight"]) for t in TREES}
    assert {r["intercept"] for r in back.collect()} == {0.5}
    assert formats.tree_arrays(TREES, 0)[0]["left_child"] == 1


def test_stream_is_scored_like_a_table(spark, tmp_path):
    from timberline.catalogue import TREES

    rows = spark.createDataFrame([(1, 100000.0, None, "1-URGENT"), (2, 200000.0, 150000.0, "x")], "id long, o_totalprice double, gap double, priority string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, TREES, [0, 1]).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["votes"] for r in spark.table("scored").collect()} == {1: ["F", "O"], 2: ["P", "O"]}


def test_welch_p(spark):
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip([3, 4, 5, 6, 8], [1, 2, 2, 4, 3], strict=True)], "g string, a double, b double")
    r = score.welch(df, "g", "a", "b").first()
    steps, n = 200_000, r["df"]
    x = np.linspace(r["t"], 60, steps)
    density = math.gamma((n + 1) / 2) / math.sqrt(n * math.pi) / math.gamma(n / 2) * (1 + x * x / n) ** (-(n + 1) / 2)
    assert abs(np.trapezoid(density, x) - r["p"]) < 1e-5
