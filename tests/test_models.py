"""Votes, blocks of trees, and models that are stored."""

import math
import statistics

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from timberline.operators import votes
from timberline.plans import scoring
from timberline.plans.forest import Forest
from timberline.plans.grow import Growth
from timberline.plans.ml import DecisionForest
from test_growth import table


class Median(votes.Numbers):
    """The middle vote; of an even number the lower one."""

    def finish(self, parts):
        return F.get(F.array_sort(F.transform(parts["votes"], lambda v: v["pred"].cast("double"))), ((F.size(parts["votes"]) - 1) / 2).cast("int"))


ROWS = [(c, str((c * 7 + t * t) % 11), 1.0 + t % 2) for c in range(30) for t in range(5)] + [(99, None, 1.0), (98, "x", 1.0)]


def test_votes_of_ones_own(spark):
    v = spark.createDataFrame(ROWS, "case_id long, pred string, weight double")
    got = {r["case_id"]: r["pred"] for r in votes.tally(v, Median()).collect()}
    assert got == {c: statistics.median_low([float(p) for k, p, _ in ROWS if k == c]) for c in range(30)}
    mode = {r["case_id"]: r["pred"] for r in votes.tally(v, votes.Mode()).collect()}
    for c in range(30):
        sums = {}
        for k, p, w in ROWS:
            if k == c:
                sums[p] = sums.get(p, 0) + w
        assert mode[c] == min(p for p, w in sums.items() if w == max(sums.values()))
    assert mode[98] == "x" and 99 not in mode


def test_votes_of_a_stream(spark, tmp_path):
    v = spark.createDataFrame([r for r in ROWS if r[1] and r[1] != "x"], "case_id long, pred string, weight double")
    v.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = votes.tally(stream, votes.Mean()).writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    text = lambda df: sorted((r["case_id"], round(r["pred"], 9)) for r in df.collect())
    assert text(spark.table("means")) == text(votes.tally(v, votes.Mean()))


def test_blocks_of_trees_score_alike(spark, monkeypatch):
    df = table(spark, 120)
    f = Forest("y", "case_id", ["a", "b"], ["c", "d"], n_trees=4, how=Growth(max_depth=3, split_missing=True)).fit(df)
    text = lambda: sorted(map(tuple, f.votes(df).collect()))
    whole, sizes = text(), [r["count"] for r in f.nodes.groupBy("tree").count().collect()]
    for most in (max(sizes) + 1, min(sizes)):  # blocks; and trees that are too large for any
        monkeypatch.setattr(scoring, "MODEL_NODES", most)
        assert text() == whole


def test_models_in_a_pipeline_are_stored(spark, tmp_path):
    df = table(spark, 120)
    for kind, target in (("classes", "y"), ("numbers", "z"), ("gbt", "z")):
        stage = DecisionForest(target=target, caseId="case_id", numeric=["a", "b"], categorical=["c", "d"], nTrees=3, growth=Growth(max_depth=3), boost="gbt" if kind == "gbt" else "", bag="none" if kind == "gbt" else "bootstrap")
        stage.save(str(tmp_path / f"{kind}-estimator"))
        assert DecisionForest.load(str(tmp_path / f"{kind}-estimator")).extractParamMap().keys() == stage.extractParamMap().keys()
        fitted = Pipeline(stages=[stage]).fit(df)
        fitted.save(str(tmp_path / kind))
        text = lambda model: sorted((r["case_id"], str(r["prediction"])) for r in model.transform(df).collect())
        first = text(fitted)
        assert text(PipelineModel.load(str(tmp_path / kind))) == first and len(first) == 120 and len({p for _, p in first}) > 1


def test_adaboost_joins_nothing(spark, monkeypatch):
    """The cases carry their features through all rounds; one without a leaf counts as wrong."""
    df = spark.createDataFrame([(i, None if i % 10 == 0 else float(i), "ab"[i % 2], "x" if i < 60 else "y") for i in range(100)], "id long, v double, c string, y string").cache()
    asked = []
    monkeypatch.setattr(type(df), "join", lambda *a, **k: asked.append(a) or pytest.fail("a join"))
    f = Forest("y", "id", ["v"], ["c"], n_trees=2, how=Growth(max_depth=1), boost="ada", bag="none").fit(df)
    root = f.nodes.filter("path = '*' and tree = 0").first()
    assert not asked and root["feature"] == "v" and 59 <= root["threshold"] <= 61
    assert abs(root["weight"] - 0.5 * math.log(0.9 / 0.1)) < 1e-9
